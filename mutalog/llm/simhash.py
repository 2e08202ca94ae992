"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Fingerprints are computed where the texts are read. Distinct fingerprints are
then placed in vantage-point trees of several levels: each node has a vantage
fingerprint (a hash of the node's path, so nothing is sampled or sent around)
and one branch for each Hamming distance to it. A fingerprint lives in one leaf
of a tree; by the triangle inequality what it can be linked to is in branches
whose distance is near its own, and it visits the leaves of those. Each leaf
compares what lives there with what visits, exactly, and returns a spanning
forest of the links, not the pairs. Connected components follow by alternating
star joins.

Around a vantage most fingerprints have nearly the same distance, so over all 64
bits the bounds would prune by a constant factor and not more. A small radius r
therefore gets a forest: the bits are dealt into blocks, each level measures
distance in one block, and a tree leaves out r - 1 of the blocks. Whatever r
bits differ, some tree has one of them at most in all that it measures (the
trees are chosen so): there a pair parts at the levels of one block, into
neighbouring branches, and nowhere else. The number of blocks and of vantages
per block follows from the number of fingerprints. Leaves compare whole
fingerprints.

near_dedup() uses longer fingerprints with a wide radius, for which the bounds of
no tree prune. Its forest is of the same trees, each over a few bits of one word:
an alike pair differs by one bit at most in what a tree measures with known odds,
and there are so many trees that few pairs part in all of them (wide_forest()).
Those few come from the rare shingles that lead each text, an exact way for what
the trees have left apart.

Defined results: a null text is an empty one, fingerprint zero; rows without an
id take part, and a component without any id has none; repeated rows share all;
near_groups() returns no other column of the caller, near_dedup() returns all;
an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import random
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mutalog.llm.bpe import SLICE, _powers
from mutalog.llm.shared import give_back, in_batches, text_of, unused, written

#: What lives in a leaf and what visits it are dealt out in blocks of at most about so many fingerprints; each block meets each.
HOMES, VISITORS = 24_576, 131_072
#: Least width of a node's bands of distance in the one tree of a wide radius; else half the radius.
BAND = 2
#: Widest radius that gets a forest; most trees of one.
NARROW, TREES = 6, 128
#: Share of alike pairs that all trees of a wide forest together may leave apart.
MISS = 0.01
#: Comparisons within a wide radius that moving a fingerprint into another leaf counts as: few, so that leaves stay small and are not cut into blocks.
MOVED = 400
#: Leaves that are less than a unit are dealt out together, about so many fingerprints to a task's group.
GROUP = 50_000
#: Leaves of at most so many rows are compared all at once.
FEW = 48
#: Pairs that a task holds at once before it unites them.
PAIRS = 1 << 18
#: Shingles whose bits are counted at once.
SHINGLES = 1 << 16
_MIX = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _hashes(text: str, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, in order, in arrays of at most SHINGLES; none for a text without words."""
    words = text.encode("utf-8").lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    stops, digest = ends[k - 1 :].tolist(), xxhash.xxh64_intdigest
    for at in range(0, len(starts), SHINGLES):
        yield np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + SHINGLES], stops[at : at + SHINGLES])], np.uint64)


def fingerprint(text: str, shingle: int, words64: int) -> bytes:
    """Big-endian fingerprint of 64 * words64 bits: bit b is set if it is set in over half the hashes.

    Later words take further hashes that are mixed from the first one.
    """
    return _bits(_hashes(text, shingle), words64)


def _bits(hashes: Iterable[np.ndarray], words64: int) -> bytes:
    ones, n = np.zeros((words64, 64), np.int64), 0
    for h in hashes:
        n += len(h)
        for w in range(words64):
            x = h
            if w:
                x = (h ^ (h >> np.uint64(31))) * _MIX[w]
                x ^= x >> np.uint64(29)
                x *= np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(32)
            bits = np.unpackbits(x.astype(">u8").view(np.uint8)).reshape(-1, 64)
            k = len(bits) // 255 * 255  # so many rows can be summed in bytes
            ones[w] += bits[:k].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
            ones[w] += bits[k:].sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > n, axis=1).tobytes()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words64: int = 1) -> DataFrame:
    """id and fp (binary) of each row."""
    schema = T.StructType([df.schema[id_col], T.StructField("fp", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array([fingerprint(t.as_py() or "", shingle, words64) for t in b.column(text_col)], pa.binary())], schema.names)

    return in_batches(df.select(id_col, text_col), run, schema)


def _as_long(fp: Column, word: int = 0) -> Column:
    """The first 64 bits, or those of a later word, as a long."""
    half = lambda a: F.conv(F.substring(F.hex(fp), 16 * word + a, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


@functools.lru_cache(64)
def _kept_blocks(radius: int, blocks: int) -> list[tuple[int, ...]]:
    """The blocks of bits that each tree of a forest measures.

    A tree leaves out radius - 1 blocks. However radius differing bits fall into
    blocks, some tree has one of them at most in what it measures; trees are
    taken greedily until that holds.
    """
    out = max(radius - 1, 0)
    chosen = list(itertools.combinations(range(blocks), out))
    spread = list(itertools.combinations_with_replacement(range(blocks), radius))
    covers = [{i for i, e in enumerate(spread) if sum(x not in c for x in e) <= 1} for c in chosen]
    left, trees = set(range(len(spread))), []
    while left:
        best = max(range(len(chosen)), key=lambda k: len(covers[k] & left))
        left -= covers[best]
        trees.append(tuple(x for x in range(blocks) if x not in chosen[best]))
    return trees


def _shape(radius: int, n: int) -> tuple[int, int]:
    """Blocks of bits and vantages per block that cost least for n fingerprints: moving one into another leaf costs about 4,000 comparisons."""

    def cost(shape: tuple[int, int]) -> float:
        m, v = shape
        width, trees = 64 / m, _kept_blocks(radius, m)
        kept = len(trees[0])
        alike = max(2.0**-width, (math.pi * width) ** (-v / 2)) ** kept  # two fingerprints that have nothing to do with each other, in one leaf
        return len(trees) * (1 + kept * 2 ** (v - 1)) * (4_000 + n * alike)

    return min(((m, v) for m in range(max(radius, 1), radius + 5) for v in range(1, 5) if len(_kept_blocks(radius, m)) <= TREES), key=cost)


def _levels(kept: tuple[int, ...], blocks: int, vantages: int) -> list[tuple[int, int, bool, bool]]:
    """The levels of a tree from the root: the bits measured (a signed long), how many, and whether the level is the first or the last on its block."""
    out = []
    for k in kept:
        low, high = 64 * k // blocks, 64 * (k + 1) // blocks
        bits = (1 << high) - (1 << low)
        out += [(_signed(bits), high - low, v == 0, v == vantages - 1) for v in range(vantages)]
    return out


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _wide_shape(apart: float, n: int) -> tuple[int, int, int, int]:
    """Blocks of bits, bits of a block, vantages per block and trees that cost least for n fingerprints (see _shape()).

    apart: odds that a bit differs in a pair that must meet: in one tree, if one bit at most differs in all that it measures.
    """

    def trees(bits: int) -> int:
        meet = (1 - apart) ** bits + bits * apart * (1 - apart) ** (bits - 1)
        return max(1, math.ceil(math.log(MISS) / math.log1p(-meet))) if meet < 1 else 1

    def chance(width: int, v: int, odd: int) -> float:
        """That two random blocks have the distances to all vantages that put one in the branch of the other (odd: in a certain neighbouring one)."""
        return sum(math.comb(width, j) / 2**width * (math.comb(j, (j + odd) // 2) / 2**j) ** v for j in range(odd, width + 1, 2))

    def cost(shape: tuple[int, int, int, int]) -> float:
        m, width, v, many = shape
        here, beside, visits = chance(width, v, 0), chance(width, v, 1), m * 2 ** (v - 1)
        return many * ((1 + visits) * MOVED + n * here ** (m - 1) * (here + visits * beside))

    shapes = [(m, width, v, trees(m * width)) for m in range(1, 8) for width in range(3, 9) for v in range(1, 5)]
    return min((x for x in shapes if x[3] <= TREES), key=cost)


def _wide_trees(words64: int, blocks: int, width: int, vantages: int, many: int) -> list[tuple[int, list[tuple[int, int, bool, bool]]]]:
    """The word that each tree measures and its levels: bits are dealt out at random, and none twice before all bits of a word have been."""
    out, room = [], 64 // (blocks * width)
    for t in range(many):
        word, turn = t % words64, t // words64
        order = random.Random(f"{word} {turn // room}").sample(range(64), 64)[turn % room * blocks * width :]
        bits = [sum(1 << b for b in order[k * width : (k + 1) * width]) for k in range(blocks)]
        out.append((word, [(_signed(x), width, v == 0, v == vantages - 1) for x in bits for v in range(vantages)]))
    return out


def wide_forest(points: DataFrame, n: int, words64: int, least: float) -> tuple[DataFrame, int]:
    """points (n different fp) as (leaf, fp, home), and about how many rows: trees in which all but MISS of the pairs meet that are alike in least of their elements."""
    blocks, width, vantages, many = _wide_shape(math.acos(min(1.0, 2 * least / (1 + least))) / math.pi, n)
    trees = _wide_trees(words64, blocks, width, vantages, many)
    words = points.select("fp", F.array(*(_as_long(F.col("fp"), w) for w in range(words64))).alias("w"))
    return _grown(words, [levels for _, levels in trees], [word for word, _ in trees]), n * many * (1 + blocks * 2 ** (vantages - 1))


def _forest(points: DataFrame, radius: int, n: int) -> DataFrame:
    """points (fp, w) as (leaf, fp, home): the leaf of each tree where it lives, and those that it visits.

    Each level has a vantage for every node, which is a hash of the node's path.
    A pair that a tree must find differs by one bit at most in all that the tree
    measures. So at all levels of one block the distances to the vantages may
    differ by one, up or down (the triangle bound is met exactly, as a changed
    bit changes every distance), and at all others they are equal: every other
    branch is pruned. Where two fingerprints part first, the nearer one visits
    the other's branch, so a pair meets in one leaf of a tree.
    """
    blocks, vantages = _shape(radius, n)
    return _grown(points, [_levels(kept, blocks, vantages) for kept in _kept_blocks(radius, blocks)])


def _grown(points: DataFrame, trees: list[list[tuple[int, int, bool, bool]]], words: list[int] | None = None) -> DataFrame:
    """points (fp, w) in the leaves of trees, given by their levels; words: the element of w that each tree measures, if w is an array."""
    # off: 0 at home, 1 in a neighbouring branch and still on that block, 2 further down
    rows = points.select("fp", "w", F.explode(F.sequence(F.lit(1), F.lit(len(trees)))).alias("tree")).select("*", F.xxhash64("tree").alias("leaf"), F.lit(0).alias("off"))
    if words:
        rows = rows.withColumn("w", F.element_at("w", F.element_at(F.array(*(F.lit(w + 1) for w in words)), F.col("tree"))))
    for level in range(len(trees[0])):
        _, _, first, last = trees[0][level]
        bits, width = (F.element_at(F.array(*(F.lit(t[level][k]).cast("long") for t in trees)), F.col("tree")) for k in (0, 1))
        d = F.bit_count(F.col("w").bitwiseXOR(F.xxhash64(F.lit(f"vantage {level}"), "leaf")).bitwiseAND(bits))
        branch = lambda by, off: F.struct((F.col("d") + by).alias("band"), F.lit(off).alias("off"))
        here, next_ = F.struct(F.col("d").alias("band"), F.col("off").alias("off")), 2 if last else 1
        if first:
            to = F.when(F.col("off") == 0, F.array(here, branch(1, next_))).otherwise(F.array(here))
        else:
            to = F.when(F.col("off") == 1, F.array(branch(1, next_), branch(-1, next_))).otherwise(F.array(here))
        rows = rows.withColumn("d", d).withColumn("to", F.explode(to)).where(F.col("to.band").between(F.lit(0), width))
        rows = rows.select("fp", "w", "tree", F.xxhash64("leaf", F.col("to.band")).alias("leaf"), F.col("to.off").alias("off"))
    return rows.select("leaf", "fp", (F.col("off") == 0).alias("home"))


def _tree(points: DataFrame, radius: int) -> DataFrame:
    """points (fp, w) as (leaf, fp, home) for a radius beyond NARROW: one level of bands, which prunes little.

    Where two fingerprints part, the one in the lower band visits the other's
    leaf, so a pair meets in one leaf only.
    """
    width = max(BAND, radius // 2)
    d = F.bit_count(F.col("w").bitwiseXOR(F.xxhash64(F.lit("vantage 0"), F.lit(""))))
    band = lambda x: F.floor(x / width).cast("long")
    rows = points.withColumn("d", d).withColumn("own", band(F.col("d")))
    rows = rows.withColumn("leaf", F.explode(F.sequence("own", F.least(band(F.col("d") + radius), F.lit(64 // width).cast("long")))))
    return rows.select("leaf", "fp", (F.col("leaf") == F.col("own")).alias("home"))


def _close(a: np.ndarray, b: np.ndarray, radius: int, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of a and b at most radius bits apart, their first words at most first bits apart: those of 4,096 rows of b at a time."""
    width = max(1, min(4096, len(b)))
    differ, bits, near = (np.empty((len(a), width), t) for t in (np.uint64, np.uint8, bool))
    x0, b0 = np.ascontiguousarray(a[:, 0])[:, None], np.ascontiguousarray(b[:, 0])
    for j in range(0, len(b), width):
        y = b0[None, j : j + width]
        n = y.shape[1]
        np.bitwise_xor(x0, y, out=differ[:, :n])
        np.bitwise_count(differ[:, :n], out=bits[:, :n])
        np.less_equal(bits[:, :n], first, out=near[:, :n])
        at = np.flatnonzero(near[:, :n])
        for k in range(0, len(at), 65536):
            x, y = at[k : k + 65536] // n, at[k : k + 65536] % n + j
            if a.shape[1] > 1:
                keep = np.bitwise_count(a[x] ^ b[y]).sum(1, dtype=np.int64) <= radius
                x, y = x[keep], y[keep]
            yield x, y


class _Forest:
    """Components over 0 .. n - 1, each labelled with its least member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def unite(self, x: np.ndarray, y: np.ndarray) -> None:
        a, b = self.label[x], self.label[y]
        new = a != b
        if not new.any():
            return
        n = len(self.label)
        pairs = np.unique(np.minimum(a, b)[new] * n + np.maximum(a, b)[new])
        top: dict[int, int] = {}

        def root(i: int) -> int:
            while (up := top.get(i, i)) != i:
                top[i] = top.get(up, up)
                i = up
            return i

        for i, j in zip((pairs // n).tolist(), (pairs % n).tolist()):
            i, j = root(i), root(j)
            if i != j:
                top[max(i, j)] = min(i, j)
        to = np.arange(n)
        for i in list(top):
            to[i] = root(i)
        self.label = to[self.label]


def _compare(pdf: pd.DataFrame, radius: int, first: int) -> pd.DataFrame:
    """Units of leaves: the homes of each (side 0) with what may be linked to them, as star links.

    A unit of a large leaf has a block of all its rows at side 1; of a small leaf
    side 1 has the visitors alone, and homes meet each other as well.
    """
    fps = list(dict.fromkeys(pdf["fp"]))
    at = {f: i for i, f in enumerate(fps)}
    words = np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(len(fps), -1)
    node = np.fromiter(map(at.__getitem__, pdf["fp"]), np.int64, len(pdf))
    leaf, side, whole = pdf["leaf"].to_numpy(), pdf["side"].to_numpy(), pdf["h"].iloc[0] < 0
    order = np.lexsort((side, leaf))
    node, leaf, side = node[order], leaf[order], side[order]
    head = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1])))
    size = np.diff(np.append(head, len(leaf)))
    forest, left, right, held = _Forest(len(fps)), [], [], 0

    def keep(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal left, right, held
        new = forest.label[x] != forest.label[y]  # a group of copies is one component long before its last pair
        x, y = x[new], y[new]
        left.append(x)
        right.append(y)
        held += len(x)
        if held > PAIRS:
            forest.unite(np.concatenate(left), np.concatenate(right))
            left, right, held = [], [], 0

    if whole:  # leaves of a few rows, all at once: each row with the k-th one behind it
        few = np.repeat(size <= FEW, size)
        n, l, s = node[few], leaf[few], side[few]
        for k in range(1, int(size[size <= FEW].max(initial=1))):
            i = np.flatnonzero((l[:-k] == l[k:]) & (s[:-k] == 0))
            if len(i):
                pair = np.unique(np.minimum(n[i], n[i + k]) * len(fps) + np.maximum(n[i], n[i + k]))
                x, y = pair // len(fps), pair % len(fps)
                near = np.bitwise_count(words[x, 0] ^ words[y, 0]) <= first
                x, y = x[near], y[near]
                if words.shape[1] > 1:
                    near = np.bitwise_count(words[x] ^ words[y]).sum(1, dtype=np.int64) <= radius
                    x, y = x[near], y[near]
                keep(x, y)
    for a, n in zip(head.tolist(), size.tolist()):
        if whole and n <= FEW:
            continue
        split = a + int(np.searchsorted(side[a : a + n], 1))
        homes, others = node[a:split], node[a : a + n] if whole else node[split : a + n]
        there = words[others]
        for i in range(0, len(homes), 128):
            for x, y in _close(words[homes[i : i + 128]], there, radius, first):
                keep(homes[i + x], others[y])
    if held:
        forest.unite(np.concatenate(left), np.concatenate(right))
    linked = np.flatnonzero(forest.label != np.arange(len(fps))).tolist()
    give_back()
    return pd.DataFrame({"a": [fps[i] for i in linked], "b": [fps[i] for i in forest.label[linked].tolist()]})


def links(points: DataFrame, radius: int, first: int | None = None, leaves: DataFrame | None = None, many: int | None = None) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fp at most radius bits apart.

    points: distinct fp. first: bits that the first 64 may differ, if the
    fingerprints are longer; the trees look at these alone. leaves (leaf, fp,
    home): what to compare instead of the leaves of these trees; many: about how
    many rows, else they are counted.
    """
    first = radius if first is None else first
    if leaves is None:
        points = points.withColumn("w", _as_long(F.col("fp")))
        n = points.count()
        if first <= NARROW:
            blocks, vantages = _shape(first, n)
            trees = _kept_blocks(first, blocks)
            many, rows = n * len(trees) * (1 + len(trees[0]) * 2 ** (vantages - 1)), _forest(points, first, n)
        else:
            many, rows = 2 * n, _tree(points, first)
    else:
        many, rows = leaves.count() if many is None else many, leaves
    sizes = rows.groupBy("leaf").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("all"))
    sizes = written(sizes.where((F.col("homes") > HOMES) | (F.col("all") > VISITORS)))
    # the leaves that are a block at most share units
    units = max(1, math.ceil(many / GROUP))
    apiece = [F.lit(-1).cast("long").alias(c) for c in ("h", "v")]
    small = rows.join(sizes.select("leaf"), "leaf", "left_anti").select(F.pmod("leaf", F.lit(units)).alias("unit"), *apiece, "leaf", "fp", F.when(F.col("home"), 0).otherwise(1).alias("side"))
    sizes = sizes.where("homes > 0").select("leaf", F.ceil(F.col("homes") / HOMES).alias("hs"), F.ceil(F.col("all") / VISITORS).alias("vs"))
    large = rows.join(sizes, "leaf")
    mine = lambda c: F.pmod(F.xxhash64("fp"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    homes = large.where("home").select(F.col("leaf").alias("unit"), mine("hs").alias("h"), every("vs").alias("v"), "leaf", "fp", F.lit(0).alias("side"))
    others = large.select(F.col("leaf").alias("unit"), every("hs").alias("h"), mine("vs").alias("v"), "leaf", "fp", F.lit(1).alias("side"))
    made = small.unionByName(homes).unionByName(others)
    return made.groupBy("unit", "h", "v").applyInPandas(lambda pdf: _compare(pdf, radius, first), "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the least node of its component.

    Alternating stars: each node hangs its larger neighbours, then its smaller
    ones, below the least node it knows, until nothing changes. Every step is a
    grouped minimum and a join, so a node with very many links is summed before
    the shuffle and its join can be split.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u != v").distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = written(both.groupBy("v").agg(F.min(F.least("u", "v")).alias("m")))  # written: see near_groups()
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u != v").distinct()
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(small, "v")
        edges = written(joined.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(small.select("v", F.col("m").alias("u"))).where("u != v").distinct())
    labelled = edges.groupBy("v").agg(F.min("u").alias("label")).withColumnRenamed("v", "node")
    return labelled.unionByName(labelled.select(F.col("label").alias("node"), "label").distinct())


def near_groups(df: DataFrame, radius: int = 4, shingle: int = 4, words64: int = 1, first: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, fingerprint (hex), component_id: the least id that links lead to."""
    prints = written(fingerprints(df, id_col, text_col, shingle, words64))
    named = _components_of(prints, id_col, lambda points: links(points, radius, first))
    return prints.join(named, "fp").select(id_col, F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def _components_of(prints: DataFrame, id_col: str, linked) -> DataFrame:
    """fp, component_id (the least id that links lead to) of each different fp; linked: gives the links of a table of fp."""
    points = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    labels = components(linked(points.select("fp")))
    classes = points.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    # written, so that the join below has an exchange on either side and a hot label can be split
    tops = written(classes.groupBy("label").agg(F.min("least").alias("component_id")))
    return written(classes.join(tops, "label").select("fp", "component_id"))


#: Words of a shingle, 64-bit words of a fingerprint, bits that may differ over all and in the first word, for texts alike in 0.8 of their shingles.
#: Two such texts differ in each bit with odds of acos(0.8 / 0.9) / pi = 0.15, that is in 38.8 of 256 bits (deviation 6) and 9.7 of 64
#: (deviation 3): the radii are almost five deviations wider, and what they let in too much is told apart by the shingles themselves.
PIPELINE = {"shingle": 5, "words64": 4, "radius": 68, "first": 26}
#: Least similarity of near-duplicates: shingles in both texts over shingles in either.
ALIKE = 0.8
#: Texts of at most so many different shingles are compared also wherever they share a rare one: their bits vary too much.
SHORT = 40
#: Counters of shingles, which share them by their low bits, and how many one row holds.
COUNTERS, SLICE_OF = 1 << 19, 1 << 11
#: A group of candidates above ROWS or BLOCK_BYTES of text is compared block by block: up to BLOCKS of them, then more of at most BLOCK_ROWS. Smaller groups share units of about ROWS.
ROWS, BLOCKS, BLOCK_ROWS, BLOCK_BYTES = 256, 8, 2048, 4 << 20
#: Columns of the matrix of rows and shingles that are multiplied at once.
COLUMNS = 4096


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of a shares with each set of b; sets are arrays without repeats."""
    same = a is b
    sets = a if same else a + b
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    found, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1  # what one set alone has is not multiplied
    keep = times[column] > 1
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, (at, at + COLUMNS))
        ones = np.zeros((len(sets), COLUMNS), np.float32)
        ones[row[i:j], column[i:j] - at] = 1
        out += ones[: len(a)] @ (ones if same else ones[len(a) :]).T
    return out


def _alike(pdf: pd.DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> pd.DataFrame:
    """Star links (a, b) whose components are those of all pairs of a group's home rows (side 0) with its others (side 1; none: the homes) that are alike."""
    ids = list(dict.fromkeys(pdf[id_col]))
    at = {d: i for i, d in enumerate(ids)}
    forest = _Forest(len(ids))
    for _, rows in pdf.groupby("group", sort=False):
        node = np.fromiter(map(at.__getitem__, rows[id_col]), np.int64, len(rows))
        sets = [_distinct(shingles(t or "", shingle)) for t in rows[text_col]]
        side = rows["side"].to_numpy()
        home, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(other):
            other = home
        a = [sets[i] for i in home]
        b = a if other is home else [sets[i] for i in other]
        size = np.array([len(x) for x in sets])
        both = _shared(a, b)
        for i in range(0, len(home), 64):
            whole = size[home[i : i + 64]][:, None] + size[other][None, :]
            x, y = np.nonzero(both[i : i + 64].astype(np.float64) * (1 + least) + 1e-9 >= least * whole)  # both / (whole - both) >= least; two empty texts are alike
            forest.unite(node[home[i + x]], node[other[y]])
    linked = np.flatnonzero(forest.label != np.arange(len(ids))).tolist()
    give_back()
    return pd.DataFrame({"a": [ids[i] for i in linked], "b": [ids[i] for i in forest.label[linked].tolist()]})


def alike(df: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = ALIKE) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of rows in a group whose texts are alike in at least so many of their shingles.

    groups: id, component_id, n_bytes. Every pair within a group is compared,
    by products of matrices of rows and shingles. A large group is cut into
    blocks by a hash, and each pair of blocks is a unit of its own.
    """
    groups = written(groups.where(F.col(id_col).isNotNull()).groupBy(id_col, F.col("component_id").alias("group")).agg(F.max("n_bytes").alias("n_bytes")))
    n, n_bytes = F.count("*"), F.sum("n_bytes")
    blocks = F.greatest(F.least(F.ceil(n / ROWS), F.lit(BLOCKS)), F.ceil(n / BLOCK_ROWS), F.ceil(n_bytes / BLOCK_BYTES))
    sizes = written(groups.groupBy("group").agg(n.alias("n"), n_bytes.alias("n_bytes"), blocks.cast("long").alias("blocks")).where("n > 1"))
    small = sizes.where("blocks = 1").agg(F.sum("n"), n_bytes).first()
    tasks = max(1, math.ceil((small[0] or 0) / ROWS), math.ceil((small[1] or 0) / BLOCK_BYTES))
    members = groups.join(sizes.select("group", "blocks"), "group").select(F.col(id_col).alias("__id"), "group", "blocks")
    rows = df.select(id_col, text_col).join(members, F.col(id_col) == F.col("__id")).drop("__id")
    mine = F.pmod(F.xxhash64(id_col), "blocks")
    j = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("mine", mine).withColumn("j", j).withColumn("h", F.least("mine", "j")).withColumn("v", F.greatest("mine", "j"))
    unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(tasks))).otherwise(F.xxhash64("group"))
    split = (F.col("blocks") > 1).cast("int")
    units = rows.select(unit.alias("unit"), split.alias("split"), "h", "v", "group", id_col, text_col, ((F.col("mine") == F.col("v")) & (F.col("h") < F.col("v"))).cast("int").alias("side"))
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return units.groupBy("unit", "split", "h", "v").applyInPandas(lambda pdf: _alike(pdf, id_col, text_col, shingle, least), schema)


def shingles(text: str, k: int) -> np.ndarray:
    """A 64-bit hash of each k-word shingle in order: a polynomial over its bytes, mixed; all in one pass over the text."""
    words = text.encode("utf-8").lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    ends = np.flatnonzero(raw == 32)
    k = min(k, len(ends))
    stops = ends[k - 1 :]
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(stops)]
    out, i = np.empty(len(stops), np.uint64), 0
    while i < len(stops):  # slices of bounded bytes
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + SLICE, "right")))
        part = raw[starts[i] : stops[j - 1]]
        up, down = _powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * down[: len(part)], dtype=np.uint64, out=total[1:])
        a, z = starts[i:j] - starts[i], stops[i:j] - starts[i]
        out[i:j] = (total[z] - total[a]) * up[a]
        i = j
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """The different ones, ascending."""
    hashes = np.sort(hashes)
    return hashes[np.append(True, hashes[1:] != hashes[:-1])] if len(hashes) else hashes


def _times(df: DataFrame, text_col: str, shingle: int) -> np.ndarray:
    """How often the shingles of each counter occur in all texts.

    Each task sends its counters in slices, which are summed in two rounds, so
    no task meets more than a bounded share of them. Their number is fixed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for b in batches:
            found = [shingles(t.as_py() or "", shingle) for t in b.column(text_col)]
            if found:
                n += np.bincount((np.concatenate(found) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(COUNTERS // SLICE_OF), pa.int32()), pa.array([x.tobytes() for x in n.reshape(-1, SLICE_OF)], pa.binary())], ["slice", "n"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(SLICE_OF, np.int64)
        for x in pdf["n"]:
            n += np.frombuffer(x, np.int64)
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "n": [n.tobytes()]})

    rows = in_batches(df.select(text_col), count, "slice int, n binary").withColumn("part", F.floor(F.spark_partition_id() / 1024))
    for by in (["slice", "part"], ["slice"]):
        rows = rows.groupBy(*by).applyInPandas(add, "slice int, n binary")
    out = np.zeros((COUNTERS // SLICE_OF, SLICE_OF), np.int64)
    for r in rows.collect():
        out[r.slice] = np.frombuffer(r.n, np.int64)
    out = out.ravel()
    return (out >> max(0, int(out.max()).bit_length() - 31)).astype(np.int32)


def near_prints(df: DataFrame, times: np.ndarray, least: float, id_col: str, text_col: str, shingle: int, words64: int) -> DataFrame:
    """id, fp (of the different shingles), n_bytes, same, few and lead of each row.

    fp: of an even number of shingles without the one of the least hash, so that no bit is even.
    same: a 128-bit digest of the set of shingles. few: all shingles of a text so short that it or one alike has at most SHORT,
    else null. lead: of a longer text's n shingles the first n - ceil(least * n) + 1
    in one order for all texts, by how often the shingle's counter was met: two
    texts alike in least share one of them, whatever the order, and the rare ones
    come first.
    """
    more = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("few", "lead")]
    schema = T.StructType([df.schema[id_col], T.StructField("fp", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("same", T.BinaryType()), *more])
    most = math.floor(SHORT / least + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, same, few, lead = [], [], [], []
            for t in b.column(text_col):
                once = _distinct(shingles(t.as_py() or "", shingle))
                n = len(once)
                odd = once[1:] if n % 2 == 0 else once
                fp.append(_bits((odd[at : at + SHINGLES] for at in range(0, len(odd), SHINGLES)), words64))
                same.append(hashlib.blake2b(once.tobytes(), digest_size=16).digest())
                few.append(once.view(np.int64) if n <= most else None)
                order = np.argsort(times[(once & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")
                lead.append(once[order[: n - math.ceil(least * n - 1e-9) + 1]].view(np.int64) if n > SHORT else None)
            arrays = [pa.array(x, pa.list_(pa.int64())) for x in (few, lead)]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(fp, pa.binary()), b.column("n_bytes"), pa.array(same, pa.binary()), *arrays], schema.names)

    return in_batches(df.select(id_col, text_col, F.octet_length(text_of(text_col)).cast("long").alias("n_bytes")), run, schema)


def lead_leaves(prints: DataFrame, labels: DataFrame) -> DataFrame:
    """(leaf, fp, home): a leaf for each shingle that leads texts of several components of fingerprints.

    labels: node, label of the fp that are linked already (see components()).
    """
    rows = prints.select(F.xxhash64("fp").alias("w"), F.explode("lead").alias("leaf"))
    shared = written(rows.groupBy("leaf").agg(F.min("w").alias("a"), F.max("w").alias("b")).where("a < b").select("leaf"))
    rows = rows.join(shared, "leaf", "left_semi").distinct()
    fps = prints.select("fp").distinct().join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    fps = fps.select(F.xxhash64("fp").alias("w"), "fp", F.xxhash64(F.coalesce("label", "fp")).alias("c"))
    rows = written(rows.join(written(fps), "w").select("leaf", "fp", "c"))
    parted = written(rows.groupBy("leaf").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < b").select("leaf"))
    return rows.join(parted, "leaf", "left_semi").select("leaf", "fp", F.lit(True).alias("home"))


def near_links(points: DataFrame, prints: DataFrame, least: float, radius: int, first: int, words64: int) -> DataFrame:
    """Links (a, b) of fp at most radius bits apart, of texts that may be alike in least of their shingles.

    They come from the leaves of the trees that points are placed in; of what
    these leave apart, from leading shingles that lead texts of several
    components so far.
    """
    leaves, many = wide_forest(points, points.count(), words64, least)
    found = written(links(points, radius, first, leaves, many))
    rest = written(lead_leaves(prints.where("lead is not null"), components(found)))
    return found.unionByName(links(points, radius, first, rest))


def short_groups(prints: DataFrame, least: float, id_col: str = "doc_id") -> DataFrame:
    """Groups (id, component_id, n_bytes), one for each shingle, in which every pair of short texts meets that is alike in so many of its shingles.

    prints: id, n_bytes, few (see near_prints()), not null. Of n shingles in one order for
    all texts, alike texts share one of the first n - ceil(least * n) + 1; the
    order has rare shingles first, so that common ones propose little.
    """
    texts = prints.select(id_col, "n_bytes", F.xxhash64("few").alias("t"), F.size("few").alias("n"), "few").dropDuplicates([id_col, "t"])
    rows = written(texts.select(id_col, "n_bytes", "t", "n", F.explode("few").alias("s")))
    common = written(rows.groupBy("s").agg(F.count("*").alias("times")).where("times > 1"))
    rank = F.row_number().over(Window.partitionBy(id_col, "t").orderBy(F.coalesce("times", F.lit(1)), "s"))
    first = rows.join(common, "s", "left").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    return first.where("times is not null").select(id_col, F.concat(F.lit("s"), F.col("s").cast("string")).alias("component_id"), "n_bytes")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = ALIKE, **options) -> DataFrame:
    """df with one row of each group of near-duplicates: the one with the least id. Rows without an id stay.

    Texts with one set of shingles are copies, linked to the least id of them,
    which alone goes on. Candidates have fingerprints within the radius that meet
    in a leaf of the trees, or, for pairs that all trees leave apart, in that of a
    leading shingle (no pair alike in least misses that). Short texts, of which
    fingerprints vary too much, are candidates also if they share a rare shingle.
    In each group of candidates the texts are compared. Links are
    transitive, by texts whose similarity is least or more; rows that repeat an
    id are one document. Texts without words are copies of each other.
    """
    options = PIPELINE | options
    shingle = options["shingle"]
    prints = written(near_prints(df, _times(df, text_col, shingle), least, id_col, text_col, shingle, options["words64"]))
    named_ = prints.where(F.col(id_col).isNotNull())
    tops = written(named_.groupBy("same").agg(F.min(id_col).alias("top")))
    copies = written(named_.select(id_col, "same").join(tops, "same").where(F.col(id_col) != F.col("top")).select(id_col, "same", "top").distinct())
    first_ones = lambda *c: named_.select(id_col, "same", *c).join(copies.select(id_col, "same"), [id_col, "same"], "left_anti")
    groups = _components_of(prints, id_col, lambda points: near_links(points, prints, least, options["radius"], options["first"], options["words64"]))
    proposed = first_ones("fp", "n_bytes").join(groups, "fp").select(id_col, F.concat(F.lit("f"), F.col("component_id").cast("string")).alias("component_id"), "n_bytes")
    proposed = proposed.unionByName(short_groups(first_ones("n_bytes", "few").where("few is not null"), least, id_col))
    edges = copies.select(F.col(id_col).alias("a"), F.col("top").alias("b")).unionByName(alike(df, proposed, id_col, text_col, shingle, least))
    nodes = components(edges)
    drop = unused(df, "__drop")
    gone = nodes.where("node != label").select(F.col("node").alias(drop))
    return df.join(gone, F.col(id_col) == F.col(drop), "left_anti")
