"""Removal of repeated byte strings by hash-compared suffix sorting.

A string of LENGTH bytes counts as repeated if it starts anywhere else too. Of
the grams (GRAM bytes) in a window of LENGTH bytes, the one with the least
rolling hash is the window's anchor; equal windows have equal anchors at equal
offsets. So:

1. every document lists its anchors, each with the run of window starts it
   stands for; grams that only one anchor in the corpus has end here;
2. the others fetch their context, the bytes of all their windows. Contexts of
   one gram meet in one task, equal ones collapsed. There the suffixes behind
   the anchors, and the reversed prefixes before them, are sorted by mergesort;
   a comparison finds the common extension by binary search on prefix polynomial
   hashes. Neighbours' common lengths are verified byte by byte, which proves
   the whole order; a hash collision makes the task sort by bytes instead;
3. two windows at offset o are equal if they are in one class of the sorted
   prefixes at depth o and in one class of the sorted suffixes at depth
   LENGTH - o, so a pass over the offsets marks every repeated window. A gram
   whose contexts are more than HOT bytes isn't sorted in one task: its windows
   are counted by their 128-bit digests, as contexts are told apart by theirs;
4. marked runs go back to their documents, whose covered bytes are removed.

Texts are moved twice, compressed; all else is narrow. Matches never cross
documents and are judged on the input.

Defined results: a null text is an empty text with nothing removed; rows that
repeat id and text are two places; rows without id take part; a text that
loses part of a character shows U+FFFD there in kept_text, its digest is of the
bytes; the result has none of the caller's other columns; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mutalog.llm.bpe import SLICE, _powers, rolling
from mutalog.llm.shared import in_batches, written

LENGTH, GRAM = 400, 64
#: Grams in a window.
SPAN = LENGTH - GRAM + 1
#: Bytes of contexts that are sorted together, and of one gram's contexts above which its windows are counted by a shuffle instead.
BATCH, HOT = 3 << 20, 1 << 20
#: Bytes on either side of a gram; a window has all of them on one side or on the other.
HALF = (LENGTH - GRAM) // 2
#: Windows of hot grams in an Arrow batch.
WINDOWS = 1 << 16
_LOW = np.uint64((1 << 24) - 1)


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that share an anchor: first start, number of starts, anchor position, gram hash."""
    raw = np.frombuffer(data, np.uint8)
    parts = []
    step = SLICE - LENGTH
    for at in range(0, max(0, len(raw) - LENGTH + 1), step):
        h = rolling(raw[at : at + step + LENGTH - 1], GRAM)
        starts = len(h) - SPAN + 1
        if starts <= 0:
            break
        # hash above, position below: the least of a window is its leftmost least hash
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(key) // SPAN) * SPAN, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(key)] = key
        blocks = padded.reshape(-1, SPAN)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        where = (np.minimum(behind[:starts], ahead[SPAN - 1 : SPAN - 1 + starts]) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        count = np.diff(np.append(first, starts))
        parts.append((first + at, count, where[first] + at, h[where[first]]))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


class Texts:
    """Contexts laid end to end, for comparing suffixes (or, reversed, prefixes) at their anchors."""

    def __init__(self, data: np.ndarray, at: np.ndarray, extent: np.ndarray):
        """at: where the suffix of each context starts; extent: its bytes."""
        self.data, self.at, self.extent = data, at, extent
        self._up, down = _powers() if len(data) < SLICE else _powers(1 << len(data).bit_length())
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], dtype=np.uint64, out=self._sum[1:])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bytes that suffixes i and j have in common, by binary search on the hashes of their prefixes."""
        a, b = self.at[i], self.at[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.extent[i], self.extent[j])
        up, s = self._up, self._sum
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            m = (low[open_] + high[open_] + 1) >> 1
            x, y = a[open_], b[open_]
            same = (s[x + m] - s[x]) * up[x] == (s[y + m] - s[y]) * up[y]
            low[open_[same]] = m[same]
            high[open_[~same]] = m[~same] - 1

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(i, j)
        ends_i, ends_j = n == self.extent[i], n == self.extent[j]
        x = self.data[np.where(ends_i, 0, self.at[i] + n)]
        y = self.data[np.where(ends_j, 0, self.at[j] + n)]
        return np.where(ends_i, ~ends_j | or_equal, np.where(ends_j, False, x < y))

    def order(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorts the suffixes of each group (groups are contiguous): the order, and what each has in common with the one before it (-1 for the first of a group)."""
        n = len(group)
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(head, n))
        start = np.repeat(head, size)
        end = start + np.repeat(size, size)
        order, place, width = np.arange(n), np.arange(n), 1
        while width < size.max(initial=0):
            run = (place - start) // width
            mate = start + (run ^ 1) * width
            have = np.flatnonzero(mate < end)
            low = mate[have].copy()
            high = np.minimum(low + width, end[have])
            right = run[have] % 2 == 1  # of equal ones the left run's come first
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                before = self.less(order[mid], order[have[open_]], right[open_])
                low[open_[before]] = mid[before] + 1
                high[open_[~before]] = mid[~before]
            new = place.copy()
            base = start[have] + (run[have] // 2) * 2 * width
            new[have] = base + (place[have] - start[have]) % width + (low - mate[have])
            merged = np.empty(n, np.int64)
            merged[new] = order
            order, width = merged, width * 2
        shared = np.full(n, -1, np.int64)
        inner = np.flatnonzero(place != start)
        shared[inner] = self.common(order[inner - 1], order[inner])
        if not self._verified(order, shared, inner):
            order, shared = self._by_bytes(head, size)
        return order, shared

    def _verified(self, order: np.ndarray, shared: np.ndarray, inner: np.ndarray) -> bool:
        text, at, extent = self.data.tobytes(), self.at.tolist(), self.extent.tolist()
        o, c = order.tolist(), shared.tolist()
        for p in inner.tolist():
            i, j, n = o[p - 1], o[p], c[p]
            a, b = at[i], at[j]
            if text[a : a + n] != text[b : b + n] or text[a + n : a + min(extent[i], n + 1)] > text[b + n : b + min(extent[j], n + 1)]:
                return False
            if n < extent[i] and n < extent[j] and text[a + n] == text[b + n]:
                return False
        return True

    def _by_bytes(self, head: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = self.data.tobytes()
        suffix = lambda i: text[self.at[i] : self.at[i] + self.extent[i]]
        order = np.concatenate([np.array(sorted(range(h, h + s), key=suffix), np.int64) for h, s in zip(head.tolist(), size.tolist())])
        shared = np.full(len(order), -1, np.int64)
        for h, s in zip(head.tolist(), size.tolist()):
            for p in range(h + 1, h + s):
                a, b = suffix(order[p - 1]), suffix(order[p])
                n = 0
                while n < min(len(a), len(b)) and a[n] == b[n]:
                    n += 1
                shared[p] = n
        return order, shared


def repeated(contexts: list[bytes], offset: np.ndarray, starts: np.ndarray, group: np.ndarray, many: np.ndarray) -> np.ndarray:
    """marks[c, s]: whether the window that starts s bytes into context c starts anywhere else too.

    offset: the anchor in the context; starts: windows it has; group: contexts of
    one gram are contiguous; many: whether the context itself occurs again.
    """
    n = len(contexts)
    marks = np.zeros((n, SPAN), bool)
    size = np.array([len(c) for c in contexts], np.int64)
    base = np.concatenate(([0], np.cumsum(size)[:-1]))
    data = np.frombuffer(b"".join(contexts), np.uint8)
    ahead, tail = Texts(data, base + offset, size - offset).order(group)
    behind, lead = Texts(data[::-1].copy(), len(data) - (base + offset), offset).order(group)
    most, least = offset, offset - starts + 1
    for o in range(int(least.min(initial=0)), int(most.max(initial=-1)) + 1):
        mine = (least <= o) & (o <= most)
        if not mine.any():
            continue
        right, left = np.empty(n, np.int64), np.empty(n, np.int64)
        right[ahead] = np.cumsum(tail < LENGTH - o)
        left[behind] = np.cumsum(lead < o)
        pick = np.flatnonzero(mine)
        _, at, times = np.unique(right[pick] * (n + 1) + left[pick], return_inverse=True, return_counts=True)
        again = (times[at] > 1) | many[pick]
        marks[pick[again], (offset - o)[pick[again]]] = True
    return marks


def _runs(row: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], row.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


_ID = "__id"


def _anchor_rows(texts: DataFrame) -> DataFrame:
    names = [_ID, "none", "th", "first", "starts", "anchor", "gram"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for i, t in enumerate(b.column("text")):
                x = anchors((t.as_py() or "").encode("utf-8"))
                if len(x[0]):
                    rows.append(np.full(len(x[0]), i, np.int64))
                    found.append(x)
            if rows:
                take = pa.array(np.concatenate(rows))
                first, starts, anchor, gram = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([b.column(_ID).take(take), b.column("none").take(take), b.column("th").take(take), pa.array(first), pa.array(starts.astype(np.int32)), pa.array(anchor), pa.array(gram.view(np.int64))], names)

    return in_batches(texts, run, T.StructType([texts.schema[_ID], texts.schema["none"], *(T.StructField(n, T.IntegerType() if n == "starts" else T.LongType()) for n in names[2:])]))


def _packed(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(_ID), b.column("none"), b.column("th"), pa.array([pack.compress((t.as_py() or "").encode("utf-8")) for t in b.column("text")], pa.binary())], [_ID, "none", "th", "packed"])

    return in_batches(texts, run, T.StructType([texts.schema[_ID], texts.schema["none"], texts.schema["th"], T.StructField("packed", T.BinaryType())]))


def _context_rows(docs: DataFrame) -> DataFrame:
    """A row for each anchor; its context comes along for the first two of a kind in a task, which is all that step 2 needs."""
    names = [_ID, "none", "th", "first", "starts", "offset", "gram", "kind", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, sent = zstandard.ZstdDecompressor(), {}
        for b in batches:
            out: list[list] = [[] for _ in names]
            for i in range(b.num_rows):
                data = unpack.decompress(b.column("packed")[i].as_py())
                for a in b.column("found")[i].as_py():
                    context = data[a["first"] : a["first"] + a["starts"] - 1 + LENGTH]
                    kind = hashlib.blake2b(context, digest_size=16, key=(a["anchor"] - a["first"]).to_bytes(2, "big")).digest()
                    n = sent.get(kind, 0)
                    if len(sent) > 500_000:
                        sent.clear()
                    sent[kind] = n + 1
                    for column, value in zip(out, (i, i, i, a["first"], a["starts"], a["anchor"] - a["first"], a["gram"], kind, context if n < 2 else None)):
                        column.append(value)
            if out[0]:
                take = pa.array(out[0], pa.int64())
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in names[:3]), *(pa.array(c, k) for c, k in zip(out[3:], kinds))], names)

    schema = T.StructType([docs.schema[_ID], docs.schema["none"], docs.schema["th"], T.StructField("first", T.LongType()), T.StructField("starts", T.IntegerType()), T.StructField("offset", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("kind", T.BinaryType()), T.StructField("context", T.BinaryType())])
    return in_batches(docs, run, schema)


def _resolved(rows: DataFrame) -> DataFrame:
    """rows sorted by gram in their partition, as (kind, runs of repeated window starts)."""

    def solve(held: list[tuple]) -> pa.RecordBatch | None:
        gram = np.array([h[0] for h in held], np.int64)
        marks = repeated([h[2] for h in held], np.array([h[3] for h in held], np.int64), np.array([h[4] for h in held], np.int64), gram, np.array([h[5] for h in held], bool))
        kinds, runs = [], []
        for h, row in zip(held, marks):
            if row.any():
                kinds.append(h[1])
                runs.append([{"a": a, "b": b} for a, b in _runs(row)])
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.binary()), pa.array(runs, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["kind", "runs"]) if kinds else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        gram, kinds = None, {}

        def close() -> None:
            nonlocal size
            if len(kinds) > 1 or any(v[3] for v in kinds.values()):
                for k, v in kinds.items():
                    held.append((gram, k, *v))
                    size += len(v[0])
            kinds.clear()

        for b in batches:
            for g, kind, context, offset, starts in zip(*(b.column(c).to_pylist() for c in ("gram", "kind", "context", "offset", "starts"))):
                if g != gram:
                    close()
                    gram = g
                    if size > BATCH:
                        if made := solve(held):
                            yield made
                        held, size = [], 0
                old = kinds.get(kind)
                kinds[kind] = (context, offset, starts, old is not None)
        close()
        if held and (made := solve(held)):
            yield made

    return in_batches(rows, run, "kind binary, runs array<struct<a:int,b:int>>")


def _windows(kinds: DataFrame) -> DataFrame:
    """kinds (kind, context, offset, starts, right, left) as (window, kind, start): the digest of each window on a marked side of its gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.binary(), pa.int32()))], ["window", "kind", "start"])

        for b in batches:
            for kind, context, offset, starts, right, left in zip(*(b.column(c).to_pylist() for c in ("kind", "context", "offset", "starts", "right", "left"))):
                for s in range(starts):
                    if right if offset - s <= HALF else left:
                        for column, value in zip(out, (hashlib.blake2b(context[s : s + LENGTH], digest_size=16).digest(), kind, s)):
                            column.append(value)
                if len(out[0]) >= WINDOWS:
                    yield made()
                    out = [[], [], []]
        if out[0]:
            yield made()

    return in_batches(kinds, run, "window binary, kind binary, start int")


def _as_runs(rows: DataFrame) -> DataFrame:
    """(kind, starts) as (kind, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = []
            for at in b.column("starts").to_pylist():
                row = np.zeros(SPAN, bool)
                row[at] = True
                runs.append([{"a": a, "b": z} for a, z in _runs(row)])
            yield pa.RecordBatch.from_arrays([b.column("kind"), pa.array(runs, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["kind", "runs"])

    return in_batches(rows, run, "kind binary, runs array<struct<a:int,b:int>>")


def _counted(rows: DataFrame) -> DataFrame:
    """_resolved() for grams with very many contexts, which are dealt out by their windows and not by their gram.

    A window has HALF bytes before its gram or HALF bytes behind it, so only
    contexts that have these in common with another one list their windows.
    """
    kinds = rows.groupBy("kind").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("gram", "context", "offset", "starts")))
    near = F.col("offset") - F.col("starts") + 1  # offsets of the gram in the context's windows: from near to offset
    part = lambda at: F.substr("context", at.cast("int"), F.lit(GRAM + HALF))
    right = F.when(near <= HALF, F.xxhash64(F.lit(0), "gram", part(F.col("offset") + 1)))
    left = F.when(F.col("offset") > HALF, F.xxhash64(F.lit(1), "gram", part(F.col("offset") - HALF + 1)))
    kinds = written(kinds.withColumns({"r": right, "l": left}))
    sides = written(kinds.select(F.explode(F.array("r", "l")).alias("side")).where("side is not null").groupBy("side").agg(F.count("*").alias("times")).where("times > 1").select("side"))
    marked = kinds.join(sides.select(F.col("side").alias("r"), F.lit(True).alias("right")), "r", "left").join(sides.select(F.col("side").alias("l"), F.lit(True).alias("left")), "l", "left")
    marked = written(marked.where("right or left").select("kind", "context", "offset", "starts", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("right", "left"))))
    again = written(_windows(marked).groupBy("window").agg(F.count("*").alias("times")).where("times > 1").select("window"))
    found = _windows(marked.where("n = 1")).join(again, "window", "left_semi").groupBy("kind").agg(F.collect_set("start").alias("starts"))
    whole = kinds.where("n > 1").select("kind", F.array(F.struct(F.lit(0).alias("a"), F.col("starts").alias("b"))).alias("runs"))
    return _as_runs(found).unionByName(whole)


def _cut_rows(docs: DataFrame, keep_text: bool) -> DataFrame:
    more = [T.StructField("kept_text", T.StringType())] if keep_text else []

    names = [_ID, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if keep_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for b in batches:
            start, held, out = 0, 0, [[] for _ in names[1:]]
            for i in range(b.num_rows):
                data = unpack.decompress(b.column("packed")[i].as_py())
                spans: list[list[int]] = []
                for s in sorted((s["a"], s["b"]) for s in b.column("spans")[i].as_py() or []):
                    if spans and s[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], s[1])
                    else:
                        spans.append(list(s))
                at, kept = 0, []
                for a, z in spans:
                    kept.append(data[at:a])
                    at = z
                rest = b"".join([*kept, data[at:]])
                for column, value in zip(out, (len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", errors="replace") if keep_text else None)):
                    column.append(value)
                held += len(rest)
                if keep_text and held > BATCH or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(_ID).slice(start, i + 1 - start), *(pa.array(c, k) for c, k in zip(out, kinds))], names)
                    start, held, out = i + 1, 0, [[] for _ in names[1:]]

    return in_batches(docs, run, T.StructType([docs.schema[_ID], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), *more]))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per row of df: id, n_bytes, n_removed, n_spans, kept_sha256, and kept_text if asked for."""
    texts = df.select(F.col(id_col).alias(_ID), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    # rows without id are told apart by a longer digest of their texts
    texts = texts.withColumn("none", F.when(F.col(_ID).isNull(), F.unhex(F.md5(F.col("text").cast("binary")))))
    me = [F.coalesce(_ID, F.lit(0)).alias("k"), F.coalesce("none", F.lit(b"")).alias("none"), "th"]
    key = ["k", "none", "th"]
    found = written(_anchor_rows(texts))
    # written, so that the join has an exchange on either side and a gram with many anchors can be split
    grams = written(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    open_ = found.join(grams, "gram", "left_semi")
    # a row that is there twice lists its anchors twice: once is enough here, both rows ask
    open_ = open_.select(*me, F.struct("first", "starts", "anchor", "gram").alias("a")).groupBy(*key).agg(F.collect_set("a").alias("found"))
    packed = _packed(texts)
    docs = packed.select(*me, _ID, "packed").join(open_, key).select(_ID, F.col("none"), "th", "packed", "found")
    rows = written(_context_rows(docs))
    contexts = rows.where("context is not null").select("gram", "kind", "context", "offset", "starts")
    hot = written(contexts.groupBy("gram").agg(F.sum(F.octet_length("context").cast("long")).alias("size")).where(F.col("size") > HOT).select("gram"))
    resolved = _resolved(contexts.join(hot, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram"))
    if not hot.isEmpty():
        resolved = resolved.unionByName(_counted(contexts.join(hot, "gram", "left_semi")))
    spans = rows.select(_ID, "none", "th", "first", "kind").join(written(resolved), "kind").select(*me, F.col("first"), F.explode("runs").alias("r"))
    spans = spans.select(*key, F.struct((F.col("first") + F.col("r.a")).alias("a"), (F.col("first") + F.col("r.b") - 1 + LENGTH).alias("b")).alias("s")).groupBy(*key).agg(F.collect_set("s").alias("spans"))
    last = packed.select(*me, _ID, "packed").join(written(spans), key, "left").select(_ID, "packed", "spans")
    return _cut_rows(last, keep_text).withColumnRenamed(_ID, id_col)
