"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and columns that clash."""

import itertools
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mutalog.llm import ann, bpe, chat, mixing, quality, sharding, simhash, suffix_dedup, token_counts
from mutalog.llm import exact_dedup as exact
from mutalog.llm.shared import written
from mutalog.llm.tokens import default_path, vocabulary
from tests.llm.test_queries import brute_components, brute_fingerprint, brute_repeats, sha

RND = random.Random(3)
WORDS = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(1, 9))) for _ in range(400)]
LONG = " ".join(RND.choice(WORDS) for _ in range(40_000))
PASSAGE = " ".join(RND.choice(WORDS) for _ in range(150))
ROWS = [
    (1, "one two  three", "en", "s", "x"),
    (2, "one two\tthree", "en", "s", "x"),
    (2, "one two\tthree", "en", "s", "x"),
    (None, "one two three", None, None, None),
    (None, None, None, None, None),
    (5, None, "en", None, "x"),
    (6, "", None, "s", "y"),
    (7, " \n", "de", "s", "y"),
    (8, LONG, "de", "t", "y"),
    (9, LONG + "!", "de", "t", "y"),
    (10, "é日本 <|endoftext|> ~1 </s>", "fr", "t", "y"),
    (11, "before " + PASSAGE + " after", "fr", "t", "z"),
    (12, PASSAGE + PASSAGE, "fr", "t", "z"),
    (13, "x" * 3000, "fr", "u", "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_exact_groups(docs, none):
    norm = lambda t: " ".join(("_" + (t or "") + "_").split()).strip("_")
    got = exact.exact_groups(docs).collect()
    assert len(got) == len(ROWS)
    want = sorted(((d, sha(_norm(t))) for d, t, *_ in ROWS), key=repr)
    assert sorted(((r.doc_id, r.text_sha256) for r in got), key=repr) == want
    by = {r.doc_id: r for r in got if r.doc_id}
    assert (by[1].keep_id, by[1].group_size, by[2].keep_id, by[2].kept) == (1, 1, 2, True) or by[2].keep_id == 1
    assert by[6].keep_id == 5 and not by[6].kept and by[5].group_size == 3 and by[7].group_size == 1
    assert norm("") == "" and exact.exact_groups(none).count() == 0


def _norm(t):
    import re

    return re.sub(r"[ \t\n\x0b\f\r]+", " ", t or "")


def test_exact_groups_under_hash_collisions(docs):
    """With a hash of three values the ordinals must tell chunks apart."""
    rude = lambda c: F.pmod(F.xxhash64(c), F.lit(3))
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows(exact.exact_groups(docs, hashed=rude), *names) == rows(exact.exact_groups(docs), *names)


def test_exact_dedup_keeps_columns(docs):
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 5, 7, 8, 9, None} and 6 not in {r.doc_id for r in kept.collect()}
    assert exact.exact_dedup(docs.withColumn("__drop", F.lit(1))).columns == [*docs.columns, "__drop"]


def test_simhash_edges(docs, none):
    prints = {i: brute_fingerprint(t or "") for i, (_, t, *_) in enumerate(ROWS)}
    groups = brute_components(prints, 4)
    ids = [r[0] for r in ROWS]
    least = {}
    for i, g in groups.items():
        if ids[i] is not None:
            least[g] = min(least.get(g, ids[i]), ids[i])
    want = sorted(((ids[i], f"{prints[i]:016x}", least.get(groups[i])) for i in prints), key=repr)
    assert rows(simhash.near_groups(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_groups(none).count() == 0


@pytest.mark.parametrize("words64,radius,first", [(1, 4, None), (1, 7, None), (4, 40, 20)])
def test_links_of_dense_clusters(spark, words64, radius, first):
    rnd = random.Random(words64)
    near = []
    for _ in range(30):
        base = rnd.getrandbits(64 * words64)
        for _ in range(rnd.randint(1, 12)):
            x = base
            for _ in range(rnd.randint(0, radius)):
                x ^= 1 << rnd.randrange(64 * words64)
            near.append(x)
    prints = dict(enumerate(dict.fromkeys(near)))
    f = radius if first is None else first
    shift = 64 * (words64 - 1)
    top = list(prints)

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in prints:
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius and ((prints[a] ^ prints[b]) >> shift).bit_count() <= f:
                x, y = sorted((root(a), root(b)))
                top[y] = x
    points = spark.createDataFrame([(bytearray(p.to_bytes(8 * words64, "big")),) for p in prints.values()], "fp binary")
    labels = simhash.components(simhash.links(points, radius, first))
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.label, "big") for r in labels.collect()}
    member = lambda p: got.get(p, p)
    for a in prints:
        for b in range(a):
            assert (root(a) == root(b)) == (member(prints[a]) == member(prints[b]))


def test_forests_miss_no_pair(spark):
    """Whatever r bits differ, some tree measures one of them at most; and a pair then meets in just one leaf of that tree."""
    rnd = random.Random(2)
    for radius, n in [(0, 10), (1, 10**4), (2, 10**9), (4, 10**3), (4, 10**8), (4, 10**11), (6, 10**6)]:
        blocks, vantages = simhash._shape(radius, n)
        trees = simhash._kept_blocks(radius, blocks)
        assert len(trees) <= simhash.TREES
        masks = [sum({bits for bits, *_ in simhash._levels(kept, blocks, vantages)}) & (1 << 64) - 1 for kept in trees]
        for _ in range(300):
            gone = sum({1 << rnd.randrange(64) for _ in range(radius)})
            assert any((m & gone).bit_count() <= 1 for m in masks)
    assert simhash._shape(4, 10**5) != simhash._shape(4, 10**10)
    x = [rnd.getrandbits(64) for _ in range(200)]
    pairs = [(a, a ^ sum({1 << rnd.randrange(64) for _ in range(4)})) for a in x]
    points = spark.createDataFrame([(bytearray(p.to_bytes(8, "big")),) for pair in pairs for p in pair], "fp binary").distinct()
    for n in (1, 10**6, 10**10):
        rows_ = simhash._forest(points.withColumn("w", simhash._as_long(F.col("fp"))), 4, n).collect()
        lives, visits = {}, {}
        for r in rows_:
            (lives if r.home else visits).setdefault(bytes(r.fp), set()).add(r.leaf)
        assert len({len(v) for v in lives.values()}) == 1
        for a, b in pairs:
            a, b = (p.to_bytes(8, "big") for p in (a, b))
            assert lives[a] & (lives[b] | visits[b]) or lives[b] & visits[a]


@pytest.mark.parametrize("homes", [20, 24_576])
def test_large_leaves(spark, monkeypatch, homes):
    """Leaves above HOMES are compared in blocks: the same links."""
    monkeypatch.setattr(simhash, "HOMES", homes)
    monkeypatch.setattr(simhash, "VISITORS", 2 * homes)
    rnd = random.Random(4)
    bases = [rnd.getrandbits(64) for _ in range(3)]
    near = {b ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randint(0, 3))}) for b in bases for _ in range(80)}
    prints = dict(enumerate(sorted(near)))
    want = brute_components(prints, 4)
    points = spark.createDataFrame([(bytearray(p.to_bytes(8, "big")),) for p in prints.values()], "fp binary")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.label, "big") for r in simhash.components(simhash.links(points, 4)).collect()}
    assert {p: got.get(p, p) for p in prints.values()} == {prints[i]: prints[want[i]] for i in prints}


def test_near_dedup(spark):
    rnd = random.Random(1)
    text = lambda n: [rnd.choice(WORDS) + str(rnd.randrange(99)) for _ in range(n)]
    base = text(300)
    close = list(base)
    for i in (20, 200):
        close[i] = "changed"
    data = [(1, " ".join(base)), (2, " ".join(close)), (3, " ".join(text(300))), (None, " ".join(base)), (4, "")]
    df = spark.createDataFrame([(d, t, 1) for d, t in data], "doc_id long, text string, more int")
    assert rows(simhash.near_dedup(df), "doc_id") == [(1,), (3,), (4,), (None,)]


def brute_alike(data, least=0.8):
    """The id of each (id, text) and the least id that pairs alike in so many 5-word shingles lead to."""
    sets = {}
    for d, t in data:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets[d] = {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    holders, top = {}, {d: d for d in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for d in sorted(sets):
        shared = Counter(o for s in sets[d] for o in holders.get(s, ()))
        if not sets[d]:
            shared = {o: 0 for o in sets if o < d and not sets[o]}
        for o, n in shared.items():
            if n * (1 + least) + 1e-9 >= least * (len(sets[d]) + len(sets[o])):
                x, y = sorted((root(d), root(o)))
                top[y] = x
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    return {d: root(d) for d in sets}


@pytest.mark.parametrize("rows_of_block", [8, 256])
def test_alike_in_blocks(spark, monkeypatch, rows_of_block):
    """Copies with more and more changes around 0.8, in large and small groups: the pairs of brute force, whatever the blocks."""
    monkeypatch.setattr(simhash, "ROWS", rows_of_block)
    monkeypatch.setattr(simhash, "COLUMNS", 64)
    rnd = random.Random(6)
    data = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  two"), (5, "two one")]
    for group in range(4):
        base = [rnd.choice(WORDS) + str(rnd.randrange(99)) for _ in range(200)]
        for _ in range(120 if group == 0 else 5):
            copy = list(base)
            for _ in range(rnd.randrange(7)):
                copy[rnd.randrange(len(copy))] = rnd.choice(WORDS)
            data.append((len(data), " ".join(copy)))
    data.append((len(data), LONG))
    df = spark.createDataFrame(data, "doc_id long, text string")
    groups = df.selectExpr("doc_id", "doc_id % 2 * 0 as component_id", "length(text) as n_bytes").fillna(0)
    got = {r.node: r.label for r in simhash.components(simhash.alike(df, groups)).collect()}
    want = brute_alike(data)
    assert {d: got.get(d, d) for d, _ in data} == want and len(set(want.values())) > 10


def test_near_dedup_against_brute_force(spark):
    """Of whole texts: what stays is the least id of each group of texts alike in 0.8 of their shingles."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute_alike([tuple(r) for r in df.collect()])
    assert sorted(r.doc_id for r in simhash.near_dedup(df).collect()) == sorted(set(want.values()))


def test_near_dedup_with_repeated_lines(spark):
    """A copy that repeats a line more often has almost the same set of shingles."""
    rnd = random.Random(12)
    data = []
    for n, line, times in [(200, 12, 10)] * 12 + [(300, 15, 6)] * 12:
        base = [rnd.choice(WORDS) + str(rnd.randrange(9999)) for _ in range(n + 4)]
        copy = base[: line + 4] * times + base
        data += [(len(data), " ".join(base)), (len(data) + 1, " ".join(copy))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute_alike(data)
    assert sorted(r.doc_id for r in simhash.near_dedup(df).collect()) == sorted(set(want.values())) == [2 * i for i in range(24)]


def test_near_dedup_of_short_texts(spark):
    """Pairs of 8 and 9 words, and other short ones at the limit or just below it, with a line that many have."""
    rnd = random.Random(13)
    word = lambda: rnd.choice(WORDS) + str(rnd.randrange(999))
    data = []
    for i in range(900):
        base = [word() for _ in range(8 if i < 400 else rnd.randint(1, 60))]
        if i % 9 == 0:
            base += "this line is in very many of the texts".split()
        copy = base + [word() for _ in range(1 if i < 400 else rnd.randint(0, 1 + len(base) // 4))]
        data += [(len(data), " ".join(base)), (len(data) + 1, " ".join(copy))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute_alike(data)
    assert sorted(r.doc_id for r in simhash.near_dedup(df).collect()) == sorted(set(want.values()))
    assert sum(want[2 * i] == want[2 * i + 1] for i in range(400)) == 400 and len(set(want.values())) > 1000


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.label for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_round_trip_and_counts(docs, none):
    library = vocabulary(default_path()).library
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t, *_ in ROWS]
    got = rows(bpe.round_trip(docs.drop("score")), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(((d, len(i), sha(",".join(map(str, i))), sha(t or "")) for (d, t, *_), i in zip(ROWS, ids)), key=repr)
    counts = token_counts.count_tokens(docs)
    assert rows(counts, "doc_id", "n_bytes", "n_tokens") == sorted(((d, len((t or "").encode()), len(i)) for (d, t, *_), i in zip(ROWS, ids)), key=repr)
    assert "score" in counts.columns and token_counts.count_tokens(none).count() == bpe.round_trip(none).count() == 0
    back = bpe.decode(bpe.encode(docs)).where("coalesce(text, '') != decoded")
    assert back.count() == 0
    clash = bpe.round_trip(docs.withColumn("N_tokens", F.lit(1)).withColumn("N_tokens_input", F.lit(2)))
    assert {"n_tokens", "N_tokens_input", "N_tokens_input_input"} < set(clash.columns)
    assert rows(clash, "doc_id", "n_tokens", "N_tokens_input_input") == sorted(((d, len(i), 1) for (d, *_), i in zip(ROWS, ids)), key=repr)
    assert token_counts.count_tokens(docs.withColumn("over_limit", F.lit("x"))).select("over_limit_input").distinct().collect() == [("x",)]


def test_chunk_joins_at_every_place(monkeypatch):
    """Tiny chunks: joins inside words, numbers, runs of spaces, contractions and special strings."""
    for name, value in (("WINDOW", 4), ("MASK", 3), ("LEAST", 3), ("MOST", 17)):
        monkeypatch.setattr(bpe, name, value)
    e, library, rnd = bpe.Encoder(default_path()), vocabulary(default_path()).library, random.Random(5)
    parts = [" ", "  ", "\n", "don't", "we'll", "<|endoftext|>", "12345", "日本", "é", "!!", "abc", "the", " of", "\t"]
    for _ in range(300):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))
        assert list(e.encode(t)) == library.encode(t, add_special_tokens=False).ids, t
        assert bpe.cuts(t.encode())[-1:] == ([len(t.encode())] if t else [])
    assert e.reused_bytes > 0


def test_every_prefix(spark):
    library, rnd = vocabulary(default_path()).library, random.Random(6)
    parts = [" ", "  ", "\n", "don't", "'ll", "<|endoftext|>", "12345", "日本", "é", "!!", "abcdefgh", "the", " of", "ʼ", "՘"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(60)] + [None, "a" * 200, " " * 90 + "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tables = written(token_counts.prefix_tables(df))
    want = {i: [len(library.encode((t or "")[:k], add_special_tokens=False).ids) for k in range(len(t or "") + 1)] for i, t in enumerate(texts)}
    assert {r.doc_id: r.prefix_tokens for r in tables.collect()} == want
    for r in token_counts.truncated(tables, 5).collect():
        k = max(k for k, n in enumerate(want[r.doc_id]) if n <= 5)
        assert (r.text, r.n_tokens) == ((texts[r.doc_id] or "")[:k], want[r.doc_id][k])


def test_suffix_dedup_edges(docs, none):
    got = rows(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(((d, *w) for (d, *_), w in zip(ROWS, brute_repeats([(t or "").encode() for _, t, *_ in ROWS]))), key=repr)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_of_overlapping_copies(spark):
    """Shared stretches of every length around the limit, at many offsets, in small alphabets."""
    rnd = random.Random(8)
    pool = ["".join(rnd.choice("ab") for _ in range(900)) for _ in range(3)]
    texts = []
    for _ in range(60):
        t = ""
        for _ in range(rnd.randint(1, 4)):
            p, a = rnd.choice(pool), rnd.randrange(500)
            t += p[a : a + rnd.choice([100, 398, 399, 400, 401, 450])] + "".join(rnd.choice("abc") for _ in range(rnd.choice([0, 1, 30])))
        texts.append(t)
    texts += ["a" * 1000, "ab" * 300, "ä" * 350]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(brute_repeats([t.encode() for t in texts])))
    assert {r[0]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(df).collect()} == want


def test_suffix_order_of_long_batches():
    """More bytes than a slice: the powers reach as far as the data."""
    data = np.tile(np.frombuffer(b"ab", np.uint8), 2_200_000)
    at = np.array([1, 0, len(data) - 500, len(data)])
    order, shared = suffix_dedup.Texts(data, at, np.array([500, 600, 500, 0])).order(np.zeros(4, np.int64))
    assert order.tolist() == [3, 2, 1, 0] and shared.tolist() == [-1, 0, 500, 0]


def with_one_gram(n, rnd):
    """n + 40 texts around one gram of least hash: n share nothing else, 40 share windows of every kind."""
    word = lambda k: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    pool = word(1 << 20)
    p = int(np.argmin(suffix_dedup.rolling(np.frombuffer(pool.encode(), np.uint8), suffix_dedup.GRAM)))
    gram = pool[p : p + suffix_dedup.GRAM]
    before, after = word(336), word(336)
    near = []
    for _ in range(40):
        a, b = rnd.randrange(337), rnd.randrange(337)
        near.append(word(336 - a) + before[336 - a :] + gram + after[:b] + word(336 - b))
    near[-1] = near[-2]
    return [word(336) + gram + word(336) for _ in range(n)], near


def test_suffix_dedup_of_a_gram_in_many_contexts(spark):
    """One gram with more than 4 MiB of different contexts."""
    apart, near = with_one_gram(6500, random.Random(9))
    df = spark.createDataFrame(list(enumerate(near + apart)), "doc_id long, text string")
    want = dict(enumerate(brute_repeats([t.encode() for t in near]) + [(len(t), 0, 0, sha(t)) for t in apart]))
    assert {r[0]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(df).collect()} == want
    assert len({w[1] for w in want.values()}) > 5


def test_suffix_dedup_by_counted_windows(spark, docs, monkeypatch):
    """All grams treated as those with very many contexts: the same as brute force."""
    monkeypatch.setattr(suffix_dedup, "HOT", 0)
    got = rows(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(((d, *w) for (d, *_), w in zip(ROWS, brute_repeats([(t or "").encode() for _, t, *_ in ROWS]))), key=repr)
    test_suffix_dedup_of_overlapping_copies(spark)


def test_suffix_order_survives_collisions(monkeypatch):
    data = np.frombuffer(b"banana bandana cabana", np.uint8)
    at = np.arange(len(data))
    group = np.zeros(len(data), np.int64)
    want = sorted(range(len(data)), key=lambda i: data.tobytes()[i:])
    t = suffix_dedup.Texts(data, at, len(data) - at)
    assert t.order(group)[0].tolist() == want
    t._sum[:] = 0  # every hash collides
    order, shared = t.order(group)
    assert order.tolist() == want and shared[0] == -1 and shared.max() >= 3


def test_quality_edges(docs, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (8, 1, 0), (None, 1, 0), (9, None, None), (9, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.scored(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got) and {r.score_input for r in got} == {r[4] for r in ROWS}
    empty = quality.train(none, labels.limit(0))
    assert {r.score for r in quality.scored(docs.drop("score"), empty).collect()} == {0.5}
    assert quality.keep_good(docs, model).columns == docs.columns


def test_quality_samples_ids_once(spark):
    """One id listed very often is one row of the sample."""
    docs = spark.range(4000).selectExpr("if(id % 4 = 0, id, 77) as doc_id", "cast(id as string) as text")
    ids = quality._sampled(docs, 500, "doc_id")
    assert ids.count() == 500
    assert quality._features_of(docs, docs.select("doc_id").distinct(), "doc_id", "text").shape == (1001, len(quality.NAMES))


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_class_prior(prior):
    """Mixed from two classes that overlap a little, the unlabelled rows give their share of positives back."""
    rng = np.random.default_rng(4)
    draw = lambda n, at: rng.normal(at, 1, (n, len(quality.NAMES)))
    n = int(6000 * prior)
    model = quality.fit(draw(3000, 0.6), rng.permutation(np.concatenate([draw(n, 0.6), draw(6000 - n, -0.6)])))
    assert abs(model.prior - prior) < 0.04


def test_mixing_edges(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.p <= 1 for r in got)
    assert {r.kept for r in got if r.doc_id == 2} <= {True, False} and len({r.kept for r in got if r.doc_id == 2}) == 1
    assert mixing.mix(none).count() == 0
    clash = mixing.mix(docs.withColumns({"p": F.lit(9), "topic": F.lit("mine"), "kept": F.lit(None).cast("int")}))
    assert rows(clash, "doc_id", "p", "kept") == rows(mixing.mix(docs), "doc_id", "p", "kept") and {(r.p_input, r.topic_input, r.kept_input) for r in clash.collect()} == {(9, "mine", None)}


def test_raking_meets_its_targets(spark, docs):
    cells = [(s, la, t, 10 + 7 * i * i) for i, (s, la, t) in enumerate((s, la, t) for s in "abc" for la in "xy" for t in "pq")]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    share = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "source string, share double")
    made = mixing.rake(df, 0.0, {"source": share})
    total = sum(c[3] for c in cells)
    sums = {r[0]: r[1] / total for r in made.groupBy("source").agg(F.sum("weight")).collect()}
    assert sums == pytest.approx({"a": 0.5, "b": 0.3, "c": 0.2}, abs=1e-6)
    assert {round(r[1] / total, 6) for r in made.groupBy("topic").agg(F.sum("weight")).collect()} == {0.5}
    p = mixing.probabilities(made, 0.4).collect()
    assert sum(r.tokens * r.p for r in p) == pytest.approx(0.4 * total) and max(r.p for r in p) <= 1


def test_raking_goes_on_until_the_margins_agree(spark, monkeypatch):
    """Sources that nearly determine languages: eight sweeps would leave a margin percents off; both ways of summing agree."""
    cells = [(f"s{s}", f"l{la}", f"t{t}", (990 if s % 4 == la else 3) * (s + 1) ** 2 + t) for s in range(6) for la in range(4) for t in range(3)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    made = mixing.rake(df, 0.0)
    off = mixing.marginals(made, 0.0).selectExpr("max(abs(share / target - 1)) as off").first().off
    assert off < 1e-8
    short = mixing.marginals(mixing.rake(df, 0.0, most=8), 0.0).selectExpr("max(abs(share / target - 1)) as off").first().off
    assert short > 0.02
    monkeypatch.setattr(mixing, "CELLS", 0)
    monkeypatch.setattr(mixing, "ROUND", 2)
    with pytest.warns(UserWarning, match="can't all be met"):
        summed = mixing.rake(df, 0.0, most=4)
    monkeypatch.setattr(mixing, "CELLS", 20_000)
    with pytest.warns(UserWarning):
        want = mixing.rake(df, 0.0, most=4)
    key = lambda d: sorted((r.source, r.lang, r.topic, round(r.weight, 6)) for r in d.collect())
    assert key(summed) == key(want)


def test_clipping_meets_the_rate(spark):
    """Cells that would be drawn more than once are kept whole, the others make up the rest; many cells are joined by shuffles."""
    cells = [(str(i), "x", "p", 10, w) for i, w in enumerate((1.0, 2.0, 5.0, 30.0, 200.0, 0.0))]
    df = spark.createDataFrame([*cells, ("none", "x", "p", 0, 0.0)], "source string, lang string, topic string, tokens long, weight double")
    p = {r.source: r.p for r in mixing.probabilities(df, 0.5).collect()}
    assert p["4"] == p["3"] == p["none"] == 1 and p["5"] == 0 and sum(p[s] * 10 for s in "012345") == pytest.approx(30)
    assert p["0"] * 5 == pytest.approx(p["2"])
    assert {r.p for r in mixing.probabilities(df, 1.0).where("tokens > 0 and weight > 0").collect()} == {1.0}


def test_many_cells(docs, monkeypatch):
    monkeypatch.setattr(mixing, "ROUND", 2)
    want = rows(mixing.mix(docs), "doc_id", "p", "kept")
    monkeypatch.setattr(mixing, "CELLS", 0)
    assert [(d, round(p, 9), k) for d, p, k in rows(mixing.mix(docs), "doc_id", "p", "kept")] == [(d, round(p, 9), k) for d, p, k in want]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40, 41, 1000])
def test_permutation(spark, n):
    df = spark.range(n).select(sharding.permuted(F.col("id"), F.lit(n).cast("long"), 3).alias("p"))
    assert sorted(r.p for r in df.collect()) == list(range(n))


def test_sharding_edges(docs, none, spark, tmp_path):
    made = sharding.shuffle_into_shards(docs, ["doc_id", "text"], [], 4, seed=1)
    got = made.collect()
    assert sorted(r.slot * 4 + r.shard for r in got) == list(range(len(ROWS)))
    assert sharding.shuffle_into_shards(none, ["doc_id"], [], 4).count() == 0
    sharding.write_shards(made, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ROWS)
    clash = sharding.shuffle_into_shards(docs.withColumns({"slot": F.lit("mine"), "__n": F.lit(0)}), ["doc_id", "text"], [], 4, seed=1)
    assert sorted(r.slot * 4 + r.shard for r in clash.where("slot_input = 'mine' and __n_input = 0").collect()) == list(range(len(ROWS)))


def test_reply_trees(spark):
    m = [
        ("t", 1, None, "user", "root <|end|>\n ~0 </s>", 0.0),
        ("t", 2, 1, "assistant", "good", 5.0),
        ("t", 3, 1, "assistant", "bad", 1.0),
        ("t", 4, 2, "user", None, 0.0),
        ("t", 5, 4, "assistant", "deep <|turn|>user\nx", 9.0),
        ("u", 1, 99, "system\nrole", "", None),
        ("v", 1, 2, "user", "cycle", 0.0),
        ("v", 2, 1, "user", "cycle", 0.0),
        (None, 1, None, None, "alone", 0.0),
    ]
    df = spark.createDataFrame(m, "tree_id string, message_id long, parent_id long, role string, text string, score double")
    read = lambda d: {(r.tree_id, r.leaf_id): ([tuple(t) for t in r.turns], r.loss, r.branch) for r in d.select("tree_id", "leaf_id", "branch", chat.parsed(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    got = read(chat.conversations(df))
    assert got == {
        ("t", 3): ([("user", m[0][4]), ("assistant", "bad")], "bad", None),
        ("t", 5): ([("user", m[0][4]), ("assistant", "good"), ("user", ""), ("assistant", m[4][4])], "good" + m[4][4], None),
        ("u", 1): ([("system\nrole", "")], "", None),
        (None, 1): ([("", "alone")], "", None),
    }
    assert set(read(chat.conversations(df, branches=1))) == {("t", 5), ("u", 1), (None, 1)}
    assert chat.conversations(df.limit(0)).count() == 0


def test_repeated_messages(spark):
    """A chain of 40 messages, each listed three times, once with another score and text: one path, of the least rows."""
    m = [("t", i, i - 1 if i else None, "user", f"said {i}", 1.0, k) for i in range(40) for k in range(2)]
    m += [("t", i, i - 1 if i else None, "user", f"said {i}!", 0.0, 2) for i in range(40)] + [("t", None, 3, "user", "no id", 0.0, 0)]
    df = spark.createDataFrame(m, "tree_id string, message_id long, parent_id long, role string, text string, score double, branch int")
    got = chat.conversations(df, branches=3).select("tree_id", "leaf_id", "branch", chat.parsed(F.col("formatted")).alias("turns")).collect()
    assert [(r.tree_id, r.leaf_id, r.branch, [t.text for t in r.turns]) for r in got] == [("t", 39, 1, [f"said {i}" for i in range(40)])]


def test_escapes_are_reversible(spark):
    texts = ["", "~", "~1", "~01", "<|", "<<||>", "[INST][/INST]", "[/[INST]INST]", "<s></s><<SYS>><</SYS>>", "~~0~8\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    got = df.select("t", "e", chat.unescaped(F.col("e")).alias("back")).collect()
    assert all(r.t == r.back and not any(c in r.e for c in chat.CONTROL) for r in got)


def test_long_conversations(spark):
    df = spark.range(300).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    got = chat.conversations(chat.as_messages(df)).select(chat.parsed(F.col("formatted")).alias("turns")).first()
    assert [t.text for t in got.turns] == [str(i) for i in range(300)]


def test_ann_edges(spark):
    v = lambda *x: list(map(float, x))
    data = [(0, v(1, 0)), (1, v(1, 0)), (2, v(1, 0)), (3, None), (4, []), (5, v(0, 0)), (6, [1.0, None]), (7, v(float("nan"), 1)), (8, v(float("inf"), 1)), (9, v(2, 0)), (10, v(1, 2, 3)), (None, v(1, 1)), (9, v(2, 0))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    points = ann.vectors(df, "vec_id", "embedding")
    got = ann.search(ann.index(points, 2), points.where("vec_id in (0, 10)"), 2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 0.0), (0, 2, 2, 0.0)]
    assert ann.search(ann.index(points.limit(0), 2), points.limit(0), 2).count() == 0


def test_ann_copies_and_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    x[50:250] = x[0]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    points = ann.vectors(df, "vec_id", "embedding")
    asked = points.where("vec_id % 20 = 0")
    got = ann.search(ann.index(points, 5, shard_size=60), asked, 5, block=7).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {(q, j) for q in range(0, 400, 20) for j in [j for j in np.lexsort((np.arange(400), d[q])) if j != q][:5]}
    assert len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.95 * len(want) and len(got) == len(want)


def test_wide_forests_leave_few_pairs_apart(spark):
    """Pairs that differ like texts alike in 0.8 meet in some tree, most others in none; more fingerprints get trees that prune more."""
    rnd = random.Random(21)
    apart = math.acos(1.6 / 1.8) / math.pi
    x = [rnd.getrandbits(256) for _ in range(400)]
    pairs = [(a, a ^ sum(1 << b for b in range(256) if rnd.random() < apart)) for a in x]
    points = spark.createDataFrame([(bytearray(p.to_bytes(32, "big")),) for pair in pairs for p in pair], "fp binary")
    chance = []
    for n in (10**3, 2 * 10**5, 10**8):
        leaves, many = simhash.wide_forest(points, n, 4, 0.8)
        lives, visits, total = {}, {}, 0
        for r in leaves.collect():
            (lives if r.home else visits).setdefault(int.from_bytes(r.fp, "big"), set()).add(r.leaf)
            total += 1
        assert total <= many * len(points.collect()) / n
        meet = lambda a, b: bool(lives[a] & (lives[b] | visits.get(b, set())) or lives[b] & visits.get(a, set()))  # noqa: E731, B023
        assert sum(meet(a, b) for a, b in pairs) >= 0.97 * len(pairs)
        chance.append(sum(meet(a, b) for a, b in itertools.combinations(x[:150], 2)) / 11_175)
    assert chance[0] > chance[1] > chance[2] and chance[2] < 0.02
    many = simhash._wide_shape(apart, 10**10)[3]
    assert many <= simhash.TREES and len(simhash._wide_trees(4, *simhash._wide_shape(apart, 10**10))) == many


def test_near_dedup_goes_through_the_trees(spark, monkeypatch):
    """Without the exact ways for the rest, the trees alone find nearly all near copies; with them, leading shingles see only what the trees left apart."""
    rnd = random.Random(22)
    word = lambda: rnd.choice(WORDS) + str(rnd.randrange(9999))
    data = []
    for _ in range(200):
        base = [word() for _ in range(250)]
        copy = list(base)
        for i in rnd.sample(range(250), 4):
            copy[i] = word()
        data += [(len(data), " ".join(base)), (len(data) + 1, " ".join(copy))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    whole, seen = simhash.lead_leaves, []

    def counted(*args):
        made = whole(*args)
        seen.append(made.count())
        return made

    monkeypatch.setattr(simhash, "lead_leaves", counted)
    assert sorted(r.doc_id for r in simhash.near_dedup(df).collect()) == [2 * i for i in range(200)]
    rows_ = simhash.near_prints(df, simhash._times(df, "text", 5), 0.8, "doc_id", "text", 5, 4)
    assert seen[0] < rows_.selectExpr("sum(size(lead)) as n").first().n * 0.05
    monkeypatch.setattr(simhash, "lead_leaves", lambda *args: spark.createDataFrame([], "leaf long, fp binary, home boolean"))
    monkeypatch.setattr(simhash, "short_groups", lambda *args: spark.createDataFrame([], "doc_id long, component_id string, n_bytes long"))
    kept = {r.doc_id for r in simhash.near_dedup(df).collect()}
    assert kept >= {2 * i for i in range(200)} and len(kept) <= 206


def _peak(f):
    """What f() returns, and the bytes that Python and NumPy held for it at most."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_leaf_of_near_copies_in_little_memory():
    """All pairs of a leaf are near: they are not held, but united as they come."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, 32, dtype=np.uint8)
    noise = np.packbits(rng.random((3000, 256)) < 0.02, axis=1)
    fps = [x.tobytes() for x in base ^ noise]
    pdf = pd.DataFrame({"leaf": 1, "side": 0, "h": -1, "fp": fps})
    made, most = _peak(lambda: simhash._compare(pdf, 68, 26))
    assert len(made) == len(set(fps)) - 1 and made["b"].nunique() == 1
    assert most < 64 << 20


def test_a_block_of_near_copies_in_little_memory():
    """Nor are all pairs of a block of alike texts, of which the matrix of common shingles is the largest that is left."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words, f"x{i}"]) for i in range(2000)]
    pdf = pd.DataFrame({"group": "g", "side": 0, "doc_id": range(2000), "text": texts})
    made, most = _peak(lambda: simhash._alike(pdf, "doc_id", "text", 5, simhash.ALIKE))
    assert len(made) == 1999 and set(made["b"]) == {0}
    assert most < 112 << 20


def test_powers_follow_the_longest_text():
    """Short texts need no tables of a whole slice, and shingles are the same with any tables."""
    bpe._TABLES.clear()
    text = " ".join(WORDS)
    before = simhash.shingles(text, 5)
    assert len(bpe._TABLES[0]) == 1 << 16
    cuts = bpe.cuts(LONG.encode())
    assert len(bpe._powers()[0]) == bpe.SLICE + bpe.WINDOW + 1
    assert (simhash.shingles(text, 5) == before).all() and bpe.cuts(LONG.encode()) == cuts
