"""Each registered query against its SQL or a brute-force version on the small tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from mutalog.llm.queries import ORACLES, QUERIES
from mutalog.llm.tokens import default_path, vocabulary
from tests.oracle import assert_same

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def table(name, sf=SF, columns="*"):
    return duckdb.sql(f"select {columns} from '{sf}/{name}.parquet'").fetchall()


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.mark.parametrize("name", ORACLES)
def test_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name], SF)


def exact_neighbours(sf):
    rows = table("embeddings", sf, "vec_id, embedding")
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:10]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_ann_recall(spark, sf):
    want, got = exact_neighbours(sf), defaultdict(list)
    for r in QUERIES["op2_ann"](spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want]
    assert np.mean(hits) / 10 >= 0.9
    exact = dict(x for q in want for x in [((q, v), d) for v, d in want[q]])
    assert all(abs(exact[q, v] - d) < 1e-12 for q in got for v, d in got[q] if (q, v) in exact)


def brute_fingerprint(text, k=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(prints, radius):
    ids = sorted(prints)
    top = {i: i for i in ids}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {i: root(i) for i in ids}


def test_simhash(spark):
    prints = {d: brute_fingerprint(t) for d, t in table("documents", SF, "doc_id, text")}
    want = brute_components(prints, 4)
    got = QUERIES["op3_simhash"](spark, SF).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{p:016x}", want[d]) for d, p in prints.items()}
    assert len(got) == len(prints)


def test_encoding_and_counts(spark):
    rows = dict(table("documents", SF, "doc_id, text"))
    ids = dict(zip(rows, (e.ids for e in vocabulary(default_path()).library.encode_batch(list(rows.values()), add_special_tokens=False))))
    got = QUERIES["op5_bpe"](spark, SF).collect()
    assert {tuple(r) for r in got} == {(d, len(ids[d]), sha(",".join(map(str, ids[d]))), sha(t)) for d, t in rows.items()} and len(got) == len(rows)
    got = QUERIES["op10_token_counts"](spark, SF).collect()
    assert {tuple(r) for r in got} == {(d, len(t.encode()), len(ids[d]), len(ids[d]) > 512) for d, t in rows.items()}


def test_quality(spark):
    labels = dict(table("labels", "/root/testdata/sf0.1", "doc_id, quality"))
    got = QUERIES["op6_quality"](spark, "/root/testdata/sf0.1").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    good, bad = [r.score for r in held if labels[r.doc_id] == 1], [r.score for r in held if labels[r.doc_id] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    assert np.mean([g >= 0.7 for g in good]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def brute_repeats(texts, length=400):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone) if not g))))
    return out


def test_suffix_dedup(spark):
    rows = table("documents", SMALL, "doc_id, text")
    want = dict(zip([d for d, _ in rows], brute_repeats([t.encode() for _, t in rows])))
    made = QUERIES["op7_suffix_dedup"](spark, SMALL).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in made}
    assert got == want and any(0 < w[1] < w[0] for w in want.values()) and len(made) == len(rows)
    assert all(r.removed == (r.n_removed > 0) and r.kept_bytes == r.n_bytes - r.n_removed for r in made)
    whole = dict(rows)
    assert all(r.kept_text == whole[r.doc_id] for r in made if not r.removed)


def test_suffix_dedup_columns(spark):
    """The columns of the contract come first and in its order; others follow."""
    assert QUERIES["op7_suffix_dedup"](spark, SMALL).columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_sharding(spark):
    rows = dict(table("documents", SF, "doc_id, text"))
    got = QUERIES["op8_sharding"](spark, SF).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == {(d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in rows.items()}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert sorted(slots) == list(range(40)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(got) != sorted(got, key=lambda r: (r.slot, r.shard))
    again = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    again.createOrReplaceTempView("shuffled_documents")
    from mutalog.llm import queries

    read = queries._documents
    try:
        queries._documents = lambda *a: again.select("doc_id", "text")
        assert sorted(queries.op8_sharding(spark, SF).collect(), key=lambda r: r.doc_id) == sorted(got, key=lambda r: r.doc_id)
    finally:
        queries._documents = read


def test_pipeline(spark):
    """Stage by stage against brute force on what the stage before has kept; run() gives what the last one gives."""
    import corpus_pipeline
    from mutalog.llm import quality
    from mutalog.llm.shared import written
    from tests.llm.test_edges import _norm, brute_alike

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF))
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.count() == len(kept[name]) and (name == "encoding" or docs.columns == corpus_pipeline.COLUMNS)
        had = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
        if name == "quality":
            model = quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
            x = np.array([quality.features(t or "") for t in had.values()])
            assert kept[name] == {d for d, s in zip(had, model.score(x)) if s >= model.cut} and len(kept[name]) < len(had)
        elif name == "exact_dedup":
            least = {}
            for d in sorted(had):
                least.setdefault(_norm(had[d]), d)
            assert kept[name] == set(least.values()) and len(kept[name]) < len(had)
        elif name == "near_dedup":
            assert kept[name] == set(brute_alike(list(had.items())).values()) and len(kept[name]) < len(had)
        elif name == "mixing":
            assert kept[name] < set(had) and 0.6 < len(kept[name]) / len(had) < 1
        else:
            ids = {d: vocabulary(default_path()).library.encode(t, add_special_tokens=False).ids for d, t in had.items()}
            want = {(d, len(i), sha(",".join(map(str, i))), sha(had[d])) for d, i in ids.items()}
            assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in docs.collect()} == want
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == kept["encoding"]


def test_mixing_meets_its_targets(spark):
    """The raked weights of the query's cells have the target shares of each margin; expected tokens are the rate of all."""
    from mutalog.llm import mixing

    rows = mixing.with_probabilities(spark.read.parquet(f"{SF}/documents.parquet")).select(*mixing.MARGINS, "n_tokens", "weight", "p").collect()
    cells = {tuple(r)[:3]: r.weight for r in rows}
    total = sum(r.n_tokens for r in rows)
    for i, m in enumerate(mixing.MARGINS):
        tokens = Counter()
        for r in rows:
            tokens[r[m]] += r.n_tokens
        whole = sum(n**0.7 for n in tokens.values())
        for k, n in tokens.items():
            assert sum(w for c, w in cells.items() if c[i] == k) / total == pytest.approx(n**0.7 / whole, rel=1e-8)
    assert sum(r.p * r.n_tokens for r in rows) == pytest.approx(total / 2, rel=1e-6)
