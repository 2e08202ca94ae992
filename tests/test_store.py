"""Conformance of the store: order, ranges, overwrites, deletes, reopening, compaction, expiry, streams."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mutalog.functions.codec import component_bounds, encode, prefix_bounds
from mutalog.operators import compact, resolve
from mutalog.sources.store import Store
from mutalog.streaming.ingest import ingest

NOW = datetime(2024, 1, 1)


def pairs(df):
    return [(r.key, r.value) for r in df.collect()]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "kv"))


def test_order_and_unsigned_bytes(spark, store):
    store.upsert_strings([("b", "1"), ("aa", "2"), ("", "3"), ("я", "4"), ("~", "5")])
    assert [k for k, _ in pairs(store.strings())] == ["", "aa", "b", "~", "я"]
    low = spark.createDataFrame([(bytearray(b),) for b in (b"\xff", b"\x80", b"\x7f", b"\x00", b"")], "key binary")
    assert [bytes(r.key) for r in resolve.ordered(low).collect()] == [b"", b"\x00", b"\x7f", b"\x80", b"\xff"]


@pytest.mark.parametrize("flushed", [False, True])
def test_ranges(store, flushed):
    key = lambda i: f"k{i:010d}"
    store.upsert_strings([(key(i), f"v{i}") for i in (7, 97, 101)])
    if flushed:
        store.flush()
    read = lambda a, b: [int(k[1:]) for k, _ in pairs(store.strings(a and key(a), b and key(b)))]
    assert read(None, None) == read(6, None) == read(7, 102) == [7, 97, 101]
    assert read(8, None) == read(96, 102) == [97, 101]
    assert read(None, 101) == read(7, 98) == [7, 97]
    assert read(7, 7) == read(98, 101) == read(102, 1000) == read(101, 7) == []


def test_newest_wins_across_generations(store):
    store.upsert_strings([("k1", "1"), ("k2", "2"), ("k3", "3")])
    store.flush()
    store.upsert_strings([("k2", "4"), ("k3", "5")])
    store.flush()
    store.upsert_strings([("k3", "6"), ("k4", "7")])
    assert pairs(store.strings()) == [("k1", "1"), ("k2", "4"), ("k3", "6"), ("k4", "7")]
    assert pairs(store.strings("k2", "k4")) == [("k2", "4"), ("k3", "6")]


def test_delete_restore_empty_value(spark, store, tmp_path):
    store.upsert_strings([("a", "1"), ("b", ""), ("c", "3")])
    store.flush()
    store.upsert_strings([("a", None), ("missing", None)])
    store.flush()
    assert pairs(store.strings()) == [("b", ""), ("c", "3")]
    assert store.point(b"a").count() == 0 and store.point(b"b").count() == 1
    store.upsert_strings([("a", "again")])
    store.close()
    store.close()
    again = Store(spark, str(tmp_path / "kv"))
    assert pairs(again.strings()) == [("a", "again"), ("b", ""), ("c", "3")]
    with pytest.raises(RuntimeError):
        store.upsert_strings([("x", "y")])


def test_compaction(spark, store):
    store.upsert_strings([(f"k{i:03d}", "v" * 50) for i in range(100)])
    store.flush()
    store.upsert_strings([(f"k{i:03d}", None) for i in range(50)])
    store.flush()
    before, old = pairs(store.strings()), store.snapshot()
    store.compact()
    assert pairs(store.strings()) == before and len(store.snapshot().manifest.generations) == 1
    made = store.snapshot().manifest.generations[0]
    assert (made.n_rows, made.n_tombstones) == (50, 0)
    assert old.all().count() == 50  # a pinned snapshot still reads
    version = store.snapshot().manifest.version
    assert store.compact().version == version  # nothing to do
    assert store.snapshot(1).all().count() == 100  # time travel
    assert store.vacuum() == 2
    assert "Exchange" not in store.snapshot().all()._jdf.queryExecution().executedPlan().toString()


def test_compacting_deletes_only_empties_the_store(store):
    store.upsert_strings([(f"k{i}", None) for i in range(100)])
    store.flush()
    store.compact()
    assert store.snapshot().manifest.generations == () and store.strings().count() == 0


def test_empty_flush_writes_nothing(store):
    assert store.flush().version == 0
    store.upsert_strings([("a", "b")])
    store.flush()
    assert store.flush().version == 1


def test_flush_threshold(spark, tmp_path):
    s = Store(spark, str(tmp_path / "kv"), flush_threshold_bytes=10)
    s.upsert_strings([("abc", "de")])
    assert s.snapshot().manifest.version == 0
    s.upsert_strings([("abcdefgh", "de")])
    assert s.snapshot().manifest.version == 1


def test_compaction_keeps_a_concurrent_flush(spark, store, tmp_path):
    store.upsert_strings([("a", "1"), ("b", "1")])
    store.flush()
    other, publish = Store(spark, str(tmp_path / "kv")), store.manifests.publish

    def late(manifest):
        store.manifests.publish = publish
        other.upsert_strings([("b", "2")])
        other.flush()
        return publish(manifest)

    store.manifests.publish = late
    store.compact()
    assert pairs(store.strings()) == [("a", "1"), ("b", "2")]


def test_two_flushes_at_once(spark, store, tmp_path):
    other, publish = Store(spark, str(tmp_path / "kv")), store.manifests.publish
    store.upsert_strings([("a", "first")])
    other.upsert_strings([("a", "other"), ("b", "other")])

    def late(manifest):
        store.manifests.publish = publish
        other.flush()
        return publish(manifest)

    store.manifests.publish = late
    store.flush()
    assert pairs(store.strings()) == [("a", "first"), ("b", "other")]
    assert len({g.id for g in store.snapshot().manifest.generations}) == 2


def test_expiry(store):
    store.upsert_strings([(f"k{i}", "old") for i in range(4)])
    store.flush()
    store.upsert_strings([("k0", "new"), ("k1", "new")], ttl=timedelta(milliseconds=10), now=NOW)
    store.upsert_strings([("k2", None)], ttl=timedelta(minutes=1), now=NOW)
    store.flush()
    at = lambda ms: sorted(bytes(r.key).decode() for r in store.get(now=NOW + timedelta(milliseconds=ms)).collect())
    assert at(9) == ["k0", "k1", "k3"]
    assert at(10) == ["k3"]  # expired at exactly now, and no older version comes back
    store.compact(now=NOW + timedelta(seconds=1))
    assert [bytes(r.key).decode() for r in store.get().collect()] == ["k3"]


def test_partial_compaction_keeps_deletes(spark):
    rows = [("a", "1", 0, 0), ("a", None, 1, 3), ("b", "2", 2, 4), ("b", "3", 3, 5), ("c", "4", 4, 9)]
    log = spark.createDataFrame(rows, "key string, value string, seq long, gen long")
    merged = compact.compact_partial(log, F.col("gen").between(3, 5))
    assert sorted(pairs(resolve.scan(merged))) == [("b", "3"), ("c", "4")]
    assert merged.count() == 4


def test_ranked(spark):
    keys = [bytearray(random.Random(i).randbytes(i % 5)) for i in range(300)]
    entries = spark.createDataFrame([(k,) for k in keys], "key binary").distinct()
    want = [bytes(k) for k in sorted({bytes(k) for k in keys})]
    for descending in (False, True):
        got = sorted((r.pos, bytes(r.key)) for r in resolve.ranked(entries, descending).collect())
        assert got == [(i + 1, k) for i, k in enumerate(reversed(want) if descending else want)]
    assert resolve.ranked(entries.where("false")).count() == 0


def test_prefixes():
    assert prefix_bounds(b"ab") == (b"ab", b"ac")
    assert prefix_bounds(b"a\xff\xff") == (b"a\xff\xff", b"b")
    assert prefix_bounds(b"\xff") == (b"\xff", None)
    assert component_bounds("Ar1", "Al2") == (b"Ar1\0Al2\0", b"Ar1\0Al2\1")


def test_composite_keys(store):
    tracks = [("Ar1", "Al11", "t1"), ("Ar1", "Al11", "t2"), ("Ar1", "Al12", "t1"), ("Ar1", "Al12", "t2"), ("Ar1", "Al12", "t3"), ("Ar2", "Al21", "t1"), ("Ar2", "Al21", "t2")]
    store.upsert_strings([("\0".join(t), "100") for t in tracks])
    store.flush()
    count = lambda *p: store.get(*component_bounds(*p)).count()
    assert [count("Ar1"), count("Ar2"), count("Ar1", "Al11"), count("Ar1", "Al12"), count("Ar2", "Al21")] == [5, 2, 2, 3, 2]


def test_against_a_dict(spark, tmp_path):
    rnd, model, s = random.Random(7), {}, Store(spark, str(tmp_path / "kv"))
    for _ in range(12):
        batch = {f"k{rnd.randrange(40):03d}": None if rnd.random() < 0.3 else str(rnd.random()) for _ in range(15)}
        s.upsert_strings(list(batch.items()))
        model.update(batch)
        move = rnd.random()
        if move < 0.6:
            s.flush()
        if move < 0.2:
            s.compact()
        if move > 0.9:
            s.close()
            s = Store(spark, str(tmp_path / "kv"))
    assert pairs(s.strings()) == sorted((k, v) for k, v in model.items() if v is not None)


def test_streaming_ingest_and_replay(spark, store, tmp_path):
    source = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame([(f"k{j}", f"{i}") for j in range(i, 5)], "key string, value string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("key string, value string").option("maxFilesPerTrigger", 1).parquet(str(source)).select(encode("key").alias("key"), encode("value").alias("value"))
        ingest(stream, store, "s", str(tmp_path / "cp"), compact_at=3).awaitTermination()
    assert pairs(store.strings()) == [("k0", "0"), ("k1", "1"), ("k2", "2"), ("k3", "2"), ("k4", "2")]
    version = store.snapshot().manifest.version
    store.upsert_strings([("k0", "replayed")])
    assert store.flush(batch=("s", 0)).version == version
    assert ("k0", "0") in pairs(store.strings())


class Crash(Exception):
    pass


def crash(*_, **__):
    raise Crash


@pytest.mark.parametrize("step", ["files", "manifest", "rename", "unstage"])
def test_crash_while_flushing(spark, store, tmp_path, monkeypatch, step):
    """Whatever step a writer dies at, a reader sees the whole flush or nothing of it, and the next writer goes on."""
    store.upsert_strings([("a", "1"), ("b", "1")])
    store.flush()
    store.upsert_strings([("a", "2"), ("c", "2")])
    with monkeypatch.context() as m:
        if step == "files":
            m.setattr(store, "_describe", crash)  # the files are there, nothing names them
        elif step == "manifest":
            m.setattr(store.manifests, "publish", crash)
        elif step == "rename":
            m.setattr(store.manifests, "_context", type("Context", (), {"rename": crash}))  # the manifest has its temporary name
        else:
            m.setattr(store, "_unstage", crash)  # published, but the writer never hears of it
        with pytest.raises(Crash):
            store.flush()
    again = Store(spark, str(tmp_path / "kv"))
    old, new = [("a", "1"), ("b", "1")], [("a", "2"), ("b", "1"), ("c", "2")]
    assert pairs(again.strings()) == (new if step == "unstage" else old)
    again.upsert_strings([("a", "2"), ("c", "2")])
    again.flush()
    assert pairs(again.strings()) == new and pairs(Store(spark, str(tmp_path / "kv")).strings()) == new


@pytest.mark.parametrize("step", ["files", "manifest", "rename"])
def test_crash_while_compacting(spark, store, tmp_path, monkeypatch, step):
    for i in range(3):
        store.upsert_strings([("a", str(i)), (f"b{i}", str(i)), (f"b{i - 1}", None)])
        store.flush()
    before = pairs(store.strings())
    with monkeypatch.context() as m:
        if step == "files":
            m.setattr(store, "_describe", crash)
        elif step == "manifest":
            m.setattr(store.manifests, "publish", crash)
        else:
            m.setattr(store.manifests, "_context", type("Context", (), {"rename": crash}))
        with pytest.raises(Crash):
            store.compact()
    again = Store(spark, str(tmp_path / "kv"))
    assert pairs(again.strings()) == before == [("a", "2"), ("b2", "2")] and len(again.snapshot().manifest.generations) == 3
    assert again.compact().compacted and pairs(again.strings()) == before


def test_families_compression_and_bloom_filters(spark, tmp_path):
    """Families of one root don't see each other; the options reach the files."""
    from pyarrow import parquet

    size = {}
    for family, bloom, compression in (("x", True, "snappy"), ("y", False, "gzip")):
        s = Store(spark, str(tmp_path / "kv"), family=family, bloom=bloom, compression=compression)
        s.upsert_strings([(f"{i:0300d}", family) for i in range(5000)])
        s.flush()
        assert {v for _, v in pairs(s.strings())} == {family} and pairs(s.strings(f"{7:0300d}", f"{8:0300d}")) == [(f"{7:0300d}", family)]
        files = list((tmp_path / "kv" / family / "data").rglob("*.parquet"))
        assert {parquet.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {compression.upper()}
        part = parquet.ParquetFile(files[0]).metadata.row_group(0)
        size[family] = files[0].stat().st_size - sum(part.column(i).total_compressed_size for i in range(part.num_columns))
    assert size["x"] > size["y"] + 1000  # the filter lies beside the columns


def test_compaction_with_staged_rows(store):
    store.upsert_strings([("a", "1"), ("b", "1")])
    store.flush()
    store.upsert_strings([("a", None), ("c", "2")])
    assert len(store.compact().generations) == 1 and pairs(store.snapshot().all()) == [(bytearray(b"a"), bytearray(b"1")), (bytearray(b"b"), bytearray(b"1"))]
    made = store.compact(include_staged=True)
    assert made.compacted and made.generations[0].n_rows == 2 and pairs(store.strings()) == [("b", "1"), ("c", "2")]


def test_staged_rows_are_evaluated_once(spark, tmp_path):
    """A source that differs each time it is read gives what it gave when it was staged; files follow the size of what is staged."""
    s = Store(spark, str(tmp_path / "kv"), target_file_bytes=20_000)
    s.upsert(spark.range(2000).select(encode(F.col("id").cast("string")).alias("key"), encode(F.uuid()).alias("value")))
    before = pairs(s.strings())
    s.flush()
    assert pairs(s.strings()) == before
    assert len(list((tmp_path / "kv" / "default" / "data").rglob("*.parquet"))) > 2 and not any((tmp_path / "kv" / "default" / "staged").iterdir())


def test_another_order_of_keys(spark):
    """A comparator is an expression: here numbers as numbers."""
    entries = spark.createDataFrame([(str(i),) for i in (10, 9, 100, 1)], "key string")
    read = lambda **o: [r.key for r in resolve.ordered(entries, **o).collect()]
    assert read() == ["1", "10", "100", "9"]
    assert read(by=F.col("key").cast("int")) == ["1", "9", "10", "100"] == read(by=F.col("key").cast("int"), descending=True)[::-1]
