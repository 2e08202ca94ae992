"""Every registered query of the key-value engine with its SQL twin.

`events` is read as a mutation log: key from user_id, seq from event_id (unique),
'error' rows are deletes, a generation is 1000 events and expiry is ts plus
event_id % 30 days.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutalog.functions.codec import component_bounds, decode, encode, padded_key
from mutalog.operators import compact, resolve
from mutalog.sources.folders import fresh
from mutalog.sources.store import Snapshot, Store

NOW = datetime(2024, 1, 31)
LOW, HIGH = "k0000000007", "k0000000101"
_NOW_SQL = "timestamp '2024-01-31 00:00:00'"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, value, seq, gen, expires_at; expiry is computed in UTC whatever the session's time zone."""
    e = _table(spark, sf_dir, "events")
    return e.select(
        padded_key(F.col("user_id")).alias("key"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.col("event_id").alias("seq"),
        F.floor(F.col("event_id") / 1000).cast("bigint").alias("gen"),
        (F.col("ts") + F.make_dt_interval(days=(F.col("event_id") % 30).cast("int"))).alias("expires_at"),
    )


def _kv(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(event_log(spark, sf_dir))


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("key", "value")


def _multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _table(spark, sf_dir, "customer").select(padded_key(F.col("c_custkey")).alias("key")).distinct()
    return _pairs(resolve.multi_get(event_log(spark, sf_dir), wanted))


def _rank(df: DataFrame, descending: bool) -> DataFrame:
    return resolve.ranked(df, descending).select("pos", "key", "value")


def _gen_merge(log: DataFrame) -> DataFrame:
    """Runs first, then across runs: the same state as resolving once."""
    return resolve.latest(resolve.per_generation(log)).select("key", "seq", "gen", "value")


def _newest_gen(log: DataFrame) -> int:
    return log.agg(F.coalesce(F.max("gen"), F.lit(0))).first()[0]


def _snapshot_gen(log: DataFrame) -> DataFrame:
    """What was visible when half of the generations were there."""
    return _pairs(resolve.scan(resolve.as_of(log, _newest_gen(log) // 2)))


def _compact_partial(log: DataFrame) -> DataFrame:
    """The log, with its middle half of generations merged: what is there, deletes included."""
    top = _newest_gen(log)
    return compact.compact_partial(log, F.col("gen").between(top // 4, 3 * top // 4)).select("key", "seq", "gen", "value")


def _point_get_deleted(log: DataFrame) -> DataFrame:
    """The least deleted key: how many versions it has, and how many rows a point read of it gives."""
    key = resolve.tombstones(log).agg(F.min("key")).first()[0]
    read = resolve.point_get(log, key).agg(F.count("*").alias("found"))
    return log.where(F.col("key") == F.lit(key)).agg(F.first("key").alias("key"), F.count("*").alias("versions")).crossJoin(read)


#: Flushes that load `events` into a store, oldest events first.
FLUSHES = 4


def _binary(log: DataFrame) -> DataFrame:
    return log.select(encode("key").alias("key"), encode(F.col("value").cast("string")).alias("value"), "seq", "expires_at")


def _entries(df: DataFrame) -> DataFrame:
    return df.select(decode("key").alias("key"), decode("value").cast("double").alias("value"))


def _quarter(log: DataFrame) -> DataFrame:
    """log with part, its events in FLUSHES stretches of about as many numbers."""
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    return log.withColumn("part", F.floor(F.col("seq") * FLUSHES / (top + 1)).cast("int"))


def _loaded(spark: SparkSession, sf_dir: str, parts: range = range(FLUSHES), **options) -> Store:
    """A store in the shared folder with a generation for each of these parts of events."""
    store, log = Store(spark, fresh(spark), **options), _quarter(event_log(spark, sf_dir))
    for part in parts:
        store.upsert(_binary(log.where(F.col("part") == part)), order=F.col("seq"))
        store.flush()
    return store


def _store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(_loaded(spark, sf_dir).get(LOW.encode(), HIGH.encode()))


def _store_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three generations with the newest events on top, not flushed."""
    store = _loaded(spark, sf_dir, range(FLUSHES - 1))
    store.upsert(_binary(_quarter(event_log(spark, sf_dir)).where(F.col("part") == FLUSHES - 1)), order=F.col("seq"))
    return _entries(store.get())


def _store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compacted without what has expired, then flushed into again, and compacted with what was staged."""
    store = _loaded(spark, sf_dir, range(FLUSHES - 1))
    store.compact()
    store.upsert(_binary(_quarter(event_log(spark, sf_dir)).where(F.col("part") == FLUSHES - 1)), order=F.col("seq"))
    store.compact(now=NOW, include_staged=True)
    return _entries(store.snapshot().all())


def _store_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that was published when half of the events were in, read after a compaction."""
    store = _loaded(spark, sf_dir)
    store.compact()
    return _entries(store.snapshot(FLUSHES // 2).all())


def _store_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two families of one store, with Bloom filters and other compression, read apart and put together."""
    root, log, parts = fresh(spark), event_log(spark, sf_dir), []
    for family, odd in (("even", 0), ("odd", 1)):
        store = Store(spark, root, family=family, bloom=True, compression="snappy")
        store.upsert(_binary(log.where(F.col("seq") % 2 == odd)), order=F.col("seq"))
        store.flush()
        parts.append(_entries(store.get(now=NOW)).withColumn("family", F.lit(family)))
    return parts[0].unionByName(parts[1])


def _store_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in, then the keys of one market segment's customers deleted, some of which were never there."""
    store = _loaded(spark, sf_dir)
    gone = _table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(encode(padded_key(F.col("c_custkey"))).alias("key"))
    store.delete(gone)
    store.flush()
    return _entries(store.get())


def _store_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(encode(padded_key(F.col("c_custkey"))).alias("key"))
    return _entries(_loaded(spark, sf_dir).view().multi_get(wanted, NOW))


def _store_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest says of each generation against what the files hold."""
    store = _loaded(spark, sf_dir)
    snapshot = store.snapshot()
    said = spark.createDataFrame([(g.id, g.n_rows, g.n_tombstones, bytes.fromhex(g.min_key).decode(), bytes.fromhex(g.max_key).decode()) for g in snapshot.manifest.generations], "gen long, n_rows long, n_tombstones long, min_key string, max_key string")
    held = Snapshot(spark, snapshot.manifest).log().groupBy("gen").agg(F.count("*").alias("held"))
    return said.join(held, "gen")


def _composite_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    packed = c.select("c_mktsegment", F.concat_ws("\0", "c_mktsegment", F.col("c_custkey").cast("string")).alias("key"))
    low, high = F.concat("c_mktsegment", F.lit("\0")), F.concat("c_mktsegment", F.lit("\1"))
    inside = packed.where((F.col("key") >= low) & (F.col("key") < high))
    return inside.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def _component_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one segment by a range of packed binary keys."""
    low, high = component_bounds("BUILDING")
    c = _table(spark, sf_dir, "customer").select(encode(F.concat_ws("\0", "c_mktsegment", F.col("c_custkey").cast("string"))).alias("key"), "c_custkey", "c_acctbal")
    return c.where(resolve.half_open(bytearray(low), bytearray(high))).select("c_custkey", "c_acctbal")


def _orders_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = resolve.latest(_table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return newest.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


def _lineitem_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest shipment of each part and supplier: a composite key with ties broken by order and line."""
    newest = resolve.latest(_table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_extendedprice"), F.desc("l_quantity")])
    return newest.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


def _state_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live entries by the nation of their customer: what a store is read for."""
    live = resolve.scan(event_log(spark, sf_dir), now=NOW)
    c = _table(spark, sf_dir, "customer").select(padded_key(F.col("c_custkey")).alias("key"), "c_nationkey")
    n = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = live.join(c, "key").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n_keys"), F.round(F.sum("value"), 4).alias("total"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "kv_all": _kv(lambda g: _pairs(resolve.scan(g))),
    "kv_range": _kv(lambda g: _pairs(resolve.scan(g, LOW, HIGH))),
    "kv_range_inverted": _kv(lambda g: _pairs(resolve.scan(g, HIGH, LOW))),
    "kv_all_from": _kv(lambda g: _pairs(resolve.scan(g, HIGH))),
    "kv_all_to": _kv(lambda g: _pairs(resolve.scan(g, None, LOW))),
    "kv_point_get": _kv(lambda g: _pairs(resolve.point_get(g, "k0000000011"))),
    "kv_point_get_deleted": _kv(_point_get_deleted),
    "kv_multi_get": _multi_get,
    "kv_prefix_count": _kv(lambda g: resolve.scan(g, "k00000000", "k00000001").agg(F.count("*").alias("n"))),
    "kv_ceiling": _kv(lambda g: _pairs(resolve.ceiling(g, "k0000000050"))),
    "kv_ordered_rank": _kv(lambda g: _rank(resolve.scan(g), False)),
    "kv_reverse_rank": _kv(lambda g: _rank(resolve.scan(g), True)),
    "kv_ttl_all": _kv(lambda g: _pairs(resolve.scan(g, now=NOW))),
    "kv_ttl_range": _kv(lambda g: _pairs(resolve.scan(g, LOW, HIGH, NOW))),
    "kv_ttl_point_get": _kv(lambda g: _pairs(resolve.point_get(g, "k0000000011", NOW))),
    "kv_skip": _kv(lambda g: _pairs(resolve.scan(g, now=NOW, skip=F.col("value") < 50))),
    "kv_snapshot_gen": _kv(_snapshot_gen),
    "kv_gen_merge": _kv(_gen_merge),
    "kv_compact_full": _kv(lambda g: compact.compact_full(g).select("key", "seq", "gen", "value")),
    "kv_compact_purge": _kv(lambda g: compact.compact_full(g, NOW).select("key", "seq", "gen", "value")),
    "kv_compact_partial": _kv(_compact_partial),
    "kv_tombstones": _kv(lambda g: resolve.tombstones(g).select("key", "seq")),
    "kv_shadowed": _kv(lambda g: resolve.shadowed(g).groupBy("gen").agg(F.count("*").alias("n"))),
    "kv_gen_stats": _kv(lambda g: compact.generation_stats(g).drop("max_expiry")),
    "kv_size_bytes": _kv(lambda g: compact.size_bytes(resolve.latest(g), F.octet_length("key"), F.when(F.col("value").isNotNull(), 8))),
    "kv_latest_value": _kv(lambda g: resolve.latest_value(g.select("key", "value", "seq")).where("value is not null")),
    "kv_state_by_nation": _state_join,
    "kv_composite_prefix": _composite_prefix,
    "kv_component_scan": _component_scan,
    "kv_orders_latest_per_customer": _orders_latest,
    "kv_lineitem_latest": _lineitem_latest,
    "kv_store_range": _store_range,
    "kv_store_staged": _store_staged,
    "kv_store_compacted": _store_compacted,
    "kv_store_as_of": _store_as_of,
    "kv_store_family": _store_family,
    "kv_store_deleted": _store_deleted,
    "kv_store_multi_get": _store_multi_get,
    "kv_store_generations": _store_generations,
}

_CTE = """with log as (
  select 'k' || lpad(cast(user_id as varchar), 10, '0') as key, event_id as seq,
         case when event_type <> 'error' then value end as value,
         cast(floor(event_id / 1000) as bigint) as gen,
         ts + to_days(cast(event_id % 30 as integer)) as expires_at
  from events{where}),
ranked as (select *, row_number() over (partition by key order by seq desc) as rn from log),
newest as (select key, seq, value, gen, expires_at from ranked where rn = 1),
live as (select key, seq, value, gen, expires_at from newest where value is not null),
fresh as (select * from live where expires_at is null or expires_at > {now})
"""


def _sql(body: str, where: str = "") -> str:
    return _CTE.format(where=where, now=_NOW_SQL) + body


_PARTS = f", parts as (select *, cast(floor(seq * {FLUSHES} / ((select max(seq) from log) + 1)) as int) as part from log)"
_BUILDING = "(select 'k' || lpad(cast(c_custkey as varchar), 10, '0') from customer where c_mktsegment = 'BUILDING')"

ORACLES: dict[str, str] = {
    "kv_all": _sql("select key, value from live"),
    "kv_range": _sql(f"select key, value from live where key >= '{LOW}' and key < '{HIGH}'"),
    "kv_range_inverted": _sql(f"select key, value from live where key >= '{HIGH}' and key < '{LOW}'"),
    "kv_all_from": _sql(f"select key, value from live where key >= '{HIGH}'"),
    "kv_all_to": _sql(f"select key, value from live where key < '{LOW}'"),
    "kv_point_get": _sql("select key, value from live where key = 'k0000000011'"),
    "kv_point_get_deleted": _sql("select key, count(*) as versions, (select count(*) from live where key = l.key) as found from log l where key = (select min(key) from newest where value is null) group by key"),
    "kv_multi_get": _sql("select key, value from live where key in (select 'k' || lpad(cast(c_custkey as varchar), 10, '0') from customer)"),
    "kv_prefix_count": _sql("select count(*) as n from live where key >= 'k00000000' and key < 'k00000001'"),
    "kv_ceiling": _sql("select key, value from live where key >= 'k0000000050' order by key limit 1"),
    "kv_ordered_rank": _sql("select cast(row_number() over (order by key) as bigint) as pos, key, value from live"),
    "kv_reverse_rank": _sql("select cast(row_number() over (order by key desc) as bigint) as pos, key, value from live"),
    "kv_ttl_all": _sql("select key, value from fresh"),
    "kv_ttl_range": _sql(f"select key, value from fresh where key >= '{LOW}' and key < '{HIGH}'"),
    "kv_ttl_point_get": _sql("select key, value from fresh where key = 'k0000000011'"),
    "kv_skip": _sql("select key, value from fresh where not value < 50"),
    "kv_snapshot_gen": _sql("select key, value from live", " where floor(event_id / 1000) <= floor((select floor(max(event_id) / 1000) from events) / 2)"),
    "kv_gen_merge": _sql("select key, seq, gen, value from newest"),
    "kv_compact_full": _sql("select key, seq, gen, value from live"),
    "kv_compact_purge": _sql("select key, seq, gen, value from fresh"),
    "kv_compact_partial": _sql("""
, g as (select *, gen between floor(top / 4) and floor(3 * top / 4) as chosen from log, (select max(gen) as top from log) t)
select key, seq, gen, value from (select *, row_number() over (partition by key, chosen order by seq desc) as rn from g) r where rn = 1 or not chosen"""),
    "kv_tombstones": _sql("select key, seq from newest where value is null"),
    "kv_shadowed": _sql("select gen, count(*) as n from ranked where rn > 1 group by gen"),
    "kv_gen_stats": _sql("select gen, min(key) as min_key, max(key) as max_key, count(*) as n_rows, cast(sum(case when value is null then 1 else 0 end) as bigint) as n_tombstones, min(seq) as min_seq, max(seq) as max_seq from log group by gen"),
    "kv_size_bytes": _sql("select cast(sum(length(key) + case when value is null then 0 else 8 end) as bigint) as bytes from newest"),
    "kv_latest_value": _sql("select key, value from live"),
    "kv_state_by_nation": _sql("select n_name, count(*) as n_keys, round(sum(value), 4) as total from fresh join customer on key = 'k' || lpad(cast(c_custkey as varchar), 10, '0') join nation on c_nationkey = n_nationkey group by n_name"),
    "kv_composite_prefix": "select c_mktsegment, count(*) as n from customer where c_mktsegment || chr(0) || cast(c_custkey as varchar) >= c_mktsegment || chr(0) and c_mktsegment || chr(0) || cast(c_custkey as varchar) < c_mktsegment || chr(1) group by c_mktsegment",
    "kv_component_scan": "select c_custkey, c_acctbal from customer where c_mktsegment = 'BUILDING'",
    "kv_orders_latest_per_customer": "select o_custkey, o_orderkey, o_orderstatus, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) t where rn = 1",
    "kv_lineitem_latest": "select l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice from (select *, row_number() over (partition by l_partkey, l_suppkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_extendedprice desc, l_quantity desc) as rn from lineitem) t where rn = 1",
    "kv_store_range": _sql(f"select key, value from live where key >= '{LOW}' and key < '{HIGH}'"),
    "kv_store_staged": _sql("select key, value from live"),
    "kv_store_compacted": _sql("select key, value from fresh"),
    "kv_store_as_of": _sql(f"{_PARTS} select key, value from (select *, row_number() over (partition by key order by seq desc) as rn from parts where part < {FLUSHES // 2}) x where rn = 1 and value is not null"),
    "kv_store_family": _sql(f", f as (select *, row_number() over (partition by key, seq % 2 order by seq desc) as rn from log) select key, value, case when seq % 2 = 0 then 'even' else 'odd' end as family from f where rn = 1 and value is not null and expires_at > {_NOW_SQL}"),
    "kv_store_deleted": _sql(f"select key, value from live where key not in {_BUILDING}"),
    "kv_store_multi_get": _sql(f"select key, value from fresh where key in {_BUILDING}"),
    "kv_store_generations": _sql(f"{_PARTS}, r as (select *, row_number() over (partition by part, key order by seq desc) as rn from parts) select cast(part as bigint) as gen, count(*) as n_rows, cast(sum(case when value is null then 1 else 0 end) as bigint) as n_tombstones, min(key) as min_key, max(key) as max_key, count(*) as held from r where rn = 1 group by part"),
}
