"""Newest version per key, then what of it is visible.

The order matters: resolving first and filtering afterwards. A filter on value
or expiry put before latest() would bring deleted keys back. A filter on key
alone commutes with it, and Catalyst pushes it down to the scan by itself.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutalog.sources.folders import written


def latest(log: DataFrame, keys: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """The newest row of each key, all columns kept.

    row_number() = 1 plans as WindowGroupLimit, which keeps one row of a key in
    each map task before the shuffle, so a key with a third of all versions
    costs its reducer one row a task. Rows that tie in order are told apart by
    nothing: give an order that is unique within a key.
    """
    keys = keys or ["key"]
    order = order or [F.desc("gen"), F.desc("seq")]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return log.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def latest_value(log: DataFrame, value: str = "value", order: str = "seq", key: str = "key") -> DataFrame:
    """latest() for one fixed-width payload: max_by in a HashAggregate with partial sums on the map side."""
    return log.groupBy(key).agg(F.max_by(value, order).alias(value))


def is_visible(now: datetime | None = None, skip: Column | None = None) -> Column:
    """Not deleted and, at now, not expired; an entry that expires at now is dead. now None: nothing expires. skip: hides what else it is true for."""
    alive = F.col("value").isNotNull()
    if now is not None:
        alive = alive & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now)))
    return alive if skip is None else alive & ~F.coalesce(skip, F.lit(False))


def visible(state: DataFrame, now: datetime | None = None, skip: Column | None = None) -> DataFrame:
    return state.where(is_visible(now, skip))


def half_open(low=None, high=None, key: str = "key") -> Column:
    """low <= key < high; a bound of None is open. An inverted range is empty."""
    bound = F.lit(True)
    if low is not None:
        bound = bound & (F.col(key) >= F.lit(low))
    if high is not None:
        bound = bound & (F.col(key) < F.lit(high))
    return bound


def scan(log: DataFrame, low=None, high=None, now: datetime | None = None, skip: Column | None = None) -> DataFrame:
    """Visible entries with low <= key < high, in no order; see ordered(). A skipped version still hides older ones."""
    return visible(latest(log.where(half_open(low, high))), now, skip)


def point_get(log: DataFrame, key, now: datetime | None = None) -> DataFrame:
    """Zero or one row."""
    return visible(latest(log.where(F.col("key") == F.lit(key))), now)


def multi_get(log: DataFrame, wanted: DataFrame, now: datetime | None = None) -> DataFrame:
    """The visible entries of the keys in wanted: one job for a whole batch of point reads."""
    return visible(latest(log.join(wanted.select("key"), "key", "left_semi")), now)


def as_of(log: DataFrame, gen: int) -> DataFrame:
    """The log as it was when generation gen was the newest."""
    return log.where(F.col("gen") <= gen)


def ordered(entries: DataFrame, descending: bool = False, by: Column | None = None) -> DataFrame:
    """Total order by key, or by another order of keys given as an expression: a range-partitioned sort."""
    by = F.col("key") if by is None else by
    return entries.orderBy(by.desc() if descending else by.asc())


#: Ranges that ranked() cuts the keys into, and keys that it draws to place the cuts.
RANGES, DRAWN = 64, 4096


def _place(cuts: list, first: int = 0) -> Column:
    """How many of the ascending cuts are not above key, by halving."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(F.col("key") < F.lit(cuts[mid]), _place(cuts[:mid], first)).otherwise(_place(cuts[mid + 1 :], first + mid + 1))


def ranked(entries: DataFrame, descending: bool = False) -> DataFrame:
    """entries (unique keys) with pos, the place of each in key order, from 1.

    No task sees all entries: rows are numbered inside RANGES ranges of keys, and
    the sizes of the ranges before are added. Cuts come from the keys of the
    least hashes. The entries are written first, as they are read three times.
    """
    entries = written(entries)
    drawn = [r.key for r in entries.select("key").orderBy(F.xxhash64("key"), "key").limit(DRAWN).collect()]
    drawn.sort()
    cuts = sorted({drawn[len(drawn) * i // RANGES] for i in range(1, RANGES)}) if drawn else []
    placed = entries.withColumn("__range", _place(cuts))
    sizes = {r["__range"]: r["count"] for r in placed.groupBy("__range").count().collect()}
    before, at = [0] * (len(cuts) + 1), 0
    for i in sorted(range(len(before)), reverse=descending):
        before[i], at = at, at + sizes.get(i, 0)
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(F.desc("key") if descending else F.asc("key")))
    offset = F.element_at(F.array(*(F.lit(n).cast("long") for n in before)), F.col("__range") + 1)
    return placed.withColumn("pos", inside + offset).drop("__range")


def ceiling(log: DataFrame, low, now: datetime | None = None) -> DataFrame:
    """The first visible entry with key >= low (TakeOrderedAndProject: no full sort)."""
    return scan(log, low, None, now).orderBy("key").limit(1)


def per_generation(log: DataFrame) -> DataFrame:
    """One version of each key in each generation, as sorted runs hold it."""
    return latest(log, ["gen", "key"], [F.desc("seq")])


def tombstones(log: DataFrame) -> DataFrame:
    """Keys whose newest version is a delete."""
    return latest(log).where(F.col("value").isNull())


def shadowed(log: DataFrame) -> DataFrame:
    """Versions that a newer one hides: what a full compaction reclaims."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("gen"), F.desc("seq")))
    return log.withColumn("__rank", rank).where("__rank > 1").drop("__rank")
