"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Row numbers follow from the rows alone (bucket of a hash, then order inside the
bucket), not from how they are read, so every run and every retry gives the
same. The permutation is computed, not stored: place() gives shard and slot of
any row number, and its inverse is a handful of modular steps. Law `rows`:
shard = p % shards, slot = p // shards, so counts differ by one at most and
slots have no gaps.

Defined results: null ids and null texts are values like others; rows equal in
id, size and checksum are interchangeable (which of them gets which of their
places is open, the set of result rows is not); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutalog.llm.shared import apart

ROUNDS = 8
#: Steps that a walk may take. At most sqrt(n) points lie outside, so up to n = 64 ** 2 no walk is longer, and above it one of 64 steps has odds below 64 ** -64.
WALK = 64


def permuted(row: Column, total: Column, seed: int = 0) -> Column:
    """A permutation of 0 .. total - 1, as a column expression of the row number."""
    root = F.ceil(F.sqrt(total.cast("double"))).cast("long")
    a = F.when(root * root < total, root + 1).otherwise(root)
    b = F.floor((total + a - 1) / a).cast("long")
    b = F.when(a * b < total, b + 1).otherwise(b)

    def feistel(x: Column) -> Column:
        left, right = F.floor(x / b).cast("long"), F.pmod(x, b)
        left = F.when(left * b > x, left - 1).otherwise(left)
        state = F.struct(left.alias("l"), right.alias("r"))

        def step(s: Column, k: Column) -> Column:
            new = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], k, F.lit(seed)), a), a)
            # halves swap roles: the other half moves in the same round
            return F.struct(new.alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(new, k, F.lit(seed + 1)), b), b).alias("r"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), state, step, lambda s: s["l"] * b + s["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), feistel(row), lambda x, _: F.when(x < total, x).otherwise(feistel(x)))
    return F.when(walked < total, walked).otherwise(F.raise_error(F.lit("the cycle walk did not end")).cast("long"))


def place(row: Column, total: Column, shards: int, seed: int = 0) -> Column:
    """struct(shard, slot) of a row number."""
    p = permuted(row, total, seed)
    return F.transform(F.array(p), lambda x: F.struct(F.pmod(x, F.lit(shards)).cast("int").alias("shard"), F.floor(x / shards).cast("long").alias("slot")))[0]


def numbered(df: DataFrame, keys: list[str], ties: list[str], buckets: int = 16_384) -> DataFrame:
    """df (without columns __bucket, __n, __before) with __row, gapless from 0 over the whole table, and __total.

    Rows go to buckets by a hash of keys and are ordered in their bucket by keys
    and ties. The table of bucket sizes has `buckets` rows whatever the input's
    size, so it may be summed in one task and broadcast.
    """
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy("__bucket").agg(F.count("*").alias("__n"))
    sizes = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__total"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(*keys, *ties)).cast("long") - 1
    return df.withColumn("__n", inside).join(F.broadcast(sizes), "__bucket").withColumn("__row", F.col("__n") + F.col("__before")).drop("__bucket", "__n", "__before")


def shuffle_into_shards(df: DataFrame, keys: list[str], ties: list[str], shards: int, seed: int = 0) -> DataFrame:
    """df with shard and slot; law `rows`."""
    df = apart(df, "shard", "slot", "__at", "__bucket", "__n", "__before", "__row", "__total")
    rows = numbered(df, keys, ties).withColumn("__at", place(F.col("__row"), F.col("__total"), shards, seed))
    return rows.withColumns({"shard": F.col("__at.shard"), "slot": F.col("__at.slot")}).drop("__at", "__row", "__total")


def write_shards(df: DataFrame, path: str, shards: int) -> None:
    """One sorted run of files per shard below path."""
    df.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
