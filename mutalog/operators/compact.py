"""Compaction as relational expressions over generations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutalog.operators.resolve import latest, visible


def compact_full(log: DataFrame, now: datetime | None = None) -> DataFrame:
    """All generations into one: newest versions only, without deletes and, given now, expired entries."""
    return visible(latest(log), now)


def compact_partial(log: DataFrame, chosen: Column) -> DataFrame:
    """Merges the chosen generations and leaves the others alone.

    Deletes and expired versions of the chosen ones stay, since older
    generations outside the choice may hold versions that they hide.
    """
    picked = F.coalesce(chosen, F.lit(False))
    return latest(log.where(picked)).unionByName(log.where(~picked))


def generation_stats(log: DataFrame) -> DataFrame:
    """What a manifest keeps of each generation, to prune it and to tell whether compaction pays."""
    return log.groupBy("gen").agg(
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.count("*").alias("n_rows"),
        F.sum(F.col("value").isNull().cast("long")).alias("n_tombstones"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
        F.max("expires_at").alias("max_expiry"),
    )


def size_bytes(state: DataFrame, key_size: Column | None = None, value_size: Column | None = None) -> DataFrame:
    """Key plus value bytes of the newest versions; a delete counts its key only."""
    key_size = F.octet_length("key") if key_size is None else key_size
    value_size = F.octet_length("value") if value_size is None else value_size
    return state.agg(F.coalesce(F.sum(key_size + F.coalesce(value_size, F.lit(0))), F.lit(0)).cast("long").alias("bytes"))
