"""Exact deduplication by content-defined chunk recipes, with native expressions only.

A text is cut where its own characters say so, so equal passages give equal
chunks wherever they stand. Chunks are deduplicated to identifiers: the 64-bit
hash of a chunk, which one shuffle of the distinct chunks verifies; the rare
hashes that several chunks share get an ordinal per chunk. A document is then
the ordered list of its identifiers, and only these short lists are grouped and
joined; the texts themselves move once at most, as distinct chunks.

Defined results: a null text is an empty text; rows without an id are always
kept, as nothing could name them, and never are another row's keep_id; rows that
repeat both id and text are one document listed twice and get the same decision;
an empty table gives no rows. exact_groups() reads the id and the text and
returns no other column of the caller; exact_dedup() returns all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutalog.llm.shared import SPACES, text_of, unused, written

#: Least and most characters of a chunk; a cut falls behind the first place in between that CUT matches.
MIN_CHUNK, MAX_CHUNK = 1024, 8192
CUT = "[acegikmoqsuwyäéíóñ][a-m] [a-g]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def chunks(text: Column) -> Column:
    """The text as an array of chunks; joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?<={CUT})|.{{1,{MAX_CHUNK}}}"), F.lit(0))


def _identified(df: DataFrame, hashed) -> DataFrame:
    """df with __ids, the ordered verified identifiers of the chunks of __text."""
    distinct = df.select(F.explode(chunks(F.col("__text"))).alias("chunk")).select(hashed(F.col("chunk")).alias("h"), "chunk").distinct()
    clashing = written(distinct.withColumn("n", F.lit(1)).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    ids = df.withColumn("__ids", F.transform(chunks(F.col("__text")), lambda c: F.struct(hashed(c).alias("h"), F.lit(0).cast("long").alias("ordinal"))))
    if clashing.isEmpty():
        return ids
    # several chunks under one hash: their order tells them apart
    order = F.row_number().over(Window.partitionBy("h").orderBy("chunk")).cast("long")
    ordinals = distinct.join(clashing, "h", "left_semi").withColumn("ordinal", order)
    numbered = df.withColumn("__row", F.struct(F.xxhash64("__text"), F.md5(F.col("__text").cast("binary")), F.octet_length("__text")))
    texts = numbered.select("__row", "__text").distinct()
    placed = texts.select("__row", F.posexplode(chunks(F.col("__text"))).alias("i", "chunk")).withColumn("h", hashed(F.col("chunk")))
    placed = placed.join(ordinals, ["h", "chunk"], "left").select("__row", F.struct("i", "h", F.coalesce("ordinal", F.lit(0).cast("long")).alias("ordinal")).alias("c"))
    lists = placed.groupBy("__row").agg(F.transform(F.sort_array(F.collect_list("c")), lambda c: F.struct(c["h"].alias("h"), c["ordinal"].alias("ordinal"))).alias("__list"))
    empty = F.array().cast("array<struct<h:bigint,ordinal:bigint>>")
    return numbered.join(lists, "__row", "left").withColumn("__ids", F.coalesce("__list", empty)).drop("__row", "__list")


def recipes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed=F.xxhash64) -> DataFrame:
    """Per row: the id, the recipe (ordered verified chunk identifiers) and the digest of the normalised text."""
    texts = df.select(F.col(id_col), normalised(text_of(text_col)).alias("__text"))
    return _identified(texts, hashed).select(id_col, F.col("__ids").alias("recipe"), F.sha2(F.col("__text").cast("binary"), 256).alias("text_sha256"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed=F.xxhash64) -> DataFrame:
    """One row per row of df: id, keep_id (smallest id of its equals), group_size, kept, text_sha256."""
    rows = written(recipes(df, id_col, text_col, hashed))
    # written, so that the join has an exchange on either side and the recipe of a large group can be split
    groups = written(rows.groupBy("recipe").agg(F.min(id_col).alias("keep_id"), F.count("*").alias("group_size")))
    joined = rows.join(groups, "recipe")
    kept = F.coalesce(F.col(id_col) == F.col("keep_id"), F.lit(True))
    return joined.select(id_col, "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, all their columns untouched."""
    drop = unused(df, "__drop")
    gone = exact_groups(df, id_col, text_col).where("not kept").select(F.col(id_col).alias(drop)).distinct()
    return df.join(gone, F.col(id_col) == F.col(drop), "left_anti")
