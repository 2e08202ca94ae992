"""A training corpus from raw documents, in five stages.

Each stage reads all that its predecessor kept, as Parquet, and returns the
columns of documents; the last returns the encoded corpus. SQL can express
neither the classifier nor the fingerprints nor the encoding, so ORACLE_SQL is
None and tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mutalog.llm import bpe, mixing, quality, simhash
from mutalog.llm.exact_dedup import exact_dedup
from mutalog.sources.folders import last_one_kept, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A mild flattening of sources, languages and topics that keeps most of the corpus.
TEMPERATURE, RATE = 0.85, 0.85


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without what the quality classifier rejects: what scores below its cut, which is 0.7 at most and lower if trusted documents would go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs.select(COLUMNS), model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs.select(COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.near_dedup(docs.select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens approach the target weights."""
    return mixing.mix(docs.select(COLUMNS), TEMPERATURE, RATE).where("kept").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and the digests of ids and of what they decode to."""
    return bpe.round_trip(docs.select("doc_id", "source", "lang", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", classify),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each result written and read again; what a stage has written on the way is deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with last_one_kept(spark):
            docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
