"""What several operators need: Arrow batches of bounded size, and column helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutalog.sources.folders import written as written

#: White space of the text contracts: space and the controls 9 to 13.
SPACES = r"[ \t\n\x0B\f\r]+"


#: Bytes of an Arrow batch: workers hold a few at a time, whatever the length of the texts.
BATCH_BYTES = 8 << 20


def in_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow() with batches of at most BATCH_BYTES (or one row).

    Spark reads that bound when the plan runs, not here, so it is set in the
    session and stays: Arrow batches of later queries have it too, which changes
    no result.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(to_the_end, schema)


def give_back() -> None:
    """Returns what this process has freed to the system, where its C library can: a worker that waits for its next task counts in its executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def apart(df: DataFrame, *names: str) -> DataFrame:
    """df with the columns out of the way that an operator adds: a column of the caller under such a name (whatever its case) goes on as <name>_input."""
    taken = {c.lower() for c in df.columns}
    for old in [c for c in df.columns if c.lower() in {n.lower() for n in names}]:
        new = f"{old}_input"
        while new.lower() in taken:
            new += "_input"
        taken.add(new.lower())
        df = df.withColumnRenamed(old, new)
    return df


def unused(df: DataFrame, name: str) -> str:
    """name, or the first longer one that isn't a column of df: for a column that is dropped again."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
