"""Structured Streaming into a store: each micro-batch becomes one generation, once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from mutalog.sources.store import Store


def ingest(stream: DataFrame, store: Store, name: str, checkpoint: str, order: Column | None = None, compact_at: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Starts writing stream (key, value and optionally expires_at) to store.

    A replayed micro-batch has the number of the first try and is skipped, so
    the sink is idempotent. Back-pressure is the source's maxFilesPerTrigger or
    maxBytesPerTrigger. compact_at: generations at which to compact.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.upsert(batch, order=order)
        store.flush(batch=(name, number))
        if compact_at:
            store.compact_if(compact_at)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
