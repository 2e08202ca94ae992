"""A store: staged mutations, sorted generations, snapshots and compaction.

Writers stage DataFrames, each written once as it comes, and flush() merges them
into one Parquet generation sorted by key; nothing is visible to other sessions
before its manifest is published.
Readers pin one manifest, so a scan never changes under them. Everything that
touches rows is a DataFrame; the driver handles manifests alone.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable
from dataclasses import replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mutalog.functions.codec import as_strings, encode, prefix_bounds
from mutalog.operators import resolve
from mutalog.operators.compact import compact_full
from mutalog.schema import MUTATION
from mutalog.sources.manifest import CommitConflict, Generation, Manifest, ManifestLog


class Snapshot:
    """One manifest version as a DataFrame source; staged rows of the session on top, if given."""

    def __init__(self, spark: SparkSession, manifest: Manifest, staged: list[DataFrame] | None = None):
        self.spark, self.manifest, self.staged = spark, manifest, list(staged or [])

    def log(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """All versions whose generation can hold keys in [low, high); others aren't opened."""
        paths = [g.path for g in self.manifest.generations if g.meets(low, high)]
        parts = [self.spark.read.schema(MUTATION).parquet(*paths)] if paths else []
        top = self.manifest.next_gen
        parts += [df.withColumn("gen", F.lit(top + i).cast("long")) for i, df in enumerate(self.staged)]
        if not parts:
            return self.spark.createDataFrame([], MUTATION)
        return reduce(DataFrame.unionByName, parts)

    def get(self, low: bytes | None = None, high: bytes | None = None, now: datetime | None = None) -> DataFrame:
        """Visible entries in [low, high), not ordered; resolve.ordered() sorts them."""
        rows = self.log(low, high).where(resolve.half_open(low, high))
        if self.manifest.compacted and not self.staged:  # unique keys: no resolution, no shuffle
            return resolve.visible(rows, now).select("key", "value")
        return resolve.visible(resolve.latest(rows), now).select("key", "value")

    def all(self, now: datetime | None = None) -> DataFrame:
        return self.get(None, None, now)

    def prefix(self, prefix: bytes, now: datetime | None = None) -> DataFrame:
        return self.get(*prefix_bounds(prefix), now)

    def point(self, key: bytes, now: datetime | None = None) -> DataFrame:
        rows = self.log(key, key + b"\0").where(F.col("key") == F.lit(bytearray(key)))
        return resolve.visible(resolve.latest(rows), now).select("key", "value")

    def multi_get(self, wanted: DataFrame, now: datetime | None = None) -> DataFrame:
        return resolve.multi_get(self.log(), wanted, now).select("key", "value")


class Store:
    """flush_threshold_bytes: staged bytes above which upsert() flushes; None: only flush() does."""

    def __init__(self, spark: SparkSession, root: str, flush_threshold_bytes: int | None = None, family: str = "default", target_file_bytes: int = 256 << 20, bloom: bool = False, compression: str = "zstd"):
        self.spark, self.root = spark, f"{root.rstrip('/')}/{family}"
        self.manifests = ManifestLog(spark, self.root)
        self.flush_threshold_bytes, self.target_file_bytes = flush_threshold_bytes, target_file_bytes
        self.options = {"compression": compression} | ({"parquet.bloom.filter.enabled#key": "true"} if bloom else {})
        self._staged: list[DataFrame] = []
        self._staged_paths: list[str] = []
        self._staged_bytes = 0
        self._closed = False

    # -- writes ---------------------------------------------------------------------------------

    def upsert(self, rows: DataFrame, ttl: timedelta | None = None, now: datetime | None = None, order: Column | None = None) -> None:
        """Stages key, value (value NULL deletes). order tells versions of one key in rows apart; without it keys must be unique.

        The rows are evaluated here, once, and written below the store's root.
        """
        if self._closed:
            raise RuntimeError("the store is closed")
        if ttl is not None:
            if now is None:
                raise ValueError("a time-to-live needs now")
            rows = rows.withColumn("expires_at", F.lit(now + ttl))
        elif "expires_at" not in rows.columns:
            rows = rows.withColumn("expires_at", F.lit(None).cast("timestamp"))
        seq = F.lit(0) if order is None else order
        rows = rows.select(F.col("key").cast("binary"), F.col("value").cast("binary"), seq.cast("long").alias("seq"), F.lit(0).cast("long").alias("gen"), "expires_at")
        path = f"{self.root}/staged/{uuid.uuid4().hex}"
        size = Observation()
        rows.observe(size, F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).alias("bytes")).write.options(**self.options).parquet(path)
        self._staged.append(self.spark.read.schema(MUTATION).parquet(path))
        self._staged_paths.append(path)
        self._staged_bytes += size.get["bytes"] or 0
        if self.flush_threshold_bytes is not None and self._staged_bytes > self.flush_threshold_bytes:
            self.flush()

    def upsert_strings(self, pairs: Iterable[tuple[str, str | None]], **options) -> None:
        rows = self.spark.createDataFrame(list(pairs), "key string, value string")
        self.upsert(rows.select(encode("key").alias("key"), encode("value").alias("value")), **options)

    def delete(self, keys: DataFrame) -> None:
        self.upsert(keys.select("key", F.lit(None).cast("binary").alias("value")))

    def _write(self, rows: DataFrame, n_bytes: int) -> tuple[str, DataFrame]:
        """rows sorted by key over as many files as their size asks for."""
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        n = max(1, math.ceil(n_bytes / self.target_file_bytes))
        rows.repartitionByRange(n, "key").sortWithinPartitions("key").write.options(**self.options).parquet(path)
        return path, self.spark.read.schema(MUTATION).parquet(path)

    def _unstage(self) -> None:
        for path in self._staged_paths:
            self.manifests.delete(path)
        self._staged, self._staged_paths, self._staged_bytes = [], [], 0

    def _describe(self, gen: int, path: str, rows: DataFrame) -> Generation:
        s = rows.agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))), F.lit(0)).alias("bytes"),
            F.coalesce(F.sum(F.col("value").isNull().cast("long")), F.lit(0)).alias("dead"),
            F.hex(F.min("key")).alias("low"),
            F.hex(F.max("key")).alias("high"),
            F.max(F.unix_millis("expires_at")).alias("expiry"),
        ).first()
        lower = lambda x: None if x is None else x.lower()
        return Generation(gen, path, s.n, s.bytes, s.dead, lower(s.low), lower(s.high), s.expiry)

    def flush(self, batch: tuple[str, int] | None = None) -> Manifest:
        """Publishes what is staged as one generation; no rows, no generation.

        batch (stream, number): a number that the stream has committed already is skipped, so replays are harmless.
        """
        manifest = self.manifests.read()
        if batch and manifest.batches.get(batch[0], -1) >= batch[1]:
            self._unstage()
            return manifest
        if not self._staged:
            return manifest
        log = reduce(DataFrame.unionByName, [df.withColumn("gen", F.lit(i).cast("long")) for i, df in enumerate(self._staged)])
        newest = resolve.latest(log).withColumn("gen", F.lit(manifest.next_gen).cast("long"))
        path, written = self._write(newest, self._staged_bytes)
        while True:
            made = self._describe(manifest.next_gen, path, written)
            generations = (*manifest.generations, made) if made.n_rows else manifest.generations
            batches = manifest.batches | ({batch[0]: batch[1]} if batch else {})
            if not made.n_rows and not batch:
                self.manifests.delete(path)
                break
            try:
                manifest = self.manifests.publish(Manifest(manifest.version + 1, manifest.next_gen + 1, False, generations, batches))
                break
            except CommitConflict:  # the rows carry their generation's number: write them anew under the next free one
                manifest, old = self.manifests.read(), path
                path, written = self._write(written.withColumn("gen", F.lit(manifest.next_gen).cast("long")), made.n_bytes)
                self.manifests.delete(old)
        self._unstage()
        return manifest

    def compact(self, now: datetime | None = None, include_staged: bool = False) -> Manifest:
        """All published generations into one. Generations that others publish meanwhile stay."""
        if include_staged:
            self.flush()
        manifest = self.manifests.read()
        if not manifest.generations or manifest.compacted and not self._expired(manifest, now):
            return manifest
        log = Snapshot(self.spark, manifest).log()
        path, written = self._write(compact_full(log, now).select(*MUTATION.names), sum(g.n_bytes for g in manifest.generations))
        merged = {g.id for g in manifest.generations}
        while True:
            rest = tuple(g for g in manifest.generations if g.id not in merged)
            made = self._describe(manifest.next_gen, path, written)
            generations = ((made,) if made.n_rows else ()) + rest
            try:
                return self.manifests.publish(replace(manifest, version=manifest.version + 1, next_gen=manifest.next_gen + 1, compacted=not rest, generations=generations))
            except CommitConflict:
                manifest = self.manifests.read()
                if not merged <= {g.id for g in manifest.generations}:
                    raise  # another compaction has replaced what this one read

    def compact_if(self, generations: int) -> Manifest:
        """Compacts once there are as many generations."""
        manifest = self.manifests.read()
        return self.compact() if len(manifest.generations) >= generations else manifest

    @staticmethod
    def _expired(manifest: Manifest, now: datetime | None) -> bool:
        return now is not None and any(g.max_expiry_ms is not None for g in manifest.generations)

    def vacuum(self, keep_versions: int = 1) -> int:
        """Deletes generations that none of the newest keep_versions manifests names; returns how many."""
        kept_versions = self.manifests.versions()
        old, new = kept_versions[:-keep_versions], kept_versions[-keep_versions:]
        named = {g.path for v in new for g in self.manifests.read(v).generations}
        gone = {g.path for v in old for g in self.manifests.read(v).generations} - named
        for path in gone:
            self.manifests.delete(path)
        for v in old:
            self.manifests.delete(f"{self.root}/manifest/v{v:012d}.json")
        return len(gone)

    def close(self) -> None:
        """Flushes once; a second call does nothing. The SparkSession stays."""
        if not self._closed:
            self.flush()
            self._closed = True

    # -- reads ----------------------------------------------------------------------------------

    def snapshot(self, version: int | None = None) -> Snapshot:
        """What is published, or was at an older version."""
        return Snapshot(self.spark, self.manifests.read(version))

    def view(self) -> Snapshot:
        """What is published with this session's staged rows on top."""
        return Snapshot(self.spark, self.manifests.read(), self._staged)

    def get(self, low: bytes | None = None, high: bytes | None = None, now: datetime | None = None) -> DataFrame:
        return self.view().get(low, high, now)

    def point(self, key: bytes, now: datetime | None = None) -> DataFrame:
        return self.view().point(key, now)

    def strings(self, low: str | None = None, high: str | None = None, now: datetime | None = None) -> DataFrame:
        b = lambda x: None if x is None else x.encode()
        return resolve.ordered(as_strings(self.get(b(low), b(high), now)))
