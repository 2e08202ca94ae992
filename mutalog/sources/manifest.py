"""Versioned manifests: which generations make up a store, published atomically.

A manifest is one JSON file v<N>.json. It is written under a temporary name and
renamed without overwriting, so two writers that both publish version N can't
both succeed; the loser reads the new state and tries again. Everything goes
through Hadoop's FileContext, so a store can live wherever Spark can write.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession


class CommitConflict(RuntimeError):
    """Another writer has published this version first."""


@dataclass(frozen=True)
class Generation:
    """One immutable sorted run. age orders runs: higher is newer. It differs from id after a compaction."""

    id: int
    path: str
    n_rows: int
    n_bytes: int
    n_tombstones: int
    min_key: str | None = None  # hex
    max_key: str | None = None
    max_expiry_ms: int | None = None

    def meets(self, low: bytes | None, high: bytes | None) -> bool:
        """Whether keys in [low, high) can be here; hex order is byte order."""
        if self.min_key is None:
            return False
        return (high is None or self.min_key < high.hex()) and (low is None or self.max_key >= low.hex())


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    next_gen: int = 0
    compacted: bool = False  # one generation with unique keys and no deletes
    generations: tuple[Generation, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)  # newest committed batch of each stream


class ManifestLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._jvm = jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)\.json", n)))

    def read(self, version: int | None = None) -> Manifest:
        """The newest manifest, or an older version; version 0 is the empty store."""
        have = self.versions()
        if version is None:
            version = have[-1] if have else 0
        if version == 0:
            return Manifest()
        if version not in have:
            raise ValueError(f"no version {version} of {self.root}; there are {have}")
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version:012d}.json"))
        try:
            raw = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return Manifest(**raw | {"generations": tuple(Generation(**g) for g in raw["generations"])})

    def publish(self, manifest: Manifest) -> Manifest:
        """Makes manifest the next version, or raises CommitConflict and changes nothing."""
        temporary = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}.tmp")
        target = self._path(f"{self.root}/manifest/v{manifest.version:012d}.json")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        no_overwrite = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        no_overwrite[0] = getattr(self._jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            self._context.rename(temporary, target, no_overwrite)
        except Exception as e:
            self._fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {manifest.version} exists") from e
            raise
        return manifest

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
