"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only in local mode, as in tests, a temporary one takes its place where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="mutalog-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


#: Paths of the tables that written() has made in this process, oldest first.
_MADE: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: its lineage ends there and any executor can read it."""
    path, schema = fresh(df.sparkSession), df.schema
    df.write.option("compression", "zstd").parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(schema).parquet(path)


@contextmanager
def last_one_kept(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the tables that written() has made inside, but the last one: for a result that is written itself."""
    mark = len(_MADE)
    yield
    jvm, gone = spark._jvm, _MADE[mark:-1]
    for path in gone:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    del _MADE[mark:-1]
