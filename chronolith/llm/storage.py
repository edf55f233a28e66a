"""The shared folder for intermediate tables and files.

The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a Spark of one
machine gets a temporary folder; a cluster gets an error, as its executors could not
see such a folder.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path under the session's shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        base = f"file://{tempfile.mkdtemp(prefix='chronolith-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/chronolith-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writes: list[str] = []  # what the setting was before, for each write under way
_lock = threading.Lock()


def written(df: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and outlives lost executors.

    The shuffle files of the write are deleted when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    schema = df.schema
    with _lock:
        _writes.append(_writes[0] if _writes else spark.conf.get(_CLEANUP, "false"))
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        with _lock:
            before = _writes.pop()
            if not _writes:
                spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a path that ``shared_dir`` gave, through Spark's own file systems."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables in the shared folder that are deleted together: ``with Scratch(spark) as kept: t = kept(df)``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, **options: str) -> DataFrame:
        self.paths.append(shared_dir(self.spark))
        return written(df, self.paths[-1], **options)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            drop(self.spark, path)
