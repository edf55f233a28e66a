"""Several tables that change together.

A store is a folder. ``data/`` holds Parquet files of buckets of a key, written once and
never changed; ``manifests/<n>.json`` says which of them are the tables as of version n. A
commit writes new files for the buckets it touches, of as many tables as it likes, and then
renames one manifest into place, which fails if that version is there already: readers see
all of a commit or nothing, and of two writers that began at one version the second merges
again on what the first left. A writer that dies leaves files that no manifest names;
``vacuum`` deletes these, and the versions that buckets had before the last few manifests.

The driver sees names of buckets and folders only, as many as tables times ``buckets``. The
rename is atomic on HDFS and alike; on an object store without such a rename, writers must
take turns.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (rows of the touched buckets, what comes in) to the rows that those buckets hold next.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Other writers were faster each time."""


@dataclass(frozen=True)
class Table:
    """A table's schema, as DDL, and the column by whose hash its rows lie in buckets. What is merged must be told by that column."""

    schema: str
    key: str


class Files:
    """The few steps on folders that Spark's readers and writers lack, through the file systems that Spark itself has."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.new_array = spark.sparkContext._gateway.new_array
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[tuple[str, int]]:
        """(name, time of change in ms) of what a folder holds; nothing if there is none."""
        at = self.path(folder)
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def publish(self, name: str, text: str) -> bool:
        """Writes a file under another name and renames it; False if the name is taken."""
        hidden = self.path(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        out = self.fs.create(hidden, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        kinds = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.new_array(kinds, 1)
        how[0] = kinds.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf)
        try:
            context.rename(hidden, self.path(name), how)
            return True
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            self.fs.delete(hidden, False)
            return False

    def text(self, name: str) -> str:
        read = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(read, "UTF-8")
        finally:
            read.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Store:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table], buckets: int = 64):
        self.spark, self.tables, self.buckets, self.files = spark, tables, buckets, Files(spark, root)

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return max((int(n[:-5]) for n, _ in self.files.names("manifests") if n.endswith(".json") and n[0] != "."), default=0)

    def manifest(self, version: int) -> dict[str, dict[str, str]]:
        """For each table the folder of each of its buckets, as of a version."""
        return json.loads(self.files.text(f"manifests/{version}.json"))["tables"] if version else {}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the newest unless one is named: a reader that names one sees the same rows whatever is committed."""
        return self._rows(table, self.manifest(self.version() if version is None else version).get(table, {}))

    def _rows(self, table: str, held: dict[str, str]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self.tables[table].schema)
        return self.spark.read.schema(self.tables[table].schema).parquet(*(f"{self.files.root}/{folder}/bucket={b}" for b, folder in sorted(held.items())))

    def _write(self, rows: DataFrame, table: str) -> tuple[str, list[str]]:
        """The folder that rows were written to, and their buckets. Each bucket is dealt to few tasks, so its files are few."""
        folder = f"data/{table}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(self.tables[table].key), F.lit(self.buckets)).cast("int")
        rows.withColumn("bucket", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.files.root}/{folder}")
        return folder, [n[7:] for n, _ in self.files.names(folder) if n.startswith("bucket=")]

    def commit(self, changes: dict[str, tuple[DataFrame, Merge]], note: str = "", tries: int = 5, onto: int | None = None) -> int:
        """Merges what comes in into several tables and publishes them at once; gives the version.

        What comes in is written first, so it is computed once, however often the merge is
        tried; then only the buckets that it touches are read and written. What was made
        from one version and holds for that one only is committed ``onto`` it, or not at all.
        """
        staged = {}
        for name, (incoming, merge) in changes.items():
            folder, touched = self._write(incoming, name)
            staged[name] = folder, touched, incoming.schema, merge
        try:
            for _ in range(tries):
                base = self.version() if onto is None else onto
                tables = self.manifest(base)
                for name, (folder, touched, schema, merge) in staged.items():
                    if not touched:
                        continue
                    held = tables.get(name, {})
                    came = self.spark.read.schema(schema).parquet(*(f"{self.files.root}/{folder}/bucket={b}" for b in touched))
                    merged = merge(self._rows(name, {b: held[b] for b in touched if b in held}), came)
                    columns = self.spark.createDataFrame([], self.tables[name].schema).schema
                    new, filled = self._write(merged.select(*(F.col(f.name).cast(f.dataType) for f in columns)), name)
                    tables[name] = {b: f for b, f in held.items() if b not in touched} | dict.fromkeys(filled, new)
                if self.files.publish(f"manifests/{base + 1}.json", json.dumps({"note": note, "tables": tables})):
                    return base + 1
                if onto is not None:
                    break
            raise Conflict("other writers came first")
        finally:
            for folder, *_ in staged.values():
                self.files.delete(folder)

    def vacuum(self, keep: int = 2, older_than_ms: int = 24 * 3600 * 1000) -> list[str]:
        """Deletes manifests but for the newest ``keep``, and files that none of these names and that are older than a commit may take; gives their folders."""
        newest = self.version()
        kept = range(max(1, newest - keep + 1), newest + 1)
        named = {folder for v in kept for held in self.manifest(v).values() for folder in held.values()}
        now = time.time() * 1000  # clocks may differ by far less than a commit may take
        for name, _ in self.files.names("manifests"):
            if name.endswith(".json") and name[0] != "." and int(name[:-5]) < kept.start:
                self.files.delete(f"manifests/{name}")
        gone = [f"data/{name}" for name, at in self.files.names("data") if f"data/{name}" not in named and now - at >= older_than_ms]
        for folder in gone:
            self.files.delete(folder)
        return gone


def replace(_: DataFrame, came: DataFrame) -> DataFrame:
    """A merge that keeps of the touched buckets only what came."""
    return came


def append(current: DataFrame, came: DataFrame) -> DataFrame:
    return current.unionByName(came.select(*current.columns))


def failing(error: Exception) -> str:
    """What a log keeps of an error: its first 200 characters."""
    said = error.getMessage() if isinstance(error, PySparkException) else str(error)
    return (said or type(error).__name__)[:200]
