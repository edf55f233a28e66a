"""Backups: digests of tables that do not depend on the order of rows, a rehearsal of a restore, migrations run once, and which dumps to keep."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP = 14  # fixed value: how many dumps are kept


def row_hash(columns: list[str]) -> Column:
    """60 bits of a row: of the MD5 of its values, each with its length, so that no two rows share a text; nulls have none."""
    said = [F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *said)), 1, 15), 16, 10).cast("long")


def digests(rows: DataFrame, key: str, buckets: int = 64) -> DataFrame:
    """(bucket, rows, total, mixed) by the hash of a key: the number, the sum and the xor of row hashes. Sums up before the shuffle."""
    columns = sorted(rows.columns)
    bucket = row_hash([key]) % buckets
    return rows.select(bucket.cast("int").alias("bucket"), row_hash(columns).alias("h")).groupBy("bucket").agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"), F.bit_xor("h").alias("mixed"))


def differing(kept: DataFrame, restored: DataFrame) -> DataFrame:
    """Buckets (bucket, kept_rows, restored_rows) whose digests differ, or that one side lacks."""
    a = kept.select("bucket", F.struct("rows", "total", "mixed").alias("a"))
    b = restored.select("bucket", F.struct("rows", "total", "mixed").alias("b"))
    odd = a.join(b, "bucket", "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    return odd.select("bucket", F.coalesce("a.rows", F.lit(0)).alias("kept_rows"), F.coalesce("b.rows", F.lit(0)).alias("restored_rows"))


def rehearsed(kept: dict[str, tuple[DataFrame, str]], restored: dict[str, DataFrame], buckets: int = 64) -> DataFrame:
    """(name, bucket, kept_rows, restored_rows) of what a restore would get wrong, over all tables (rows, key): empty if it would get all right."""
    each = [differing(digests(rows, key, buckets), digests(restored[n], key, buckets)).select(F.lit(n).alias("name"), "*") for n, (rows, key) in kept.items()]
    return reduce(DataFrame.union, each)


def retained(dumps: DataFrame, prefixes: list[str], keep: int = KEEP) -> DataFrame:
    """``dumps`` (name) with stamp and kept: of all ``prefix-stamp.dump`` the newest by stamp, whichever prefix, stay; files that are no dumps are not touched."""
    stamp = F.nullif(F.regexp_extract("name", rf"^(?:{'|'.join(prefixes)})-(.*)\.dump$", 1), F.lit(""))
    stamped = dumps.withColumn("stamp", stamp)
    newest = stamped.filter("stamp is not null").orderBy(F.col("stamp").desc(), F.col("name").desc()).limit(keep).select("name", F.lit(True).alias("new"))
    return stamped.join(newest, "name", "left").select("name", "stamp", (F.col("stamp").isNull() | F.coalesce("new", F.lit(False))).alias("kept"))


def migrate(store, steps: dict[str, Callable[[], dict]]) -> list[str]:
    """Runs the steps that the store's ``migrations`` (filename, applied_at) lacks, in the order of their names, each once; gives those that ran.

    A step gives changes for ``Store.commit``; they are published in one commit with the
    row that says so, and a step that fails leaves neither, and ends the run.
    """
    done = {r.filename for r in store.read("migrations").select("filename").collect()}  # as many rows as files of steps
    ran = []
    for name in sorted(set(steps) - done):
        row = store.spark.range(1).select(F.lit(name).alias("filename"), F.current_timestamp().alias("applied_at"))
        store.commit({**steps[name](), "migrations": (row, _once)}, name)
        ran.append(name)
    return ran


def _once(current: DataFrame, came: DataFrame) -> DataFrame:
    """Adds a step's row; one that another run added meanwhile ends this one, and none of its changes are published."""
    twice = came.join(current.select("filename", F.lit(True).alias("had")), "filename", "left")
    checked = twice.select(F.when(F.col("had"), F.raise_error(F.concat(F.lit("already applied: "), "filename"))).otherwise(F.col("filename")).alias("filename"), "applied_at")
    return current.unionByName(checked)
