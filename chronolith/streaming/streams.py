"""Structured Streaming forms of the stateful behaviours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import model
from ..operators import merges


def weekly_counts(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Events (kind, ts) by kind and week from Monday on; the epoch was a Thursday. ``spikes`` has the signal on top of it."""
    week = F.window("ts", "7 days", "7 days", "4 days")
    return events.withWatermark("ts", late).groupBy(week, "kind").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("week"), "kind", "n")


def first_seen(events: DataFrame, key: str = "dedup_key", late: str = "1 day") -> DataFrame:
    """Drops repeats of a key within the watermark, before an upsert."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def _bucket(key: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def snapshot(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """A table that ``upsert_into`` keeps: of each bucket its newest version (older than batch ``before``). As many rows as there are buckets are broadcast."""
    rows = spark.read.schema(f"{schema}, v int, bucket int").parquet(path)
    rows = rows if before is None else rows.filter(F.col("v") < before)
    return rows.join(F.broadcast(rows.groupBy("bucket").agg(F.max("v").alias("v"))), ["bucket", "v"]).drop("v")


def upsert_into(stream: DataFrame, path: str, schema: str, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, key: str, buckets: int = 64) -> StreamingQuery:
    """Merges each micro-batch into a table under ``path``, in buckets of ``key``: only those that a batch touches are read and written, as versions of the batch's number. A batch that runs again reads what it read before and writes its own versions again, so the result is the same."""
    spark = stream.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        touched = F.broadcast(batch.select(_bucket(key, buckets).alias("bucket")).distinct())  # as many rows as buckets
        current = snapshot(spark, path, schema, number).join(touched, "bucket", "left_semi").drop("bucket") if number else spark.createDataFrame([], schema)
        merged = merge(current, batch).select(*current.columns)
        merged.withColumn("bucket", _bucket(key, buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_failures(current: DataFrame, batch: DataFrame) -> DataFrame:
    """The claim ledger's failures, one batch at a time, for ``upsert_into``."""
    return merges.record_failures(current, batch.groupBy("slug").agg(F.max("at").alias("at")))


def retained(log: DataFrame, at: str = "asked_at", days: int = model.RETENTION_DAYS) -> DataFrame:
    """A log without what is older than ``days`` at the time of each trigger."""
    return log.filter(F.col(at) >= F.current_timestamp() - F.make_dt_interval(F.lit(days)))
