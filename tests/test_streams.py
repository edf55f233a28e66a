"""Streams on a few micro-batches."""

import datetime as dt

from pyspark.sql import functions as F

from chronolith.operators import merges
from chronolith.streaming import streams

EVENTS = "dedup_key string, content_hash string, kind string, day date, precision string, title string, body string, image_url string"


def test_upserts_are_idempotent(spark, tmp_path):
    d = dt.date(2024, 1, 1)
    rows = [[("a", "1", "news", d, "day", "T", "b", None, 0)], [("a", "2", "press", d, "day", "T2", "b", "i", 0), ("b", "1", "news", d, "day", "U", None, None, 1)], [("a", "2", "news", d, "day", "T3", "b", None, 0)]]
    src = tmp_path / "in"
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, EVENTS + ", pos int").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(EVENTS + ", pos int").parquet(str(src))
        streams.upsert_into(stream, str(tmp_path / "out"), EVENTS, merges.upsert_events, str(tmp_path / "ck"), "dedup_key", 4).awaitTermination()
    got = {r.dedup_key: (r.kind, r.title, r.image_url) for r in streams.snapshot(spark, str(tmp_path / "out"), EVENTS).collect()}
    assert got == {"a": ("news", "T2", "i"), "b": ("news", "U", None)}


def test_weeks_begin_on_monday(spark, tmp_path):
    stamps = ["2024-01-01 00:00:00", "2024-01-07 23:00:00", "2024-01-08 00:00:00", "2024-03-01 00:00:00"]
    spark.createDataFrame([("n", s) for s in stamps], "kind string, t string").select("kind", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    counts = streams.weekly_counts(spark.readStream.schema("kind string, ts timestamp").parquet(str(tmp_path / "in")))
    q = counts.writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.week.isoformat(), r.n) for r in spark.table("weeks").collect()) == [("2024-01-01", 2), ("2024-01-08", 1), ("2024-02-26", 1)]


def test_merges_apply_twice_as_once(spark):
    d = dt.date(2024, 1, 1)
    rows = spark.createDataFrame([(1, d, 5.0, 7, 0), (1, d, 6.0, None, 1)], "subject_id long, day date, close double, volume long, pos int")
    empty = rows.drop("pos").limit(0)
    once = merges.upsert_prices(empty, rows)
    assert [tuple(r) for r in once.collect()] == [tuple(r) for r in merges.upsert_prices(once, rows).collect()] == [(1, d, 6.0, 7)]
    at = dt.datetime(2024, 1, 1)
    ledger = spark.createDataFrame([], "slug string, failures int, attempted_at timestamp, dead_until timestamp")
    failed = spark.createDataFrame([("x", at)], "slug string, at timestamp")
    waits = []
    for _ in range(5):
        ledger = merges.record_failures(ledger, failed)
        waits.append((ledger.first().dead_until - at).total_seconds() / 60)
    assert waits == [30, 120, 480, 10080, 10080]
    asked = spark.createDataFrame([("x", at + dt.timedelta(minutes=400)), ("y", at)], "slug string, at timestamp")
    assert sorted((r.slug, r.claimed) for r in merges.claimable(ledger, asked).collect()) == [("x", False), ("y", True)]
