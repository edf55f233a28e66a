"""The running median and spread against sorting, and the stream against the batch query."""

import datetime as dt
import os
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from chronolith.operators import stats
from chronolith.streaming import ledger, spikes

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def store(spark):
    for k, x in ledger.STORE.items():
        spark.conf.set(k, x)
    yield spark
    for k in ledger.STORE:
        spark.conf.unset(k)


def test_halves_against_sorting():
    rng = random.Random(1)
    for top in (1, 3, 1000):
        for _ in range(60):
            halves, seen = spikes.Halves(), []
            for _ in range(rng.randint(0, 40)):
                x = rng.randint(0, top)
                halves.add(x)
                seen.append(x)
                m = median(seen)
                assert (halves.median(), halves.spread()) == (m, median(abs(y - m) for y in seen)), seen
    assert (spikes.Halves().median(), spikes.Halves().spread()) == (0.0, 0.0)


def _run(spark, tmp_path, batches, late, **of):
    """Batches one by one, each by a query that is started anew from the checkpoint."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(src)
        changes = spikes.weekly_spikes(spark.readStream.schema("kind string, ts timestamp").parquet(src), late, **of)
        changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spikes.standing(spark.read.schema(spikes.CHANGES).parquet(out))


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the driver's tables")
def test_stream_equals_the_batch_form(store, tmp_path):
    """All events in shuffled micro-batches, with restarts, against the batch operator; a last event closes all weeks."""
    rows = store.read.parquet(f"{DATA}/events.parquet").select(F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.union(rows.filter("kind = 'error'").select(F.lit("regulation"), "ts"))
    end = rows.agg(F.max("ts")).first()[0]
    parts = [rows.filter(F.pmod(F.xxhash64("ts", "kind"), F.lit(4)) == k) for k in range(4)]
    closing = store.createDataFrame([("end", end + dt.timedelta(days=5000))], "kind string, ts timestamp")
    got = _run(store, tmp_path, [*parts, closing], "4000 days", sigma=0.5)
    counts = rows.groupBy(stats.week_of(F.col("ts")).alias("period"), "kind").agg(F.count("*").alias("n"))
    want = stats.spikes(counts, sigma=0.5).select("signal", "kind", F.col("period").alias("week"), "n", "base", "spread", "magnitude")
    rounded = lambda df: sorted((r.signal, r.kind, r.week, r.n, r.base, r.spread, round(r.magnitude, 1)) for r in df.collect())
    assert rounded(got) == rounded(want) and got.count() > 3


def test_late_events_and_withdrawn_spikes(store, tmp_path):
    """A week that was a spike is none once the base has risen; events after their week was closed change nothing."""
    day = dt.datetime(2024, 1, 1)
    week = lambda k, n: [("news", day + dt.timedelta(days=7 * k, minutes=i)) for i in range(n)]
    frame = lambda rows: store.createDataFrame(rows, "kind string, ts timestamp")
    one = _run(store, tmp_path, [frame(week(0, 1) + week(1, 1) + week(2, 8)), frame(week(4, 1))], "1 day")
    assert [(r.week.isoformat(), r.n, r.base, r.spread) for r in one.collect()] == [("2024-01-15", 8, 1.0, 0.0)]
    two = _run(store, tmp_path, [frame(week(2, 50) + week(5, 9)), frame(week(6, 9) + week(7, 9)), frame(week(9, 1))], "1 day")
    assert two.collect() == []  # the 50 came too late, and 8 is the usual number by now
