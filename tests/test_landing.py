"""Landed payloads read by name, in batch and as a stream: partitions, pushed filters, bad lines, restarts, and the rows of the filings query."""

import datetime as dt
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from chronolith.plans import landed as plans
from chronolith.plans.queries import QUERIES
from chronolith.sources import landing, markets

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def sources(spark):
    landing.register(spark)
    yield spark
    spark.conf.unset(landing.PUSHDOWN)


def _file(folder, day, name, lines):
    path = folder / f"landed={day}"
    path.mkdir(parents=True, exist_ok=True)
    body = "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines).encode()
    (path / name).write_bytes(gzip.compress(body) if name.endswith(".gz") else body)


def test_kinds_faults_and_types(sources, tmp_path):
    good = {"ticker": "A", "timestamp": [1, 2.0, None, "x"], "close": [1, 2.5, None, True], "volume": "none", "more": 1}
    _file(tmp_path, "2024-01-01", "a.json", [good, "{broken", "", "[1]", {"ticker": 5}, '{"ticker": "cut'])
    _file(tmp_path, "2024-01-02", "b.json.gz", [{"ticker": "B"}])
    _file(tmp_path, "2024-01-02", "_SUCCESS", ["x"])
    rows = sources.read.format("chronolith.prices").load(f"file://{tmp_path}").orderBy("landed", "line").collect()
    assert [(r.ticker, r.fault is None, r.line) for r in rows] == [("A", True, 0), (None, False, 1), (None, False, 2), ("5", True, 3), (None, False, 4), ("B", True, 0)]
    assert (rows[0].timestamp, rows[0].close, rows[0].volume) == ([1, 2, None, None], [1.0, 2.5, None, None], None)
    assert rows[5].landed == dt.date(2024, 1, 2)


def test_filters_prune_files(sources, tmp_path):
    for day in range(1, 10):
        _file(tmp_path, f"2024-01-0{day}", "a.json", [{"article_id": day, "title": "t"}])
    rows = sources.read.format("chronolith.articles").load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 9
    some = rows.filter("landed >= date'2024-01-07' and title = 't' and landed <> date'2024-01-08'")
    assert some.rdd.getNumPartitions() == 3  # the last test stays with Spark
    assert sorted(r.article_id for r in some.collect()) == [7, 9]
    assert rows.filter("landed in (date'2024-01-02', date'2024-01-03')").rdd.getNumPartitions() == 2
    assert rows.filter("landed = date'2030-01-01'").count() == 0
    assert sources.read.format("chronolith.articles").load(str(tmp_path / "none")).count() == 0


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the driver's tables")
def test_filings_equal_the_query_in_batch_and_stream(sources, tmp_path):
    """The query's blocks land on three days; batch, and a stream that is restarted after each day, give its rows."""
    recent, older = plans.filing_blocks(sources, DATA)
    blocks = recent.unionByName(older).withColumn("landed", F.concat(F.lit("2024-02-0"), F.pmod(F.xxhash64("cik", F.size("form")), F.lit(3)) + 1))
    want = sorted(tuple(r) for r in QUERIES["q_filings"](sources, DATA).collect())
    columns = ["id", "day", "kind", "title", "url", "description"]

    def rows(events):
        return sorted(tuple(r) for r in events.dropDuplicates(["id"]).withColumn("day", F.date_format("day", "yyyy-MM-dd")).select(*columns).collect())

    seen = []
    for day in ("2024-02-01", "2024-02-02", "2024-02-03"):
        landing.land(blocks.filter(F.col("landed") == day), str(tmp_path / "in"))
        stream = markets.filings(sources.readStream.format("chronolith.filings").load(str(tmp_path / "in")))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append(sources.read.parquet(str(tmp_path / "out")).count())
    assert seen[0] < seen[1] < seen[2]
    assert rows(markets.filings(sources.read.format("chronolith.filings").load(str(tmp_path / "in")))) == want
    assert rows(sources.read.parquet(str(tmp_path / "out"))) == want
    assert sources.read.parquet(str(tmp_path / "out")).count() == markets.filings(blocks).count()  # each file once
