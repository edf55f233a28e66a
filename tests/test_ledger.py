"""Keyed state over several micro-batches."""

import datetime as dt

import pytest

from chronolith.streaming import ledger

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    for k, x in ledger.STORE.items():
        spark.conf.set(k, x)
    yield spark
    for k in ledger.STORE:
        spark.conf.unset(k)


def run(spark, tmp_path, batches, schema, make):
    src, name = tmp_path / "in", f"out_{tmp_path.name}".replace("-", "_")
    for k, rows in enumerate(batches):
        spark.createDataFrame([(*r[:-2], START + dt.timedelta(minutes=r[-2]), r[-1]) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(src))
        out = make(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / "ck"))
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / name)).collect()


def test_claims_wait_and_die(store, tmp_path):
    batches = [
        [("x", 0, "ask"), ("x", 1, "ask"), ("y", 0, "ask")],
        [("x", 2, "failure"), ("x", 400, "ask"), ("x", 401, "failure"), ("x", 402, "failure"), ("x", 403, "failure")],
        [("x", 800, "ask"), ("x", 403 + 10080, "ask"), ("x", 403 + 10081, "success"), ("y", 361, "ask")],
    ]
    rows = run(store, tmp_path, batches, "slug string, at timestamp, what string", ledger.claims)
    got = sorted((r.slug, (r.at - START).total_seconds() / 60, r.claimed) for r in rows)
    assert got == [("x", 0, True), ("x", 1, False), ("x", 400, True), ("x", 800, False), ("x", 10483, True), ("y", 0, True), ("y", 361, True)]


def test_sources_are_asked_again_in_time(store, tmp_path):
    batches = [
        [("gdelt", "a", 0, "ask"), ("gdelt", "a", 1, "ok"), ("gdelt", "a", 30, "ask"), ("sec", "a", 0, "ask")],
        [("gdelt", "a", 61, "ask"), ("gdelt", "a", 62, "throttled"), ("gdelt", "a", 100, "ask"), ("gdelt", "a", 122, "ask"), ("gdelt", "b", 100, "ask")],
    ]
    rows = run(store, tmp_path, batches, "source string, subject string, at timestamp, what string", ledger.freshness)
    got = sorted((r.source, r.subject, (r.at - START).total_seconds() / 60, r.fetch) for r in rows)
    assert got == [("gdelt", "a", 0, True), ("gdelt", "a", 30, False), ("gdelt", "a", 61, True), ("gdelt", "a", 100, False), ("gdelt", "a", 122, True), ("gdelt", "b", 100, True), ("sec", "a", 0, True)]
