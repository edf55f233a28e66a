"""The demand queue, finality and state that expires, over micro-batches with restarts."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from chronolith.operators import merges
from chronolith.streaming import demand, finality, ledger

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    for k, x in ledger.STORE.items():
        spark.conf.set(k, x)
    yield spark
    for k in ledger.STORE:
        spark.conf.unset(k)


def step(spark, tmp_path, rows, schema, make):
    """One more micro-batch, by a query that starts from the checkpoint; all that came out so far."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(src)
    stream = make(spark.readStream.schema(schema).parquet(src))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start().awaitTermination(60)
    return spark.read.schema(stream.schema).parquet(out)


def test_queue_equals_the_batch_form_after_each_batch(store, tmp_path):
    """Requests and marks in any order against the upsert and the batch queue; one slug has a third of all rows."""
    schema = "slug string, kind string, ticker string, at timestamp, what string"
    rng, ledger_rows, at = random.Random(2), store.createDataFrame([], "slug string, kind string, ticker string, requests long, first_asked timestamp, last_asked timestamp, fulfilled_at timestamp"), START
    for _ in range(3):
        rows = []
        for _ in range(120):
            at += dt.timedelta(minutes=1)
            rows.append((rng.choice(["hot", "hot", *(f"s{i}" for i in range(12))]), "topic", rng.choice([None, "T"]), at, "ask"))
        for slug in rng.sample(["hot", *(f"s{i}" for i in range(12))], 4):
            at += dt.timedelta(minutes=1)
            rows.append((slug, None, None, at, "fulfilled"))
        again = at + dt.timedelta(minutes=1)
        rows.append(("s3", "topic", None, again, "ask"))  # open again, if it was done
        at = again
        shuffled = rng.sample(rows, len(rows))
        changes = step(store, tmp_path, shuffled, schema, lambda s: demand.queue(s, most=5, shards=3))
        asked = store.createDataFrame([(s, k, t, w, i) for i, (s, k, t, w, what) in enumerate(rows) if what == "ask"], "slug string, kind string, ticker string, asked_at timestamp, pos int")
        done = store.createDataFrame([(s, w) for s, _, _, w, what in rows if what != "ask"], "slug string, at timestamp")
        merged = merges.request_subjects(ledger_rows, asked)
        last = {s: max(w for x, _, _, w, what in rows if x == s and what == "ask") for s in {r[0] for r in rows if r[4] == "ask"}}
        marks = [(s, w, None) for s, w in ((r.slug, r.at) for r in done.collect()) if s not in last or last[s] < w]
        merged = merges.mark_requests(merged.withColumn("last_error", F.lit(None).cast("string")), store.createDataFrame(marks, "slug string, at timestamp, error string")).drop("last_error")
        ledger_rows = store.createDataFrame(merged.collect(), merged.schema)
        want = [(r.slug, r.kind, r.ticker, r.requests, r.first_asked, r.last_asked) for r in merges.pending(ledger_rows, 5).collect()]
        assert [tuple(r) for r in demand.pending(changes, 5).collect()] == want


def test_fulfilled_requests_are_forgotten(store, tmp_path):
    schema = "slug string, kind string, ticker string, at timestamp, what string"
    make = lambda s: demand.queue(s, shards=2, forget=3)
    minute = lambda k: START + dt.timedelta(minutes=k)
    step(store, tmp_path, [("a", "t", None, minute(0), "ask"), ("a", None, None, minute(1), "fulfilled"), ("b", "t", None, minute(0), "ask")], schema, make)
    held = lambda name: store.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "ck")).count()
    assert (held("open"), held("done")) == (1, 1)
    time.sleep(4)
    changes = step(store, tmp_path, [(f"c{i}", "t", None, minute(2), "ask") for i in range(8)] + [("a", "t", None, minute(3), "ask")], schema, make)
    assert (held("open"), held("done")) == (10, 0)  # b never expires, and a is new
    assert {r.slug: r.requests for r in demand.pending(changes).collect()} == {"a": 1, "b": 1, **{f"c{i}": 1 for i in range(8)}}


@pytest.mark.parametrize("which", ["claims", "freshness"])
def test_state_expires(store, tmp_path, which):
    """The state's rows, read from the checkpoint, shrink after ``forget``; a key that comes back is new."""
    claims = which == "claims"
    schema = "slug string, at timestamp, what string" if claims else "source string, subject string, at timestamp, what string"
    key = (lambda k: (k,)) if claims else (lambda k: ("sec", k))
    make = lambda s: (ledger.claims if claims else ledger.freshness)(s, forget=3)
    step(store, tmp_path, [(*key(f"k{i}"), START, "ask" if claims else "ok") for i in range(6)], schema, make)
    held = lambda: store.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "ck")).count()
    assert held() == 6
    time.sleep(4)
    out = step(store, tmp_path, [(*key("k1"), START + dt.timedelta(minutes=1), "ask"), (*key("new"), START, "ask")], schema, make)
    assert held() == 2
    assert all(r[-1] for r in out.filter(F.col("at") > START).collect())


def test_rows_wait_until_they_are_final(store, tmp_path):
    """Held over a restart and let go by a timer; other chains and times of 0 never pass."""
    now = int(time.time())
    schema = "chain string, time long, hash string, note string"
    make = lambda s: finality.held_back(s, "hash", {"ethereum": 6, "bitcoin": 3600})
    first = step(store, tmp_path, [("ethereum", now - 60, "old", "x"), ("ethereum", now + 2, "young", None), ("ethereum", now + 2, "young2", "y"), ("bitcoin", now, "long", "z"), ("ethereum", 0, "zero", ""), ("other", 5, "none", "")], schema, make)
    assert sorted(r.hash for r in first.collect()) == ["old"]
    time.sleep(max(0, now + 9 - time.time()))
    rest = step(store, tmp_path, [("bitcoin", now - 7200, "also old", "")], schema, make)
    assert sorted((r.hash, r.note) for r in rest.collect() if r.hash != "old") == [("also old", ""), ("young", None), ("young2", "y")]
