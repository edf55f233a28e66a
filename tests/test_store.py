"""Tables that change together: commits, conflicts, dead writers, pinned readers, and scheduled runs over them."""

import datetime

import pytest
from pyspark.sql import functions as F

from chronolith.operators import digests
from chronolith.sources.store import Conflict, Store, Table, append, replace
from chronolith.streaming import runs

AB = {"a": Table("k long, v string", "k"), "b": Table("k long, n long", "k")}


def newer(current, came):
    return current.join(came.select("k"), "k", "left_anti").unionByName(came)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", AB, buckets=4)


def test_tables_are_committed_together_and_readers_stay_at_their_version(spark, store):
    assert store.version() == 0 and rows(store.read("a")) == []
    a = spark.range(20).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    assert store.commit({"a": (a, newer), "b": (spark.range(3).select(F.col("id").alias("k"), F.col("id").alias("n")), newer)}) == 1
    assert store.commit({"a": (spark.createDataFrame([(7, "y"), (99, "z")], "k long, v string"), newer)}) == 2
    assert rows(store.read("a")) == sorted([(k, "y" if k == 7 else "x") for k in range(20)] + [(99, "z")])
    assert rows(store.read("a", 1)) == [(k, "x") for k in range(20)] and rows(store.read("b")) == [(k, k) for k in range(3)]


def test_only_touched_buckets_are_written_again(spark, store):
    store.commit({"a": (spark.range(40).select(F.col("id").alias("k"), F.lit("x").alias("v")), newer)})
    first = store.manifest(1)["a"]
    store.commit({"a": (spark.createDataFrame([(7, "y")], "k long, v string"), newer)})
    second = store.manifest(2)["a"]
    assert len(first) == 4 and len({b for b in first if first[b] != second[b]}) == 1


def test_a_bucket_that_a_merge_empties_is_gone(spark, store):
    store.commit({"a": (spark.createDataFrame([(1, "x")], "k long, v string"), newer)})
    store.commit({"a": (spark.createDataFrame([(1, "x")], "k long, v string"), lambda current, came: current.join(came.select("k"), "k", "left_anti"))})
    assert rows(store.read("a")) == []


def test_a_writer_that_dies_between_two_tables_leaves_the_old_version(spark, store):
    one = spark.createDataFrame([(1, "x")], "k long, v string")
    store.commit({"a": (one, newer)})

    def dies(current, came):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        store.commit({"a": (one.withColumn("v", F.lit("y")), newer), "b": (spark.createDataFrame([(1, 1)], "k long, n long"), dies)})
    assert store.version() == 1 and rows(store.read("a")) == [(1, "x")] and rows(store.read("b")) == []
    left = store.vacuum(older_than_ms=0)
    assert len(left) == 1 and left[0] not in store.manifest(1)["a"].values() and rows(store.read("a")) == [(1, "x")]


def test_of_two_writers_at_one_version_the_second_merges_again(spark, store):
    come = [0]

    def slow(current, came):
        if not come[0]:  # another writer is faster
            come[0] = 1
            store.commit({"a": (spark.createDataFrame([(1, "other")], "k long, v string"), append)})
        return append(current, came)

    assert store.commit({"a": (spark.createDataFrame([(1, "own")], "k long, v string"), slow)}) == 2
    assert rows(store.read("a")) == [(1, "other"), (1, "own")] and rows(store.read("a", 1)) == [(1, "other")]


def test_what_holds_for_one_version_is_not_committed_onto_another(spark, store):
    one = spark.createDataFrame([(1, "x")], "k long, v string")
    store.commit({"a": (one, append)})
    with pytest.raises(Conflict):
        store.commit({"a": (one, append)}, onto=0)
    assert store.commit({"a": (one, append)}, onto=1) == 2


def test_old_versions_of_buckets_are_deleted_but_not_those_of_kept_manifests(spark, store):
    for n in range(4):
        store.commit({"a": (spark.createDataFrame([(1, str(n))], "k long, v string"), replace)})
    assert len(store.vacuum(keep=2, older_than_ms=0)) == 2
    assert rows(store.read("a", 3)) == [(1, "2")] and rows(store.read("a")) == [(1, "3")] and store.version() == 4
    assert store.vacuum(keep=2, older_than_ms=0) == []


def test_steps_run_once_each_with_their_row(spark, tmp_path):
    tables = {**AB, "migrations": Table("filename string, applied_at timestamp", "filename")}
    store = Store(spark, f"file://{tmp_path}/m", tables, buckets=4)
    step = lambda k: lambda: {"a": (spark.createDataFrame([(k, "s")], "k long, v string"), append)}
    assert digests.migrate(store, {"002": step(2), "001": step(1)}) == ["001", "002"]
    assert digests.migrate(store, {"002": step(2), "001": step(1), "003": step(3)}) == ["003"]
    assert rows(store.read("a")) == [(1, "s"), (2, "s"), (3, "s")]

    def bad():
        raise RuntimeError("bad step")

    with pytest.raises(RuntimeError):
        digests.migrate(store, {"004": bad})
    assert rows(store.read("migrations").select("filename")) == [("001",), ("002",), ("003",)]


def test_a_changed_row_is_found_by_its_bucket(spark):
    t = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), "id")).alias("v"))
    assert digests.rehearsed({"t": (t, "k")}, {"t": t.repartition(7, "v")}).collect() == []
    changed = t.withColumn("v", F.when(F.col("k") == 500, "other").otherwise(F.col("v")))
    where = [r[0] for r in t.filter("k = 500").select((digests.row_hash(["k"]) % 64).cast("int")).collect()]
    assert [r.bucket for r in digests.rehearsed({"t": (t, "k")}, {"t": changed}).collect()] == where
    twice = t.union(t.filter("k = 500")).union(t.filter("k = 500"))  # an even number of copies: the xor alone would miss them
    assert [(r.bucket, r.restored_rows - r.kept_rows) for r in digests.rehearsed({"t": (t, "k")}, {"t": twice}).collect()] == [(where[0], 2)]


def test_dumps_are_kept_by_stamp(spark):
    names = [f"zeta-2024-01-{d:02d}.dump" for d in range(1, 11)] + [f"alpha-2023-12-{d:02d}.dump" for d in range(1, 11)] + ["readme.txt"]
    got = {r.name: r.kept for r in digests.retained(spark.createDataFrame([(n,) for n in names], "name string"), ["alpha", "zeta"]).collect()}
    assert {n for n, kept in got.items() if not kept} == {f"alpha-2023-12-{d:02d}.dump" for d in range(1, 7)}


def at(minute):
    return F.lit(datetime.datetime(2024, 5, 1, 12) + datetime.timedelta(minutes=minute)).cast("timestamp")


def test_a_failing_source_costs_its_own_rows_only(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/runs", runs.TABLES, buckets=4)
    store.commit({"subjects": (spark.createDataFrame([(1, "a", "topic", None), (2, "b", "topic", None), (3, "x", "industry", None)], runs.SUBJECTS.schema), append)})

    def stories(copies):
        return lambda asked: asked.select("subject_id", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("n")).select("subject_id", F.col("n").alias("pos"), F.lit("news").alias("kind"), F.lit(datetime.date(2024, 5, 1)).alias("day"), F.lit("day").alias("precision"), F.concat(F.lit("Story "), F.floor(F.col("n") / copies), F.lit(" of "), "subject_id").alias("title"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("image_url"), F.lit("https://x.test").alias("url"))

    def broken(asked):
        return stories(1)(asked).withColumn("title", F.raise_error(F.lit("payload " + "e" * 300)))

    every = [runs.Source("gdelt", stories(2), capped=True), runs.Source("loc_chronam", broken), runs.Source("wikipedia", stories(100))]
    got = runs.run(store, every, "r1", at(0))
    assert got["gdelt"] == got["wikipedia"] == "ok" and "payload" in got["loc_chronam"] and len(got["loc_chronam"]) == 200
    log = {(r.source, r.subject_id): (r.outcome, r.events) for r in store.read("fetches").collect()}
    assert log == {(s, k): o for k in (1, 2) for s, o in {"gdelt": ("ok", 50), "loc_chronam": ("error", 0), "wikipedia": ("ok", 100)}.items()}
    assert store.read("events").count() == 100  # 50 stories of each subject; the encyclopedia's one is among them
    assert {r.slug for r in store.read("subjects").filter("refreshed_at is null").collect()} == {"x"}

    calm = [runs.Source("gdelt", broken), runs.Source("loc_chronam", stories(1)), runs.Source("wikipedia", broken)]
    assert set(runs.run(store, calm, "r2", at(10)).values()) == {"ok"}  # nobody is due: fresh, or backing off
    assert store.read("fetches").count() == 6
    runs.run(store, [runs.Source("loc_chronam", stories(1))], "r3", at(45))
    assert store.read("fetches").filter("fetch_id like 'r3:%'").count() == 2


def test_stories_collapse_before_the_cap(spark):
    e = spark.range(200).select(F.lit(1).alias("subject_id"), F.col("id").alias("pos"), F.lit("news").alias("kind"), F.lit(datetime.date(2024, 5, 1)).alias("day"), F.concat(F.lit("Story "), F.floor(F.col("id") / 2)).alias("title"), F.lit("d").alias("description"), F.lit(None).cast("string").alias("image_url"), F.lit("u").alias("url"))
    assert sorted(int(r.title[6:]) for r in runs.cut(e).collect()) == list(range(75))


def test_a_run_done_again_logs_once(spark):
    one = spark.createDataFrame([("r:s:1", "s", 1, None, "ok", 1, None)], runs.FETCHES.schema)
    assert runs.log_once(one, one).count() == 1


def test_a_first_visit_is_stored_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/visits", runs.FIRST_PASS, buckets=2)
    noon = datetime.datetime(2024, 5, 1, 12)
    ask = lambda *rows: spark.createDataFrame([(n, slug, kind, noon + datetime.timedelta(hours=h), free) for n, (slug, kind, h, free) in enumerate(rows)], "pos long, slug string, kind string, at timestamp, free boolean")
    answers = spark.createDataFrame([("steel", False, "Steel", 1, 0), ("co:abc", False, None, 1, 2), ("best buy earnings q3", False, "TaxAct", 21, 0), ("slow", True, None, 0, 0)], "slug string, timed_out boolean, title string, events long, bars long")
    day = datetime.date(2024, 4, 1)
    events = spark.createDataFrame([("steel", 1, 0, "history", day, "year", "Steel is made", None, None, None), ("co:abc", 2, 0, "filing", day, "day", "10-K", None, None, None), ("best buy earnings q3", 3, 0, "history", day, "day", "Tax", None, None, None)], "key string, subject_id long, pos long, kind string, day date, precision string, title string, description string, image_url string, url string")
    prices = spark.createDataFrame([("co:abc", 2, day, 1.5, 10), ("steel", 9, day, 1.0, None)], "key string, subject_id long, day date, close double, volume long")
    first = ask((" Steel ", "topic", 0, True), ("steel", "topic", 0, True), ("ABC", "company", 0, True), ("best buy earnings q3", "topic", 0, True), ("slow", "topic", 0, True), ("steel", "topic", 0, False), (" ", "topic", 0, True), ("unheard of", "company", 0, True))

    kept = runs.keep_events
    try:
        runs.keep_events = lambda current, came: (_ for _ in ()).throw(RuntimeError("lost"))  # the writer dies after the ledger was written
        with pytest.raises(RuntimeError, match="lost"):
            runs.first_pass(store, first, answers, events, prices, "v0")
    finally:
        runs.keep_events = kept
    assert store.version() == 0

    got = [r.outcome for r in runs.first_pass(store, first, answers, events, prices, "v1").orderBy("pos").collect()]
    assert store.version() == 1
    want = ["ingested", "already_attempted", "ingested", "unresolvable", "unresolvable", "unavailable", "unresolvable", "unresolvable"]
    assert got == want
    assert {r.title for r in store.read("events").collect()} == {"Steel is made", "10-K"} and [r.close for r in store.read("prices").filter("subject_id = 2").collect()] == [1.5]
    assert {r.fetch_id for r in store.read("fetches").collect()} == {"v1:steel", "v1:co:abc"}
    assert {r.slug: r.failures for r in store.read("ledger").collect()} == {"steel": 0, "co:abc": 0, "best buy earnings q3": 1, "slow": 0, "co:unheard of": 1}

    again = ask(("steel", "topic", 1, True), ("best buy earnings q3", "topic", 7, True), ("slow", "topic", 7, True))
    answers = answers.filter("slug <> 'slow'").union(spark.createDataFrame([("slow", False, "Slow", 1, 0)], answers.schema))
    assert [r.outcome for r in runs.visits.first_visits(again, store.read("ledger"), answers).orderBy("pos").collect()] == ["already_attempted", "unresolvable", "ingested"]
    runs.first_pass(store, again, answers, events, prices, "v2")
    assert {r.slug: r.failures for r in store.read("ledger").collect()} == {"steel": 0, "co:abc": 0, "best buy earnings q3": 2, "slow": 0, "co:unheard of": 1}
