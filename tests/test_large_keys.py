"""Queries on keys as large as those of larger tables."""

import datetime

import duckdb
from oracle import plain
from pyspark.sql import functions as F

from chronolith.functions import numbers, text
from chronolith.llm import license_scan
from chronolith.operators import pages as pages_
from chronolith.operators import resolve, series
from chronolith.plans import landed, pages, queries, views
from chronolith.sources import articles


def rows_of(spark, folder, query, **tables):
    """The query's rows and those of its SQL over small tables, each a list of dicts with its schema."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    got = query(spark, str(folder))
    want = con.sql(queries.ORACLES[query.__name__])
    at = [want.columns.index(c) for c in got.columns]
    return sorted((tuple(map(plain, r)) for r in got.collect()), key=repr), lambda: sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_a_rate_of_no_request_a_day_has_no_capacity(spark, tmp_path):
    users = [(u,) for u in (0, 1, 28_738, 28_739, 28_741, 90_001)]  # from 28,740 on, a day has fewer than 0.05 requests
    got, _ = rows_of(spark, tmp_path, pages.q_capacity, events=(users, "user_id long"))  # the SQL cannot cast what it divides by 0
    assert got == sorted([(0.0, None), (1.0, 4.0), (28_738.0, 288_380.0), (28_739.0, 288_390.0), (28_741.0, None), (90_001.0, None)], key=repr)


def test_filings_of_two_registrants_with_one_number_are_two(spark, tmp_path):
    date = datetime.datetime(2024, 1, 2)
    orders = [(1, 23, date), (12, 3, date), (4, 5, date), (9, 9, date)]  # 1-23 and 12-3 are one number without the dash; 4 and 9 are in one block or both
    got, want = rows_of(spark, tmp_path, landed.q_filings, orders=(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"))
    assert got == want() and len(got) == 4


def test_amounts_of_more_than_eight_digits_are_read_whole(spark, tmp_path):
    events = [(1, 0), (2, 5), (3, 4294), (4, 4295), (5, 90_001), (6, 9_000_001)]
    got, want = rows_of(spark, tmp_path, landed.q_hex_amounts, events=(events, "event_id long, user_id long"))
    assert got == want() and [r[2] for r in got] == [0.0, 5.0, 4294.0, 4295.0, 90_001.0, 9_000_001.0]


SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_of_the_event_model_hold_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(views, "ROWS_A_TASK", 500)
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    for df in (views.links(spark, SMALL), views.links(spark, SMALL, "event_id", "subject_id"), views.attest(spark, SMALL), views.bars(spark, SMALL)):
        assert df.rdd.getNumPartitions() == -(-lines // 500)


def test_the_next_bar_is_not_looked_for_anew_from_each_bar(spark):
    assert "unboundedfollowing" not in plan_of(queries.q_nearest_bar(spark, SMALL)).lower()
    day = lambda n: datetime.date(2024, 1, n)
    prices = spark.createDataFrame([(s, day(n)) for s in (1, 2) for n in range(2, 20)], "subject_id long, day date")
    events = spark.createDataFrame([(1, day(1)), (1, day(5)), (1, day(5)), (1, day(16)), (2, day(30))], "subject_id long, day date")
    rows = lambda df: sorted(map(tuple, df.collect()))
    one = rows(series.nearest_bar_of_events(prices, events))
    assert one == rows(series.nearest_event_bar(prices, series.snap(events, prices))) and len(one) == 24


def test_a_text_is_answered_once_for_all_who_ask(spark):
    subjects = spark.createDataFrame([(1, "company", "ford-motor", "F", "Ford Motor"), (2, "topic", "forum", None, "Forum")], "subject_id long, kind string, slug string, ticker string, display_name string")
    none = spark.createDataFrame([], "subject_id long, alias string")
    asked = spark.createDataFrame([(1, "ford"), (2, "ford "), (3, "fordd motor"), (4, "fordd motor"), (5, ""), (6, None)], "query_id long, query string")
    found = resolve.candidates(asked, subjects, none)
    assert "windowspecdefinition(query_id" not in plan_of(found)
    of = lambda q: [tuple(r)[1:] for r in found.orderBy("rank").collect() if r.query_id == q]
    assert of(1) == of(2) != [] and of(3) == of(4) != [] and of(5) == of(6) == []
    got = pages_.search(asked, subjects, none, spark.createDataFrame([], "ticker string, title string"))
    assert {(r.query_id, r.rung) for r in got.collect()} == {(1, "known_company"), (2, "known_company"), (3, "known_company"), (4, "known_company"), (5, "empty"), (6, "unresolved")}
    assert str(text.word_similarity(F.col("a"), F.col("b"))).count("split(") == 2  # each side once


def test_focus_reads_each_event_once(spark):
    score = str(text.focus_score(F.col("a"), F.col("b"), F.col("c")))
    assert score.count("split(") == 2


def test_short_amounts_are_read_as_long_ones(spark):
    numbers_ = [0, 1, 9, 999_999, 1_000_000, 123_456_789_012, 16**15 - 1, 16**15, 10**40]
    rows = [(hex(n), d) for n in numbers_ for d in (0, 6, 18, 20)] + [("0x", 6), ("0xg1", 6), (None, 6), ("0x000F", 6), ("0X0", 6)]
    df = spark.createDataFrame(rows, "h string, d int")
    parts = numbers.let(numbers.hex_parts(F.col("h"), F.col("d")), lambda p: p["whole"].cast("double") + F.coalesce(F.nullif(p["rest"], F.lit("")).cast("double"), F.lit(0.0)) / F.pow(F.lit(10.0), F.col("d")))
    units = numbers.hex_units(F.col("h"), F.col("d"))
    assert "conv(" in str(units).split("ELSE")[0]
    for r in df.select("h", "d", units.alias("a"), parts.alias("b")).collect():
        assert r.a == r.b, r


def test_citations_are_read_once_each(spark):
    raw = spark.createDataFrame([(1, 0, "A long title", "https://x.test/1", "5 Jan 2015", "")], "article_id long, pos int, title string, url string, raw_date string, publication string")
    assert plan_of(articles.sound_citations(raw)).count("format_string(%04d") <= 10 // 2  # a format for each shape of a date
    assert [tuple(r) for r in articles.sound_citations(raw).collect()] == [(1, 0, "A long title", "https://x.test/1", "2015-01-05", "day", "x.test")]
