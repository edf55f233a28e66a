"""The library's queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import numbers, text
from ..operators import dedupe, merges, reports, resolve, series, stats, timeline
from . import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *uses: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``uses`` names views that the SQL begins with."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ctes = [f"{u} AS ({v.SQL[u]})" for u in uses]
            body = sql.strip()
            head = next((h for h in ("WITH RECURSIVE ", "WITH ") if body.upper().startswith(h)), "")
            if head:
                body = head + ", ".join([*ctes, body[len(head) :]])
            elif ctes:
                body = "WITH " + ", ".join(ctes) + " " + body
            ORACLES[f.__name__] = body
        return f

    return add


def ids(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r4(x: F.Column | str) -> F.Column:
    """To four decimals, in steps that round alike in both engines."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * 10000 + 0.5) / 10000


def day(column: str) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd")


SPIKES = """
WITH c AS (SELECT {period} AS period, event_type AS kind, count(DISTINCT event_id) AS n FROM events GROUP BY 1, 2),
s AS (SELECT kind, median(n) AS base, mad(n) AS spread FROM c GROUP BY 1)
SELECT CAST(CAST(period AS DATE) AS VARCHAR) AS period, kind, n, base, spread, CASE WHEN spread > 0 THEN round((n - base) / spread, 1) ELSE n - base END AS magnitude
FROM c JOIN s USING (kind) WHERE n >= 5 AND CASE WHEN spread > 0 THEN n >= base + {sigma} * spread ELSE n >= base + {sigma} + 1 END"""


def _spikes(spark: SparkSession, sf: str, period: F.Column, sigma: float) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"), "ts", F.lit(None).cast("double").alias("relevance"))
    hit = stats.spikes(stats.period_counts(rows, period), sigma=sigma)
    return hit.select(day("period").alias("period"), "kind", "n", F.col("base").cast("double").alias("base"), F.col("spread").cast("double").alias("spread"), F.col("magnitude").cast("double").alias("magnitude"))


@query(SPIKES.format(period="date_trunc('week', ts)", sigma="0.5"))
def q_spikes_weekly(spark: SparkSession, sf: str) -> DataFrame:
    return _spikes(spark, sf, stats.week_of(F.col("ts")), 0.5)


@query(SPIKES.format(period="date_trunc('day', ts)", sigma="2"))
def q_spikes_daily(spark: SparkSession, sf: str) -> DataFrame:
    return _spikes(spark, sf, F.to_date("ts"), 2.0)


@query("""
SELECT CAST(date_trunc('week', day)::DATE AS VARCHAR) AS week, kind, count(DISTINCT event_id) AS n, array_to_string(list_sort(list(DISTINCT event_id))[1:40], ',') AS ids
FROM ev JOIN links USING (event_id) WHERE relevance IS NULL OR relevance >= 0.4 GROUP BY 1, 2""", "ev", "links")  # fmt: skip
def q_weekly_counts(spark: SparkSession, sf: str) -> DataFrame:
    gated = v.ev(spark, sf).join(v.links(spark, sf), "event_id")
    return stats.period_counts(gated, stats.week_of(F.col("day")), 40).select(day("period").alias("week"), "kind", "n", ids("ids").alias("ids"))


@query("""
WITH p AS (SELECT event_id, day, count(DISTINCT subject_id) AS peers FROM ev JOIN links USING (event_id) JOIN subj USING (subject_id) GROUP BY 1, 2 HAVING count(DISTINCT subject_id) > 1)
SELECT CAST(date_trunc('week', day)::DATE AS VARCHAR) AS week, count(*) AS shared, max(peers) AS widest, array_to_string(list_sort(list(event_id))[1:40], ',') AS ids FROM p GROUP BY 1""", "ev", "links", "subj")  # fmt: skip
def q_cross_peer_weeks(spark: SparkSession, sf: str) -> DataFrame:
    """All subjects as one group of peers."""
    return stats.cross_peer(v.ev(spark, sf).join(v.links(spark, sf), "event_id"), v.subj(spark, sf).select("subject_id"), most_ids=40).select(day("week").alias("week"), "shared", "widest", ids("ids").alias("ids"))


@query("""
WITH p AS (SELECT industry_id, event_id, day, count(DISTINCT subject_id) AS peers FROM ev JOIN links USING (event_id) JOIN subj USING (subject_id) GROUP BY 1, 2, 3 HAVING count(DISTINCT subject_id) > 1)
SELECT industry_id, CAST(date_trunc('week', day)::DATE AS VARCHAR) AS week, count(*) AS shared, max(peers) AS widest, array_to_string(list_sort(list(event_id))[1:40], ',') AS ids FROM p GROUP BY 1, 2""", "ev", "links", "subj")  # fmt: skip
def q_cross_peer_weeks_by_industry(spark: SparkSession, sf: str) -> DataFrame:
    """The cross-peer weeks of every industry."""
    events = v.ev(spark, sf).join(v.links(spark, sf), "event_id")
    return stats.cross_peer(events, v.subj(spark, sf), "industry_id", 40).select("industry_id", day("week").alias("week"), "shared", "widest", ids("ids").alias("ids"))


FIRST_LAST = "SELECT subject_id, arg_min(close, day) AS first_close, arg_max(close, day) AS last_close, min(day) AS d0, max(day) AS d1 FROM bars GROUP BY 1"


@query(f"SELECT subject_id, first_close, last_close, CAST(d0 AS VARCHAR) AS d0, CAST(d1 AS VARCHAR) AS d1, round((last_close - first_close) / first_close * 100, 1) AS pct FROM ({FIRST_LAST}) WHERE first_close > 0", "bars")
def q_price_first_last(spark: SparkSession, sf: str) -> DataFrame:
    return stats.first_last(v.bars(spark, sf)).select("subject_id", "first_close", "last_close", day("d0").alias("d0"), day("d1").alias("d1"), "pct")


@query(f"""
WITH r AS (SELECT subject_id, industry_id, round((last_close - first_close) / first_close * 100, 1) AS pct FROM ({FIRST_LAST}) JOIN subj USING (subject_id) WHERE first_close > 0),
m AS (SELECT industry_id, median(pct) AS sector, count(*) AS members FROM r GROUP BY 1 HAVING count(*) >= 3),
w AS (SELECT *, row_number() OVER (PARTITION BY industry_id ORDER BY abs(pct - sector) DESC, subject_id) AS n FROM r JOIN m USING (industry_id))
SELECT industry_id, subject_id, pct, round(sector, 4) AS sector, members, round(pct - sector, 1) AS gap FROM w WHERE n = 1 AND abs(round(pct - sector, 1)) >= 15""", "bars", "subj")  # fmt: skip
def q_divergence(spark: SparkSession, sf: str) -> DataFrame:
    returns = stats.first_last(v.bars(spark, sf)).join(v.subj(spark, sf), "subject_id").select("subject_id", "industry_id", "pct")
    return stats.divergence(returns, "industry_id").select("industry_id", "subject_id", "pct", F.round("sector", 4).alias("sector"), "members", "gap")


@query(f"""
WITH e AS (SELECT industry_id, subject_id, event_id, kind, day, relevance, CAST(date_trunc('week', day) AS DATE) AS week FROM ev JOIN links USING (event_id) JOIN subj USING (subject_id)),
c AS (SELECT industry_id, week, kind, count(DISTINCT event_id) AS n, list_sort(list(DISTINCT event_id))[1:40] AS event_ids FROM e WHERE relevance IS NULL OR relevance >= 0.4 GROUP BY 1, 2, 3),
s AS (SELECT industry_id, kind, median(n) AS base, mad(n) AS spread FROM c GROUP BY 1, 2),
one AS (SELECT industry_id, CASE WHEN kind = 'regulation' THEN 'regulatory_burst' ELSE 'volume_spike' END AS signal, kind, week AS w0, week + 6 AS w1, CASE WHEN spread > 0 THEN round((n - base) / spread, 1) ELSE n - base END AS magnitude, event_ids
    FROM c JOIN s USING (industry_id, kind) WHERE n >= CASE WHEN kind = 'regulation' THEN 4 ELSE 5 END AND CASE WHEN spread > 0 THEN n >= base + 2 * spread ELSE n >= base + 3 END),
p AS (SELECT industry_id, event_id, week, count(DISTINCT subject_id) AS peers FROM e GROUP BY 1, 2, 3 HAVING count(DISTINCT subject_id) > 1),
two AS (SELECT industry_id, 'cross_peer_cluster' AS signal, NULL AS kind, week AS w0, week + 6 AS w1, CAST(max(peers) AS DOUBLE) AS magnitude, list_sort(list(event_id))[1:40] AS event_ids FROM p GROUP BY 1, week),
r AS (SELECT industry_id, subject_id, d0, d1, round((last_close - first_close) / first_close * 100, 1) AS pct FROM ({FIRST_LAST}) JOIN subj USING (subject_id) WHERE first_close > 0),
m AS (SELECT industry_id, median(pct) AS sector FROM r GROUP BY 1 HAVING count(*) >= 3),
d AS (SELECT *, round(pct - sector, 1) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY industry_id ORDER BY abs(pct - sector) DESC, subject_id) AS k FROM r JOIN m USING (industry_id)) WHERE k = 1),
x AS (SELECT industry_id, list(event_id ORDER BY day DESC, event_id)[1:25] AS event_ids FROM e JOIN d USING (industry_id, subject_id) WHERE abs(gap) >= 15 AND (relevance IS NULL OR relevance >= 0.4) AND kind IN ('earnings', 'filing', 'news') GROUP BY 1),
three AS (SELECT industry_id, 'price_divergence' AS signal, NULL AS kind, d0 AS w0, d1 AS w1, CAST(gap AS DOUBLE) AS magnitude, coalesce(event_ids, []) AS event_ids FROM d LEFT JOIN x USING (industry_id) WHERE abs(gap) >= 15)
SELECT industry_id, signal, kind, CAST(CAST(w0 AS DATE) AS VARCHAR) AS window_start, CAST(CAST(w1 AS DATE) AS VARCHAR) AS window_end, magnitude, array_to_string(event_ids, ',') AS event_ids FROM (FROM one UNION ALL FROM two UNION ALL FROM three)""", "ev", "links", "subj", "bars")  # fmt: skip
def q_signals(spark: SparkSession, sf: str) -> DataFrame:
    """The signals of every industry."""
    events = v.ev(spark, sf).join(v.links(spark, sf), "event_id")
    return stats.signals(events, v.bars(spark, sf), v.subj(spark, sf), scope="industry_id").select("industry_id", "signal", "kind", day("window_start").alias("window_start"), day("window_end").alias("window_end"), "magnitude", ids("event_ids").alias("event_ids"))


@query("""
WITH g AS (SELECT subject_id, source_id, count(DISTINCT event_id) AS events FROM links JOIN attest USING (event_id) GROUP BY 1, 2),
l AS (SELECT subject_id, source_id, arg_max({'at': fetched_at, 'outcome': outcome}, {'at': fetched_at, 'id': fetch_id}) AS x FROM fetches GROUP BY 1, 2)
SELECT subject_id, source_id, coalesce(events, 0) AS events, strftime(x.at, '%Y-%m-%d %H:%M:%S') AS fetched_at, x.outcome AS outcome,
CASE WHEN x.outcome = 'throttled' THEN 'throttled' WHEN x.outcome = 'error' THEN 'error' WHEN coalesce(events, 0) > 0 THEN 'events' WHEN x.at IS NOT NULL THEN 'asked' ELSE 'never' END AS status
FROM g FULL JOIN l USING (subject_id, source_id) WHERE source_id BETWEEN 0 AND 17""", "links", "attest", "fetches")  # fmt: skip
def q_source_contributions(spark: SparkSession, sf: str) -> DataFrame:
    attested = v.links(spark, sf).join(v.attest(spark, sf), "event_id").select("subject_id", F.col("source_id").cast("long").alias("source_id"), "event_id")
    out = timeline.contributions(spark.range(18).withColumnRenamed("id", "source_id"), attested, v.fetches(spark, sf))
    return out.select("subject_id", "source_id", "events", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"), "outcome", "status")


@query("""
SELECT subject_id, l.event_id, kind, CAST(day AS VARCHAR) AS day, title, relevance, p.url AS url, CASE WHEN n > 1 THEN concat(p.source_label, ' · ', n, ' sources') ELSE p.source_label END AS source, coalesce(n, 0) AS sources
FROM links l JOIN ev USING (event_id) LEFT JOIN (SELECT event_id, count(*) AS n FROM attest GROUP BY 1) a USING (event_id) LEFT JOIN attest p ON p.event_id = l.event_id AND p.is_primary
WHERE (relevance IS NULL OR relevance >= 0.4) AND CASE WHEN n > 1 THEN p.source_label IS NOT NULL ELSE true END
UNION ALL SELECT subject_id, l.event_id, kind, CAST(day AS VARCHAR), title, relevance, NULL, NULL, n FROM links l JOIN ev USING (event_id) JOIN (SELECT event_id, count(*) AS n, bool_or(is_primary) AS has FROM attest GROUP BY 1) a USING (event_id)
WHERE (relevance IS NULL OR relevance >= 0.4) AND n > 1 AND NOT has""", "ev", "links", "attest")  # fmt: skip
def q_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.timeline(v.ev(spark, sf), v.links(spark, sf), v.attest(spark, sf)).withColumn("day", day("day"))


@query("""
WITH o AS (SELECT industry_id, event_id, nullif(string_agg(DISTINCT ticker, ', ' ORDER BY ticker), '') AS tickers, count(DISTINCT subject_id) AS companies FROM links JOIN subj USING (subject_id) WHERE relevance IS NULL OR relevance >= 0.4 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY industry_id ORDER BY day DESC, event_id) AS n FROM o JOIN ev USING (event_id))
SELECT industry_id, event_id, tickers, companies, kind, CAST(day AS VARCHAR) AS day, title FROM r WHERE n <= 400""", "links", "subj", "ev")  # fmt: skip
def q_industry_timeline(spark: SparkSession, sf: str) -> DataFrame:
    out = timeline.industry_timeline(v.ev(spark, sf), v.links(spark, sf), v.members(spark, sf), v.subj(spark, sf))
    return out.select("industry_id", "event_id", "tickers", "companies", "kind", day("day").alias("day"), "title")


@query("SELECT * FROM (SELECT industry_id AS scope_id, CAST(industry_id AS BIGINT) AS subject_id FROM members UNION SELECT industry_id, member_id FROM members)", "members")
def q_scope(spark: SparkSession, sf: str) -> DataFrame:
    m = v.members(spark, sf)
    return timeline.scope(m.select("industry_id").distinct(), m).select("scope_id", F.col("subject_id").cast("long").alias("subject_id"))


@query("SELECT subject_id, source_id, fetch_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, source_id ORDER BY fetched_at DESC, fetch_id DESC) AS n FROM fetches WHERE outcome IN ('ok', 'empty')) WHERE n = 1", "fetches")
def q_last_fetched(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.latest(v.fetches(spark, sf), ["subject_id", "source_id"], "fetched_at", "fetch_id", ["ok", "empty"]).select("subject_id", "source_id", "fetch_id", "outcome")


@query("SELECT subject_id, display_name, count(*) AS events FROM links JOIN subj USING (subject_id) GROUP BY 1, 2 HAVING count(*) >= 100", "links", "subj")
def q_subject_index(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.index(v.links(spark, sf), v.subj(spark, sf), 100, 1_000_000).select("subject_id", "display_name", "events")


@query("SELECT n_nationkey AS industry_id, coalesce(array_to_string(list_sort(list(member_id) FILTER (member_id IS NOT NULL)), ','), '') AS members FROM nation LEFT JOIN members ON industry_id = n_nationkey GROUP BY 1", "members")
def q_memberships(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.memberships(table(spark, sf, "nation").select(F.col("n_nationkey").alias("industry_id")), v.members(spark, sf)).select("industry_id", ids("members").alias("members"))


YEARS = "SELECT CAST(o_custkey AS BIGINT) AS subject_id, o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 7 WHEN 0 THEN 'year' WHEN 1 THEN 'month' ELSE 'day' END AS precision, concat('Order ', o_orderkey) AS title FROM orders"


@query(f"""
WITH e AS ({YEARS}), r AS (
SELECT subject_id, 'year' AS kind, strftime(day, '%Y') AS sort, event_id, title FROM e UNION ALL SELECT subject_id, 'month', strftime(day, '%Y-%m'), event_id, title FROM e WHERE precision <> 'year'
UNION ALL SELECT subject_id, 'day', CASE precision WHEN 'year' THEN strftime(day, '%Y-00') WHEN 'month' THEN strftime(day, '%Y-%m-00') ELSE strftime(day, '%Y-%m-%d') END, event_id, title FROM e)
SELECT subject_id, kind, sort, count(*) AS n, array_to_string(list(title ORDER BY event_id)[1:8], ' | ') AS peek FROM r GROUP BY 1, 2, 3""")  # fmt: skip
def q_year_month_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    events = table(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id"), k.alias("event_id"), F.to_date("o_orderdate").alias("day"), F.when(k % 7 == 0, "year").when(k % 7 == 1, "month").otherwise("day").alias("precision"), F.concat(F.lit("Order "), k).alias("title"))
    return timeline.year_month_rows(events).select("subject_id", "kind", "sort", "n", F.array_join("peek", " | ").alias("peek"))


SMA = "SELECT subject_id, day, sum(close) OVER w / 20 AS mean, row_number() OVER (PARTITION BY subject_id ORDER BY day) AS n FROM bars WINDOW w AS (PARTITION BY subject_id ORDER BY day ROWS 19 PRECEDING)"


@query(f"SELECT subject_id, CAST(day AS VARCHAR) AS day, floor(round(mean * 100, 6) + 0.5) / 100 AS sma FROM ({SMA}) WHERE n >= 20", "bars")
def q_sma(spark: SparkSession, sf: str) -> DataFrame:
    return series.sma(v.bars(spark, sf), 20).withColumn("day", day("day"))


MOVES = "SELECT subject_id, day, bar, (close - prev) / prev * 100 AS pct FROM (SELECT subject_id, day, close, row_number() OVER w - 1 AS bar, lag(close) OVER w AS prev, lag(day) OVER w AS before FROM bars WINDOW w AS (PARTITION BY subject_id ORDER BY day)) WHERE prev > 0 AND day - before <= 7"


@query(f"SELECT subject_id, CAST(day AS VARCHAR) AS day, bar, floor(pct * 10000 + 0.5) / 10000 AS pct FROM ({MOVES})", "bars")
def q_daily_moves(spark: SparkSession, sf: str) -> DataFrame:
    return series.daily_moves(v.bars(spark, sf)).select("subject_id", day("day").alias("day"), F.col("bar").cast("long").alias("bar"), r4("pct").alias("pct"))


@query(f"""
WITH RECURSIVE m AS (SELECT subject_id, day, bar, pct, row_number() OVER (PARTITION BY subject_id ORDER BY abs(pct) DESC, bar) AS n FROM ({MOVES}) WHERE abs(pct) >= 2),
l AS (SELECT subject_id, list({{'bar': bar, 'day': day, 'pct': pct}} ORDER BY n) AS rest FROM m GROUP BY 1),
g AS (SELECT subject_id, 1 AS rank, rest[1] AS x, rest FROM l UNION ALL
    SELECT subject_id, rank + 1, list_filter(rest, lambda r: abs(r.bar - x.bar) >= 5)[1], list_filter(rest, lambda r: abs(r.bar - x.bar) >= 5) FROM g WHERE rank < 6 AND x IS NOT NULL)
SELECT subject_id, CAST(rank AS BIGINT) AS rank, CAST(x.day AS VARCHAR) AS day, x.bar AS bar, floor(x.pct * 10000 + 0.5) / 10000 AS pct FROM g WHERE x IS NOT NULL""", "bars")  # fmt: skip
def q_biggest_moves(spark: SparkSession, sf: str) -> DataFrame:
    return series.biggest_moves(series.daily_moves(v.bars(spark, sf))).select("subject_id", F.col("rank").cast("long").alias("rank"), day("day").alias("day"), F.col("bar").cast("long").alias("bar"), r4("pct").alias("pct"))


ASOF = "SELECT e.event_id, e.subject_id, e.kind, e.day, b.day AS bar_day FROM (SELECT event_id, subject_id, kind, day FROM links JOIN ev USING (event_id)) e ASOF JOIN bars b ON e.subject_id = b.subject_id AND e.day >= b.day"


def _events_of(spark: SparkSession, sf: str) -> DataFrame:
    return v.links(spark, sf).join(v.ev(spark, sf), "event_id").select("event_id", "subject_id", "kind", "day")


@query(f"SELECT event_id, subject_id, CAST(day AS VARCHAR) AS day, CAST(bar_day AS VARCHAR) AS bar_day FROM ({ASOF})", "links", "ev", "bars")
def q_asof_snap(spark: SparkSession, sf: str) -> DataFrame:
    return series.snap(_events_of(spark, sf), v.bars(spark, sf)).select("event_id", "subject_id", day("day").alias("day"), day("bar_day").alias("bar_day"))


@query(f"SELECT subject_id, CAST(bar_day AS VARCHAR) AS bar_day, array_to_string(list_sort(list(event_id)), ',') AS events FROM ({ASOF}) GROUP BY 1, 2", "links", "ev", "bars")
def q_events_by_bar(spark: SparkSession, sf: str) -> DataFrame:
    return series.by_bar(series.snap(_events_of(spark, sf), v.bars(spark, sf))).select("subject_id", day("bar_day").alias("bar_day"), ids("events").alias("events"))


@query("""
WITH n AS (SELECT subject_id, day, row_number() OVER (PARTITION BY subject_id ORDER BY day) - 1 AS bar FROM bars), s AS (SELECT DISTINCT subject_id, bar_day AS day FROM (""" + ASOF + """)),
m AS (SELECT n.*, s.day IS NOT NULL AS has FROM n LEFT JOIN s USING (subject_id, day)),
p AS (SELECT subject_id, day, bar, max(CASE WHEN has THEN bar END) OVER (PARTITION BY subject_id ORDER BY bar) AS b, min(CASE WHEN has THEN bar END) OVER (PARTITION BY subject_id ORDER BY bar ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM m),
d AS (SELECT subject_id, day, CASE WHEN a IS NULL OR bar - b < a - bar THEN b ELSE a END AS t, bar FROM p WHERE a IS NOT NULL OR b IS NOT NULL)
SELECT d.subject_id, CAST(d.day AS VARCHAR) AS day, CAST(n.day AS VARCHAR) AS event_day, abs(t - d.bar) AS dist FROM d JOIN n ON n.subject_id = d.subject_id AND n.bar = t WHERE abs(t - d.bar) <= 5""", "links", "ev", "bars")  # fmt: skip
def q_nearest_bar(spark: SparkSession, sf: str) -> DataFrame:
    return series.nearest_bar_of_events(v.bars(spark, sf), _events_of(spark, sf)).select("subject_id", day("day").alias("day"), day("event_day").alias("event_day"), F.col("dist").cast("long").alias("dist"))


CATALYST = {"earnings": 5, "filing": 4, "regulation": 3, "news": 1, "citation": 1, "history": 2}


def _priority(column: str, of: dict[str, int]) -> F.Column:
    return F.create_map(*(F.lit(x) for pair in of.items() for x in pair))[F.col(column)]


def _priority_sql(column: str, of: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in of.items()) + " END"


@query(f"""
WITH m AS ({MOVES} AND abs((close - prev) / prev * 100) >= {model.MIN_MOVE_PCT}), e AS (SELECT event_id, subject_id, kind, day FROM links JOIN ev USING (event_id)),
w AS (SELECT subject_id, day, unnest(range({model.CATALYST_LOOKBACK + 1})) AS back FROM m),
c AS (SELECT w.subject_id, w.day, e.event_id, e.day AS event_day, {_priority_sql('e.kind', CATALYST)} - 2 * back AS score FROM w JOIN e ON e.subject_id = w.subject_id AND e.day = w.day - CAST(back AS INT)),
b AS (SELECT *, row_number() OVER (PARTITION BY subject_id, day ORDER BY score DESC, event_day, event_id) AS n FROM c)
SELECT m.subject_id, CAST(m.day AS VARCHAR) AS day, event_id, CAST(coalesce(event_day, m.day) AS VARCHAR) AS jump_day FROM m LEFT JOIN b ON b.subject_id = m.subject_id AND b.day = m.day AND n = 1""", "bars", "links", "ev")  # fmt: skip
def q_catalysts(spark: SparkSession, sf: str) -> DataFrame:
    moves = series.daily_moves(v.bars(spark, sf)).filter(F.abs("pct") >= model.MIN_MOVE_PCT)
    return series.catalysts(moves, _events_of(spark, sf), _priority("kind", model.CATALYST_PRIORITY)).select("subject_id", day("day").alias("day"), "event_id", day("jump_day").alias("jump_day"))


@query("""
WITH e AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT min(day) AS lo, max(day) AS hi FROM bars WHERE subject_id IN (1, 2) GROUP BY subject_id)),
i AS (SELECT CASE subject_id WHEN 1 THEN 'a' ELSE 'b' END AS side, day, close FROM bars, e WHERE subject_id IN (1, 2) AND day BETWEEN lo AND hi)
SELECT side, CAST(day AS VARCHAR) AS day, floor(close / first_value(close) OVER (PARTITION BY side ORDER BY day) * 100 * 10000 + 0.5) / 10000 AS value FROM i""", "bars")  # fmt: skip
def q_overlay(spark: SparkSession, sf: str) -> DataFrame:
    bars = v.bars(spark, sf)
    return series.overlay(bars.filter("subject_id = 1"), bars.filter("subject_id = 2")).select("side", day("day").alias("day"), r4("value").alias("value"))


@query(f"SELECT subject_id, CAST(bar_day AS VARCHAR) AS bar_day, event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, bar_day ORDER BY {_priority_sql('kind', {'earnings': 3, 'filing': 2, 'news': 1, 'regulation': 2, 'citation': 1, 'history': 2})} DESC, event_id) AS n FROM ({ASOF})) WHERE n = 1", "links", "ev", "bars")
def q_markers(spark: SparkSession, sf: str) -> DataFrame:
    snapped = series.snap(_events_of(spark, sf), v.bars(spark, sf))
    return series.markers(snapped, _priority("kind", model.MARKER_PRIORITY)).select("subject_id", day("bar_day").alias("bar_day"), "event_id", "kind")


@query("SELECT subject_id, CAST(day AS VARCHAR) AS day, volume, CASE WHEN lag(close) OVER (PARTITION BY subject_id ORDER BY day) > close THEN 'down' ELSE 'up' END AS direction FROM bars WHERE volume % 5 <> 0", "bars")
def q_volume_direction(spark: SparkSession, sf: str) -> DataFrame:
    held = v.bars(spark, sf).withColumn("volume", F.when(F.col("volume") % 5 != 0, F.col("volume")))
    return series.volume_direction(held).withColumn("day", day("day"))


@query("SELECT subject_id, CAST(day AS VARCHAR) AS day, close, floor((close - prev) / prev * 100 * 10000 + 0.5) / 10000 AS pct FROM (SELECT *, lag(close) OVER w AS prev, row_number() OVER (PARTITION BY subject_id ORDER BY day DESC) AS n FROM bars WINDOW w AS (PARTITION BY subject_id ORDER BY day)) WHERE n = 1", "bars")
def q_last_change(spark: SparkSession, sf: str) -> DataFrame:
    return series.last_change(v.bars(spark, sf)).select("subject_id", day("day").alias("day"), "close", r4("pct").alias("pct"))


@query("""
WITH d AS (SELECT o_custkey AS subject_id, CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y') AS section, count(*) AS items, bool_and(o_orderstatus <> 'F') AS only_ FROM orders GROUP BY 1, 2, 3),
f AS (SELECT *, CASE WHEN only_ AND coalesce(lag(only_) OVER w, false) AND lag(section) OVER w = section THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY subject_id ORDER BY day)),
r AS (SELECT *, sum(new) OVER (PARTITION BY subject_id ORDER BY day) AS run FROM f)
SELECT subject_id, section, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS days, CAST(sum(items) AS BIGINT) AS items FROM r WHERE only_ GROUP BY subject_id, section, run HAVING sum(items) >= 3""")  # fmt: skip
def q_runs(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("subject_id"), F.to_date("o_orderdate").alias("day"), F.date_format("o_orderdate", "yyyy").alias("section")).agg(F.count("*").alias("items"), F.bool_and(F.col("o_orderstatus") != "F").alias("only"))
    return series.runs(days).select("subject_id", "section", day("first_day").alias("first_day"), day("last_day").alias("last_day"), "days", "items")


@query("""
WITH g AS (SELECT o_custkey AS subject_id, strftime(o_orderdate, '%Y') AS period, count(*) AS events, min(CAST(o_orderdate AS DATE)) AS day FROM orders GROUP BY 1, 2),
y AS (SELECT *, year(day) + ((month(day) - 1) + (day(day) - 1) / 31.0) / 12.0 AS value FROM g),
d AS (SELECT *, value - lag(value) OVER (PARTITION BY subject_id ORDER BY day) AS delta FROM y),
x AS (SELECT *, CASE WHEN delta IS NULL THEN 0.0 ELSE least(greatest(round(delta, 9) * 6, 148.0), 520.0) END AS gap FROM d)
SELECT subject_id, period, events, round(154 + sum(gap) OVER (PARTITION BY subject_id ORDER BY day), 3) AS x, CAST(CASE WHEN delta >= 15 AND gap > 168 THEN floor(delta + 0.5) ELSE 0 END AS BIGINT) AS gap_years FROM x""")  # fmt: skip
def q_stacks(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("day"))
    return series.stacks(events)


_BARE = "regexp_replace(@t, '[“”\"''’‘]', '', 'g')"
_HEAD = f"lower(trim(regexp_extract({_BARE}, '^([^-–—:]*)[-–—:]', 1), ' ' || chr(9) || chr(10) || chr(13)))"
_CUT = f"CASE WHEN {_HEAD} IN ('exclusive', 'breaking', 'analysis', 'explainer') OR regexp_full_match({_HEAD}, 'update [0-9]+') THEN regexp_replace({_BARE}, '^[^-–—:]*[-–—:]', '') ELSE {_BARE} END"
_TAIL = f"list_filter(string_split_regex(regexp_extract({_CUT}, '[-–—|:]([^-–—|:]*)$', 1), '[{text.SPACE}]+'), lambda w: w <> '')"
_FULL = f"CASE WHEN len({_TAIL}) BETWEEN 1 AND 4 AND len(list_filter({_TAIL}, lambda w: NOT regexp_full_match(w, '[A-Z][A-Za-z0-9_.&'']*'))) = 0 THEN regexp_replace({_CUT}, '[-–—|:][^-–—|:]*$', '') ELSE {_CUT} END"
STORY = f"concat(trim(regexp_replace(regexp_replace(lower({_FULL}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')), '|', @d)"


@query(f"SELECT pos, {STORY.replace('@t', 'title').replace('@d', 'CAST(day AS VARCHAR)')} AS story FROM news", "news")
def q_story_key(spark: SparkSession, sf: str) -> DataFrame:
    return v.news(spark, sf).select("pos", text.story_key(F.col("title"), F.col("day")).alias("story"))


@query(f"""
WITH n AS (SELECT *, {STORY.replace('@t', 'title').replace('@d', 'CAST(day AS VARCHAR)')} AS story, CASE WHEN description <> '' THEN 2 ELSE 0 END + CASE WHEN image_url <> '' THEN 1 ELSE 0 END + CASE WHEN url <> '' THEN 1 ELSE 0 END AS rich FROM news WHERE kind = 'news')
SELECT min(pos) AS place, count(*) AS copies, arg_min(pos, {{'r': -rich, 'p': pos}}) AS pos, 'news' AS kind FROM n GROUP BY story UNION ALL SELECT pos, 1, pos, kind FROM news WHERE kind <> 'news'""", "news")  # fmt: skip
def q_story_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.collapse(v.news(spark, sf)).select("place", "copies", "pos", "kind")


@query("""
WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
k AS (SELECT DISTINCT source, CAST(floor((k * (n - 1)) / 19 + 0.5) AS BIGINT) AS i FROM (SELECT DISTINCT source, n FROM s), range(20) t(k))
SELECT s.doc_id, s.source FROM s LEFT JOIN k ON k.source = s.source AND k.i = s.i WHERE n <= 20 OR k.i IS NOT NULL""")  # fmt: skip
def q_even_spread(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.spread(table(spark, sf, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 20)


@query("""
WITH h AS (SELECT o_custkey AS subject_id, o_orderkey AS event_id, CASE WHEN o_orderkey % 3 = 0 THEN 'history' WHEN o_orderkey % 3 = 1 THEN 'citation' ELSE 'news' END AS kind, CAST(o_orderdate AS DATE) - CAST(CASE WHEN o_orderkey % 11 = 0 THEN 80000 WHEN o_orderkey % 7 = 0 THEN 160000 ELSE 0 END AS INT) AS day FROM orders),
y AS (SELECT subject_id, event_id, year(day) AS y, year(day) - lag(year(day)) OVER w > 120 AS far FROM h WHERE kind <> 'news' WINDOW w AS (PARTITION BY subject_id ORDER BY year(day), event_id)),
f AS (SELECT subject_id, max(y) AS floor FROM (SELECT subject_id, y, bool_and(coalesce(far, true)) OVER (PARTITION BY subject_id ORDER BY y, event_id) AS ok FROM y) WHERE ok GROUP BY 1)
SELECT h.subject_id, event_id, kind, CAST(day AS VARCHAR) AS day FROM h LEFT JOIN f USING (subject_id) WHERE NOT coalesce(kind <> 'news' AND year(day) < floor, false)""")  # fmt: skip
def q_drop_prehistory(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    back = F.when(k % 11 == 0, 80000).when(k % 7 == 0, 160000).otherwise(0)
    events = table(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id"), k.alias("event_id"), F.when(k % 3 == 0, "history").when(k % 3 == 1, "citation").otherwise("news").alias("kind"), F.date_sub(F.to_date("o_orderdate"), back).alias("day"))
    return dedupe.drop_prehistory(events).withColumn("day", day("day"))


@query("""
WITH p AS (SELECT p_partkey AS event_id, p_name AS title,
    list_transform(string_split(lower(p_name), ' '), lambda w: CASE WHEN len(w) > 4 AND w LIKE '%s' THEN w[:-2] ELSE w END) AS h,
    list_transform(string_split(trim(regexp_replace(lower(concat_ws(' ', p_brand, p_type)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: CASE WHEN len(w) > 4 AND w LIKE '%s' THEN w[:-2] ELSE w END) AS b FROM part),
s AS (SELECT *, list_sum(list_transform(['small', 'ring', 'copper'], lambda t: CASE WHEN list_contains(h, t) THEN 2 WHEN list_contains(b, t) THEN 1 ELSE 0 END)) AS weight, concat(' ', array_to_string(h, ' '), ' | ', array_to_string(b, ' '), ' ') AS said FROM p)
SELECT event_id, title, round(CASE WHEN contains(said, ' small ring ') OR contains(said, ' ring copper ') THEN least(1.0, weight / 6.0 + 0.15) ELSE weight / 6.0 END, 6) AS score FROM s WHERE weight > 0""")  # fmt: skip
def q_focus_rank(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "part").select(F.col("p_partkey").alias("event_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("description"), F.col("p_type").alias("source"), F.when(F.col("p_size") > 5, F.col("p_size") / 50).alias("relevance"), F.date_add(F.lit("2024-01-01").cast("date"), "p_size").alias("day"))
    return dedupe.ranked(dedupe.focus(events, "small rings of copper")).select("event_id", "title", F.round("score", 6).alias("score"))


#: The tone of the texts of t (doc_id, title), by their words and the three words before each.
TONE = f"""
w AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(title), '[^a-z0-9{text.SPACE}-]', ' ', 'g'), '[{text.SPACE}]+'), lambda x: x <> '') AS w FROM t),
m AS (SELECT doc_id, w, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains({model.POSITIVE}, w[i]) THEN 1 WHEN list_contains({model.NEGATIVE}, w[i]) THEN -1 ELSE 0 END * CASE WHEN list_has_any(w[greatest(i - 3, 1):i - 1], {model.NEGATORS}) THEN -1 ELSE 1 END) AS m FROM w)
SELECT doc_id, CASE WHEN list_contains(m, 1) AND NOT list_contains(m, -1) THEN 'positive' WHEN list_contains(m, -1) AND NOT list_contains(m, 1) THEN 'negative' ELSE 'neutral' END AS tone FROM m"""


@query(f"WITH t AS (SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN 'profits rise ' WHEN 1 THEN 'not a miss for ' WHEN 2 THEN 'never record losses ' ELSE '' END, text) AS title FROM documents), {TONE}")
def q_tone(spark: SparkSession, sf: str) -> DataFrame:
    """The tone of whole texts behind headlines of each kind."""
    d = F.col("doc_id")
    lead = F.when(d % 4 == 0, "profits rise ").when(d % 4 == 1, "not a miss for ").when(d % 4 == 2, "never record losses ").otherwise("")
    return table(spark, sf, "documents").select("doc_id", text.tone(F.concat(lead, "text")).alias("tone"))


@query(f"WITH t AS (SELECT doc_id, text AS title FROM documents), {TONE}")
def q_tone_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The tone of whole texts."""
    return table(spark, sf, "documents").select("doc_id", text.tone(F.col("text")).alias("tone"))


@query("""
WITH a AS (SELECT rung, count(*) AS searches, count(has_events) AS known, count(*) FILTER (has_events) AS hits FROM searches GROUP BY ROLLUP (rung)), t AS (SELECT count(*) AS total FROM searches)
SELECT rung, searches, round(searches / total, 6) AS share, round(coalesce(hits / nullif(known, 0), 0), 6) AS landed, searches - known AS unknown FROM a, t""", "searches")  # fmt: skip
def q_search_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.summarise(v.searches(spark, sf)).select("rung", "searches", F.round("share", 6).alias("share"), F.round("landed", 6).alias("landed"), "unknown")


NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(f"SELECT round(avg(CASE WHEN {NORM.format('query')} <> {NORM.format('subject')} THEN 1.0 ELSE 0.0 END), 6) AS rewritten FROM searches", "searches")
def q_search_rewritten(spark: SparkSession, sf: str) -> DataFrame:
    return reports.rewritten(v.searches(spark, sf)).select(F.round("rewritten", 6).alias("rewritten"))


@query(f"""
WITH k AS (SELECT {NORM.format('query')} AS query, rung, count(*) AS n, min(pos) AS pos FROM searches GROUP BY 1, 2 HAVING query <> '')
SELECT query, CAST(sum(n) AS BIGINT) AS asked, string_agg(rung, ',' ORDER BY pos) AS rungs FROM k GROUP BY 1 ORDER BY asked DESC, query LIMIT 20""", "searches")  # fmt: skip
def q_top_queries(spark: SparkSession, sf: str) -> DataFrame:
    return reports.top_queries(v.searches(spark, sf)).select("query", "asked", F.array_join("rungs", ",").alias("rungs"))


@query("SELECT rung, quantile_disc(duration, 0.5) AS p50, quantile_disc(duration, 0.95) AS p95 FROM searches GROUP BY 1", "searches")
def q_latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return reports.nearest_rank(v.searches(spark, sf), "duration", "rung")


@query("SELECT source_id, count(*) AS fetches, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'throttled') AS throttled, count(*) FILTER (outcome = 'error') AS error FROM fetches GROUP BY 1", "fetches")
def q_fetch_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return reports.outcomes(v.fetches(spark, sf))


NOW = "2024-01-20 00:00:00"


@query(f"SELECT source_id AS source, subject_id AS subject, arg_max(outcome, {{'a': fetched_at, 'i': fetch_id}}) IN ('throttled', 'error') AS backs_off FROM fetches WHERE fetched_at > TIMESTAMP '{NOW}' - INTERVAL 3000 MINUTE GROUP BY 1, 2", "fetches")
def q_backoff(spark: SparkSession, sf: str) -> DataFrame:
    log = v.fetches(spark, sf).withColumnsRenamed({"source_id": "source", "subject_id": "subject"})
    return reports.backing_off(log, F.lit(NOW).cast("timestamp_ntz"), 3000)


@query(f"SELECT source_id, subject_id FROM (SELECT source_id, subject_id, max(fetched_at) AS last_at FROM fetches GROUP BY 1, 2) WHERE last_at > TIMESTAMP '{NOW}' OR date_diff('second', last_at, TIMESTAMP '{NOW}') >= 360 * 60", "fetches")
def q_stale_sources(spark: SparkSession, sf: str) -> DataFrame:
    last = v.fetches(spark, sf).groupBy("source_id", "subject_id").agg(F.max("fetched_at").alias("last_at")).withColumn("source", F.lit("other"))
    return reports.stale(last, F.lit(NOW).cast("timestamp_ntz")).select("source_id", "subject_id")


@query("""
SELECT user_id, count(*) AS per_day, CAST(ceil(count(*) / 30.0 * 40) AS BIGINT) AS requests, round(ceil(count(*) / 30.0 * 40) / 100, 4) AS used,
CASE WHEN ceil(count(*) / 30.0 * 40) / 100 > 1 THEN 'over' WHEN ceil(count(*) / 30.0 * 40) / 100 >= 0.8 THEN 'tight' ELSE 'ok' END AS status FROM events GROUP BY 1""")  # fmt: skip
def q_quota(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("per_day"))
    return counts.select("user_id", "per_day", numbers.projected(F.col("per_day") / 30.0, F.lit(40), F.lit(100)).alias("x")).select("user_id", "per_day", "x.*")


@query("""
WITH q AS (SELECT n_nationkey AS query_id, concat('supplier#', lpad(CAST(n_nationkey AS VARCHAR), 9, '0')) AS q FROM nation UNION ALL SELECT 100 + n_nationkey, concat('s', n_nationkey) FROM nation)
SELECT query_id, subject_id, ticker, display_name FROM (SELECT query_id, s.*, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN upper(ticker) = upper(q) THEN 1 ELSE 2 END, length(display_name), subject_id) AS n FROM q JOIN subj s ON upper(ticker) = upper(q) OR lower(display_name) = lower(q) OR lower(display_name) LIKE concat(lower(q), ' %')) WHERE n = 1""", "subj")  # fmt: skip
def q_known_company(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    nations = table(spark, sf, "nation")
    queries = nations.select(n.alias("query_id"), F.concat(F.lit("supplier#"), F.lpad(n.cast("string"), 9, "0")).alias("query")).union(nations.select(n + 100, F.concat(F.lit("s"), n)))
    return resolve.known_company(queries, v.subj(spark, sf)).select("query_id", "subject_id", "ticker", "display_name")


#: The trigrams of a text's words, each padded by two spaces before and one after, in their order.
GRAMS = "flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: concat('  ', w, ' ')[i:i + 2])))"
ASKED = "SELECT p_partkey AS query_id, CASE p_partkey // 50 % 5 WHEN 0 THEN concat(left(p_name, 3), substr(p_name, 5)) WHEN 1 THEN reverse(p_name) WHEN 2 THEN concat('P', p_partkey) WHEN 3 THEN p_name ELSE split_part(p_name, ' ', 1) END AS query FROM part WHERE p_partkey % 50 = 0"


@query(f"""
WITH n AS (SELECT p_name AS name, min(p_partkey) AS subject_id FROM part GROUP BY 1), q AS ({ASKED}), g AS (SELECT *, list_distinct({GRAMS.format('query')}) AS g FROM q),
t AS (SELECT subject_id, name, {GRAMS.format('name')} AS t FROM (SELECT subject_id, name FROM n UNION ALL SELECT subject_id, reverse(name) FROM n)),
f AS (SELECT query_id, subject_id, list_max(flatten(list_transform(range(1, len(t) + 1), lambda i: list_transform(range(i, len(t) + 1), lambda j: len(list_intersect(g, t[i:j])) / (len(g) + len(list_distinct(t[i:j])) - len(list_intersect(g, t[i:j]))))))) AS score, 5 AS v FROM g, t),
e AS (SELECT query_id, subject_id, 1.0 AS score, 1 AS v FROM q JOIN n ON lower(query) = concat('p', subject_id) UNION ALL SELECT query_id, subject_id, 0.97, 2 FROM q JOIN n ON lower(query) = lower(name) UNION ALL SELECT query_id, subject_id, 0.93, 3 FROM q JOIN n ON lower(query) = lower(reverse(name))
    UNION ALL SELECT query_id, subject_id, 0.90, 4 FROM q JOIN n ON starts_with(lower(name), concat(lower(query), ' '))),
s AS (SELECT query_id, subject_id, max(score) AS score, min(v) AS v FROM (SELECT * FROM f WHERE score >= 0.5 UNION ALL SELECT * FROM e) GROUP BY 1, 2),
r AS (SELECT query_id, name AS display_name, round(score, 6) AS score, ['ticker', 'name', 'alias', 'prefix', 'fuzzy'][v] AS via, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, length(name), replace(name, ' ', '-')) AS rank FROM s JOIN n USING (subject_id))
SELECT query_id, display_name, score, via, rank FROM r WHERE rank <= 5""")  # fmt: skip
def q_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Queries of five kinds, from each part with a key divisible by 50: a letter lost, spelt backwards (an alias), a ticker, a name, a name's first word."""
    part, k, name = table(spark, sf, "part"), F.col("p_partkey"), F.col("p_name")
    subjects = part.groupBy(name.alias("display_name")).agg(F.min("p_partkey").alias("subject_id")).select("subject_id", F.replace("display_name", F.lit(" "), F.lit("-")).alias("slug"), F.concat(F.lit("P"), "subject_id").alias("ticker"), "display_name")
    kind = F.expr("p_partkey div 50 % 5")
    asked = F.when(kind == 0, F.concat(F.left(name, F.lit(3)), F.substring(name, 5, 99))).when(kind == 1, F.reverse(name)).when(kind == 2, F.concat(F.lit("P"), k)).when(kind == 3, name).otherwise(F.split_part(name, F.lit(" "), F.lit(1)))
    queries = part.filter("p_partkey % 50 = 0").select(k.alias("query_id"), asked.alias("query"))
    return resolve.candidates(queries, subjects, subjects.select("subject_id", F.reverse("display_name").alias("alias"))).select("query_id", "display_name", "score", "via", F.col("rank").cast("long").alias("rank"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS nation, concat('s', n_nationkey) AS target, EXISTS (SELECT 1 FROM subj s JOIN links l USING (subject_id) WHERE lower(s.ticker) = concat('s', n_nationkey) OR s.slug = concat('s', n_nationkey)) AS has_events FROM nation", "subj", "links")
def q_has_events(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), F.concat(F.lit("s"), "n_nationkey").alias("target"))
    none = v.subj(spark, sf).select("subject_id", F.col("slug").alias("alias")).limit(0)
    return resolve.has_events(n, v.subj(spark, sf), none, v.links(spark, sf)).join(n, "target").select("nation", "target", "has_events")


DOC_EVENTS = "SELECT doc_id AS pos, md5(text) AS dedup_key, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS content_hash, 'news' AS kind, CAST('2024-01-01' AS DATE) + CAST(doc_id % 9 AS INT) AS day, 'day' AS precision, concat('Doc ', doc_id) AS title, source AS body, CASE WHEN doc_id % 3 = 0 THEN lang END AS image_url FROM documents"


def _doc_events(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(d.alias("pos"), F.md5("text").alias("dedup_key"), F.when(d % 2 == 0, F.col("source")).otherwise(F.col("lang")).alias("content_hash"), F.lit("news").alias("kind"), F.date_add(F.lit("2024-01-01").cast("date"), (d % 9).cast("int")).alias("day"), F.lit("day").alias("precision"), F.concat(F.lit("Doc "), d).alias("title"), F.col("source").alias("body"), F.when(d % 3 == 0, F.col("lang")).alias("image_url"))


@query(f"""
WITH e AS ({DOC_EVENTS}), c AS (SELECT * FROM e WHERE pos = (SELECT min(pos) FROM e x WHERE x.dedup_key = e.dedup_key AND x.pos % 3 <> 0) ), i AS (SELECT * FROM e WHERE pos % 3 <> 1),
f AS (SELECT dedup_key, arg_min(kind, pos) AS kind, arg_min(day, pos) AS day, arg_max(content_hash, pos) AS content_hash, arg_max(title, pos) AS title, arg_max(body, pos) AS body, arg_max(image_url, pos) FILTER (image_url IS NOT NULL) AS image_url FROM i GROUP BY 1)
SELECT dedup_key, CASE WHEN c.pos IS NULL THEN 'new' WHEN f.dedup_key IS NOT NULL AND f.content_hash IS DISTINCT FROM c.content_hash THEN 'updated' ELSE 'kept' END AS change,
CAST(coalesce(c.day, f.day) AS VARCHAR) AS day, CASE WHEN change = 'kept' THEN c.title ELSE f.title END AS title, CASE change WHEN 'kept' THEN c.image_url WHEN 'new' THEN f.image_url ELSE coalesce(f.image_url, c.image_url) END AS image_url
FROM c FULL JOIN f USING (dedup_key)""")  # fmt: skip
def q_merge_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = _doc_events(spark, sf)
    current = rows.filter("pos % 3 <> 0").groupBy("dedup_key").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "dedup_key"]), "pos").alias("x")).select("dedup_key", "x.*").drop("pos")
    out = merges.upsert_events(current, rows.filter("pos % 3 <> 1"))
    return out.select("dedup_key", "change", day("day").alias("day"), "title", "image_url")


@query("""
WITH n AS (SELECT * FROM bars WHERE volume % 2 = 0), o AS (SELECT subject_id, day, close * 2 AS close, volume FROM bars WHERE volume % 3 = 0)
SELECT subject_id, CAST(day AS VARCHAR) AS day, coalesce(n.close, o.close) AS close, coalesce(CASE WHEN n.volume % 4 = 0 THEN n.volume END, o.volume) AS volume FROM n FULL JOIN o USING (subject_id, day)""", "bars")  # fmt: skip
def q_upsert_prices(spark: SparkSession, sf: str) -> DataFrame:
    bars = v.bars(spark, sf)
    current = bars.filter("volume % 3 = 0").withColumn("close", F.col("close") * 2)
    incoming = bars.filter("volume % 2 = 0").withColumn("volume", F.when(F.col("volume") % 4 == 0, F.col("volume"))).withColumn("pos", F.lit(1))
    return merges.upsert_prices(current, incoming).withColumn("day", day("day"))


@query("""
WITH a AS (SELECT event_type AS slug, count(*) AS n, max(ts) AS l, min(ts) AS f FROM events WHERE event_id % 2 = 1 GROUP BY 1), c AS (SELECT event_type AS slug, count(*) AS n, max(ts) AS l, min(ts) AS f FROM events WHERE event_id % 2 = 0 AND event_type < 'signup' GROUP BY 1)
SELECT slug, coalesce(c.n, 0) + coalesce(a.n, 0) AS requests, strftime(coalesce(c.f, a.f), '%Y-%m-%d %H:%M:%S') AS first_asked, strftime(greatest(coalesce(c.l, a.l), coalesce(a.l, c.l)), '%Y-%m-%d %H:%M:%S') AS last_asked, a.n IS NULL AS fulfilled FROM a FULL JOIN c USING (slug)""")  # fmt: skip
def q_requests(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("slug"), F.lit("topic").alias("kind"), F.lit(None).cast("string").alias("ticker"), F.col("ts").alias("asked_at"))
    held = events.filter("pos % 2 = 0 and slug < 'signup'").groupBy("slug").agg(F.first("kind").alias("kind"), F.first("ticker").alias("ticker"), F.count("*").alias("requests"), F.min("asked_at").alias("first_asked"), F.max("asked_at").alias("last_asked")).withColumn("fulfilled_at", F.col("last_asked"))
    out = merges.request_subjects(held, events.filter("pos % 2 = 1"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("slug", "requests", stamp("first_asked"), stamp("last_asked"), F.col("fulfilled_at").isNotNull().alias("fulfilled"))


@query("""
WITH t AS (SELECT doc_id AS subject_id, concat('doc-', doc_id) AS slug, md5(text) AS title FROM documents), w AS (SELECT title, min(subject_id) AS winner FROM t GROUP BY 1 HAVING count(*) > 1)
SELECT winner AS subject_id, slug AS alias FROM t JOIN w USING (title) WHERE subject_id <> winner""")  # fmt: skip
def q_merge_topics(spark: SparkSession, sf: str) -> DataFrame:
    topics = table(spark, sf, "documents").select(F.col("doc_id").alias("subject_id"), F.lit("topic").alias("kind"), F.concat(F.lit("doc-"), "doc_id").alias("slug"), F.md5("text").alias("wikipedia_title"), F.col("lang").alias("summary"))
    links = topics.select(F.col("subject_id").alias("event_id"), "subject_id", F.lit(1.0).alias("relevance"))
    return merges.merge_topics(topics, links)[1]
