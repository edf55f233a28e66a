"""Queries of pages for many slugs at once, first visits, comparisons, backups and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digests, seeds, visits
from . import views as v
from .queries import day, query, table

START = "2024-01-01 00:00:00"

VISITS = """
a AS (SELECT event_id AS pos, user_id AS u, user_id % 2 = 0 AS co, ts AS seen, event_id % 7 > 0 AS free, event_id % 11 = 0 AS blank FROM events),
l AS (SELECT DISTINCT user_id AS u, CAST(user_id % 4 AS INT) AS failures, TIMESTAMP '2024-01-01' + to_hours(CAST(user_id % 40 AS INT)) AS tried, CASE WHEN user_id % 4 > 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(user_id % 40 + 72 AS INT)) END AS dead FROM events WHERE user_id % 3 = 0),
f AS (SELECT u, min(seen) AS seen, arg_min(pos, {'s': seen, 'p': pos}) AS pos FROM a WHERE free AND NOT blank GROUP BY 1),
w AS (SELECT f.pos FROM f LEFT JOIN l USING (u) WHERE tried IS NULL OR tried <= f.seen - INTERVAL 6 HOUR AND (dead IS NULL OR dead <= f.seen)),
o AS (SELECT a.*, w.pos IS NOT NULL AS won, u % 5 = 1 AS late, u % 5 > 1 AND CASE WHEN co THEN u % 7 > 0 AND u % 6 > 0 ELSE u % 5 > 2 END AS good FROM a LEFT JOIN w USING (pos)),
v AS (SELECT *, CASE WHEN blank THEN 'unresolvable' WHEN NOT free THEN 'unavailable' WHEN NOT won THEN 'already_attempted' WHEN good THEN 'ingested' ELSE 'unresolvable' END AS outcome, won AND NOT late AND NOT good AS missed FROM o)"""


def _visits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(ledger, visits) of every event as a visit: to topics and companies, known to the ledger or not, whose sources answer, err, are late or say nothing."""
    events = table(spark, sf, "events")
    e, u, start = F.col("event_id"), F.col("user_id"), F.lit(START).cast("timestamp")
    asked = events.select(e.alias("pos"), F.when(e % 11 == 0, " ").otherwise(F.concat(F.lit(" Subject "), u)).alias("slug"), F.when(u % 2 == 0, "company").otherwise("topic").alias("kind"), F.col("ts").cast("timestamp").alias("at"), (e % 7 > 0).alias("free"))
    users = events.select("user_id").distinct()
    key = visits.claim_key(F.concat(F.lit("Subject "), u), F.when(u % 2 == 0, "company").otherwise("topic"))
    hours = lambda n: start + F.make_dt_interval(F.lit(0), n.cast("int"))
    ledger = users.filter(u % 3 == 0).select(key.alias("slug"), (u % 4).cast("int").alias("failures"), hours(u % 40).alias("attempted_at"), F.when(u % 4 > 0, hours(u % 40 + 72)).alias("dead_until"))
    answers = users.filter(u % 5 > 0).select(key.alias("slug"), (u % 5 == 1).alias("timed_out"), F.when(u % 5 == 2, "Unrelated words").otherwise(F.concat(F.lit("Subject "), u)).alias("title"), (u % 7).alias("events"), (u % 6).alias("bars"))
    return ledger, visits.first_visits(asked, ledger, answers)


@query(f"WITH {VISITS} SELECT pos, outcome, missed FROM v")
def q_first_visits(spark: SparkSession, sf: str) -> DataFrame:
    return _visits(spark, sf)[1].select("pos", "outcome", "missed")


@query(f"""WITH {VISITS}, c AS (SELECT u, co, seen, missed, outcome FROM v WHERE won),
n AS (SELECT coalesce(l.u, c.u) AS u, coalesce(failures, 0) AS was, coalesce(c.seen, tried) AS seen, dead, missed, outcome FROM l FULL JOIN c ON l.u = c.u)
SELECT concat(CASE WHEN u % 2 = 0 THEN 'co:' ELSE '' END, 'subject ', u) AS slug, CAST(CASE WHEN outcome = 'ingested' THEN 0 WHEN missed THEN was + 1 ELSE was END AS INT) AS failures, strftime(seen, '%Y-%m-%d %H:%M:%S') AS attempted_at,
strftime(CASE WHEN outcome = 'ingested' THEN NULL WHEN missed THEN seen + to_minutes(CASE least(was + 1, 4) WHEN 1 THEN 30 WHEN 2 THEN 120 WHEN 3 THEN 480 ELSE 10080 END) ELSE dead END, '%Y-%m-%d %H:%M:%S') AS dead_until FROM n""")  # fmt: skip
def q_first_visit_ledger(spark: SparkSession, sf: str) -> DataFrame:
    ledger, seen = _visits(spark, sf)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return visits.ledger_after(ledger, seen).select("slug", F.col("failures").cast("int").alias("failures"), stamp("attempted_at"), stamp("dead_until"))


PAGES = """
q AS (SELECT c_custkey AS query_id, c_custkey % 13 = 0 AS blank, c_custkey % 2 = 0 AS co, c_custkey % 4 < 2 AS passed FROM customer),
n AS (SELECT subject_id, count(*) AS events FROM links WHERE relevance IS NULL OR relevance >= 0.4 GROUP BY 1), b AS (SELECT subject_id, count(*) AS bars FROM bars GROUP BY 1),
s AS (SELECT s_suppkey AS query_id, s_name, coalesce(events, 0) AS events, coalesce(bars, 0) AS bars FROM supplier LEFT JOIN n ON n.subject_id = s_suppkey LEFT JOIN b ON b.subject_id = s_suppkey),
p AS (SELECT q.*, s_name, events, bars, events > 0 AND (NOT co OR bars > 0) AND s_name IS NOT NULL AND NOT blank AS there, query_id % 3 > 0 AND events > 0 AND (NOT co OR bars > 0 AND query_id % 4 <> 1 AND query_id % 8 <> 2) AND s_name IS NOT NULL AND NOT blank AS early FROM q LEFT JOIN s USING (query_id)),
r AS (SELECT *, CASE WHEN blank THEN 'none' WHEN early THEN 'found' WHEN there AND passed THEN 'first_pass' ELSE 'queued' END AS outcome FROM p)"""


def _served(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of as many slugs as there are customers, most of which name nothing: of the suppliers two thirds are there before, and prices of some companies come with the first pass."""
    c = F.col("c_custkey")
    slug = F.when(c % 13 == 0, "  ").otherwise(F.concat(F.lit(" Supplier-"), F.lpad(c.cast("string"), 9, "0")))
    asked = table(spark, sf, "customer").select(c.alias("query_id"), slug.alias("slug"), F.when(c % 2 == 0, "company").otherwise("topic").alias("kind"), F.lit(START).cast("timestamp").alias("at"))
    subjects = v.subj(spark, sf)
    aliases = subjects.select("subject_id", F.col("ticker").alias("alias"))
    links, bars = v.links(spark, sf), v.bars(spark, sf)
    s = F.col("subject_id")
    before = dict(subjects=subjects.filter(s % 3 > 0), aliases=aliases.filter(s % 3 > 0), links=links, bars=bars.filter((s % 4 != 1) & (s % 8 != 2)))
    outcome = F.get(F.array(*map(F.lit, visits.OUTCOMES)), (c % 4).cast("int"))
    seen = table(spark, sf, "customer").select(c.alias("query_id"), outcome.alias("outcome"))
    return visits.pages(asked, before, seen, dict(subjects=subjects, aliases=aliases, links=links, bars=bars))


@query(f"WITH {PAGES} SELECT query_id, outcome, CASE WHEN outcome IN ('found', 'first_pass') THEN s_name END AS display_name, CASE WHEN outcome IN ('found', 'first_pass') THEN events END AS events, CASE WHEN outcome = 'found' THEN CASE WHEN query_id % 4 <> 1 AND query_id % 8 <> 2 THEN bars ELSE 0 END WHEN outcome = 'first_pass' THEN bars END AS bars FROM r", "links", "bars")
def q_pages_served(spark: SparkSession, sf: str) -> DataFrame:
    return _served(spark, sf).select("query_id", "outcome", "display_name", "events", "bars")


@query(f"WITH {PAGES} SELECT query_id AS pos, concat('supplier-', lpad(CAST(query_id AS VARCHAR), 9, '0')) AS slug, CASE WHEN co THEN upper(concat('supplier-', lpad(CAST(query_id AS VARCHAR), 9, '0'))) END AS ticker FROM r WHERE outcome IN ('queued', 'first_pass')", "links", "bars")
def q_page_demand(spark: SparkSession, sf: str) -> DataFrame:
    return visits.demand(_served(spark, sf)).select("pos", "slug", "ticker")


@query("""
WITH g AS (SELECT event_id, subject_id FROM links WHERE relevance IS NULL OR relevance >= 0.4),
own AS (SELECT subject_id, event_id, kind, day, false AS sector FROM g JOIN ev USING (event_id)),
i AS (SELECT event_id, event_id % 25 AS industry_id, kind, day FROM ev WHERE kind = 'regulation' QUALIFY row_number() OVER (PARTITION BY event_id % 25 ORDER BY day DESC, event_id) <= 120)
SELECT subject_id, event_id, kind, CAST(day AS VARCHAR) AS day, sector FROM own UNION ALL SELECT s_suppkey, event_id, kind, CAST(day AS VARCHAR), true FROM i JOIN supplier ON s_nationkey = industry_id""", "links", "ev")  # fmt: skip
def q_company_page_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every company's page: its own events, and the newest rules of its industry. No history here is old enough to be cut."""
    industry = F.col("industry_id") + 1_000_000_000  # industries are subjects too
    rules = v.ev(spark, sf).filter("kind = 'regulation'").select("event_id", (F.col("event_id") % 25).alias("industry_id")).select("event_id", industry.alias("subject_id"), F.lit(None).cast("double").alias("relevance"))
    members = v.members(spark, sf).select(industry.alias("industry_id"), "member_id")
    out = visits.company_events(v.subj(spark, sf), v.ev(spark, sf), v.links(spark, sf).unionByName(rules), members)
    return out.select("subject_id", "event_id", "kind", day("day").alias("day"), "sector")


@query("""
WITH n AS (SELECT subject_id, count(*) AS events FROM links WHERE relevance IS NULL OR relevance >= 0.4 GROUP BY 1), s AS (SELECT s_suppkey AS s, s_name, s_suppkey % 3 > 0 AS co, coalesce(events, 0) AS events, EXISTS (SELECT 1 FROM bars WHERE bars.subject_id = s_suppkey) AS priced FROM supplier LEFT JOIN n ON n.subject_id = s_suppkey),
q AS (SELECT c_custkey AS query_id, c_custkey // 4 AS s, c_custkey % 4 AS m FROM customer), x AS (SELECT *, CASE WHEN co AND priced THEN 'company' ELSE 'topic' END AS kind FROM q JOIN s USING (s) WHERE events > 0 AND (m <> 1 OR co AND priced) AND m < 3)
SELECT query_id, s AS subject_id, kind, CASE WHEN kind = 'company' THEN concat('S', s) WHEN m = 0 THEN concat('Supplier-', lpad(CAST(s AS VARCHAR), 9, '0')) ELSE concat('s', s) END AS key, CASE WHEN kind = 'company' THEN concat(s_name, ' (S', s, ')') ELSE s_name END AS label,
CASE WHEN kind = 'company' THEN concat('/company/S', s) WHEN m = 0 THEN concat('/topic/Supplier-', lpad(CAST(s AS VARCHAR), 9, '0')) ELSE concat('/topic/s', s) END AS href FROM x""", "links", "bars")  # fmt: skip
def q_compared(spark: SparkSession, sf: str) -> DataFrame:
    """Sides of comparisons: a slug, a registrant's title, a ticker that is an alias, and a name of nothing."""
    c = F.col("c_custkey")
    s, m = F.floor(c / 4), c % 4
    said = F.when(m == 0, F.concat(F.lit(" Supplier-"), F.lpad(s.cast("string"), 9, "0"))).when(m == 1, F.concat(F.lit("registrant "), s)).when(m == 2, F.concat(F.lit("s"), s, F.lit(" "))).otherwise("nothing at all")
    subjects = v.subj(spark, sf).withColumn("kind", F.when(F.col("subject_id") % 3 > 0, "company").otherwise("topic"))
    registrants = subjects.select("ticker", F.concat(F.lit("Registrant "), "subject_id").alias("title"))
    names = subjects.select("subject_id", F.col("ticker").alias("alias"))
    return visits.compared(table(spark, sf, "customer").select(c.alias("query_id"), said.alias("query")), subjects, names, registrants, v.links(spark, sf), v.bars(spark, sf))


_HASH = lambda *columns: "CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(f"coalesce(len(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in columns) + ")), 1, 15) AS BIGINT)"
_DIGEST = lambda rows: f"SELECT CAST({_HASH('k')} % 64 AS INT) AS bucket, count(*) AS rows, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS total, bit_xor(h) AS mixed FROM (SELECT *, {_HASH('c', 'k', 's')} AS h FROM ({rows})) GROUP BY 1"
KEPT = "SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END AS s FROM orders"
RESTORED = "SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 1001 = 1 THEN 'X' WHEN o_orderkey % 7 > 0 THEN o_orderstatus END AS s FROM orders WHERE o_orderkey % 2003 <> 4"


def _kept(spark: SparkSession, sf: str, said: F.Column) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), said.alias("s"))


@query(_DIGEST(KEPT))
def q_backup_digests(spark: SparkSession, sf: str) -> DataFrame:
    rows = _kept(spark, sf, F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderstatus")))
    return digests.digests(rows, "k").withColumn("total", F.col("total").cast("string"))


@query(f"WITH a AS ({_DIGEST(KEPT)}), b AS ({_DIGEST(RESTORED)}) SELECT 'orders' AS name, coalesce(a.bucket, b.bucket) AS bucket, coalesce(a.rows, 0) AS kept_rows, coalesce(b.rows, 0) AS restored_rows FROM a FULL JOIN b USING (bucket) WHERE a.total IS DISTINCT FROM b.total OR a.mixed IS DISTINCT FROM b.mixed OR a.rows IS DISTINCT FROM b.rows")
def q_restore_rehearsal(spark: SparkSession, sf: str) -> DataFrame:
    """A restore that lost some rows and changed others: the buckets in which it did."""
    k = F.col("o_orderkey")
    said = F.when(k % 7 > 0, F.col("o_orderstatus"))
    restored = _kept(spark, sf, F.when(k % 1001 == 1, "X").otherwise(said)).filter("k % 2003 <> 4")
    return digests.rehearsed({"orders": (_kept(spark, sf, said), "k")}, {"orders": restored})


@query("""
WITH d AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN concat('notes-', c_custkey, '.txt') ELSE concat(CASE WHEN c_custkey % 2 = 0 THEN 'zeta-' ELSE 'alpha-' END, strftime(DATE '1970-01-01' + CAST(c_custkey AS INT), '%Y-%m-%d'), '.dump') END AS name, CASE WHEN c_custkey % 5 > 0 THEN strftime(DATE '1970-01-01' + CAST(c_custkey AS INT), '%Y-%m-%d') END AS stamp FROM customer)
SELECT name, stamp, stamp IS NULL OR row_number() OVER (PARTITION BY stamp IS NULL ORDER BY stamp DESC, name DESC) <= 14 AS kept FROM d""")  # fmt: skip
def q_dumps_kept(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    stamp = day(F.date_add(F.lit("1970-01-01").cast("date"), c.cast("int")))
    name = F.when(c % 5 == 0, F.concat(F.lit("notes-"), c, F.lit(".txt"))).otherwise(F.concat(F.when(c % 2 == 0, "zeta-").otherwise("alpha-"), stamp, F.lit(".dump")))
    return digests.retained(table(spark, sf, "customer").select(name.alias("name")), ["alpha", "zeta"])


_MUL = lambda a, b: f"({a}::HUGEINT * {b}::HUGEINT % 4294967296)::BIGINT"
DRAWS = f"""
s AS (SELECT o_orderkey, (o_custkey + o_orderkey::HUGEINT * 1831565813) % 4294967296 AS a0 FROM orders), a AS (SELECT o_orderkey, a0::BIGINT AS a FROM s),
t AS (SELECT o_orderkey, {_MUL("xor(a, a >> 15)", "(a | 1)")} AS t FROM a), u AS (SELECT o_orderkey, xor((t + {_MUL("xor(t, t >> 7)", "(t | 61)")}) % 4294967296, t) AS t FROM t)"""


@query(f"WITH {DRAWS} SELECT o_orderkey, xor(t, t >> 14) AS draw FROM u")
def q_seed_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Of each customer's seed the draw of each order's number, as 32 bits."""
    return table(spark, sf, "orders").select("o_orderkey", (seeds.draw(F.col("o_custkey"), F.col("o_orderkey")) * 4294967296).cast("long").alias("draw"))


@query("""
WITH RECURSIVE d AS (SELECT subject_id, day, volume, row_number() OVER (PARTITION BY subject_id ORDER BY day) AS k FROM bars),
w(subject_id, day, k, x) AS (SELECT subject_id, day, k, greatest(1.0, (2 + subject_id % 50)::DOUBLE * (1 + (volume % 21 - 10.3) / 100)) FROM d WHERE k = 1
UNION ALL SELECT d.subject_id, d.day, d.k, greatest(1.0, w.x * (1 + (d.volume % 21 - 10.3) / 100)) FROM w JOIN d ON d.subject_id = w.subject_id AND d.k = w.k + 1)
SELECT subject_id, CAST(day AS VARCHAR) AS day, floor(x * 100 + 0.5) / 100 < 1.005 AS at_floor FROM w""", "bars")  # fmt: skip
def q_seed_walks(spark: SparkSession, sf: str) -> DataFrame:
    """Walks of planted moves over every subject's days: where they lie on the floor, which a recursion finds step by step."""
    s, bars = F.col("subject_id"), v.bars(spark, sf, "subject_id", "day")
    days = bars.select("subject_id", "day", s.alias("seed"), (2 + s % 50).cast("double").alias("start"), F.lit(100).alias("base_volume"))
    planted = bars.select("subject_id", "day", ((F.col("volume") % 21 - 10.3) / 100).alias("shock"))
    return seeds.walks(days, planted).select("subject_id", day("day").alias("day"), (F.col("close") < 1.005).alias("at_floor"))
