"""Queries of the records that ingestion keeps, and of sources of two steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merges
from ..sources import articles
from . import views as v
from .landed import _json
from .queries import day, query, table


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey < 15 THEN concat('k', n_nationkey) ELSE n_name END AS key, CASE WHEN n_nationkey >= 10 THEN n_name ELSE 'old' END AS name FROM nation")
def q_sources(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    nations = table(spark, sf, "nation")
    return merges.upsert_sources(nations.filter(n < 15).select(n.alias("id"), F.concat(F.lit("k"), n).alias("key"), F.lit("old").alias("name")), nations.filter(n >= 10).select(n.alias("id"), F.col("n_name").alias("key"), F.col("n_name").alias("name")))


@query("SELECT concat('sic-', s_nationkey) AS industry, s_suppkey AS member_id, CASE WHEN s_suppkey % 3 = 0 THEN 'old' ELSE 'sic' END AS origin FROM supplier UNION ALL SELECT 'sector', s_suppkey, 'curated' FROM supplier WHERE s_suppkey % 2 = 0")
def q_industry_edges(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    suppliers = table(spark, sf, "supplier")
    companies = suppliers.select(s.alias("member_id"), F.col("s_nationkey").cast("string").alias("sic"))
    current = companies.filter("member_id % 3 = 0").select(F.concat(F.lit("sic-"), "sic").alias("industry"), "member_id", F.lit("old").alias("origin"))
    return merges.industry_edges(current, companies, suppliers.filter(s % 2 == 0).select(s.alias("member_id"), F.lit("sector").alias("slug")))


@query("SELECT s_suppkey AS slug, CASE s_suppkey % 3 WHEN 1 THEN '2024-02-01' END AS fulfilled, CASE s_suppkey % 3 WHEN 0 THEN 'before' WHEN 2 THEN repeat('x', 300) END AS last_error FROM supplier")
def q_request_marks(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    suppliers = table(spark, sf, "supplier")
    requests = suppliers.select(s.alias("slug"), F.lit(None).cast("timestamp").alias("fulfilled_at"), F.lit("before").alias("last_error"))
    outcomes = suppliers.filter(s % 3 > 0).select(s.alias("slug"), F.lit("2024-02-01").cast("timestamp").alias("at"), F.when(s % 3 == 2, F.repeat(F.lit("x"), F.lit(400))).alias("error"))
    return merges.mark_requests(requests, outcomes).select("slug", day("fulfilled_at").alias("fulfilled"), "last_error")


LEDGER = "SELECT user_id, count(*) FILTER (event_type = 'error') AS failures, max(ts) FILTER (event_type = 'error') AS failed_at FROM events GROUP BY 1"


@query(f"SELECT user_id AS slug, CASE WHEN user_id % 4 = 0 THEN 0 ELSE CAST(failures AS INT) END AS failures, CASE WHEN user_id % 4 > 0 AND failures > 0 THEN strftime(failed_at + to_minutes([30, 120, 480, 10080][least(failures, 4)]), '%Y-%m-%d %H:%M:%S') END AS dead_until FROM ({LEDGER})")
def q_claim_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The last failure comes to those before it; each fourth subject then had a success."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("slug"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "error").alias("bad"))
    last = events.filter("bad").groupBy("slug").agg(F.max("at").alias("at"))
    before = events.groupBy("slug").agg((F.sum(F.col("bad").cast("int")) - 1).cast("int").alias("failures")).select("slug", F.greatest(F.lit(0), "failures").alias("failures"), F.lit(None).cast("timestamp").alias("attempted_at"), F.lit(None).cast("timestamp").alias("dead_until"))
    ledger = merges.record_successes(merges.record_failures(before, last), before.filter("slug % 4 = 0"))
    return ledger.select("slug", F.col("failures").cast("int").alias("failures"), F.date_format("dead_until", "yyyy-MM-dd HH:mm:ss").alias("dead_until"))


@query("SELECT user_id AS slug, strftime(CASE WHEN user_id % 2 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE TIMESTAMP '2024-01-30 23:00:00' END, '%Y-%m-%d %H:%M:%S') AS attempted FROM events GROUP BY 1")
def q_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Even subjects were tried long ago, odd ones an hour before; all ask at midnight."""
    users = table(spark, sf, "events").select(F.col("user_id").alias("slug")).distinct()
    at = F.lit("2024-01-31 00:00:00").cast("timestamp")
    ledger = users.select("slug", F.lit(0).alias("failures"), F.when(F.col("slug") % 2 == 0, F.lit("2024-01-01").cast("timestamp")).otherwise(F.lit("2024-01-30 23:00:00").cast("timestamp")).alias("attempted_at"), F.lit(None).cast("timestamp").alias("dead_until"))
    return merges.claim(ledger, users.select("slug", at.alias("at"))).select("slug", F.date_format("attempted_at", "yyyy-MM-dd HH:mm:ss").alias("attempted"))


@query("SELECT o_custkey AS subject_id, o_orderkey AS event_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS ordinal FROM orders WHERE o_custkey % 2 = 1")
def q_explanations(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders explained once; those of even customers were before."""
    cited = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x)
    made = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("subject_id")).agg(cited.alias("cited"))
    made = made.select("subject_id", *(F.lit("x").alias(c) for c in merges.SYNTHESIS[1:]), F.lit("body").alias("body"), "cited", F.lit(0).alias("pos"))
    _, citations = merges.save_explanations(made.filter("subject_id % 2 = 0").drop("body", "cited", "pos"), made)
    return citations.select("subject_id", "event_id", "ordinal")


@query("SELECT doc_id, trim(substr(trim(text, ' '), 1, 200), '') AS query, CAST(floor(greatest(0, n_chars - 500 + 0.5)) AS BIGINT) AS duration_ms FROM documents")
def q_search_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.col("text").alias("query"), (F.col("n_chars") - 500.0).alias("duration_ms"))
    return merges.log_rows(rows, ["query"]).withColumn("duration_ms", F.col("duration_ms").cast("long"))


def _archive(paper: str) -> None:
    image = "CASE o_orderkey % 3 WHEN 0 THEN 'https://www.nytimes.com/x/1.jpg' WHEN 1 THEN 'https://i.test/d.jpg' END" if paper == "nyt" else "CASE WHEN o_orderkey % 3 = 0 THEN 'https://i.test/t.jpg' END"

    def run(spark: SparkSession, sf: str) -> DataFrame:
        k = F.col("o_orderkey")
        title, url, at, by = F.when(k % 9 > 0, F.concat(F.lit("T"), k)).otherwise(""), F.concat(F.lit("https://x.test/"), k), F.date_format("o_orderdate", "yyyy-MM-dd'T'10:00:00'Z'"), F.when(k % 2 == 0, F.concat(F.lit("By "), "o_orderstatus")).otherwise("")
        if paper == "nyt":
            crops = F.when(k % 3 == 0, '[{"url": "a.jpg", "subtype": "wide"}, {"url": "/x/1.jpg", "subtype": "xlarge"}]').when(k % 3 == 1, '{"default": {"url": "https://i.test/d.jpg"}}')
            item = F.struct(_json(main=title).alias("headline"), url.alias("web_url"), at.alias("pub_date"), F.lit("Said").alias("snippet"), _json(original=by).alias("byline"), crops.alias("multimedia"))
        else:
            item = F.struct(title.alias("webTitle"), url.alias("webUrl"), at.alias("webPublicationDate"), _json(thumbnail=F.when(k % 3 == 0, "https://i.test/t.jpg").otherwise("t.jpg"), trailText=F.lit("<b>Said</b>"), byline=by).alias("fields"))
        landed = table(spark, sf, "orders").groupBy(F.expr("o_orderkey div 100").alias("query_id"), (k % 2).cast("int").alias("page")).agg(F.collect_list(item).alias("a"))
        body = F.to_json(F.struct(F.struct(F.col("a").alias("docs" if paper == "nyt" else "results")).alias("response")))
        return articles.archive_news(landed.select("query_id", "page", body.alias("body")), paper).select("query_id", "page", "title", "url", day("day").alias("day"), "description", "image_url")

    run.__name__ = f"q_archive_{paper}"
    query(f"SELECT o_orderkey // 100 AS query_id, CAST(o_orderkey % 2 AS INT) AS page, concat('T', o_orderkey) AS title, concat('https://x.test/', o_orderkey) AS url, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 2 = 0 THEN concat('By ', o_orderstatus, ' — Said') ELSE 'Said' END AS description, {image} AS image_url FROM orders WHERE o_orderkey % 9 > 0")(run)


for _paper in ("nyt", "guardian"):
    _archive(_paper)


@query("SELECT s_name AS name, concat('site', s_suppkey, '.test') AS domain FROM supplier WHERE s_suppkey % 3 > 0 AND s_suppkey % 5 > 0")
def q_official_domains(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    suppliers = table(spark, sf, "supplier")
    searches = suppliers.select(F.col("s_name").alias("name"), F.when(s % 3 > 0, F.concat(F.lit('{"search": [{"id": "Q'), s, F.lit('"}]}'))).otherwise('{"search": []}').alias("body"))
    claims = suppliers.select(F.concat(F.lit("Q"), s).alias("entity"), F.when(s % 5 > 0, F.concat(F.lit('{"claims": {"P856": [{"mainsnak": {"datavalue": {"value": "https://www.site'), s, F.lit('.test/at/"}}}]}}'))).otherwise("{}").alias("body"))
    return articles.official_domains(searches, claims)


@query("""
WITH t AS (SELECT n_nationkey AS n, lower(n_name) AS topic, 1900 + n_nationkey AS y FROM nation)
SELECT topic, y AS year, CASE n % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS place FROM t UNION ALL SELECT topic, y + 50, 4 FROM t""")  # fmt: skip
def q_topic_timelines(spark: SparkSession, sf: str) -> DataFrame:
    """Topics with a history or a page of their own, and a timeline that repeats the history's sentence and has another."""
    n, name = F.col("n_nationkey"), F.col("n_name")
    nations = table(spark, sf, "nation")
    said = lambda year, rest: F.concat(F.lit("In "), year, F.lit(" the people of the place came together and "), F.lit(rest))
    first = said(1900 + n, "built a town by the river.")
    own = F.when(n % 3 == 0, F.concat(F.lit("History of the "), name)).when(n % 3 == 1, F.concat(F.lit("History of "), name)).otherwise(name)
    pages = nations.select(own.alias("title"), first.alias("text")).union(nations.filter(n % 3 == 0).select(name, said(1800 + n, "left it for good in the end."))).union(nations.select(F.concat(F.lit("Timeline of "), name), F.concat(first, F.lit("\n"), said(1950 + n, "opened a school for all of them."))))
    return articles.topic_timelines(nations.select(F.lower("n_name").alias("topic")), pages).select("topic", "year", "place")


@query("SELECT subject_id, kind, count(*) AS n FROM links JOIN ev USING (event_id) WHERE subject_id % 2 = 0 OR kind = 'news' GROUP BY 1, 2", "links", "ev")
def q_feeds_by_subject(spark: SparkSession, sf: str) -> DataFrame:
    """What each subject's feeds give together: even ones have all kinds, the others news alone; a feed that gave nothing is simply not there."""
    events = v.links(spark, sf).join(v.ev(spark, sf), "event_id")
    wanted = v.subj(spark, sf).select("subject_id", F.when(F.col("subject_id") % 2 == 0, F.array(*map(F.lit, ["earnings", "filing", "news", "regulation", "citation", "history"]))).otherwise(F.array(F.lit("news"))).alias("feeds"))
    return articles.dispatched(wanted, events, "kind").groupBy("subject_id", "kind").agg(F.count("*").alias("n"))
