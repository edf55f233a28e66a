"""More queries: functions of text, dates and money, merges and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import dedupe, merges, reports, resolve, timeline
from ..sources import articles
from . import views as v
from .queries import NORM, STORY, day, ids, query, table


#: What a year may stand beside, and what is found: the year, the next one, or nothing.
SAID = [
    ("founded in @ in a town", 0), ("In @, the service of", 0), ("the mid-@s of", 0), ("(SEHK: @) reported by", None), ("listed as HKG:@ by", None), ("its stock code @ of", None), ("the site @.com of", None), ("at @ x 720 pixels of", None), ("a 3264 × @ sensor of", None),
    ("a @ mAh battery of", None), ("priced at $@ by", None), ("priced at € @,50 by", None), ("recorded in @p by", None), ("model PW@G of", None), ("a @in monitor of", None), ("a board of @ in. of", None), ("a 720 x @ panel, then # for", 1), ("@ MHz until # for", 1),
]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN doc_id % {len(SAID)} = {k} THEN {'NULL' if n is None else f'CAST(1900 + doc_id % 120 + {n} AS INT)'}" for k, (_, n) in enumerate(SAID)) + " END AS year FROM documents")
def q_extract_year(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of all shapes, with the document's source and language around the number."""
    d = F.col("doc_id")
    shape = F.get(F.array(*(F.lit(t) for t, _ in SAID)), (d % len(SAID)).cast("int"))
    year = 1900 + d % 120
    said = F.replace(F.replace(shape, F.lit("@"), year.cast("string")), F.lit("#"), (year + 1).cast("string"))
    return table(spark, sf, "documents").select("doc_id", text.extract_year(F.concat(F.lit("From "), "source", F.lit(", "), said, F.lit(" "), "lang", F.lit("."))).alias("year"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN strftime(o_orderdate, '%Y-%m-01') WHEN 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE o_orderkey % 5 WHEN 3 THEN 'month' WHEN 4 THEN NULL ELSE 'day' END AS precision FROM orders")
def q_cite_dates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    shape = lambda f: F.date_format("o_orderdate", f)
    raw = F.when(k == 0, shape("yyyy-MM-dd")).when(k == 1, shape("MMMM d, yyyy")).when(k == 2, shape("d MMMM yyyy")).when(k == 3, shape("MMMM yyyy")).otherwise(F.concat(shape("yyyy-MM-dd"), F.lit("/"), shape("yyyy-MM-dd")))
    return table(spark, sf, "orders").select("o_orderkey", text.cite_date(raw).alias("d")).select("o_orderkey", "d.date", "d.precision")


#: Legal titles, and what is left of them.
TITLES = [("@ Holdings, Inc.", "@"), ("@ Corporation", "@"), ("@", "@"), ("@ Group Holding Limited", "@ Group"), ("@ N.V.", "@"), ("@ Incorporated", "@"), ("@ Co., Ltd.", "@"), ("@ LLC", "@ LLC"), ("@ S.A.", "@"), ("@ Inc /NEW", "@ Inc /NEW"), ("@,", "@")]


@query("SELECT c_custkey, CASE " + " ".join(f"WHEN c_custkey % {len(TITLES)} = {k} THEN replace('{short}', '@', c_name)" for k, (_, short) in enumerate(TITLES)) + " END AS name FROM customer")
def q_common_names(spark: SparkSession, sf: str) -> DataFrame:
    title = F.get(F.array(*(F.lit(t) for t, _ in TITLES)), (F.col("c_custkey") % len(TITLES)).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", text.common_name(F.replace(title, F.lit("@"), F.col("c_name"))).alias("name"))


@query("SELECT doc_id, CASE WHEN source = 'src0' THEN 'Unattributed · via src0' ELSE concat(source, ' · via src0') END AS label FROM documents")
def q_source_label(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.source_label(F.col("source"), F.lit("src0")).alias("label"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey >= 100 THEN printf('$%.2fbn', o_orderkey / 100.0) ELSE concat('$', o_orderkey * 10, 'm') END AS money FROM orders")
def q_money(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", numbers.money_short(F.col("o_orderkey") * 1e7).alias("money"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(lower(p_name), ' '), lambda w: len(w) >= 3), lambda w: CASE WHEN len(w) > 4 AND w LIKE '%s' THEN w[:-2] ELSE w END))), ' ') AS terms FROM part")
def q_focus_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(text.focus_terms(F.concat(F.lit("the "), "p_name", F.lit(" of")))), " ").alias("terms"))


KEY = STORY.replace("@t", "title").replace("@d", "CAST(day AS VARCHAR)")


@query(f"SELECT {KEY} AS key FROM news WHERE pos % 2 = 0 INTERSECT SELECT {KEY} FROM news WHERE pos % 2 = 1", "news")
def q_shared_stories(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.news(spark, sf).withColumns({"sector": F.lit(False), "event_id": F.col("pos").cast("string")})
    return dedupe.shared(rows.filter("pos % 2 = 0"), rows.filter("pos % 2 = 1"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS m FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 2) WHERE m <= 40")
def q_press_caps(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("pos"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return articles.press_mentions(rows).select(F.col("query_id").alias("o_custkey"), F.col("pos").alias("o_orderkey"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '') AS host, CAST(len(regexp_extract_all(html, '(?i)<a\\s[^>]*href=')) AS BIGINT) AS n_links FROM pages")
def q_pages(spark: SparkSession, sf: str) -> DataFrame:
    return articles.page_titles(table(spark, sf, "pages")).select("page_id", "host", "n_links")


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages""")
def q_page_titles(spark: SparkSession, sf: str) -> DataFrame:
    return articles.page_titles(table(spark, sf, "pages")).select("page_id", "title")


@query("SELECT event_type AS model, CAST(sum(coalesce(CASE WHEN event_id % 7 <> 0 THEN user_id END, 0)) AS BIGINT) AS input_tokens, CAST(sum(event_id) AS BIGINT) AS output_tokens, count(*) FILTER (event_id % 7 = 0) AS unknown, count(*) AS calls FROM events GROUP BY 1")
def q_spend(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "events").select(F.col("event_type").alias("model"), F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("input_tokens"), F.col("event_id").alias("output_tokens"))
    return reports.spend(calls)


@query("SELECT event_id, coalesce(secs > 0 AND secs <= 1705000000 AND 1705000000 - secs >= CASE event_type WHEN 'click' THEN 3600 WHEN 'view' THEN 21600 END, false) AS final FROM (SELECT event_id, event_type, CAST(epoch(ts) AS BIGINT) AS secs FROM (SELECT event_id, event_type, date_trunc('second', ts) AS ts FROM events))")
def q_finality(spark: SparkSession, sf: str) -> DataFrame:
    chain = F.when(F.col("event_type") == "click", "ethereum").when(F.col("event_type") == "view", "bitcoin").otherwise("other")
    return table(spark, sf, "events").select("event_id", numbers.final(chain, F.unix_timestamp(F.col("ts").cast("timestamp")), F.lit(1705000000)).alias("final"))


@query("SELECT event_id, subject_id, relevance FROM links WHERE subject_id % 2 = 0 UNION ALL SELECT event_id, subject_id, coalesce(relevance, 0) + 1 FROM links WHERE subject_id % 2 = 1", "links")
def q_link_inserts(spark: SparkSession, sf: str) -> DataFrame:
    links = v.links(spark, sf, "event_id", "subject_id")
    incoming = links.withColumns({"relevance": F.coalesce("relevance", F.lit(0.0)) + 1, "pos": F.lit(0)})
    return merges.insert_only(links.filter("subject_id % 2 = 0"), incoming, ["event_id", "subject_id"])


@query("SELECT event_id, subject_id, CASE WHEN event_id % 3 = 0 THEN least(1.0, subject_id / 50.0) ELSE relevance END AS relevance, CASE WHEN event_id % 3 = 0 THEN 'model' END AS scored_by FROM links", "links")
def q_write_scores(spark: SparkSession, sf: str) -> DataFrame:
    links = v.links(spark, sf).withColumn("scored_by", F.lit(None).cast("string"))
    return merges.write_scores(links, links.filter("event_id % 3 = 0").select("event_id", "subject_id", (F.col("subject_id") / 50.0).alias("score")), "model")


@query("""
WITH c AS (SELECT * FROM attest WHERE source_id % 2 = 0), f AS (SELECT event_id, min(source_id) AS first FROM attest WHERE source_id % 2 = 1 GROUP BY 1), h AS (SELECT event_id, min(source_id) AS held FROM c GROUP BY 1)
SELECT a.event_id, a.source_id, CASE WHEN a.source_id % 2 = 0 THEN 'old' ELSE 'new' END AS label, a.source_id = coalesce(held, first) AS is_primary FROM attest a LEFT JOIN f USING (event_id) LEFT JOIN h USING (event_id)""", "attest")  # fmt: skip
def q_upsert_attestations(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = v.attest(spark, sf).select("event_id", "source_id", F.lit("x").alias("external_id"), "url", F.lit("old").alias("source_label"), F.lit("2024-01-01").cast("timestamp").alias("retrieved_at"))
    held = rows.filter("source_id % 2 = 0").withColumn("is_primary", F.row_number().over(Window.partitionBy("event_id").orderBy("source_id")) == 1)
    incoming = rows.withColumns({"source_label": F.lit("new"), "pos": F.col("source_id")})
    return merges.upsert_attestations(held, incoming).select("event_id", "source_id", F.col("source_label").alias("label"), "is_primary")


@query("SELECT CAST(n_nationkey AS BIGINT) AS query_id, subject_id FROM nation JOIN subj ON slug = concat('supplier-', lpad(CAST(n_nationkey AS VARCHAR), 9, '0'))", "subj")
def q_by_slug(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("SUPPLIER-"), F.lpad(F.col("n_nationkey").cast("string"), 9, "0")).alias("slug"))
    subjects = v.subj(spark, sf)
    return resolve.by_slug(asked, subjects, subjects.select("subject_id", F.col("ticker").alias("alias")))


@query("""
WITH n AS (SELECT o_custkey AS s, count(*) AS n, max(o_orderdate) AS l FROM orders GROUP BY 1), b AS (SELECT o_custkey AS s, count(*) AS n, max(o_orderdate) AS l FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1)
SELECT s AS subject_id, CAST(CASE WHEN n.n > b.n THEN n.n - b.n WHEN n.l > b.l THEN 1 ELSE 0 END AS BIGINT) AS new FROM n JOIN b USING (s)""")  # fmt: skip
def q_follow_news(spark: SparkSession, sf: str) -> DataFrame:
    sums = lambda df: df.groupBy(F.col("o_custkey").alias("subject_id")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))
    orders = table(spark, sf, "orders")
    return timeline.follow_news(sums(orders.filter("o_orderkey % 3 > 0")), sums(orders)).withColumn("new", F.col("new").cast("long"))


@query("SELECT subject_id, CAST(day AS VARCHAR) AS day, close, volume FROM bars WHERE volume % 7 <> 0", "bars")
def q_bulk_prices(spark: SparkSession, sf: str) -> DataFrame:
    holes = v.bars(spark, sf).withColumn("close", F.when(F.col("volume") % 7 != 0, F.col("close")))
    order = F.array_sort(F.collect_list(F.struct("day", "close", "volume")))
    packed = holes.groupBy("subject_id").agg(order.alias("x")).select("subject_id", F.col("x.day").alias("days"), F.col("x.close").alias("closes"), F.col("x.volume").alias("volumes"))
    return merges.bulk_prices(packed).withColumn("day", day("day"))


@query(f"SELECT pos, {NORM.format('query')} AS query FROM searches", "searches")
def q_normalise_query(spark: SparkSession, sf: str) -> DataFrame:
    return v.searches(spark, sf).select("pos", text.normalise_query(F.col("query")).alias("query"))


@query("SELECT event_type AS slug, CAST(count(*) AS BIGINT) AS requests FROM events GROUP BY 1 ORDER BY requests DESC, slug LIMIT 25")
def q_pending(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "events").groupBy(F.col("event_type").alias("slug")).agg(F.count("*").alias("requests"), F.max("ts").alias("last_asked")).withColumn("fulfilled_at", F.lit(None).cast("timestamp"))
    return merges.pending(asked).select("slug", "requests")


@query("SELECT user_id AS subject_id, array_to_string(list_sort(list(event_id))[1:5], ',') AS events FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAY GROUP BY 1")
def q_retention(spark: SparkSession, sf: str) -> DataFrame:
    kept = merges.purge(table(spark, sf, "events"), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 10)
    return kept.groupBy(F.col("user_id").alias("subject_id")).agg(F.slice(F.array_sort(F.collect_list("event_id")), 1, 5).alias("e")).select("subject_id", ids("e").alias("events"))
