"""The driver's tables read as the event model: suppliers are companies, nations industries, orders events, order lines links and attestations, shipments prices, and the event stream a log of fetches and searches.

Each view has the same columns as the SQL of its name in ``SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"1-URGENT": "earnings", "2-HIGH": "filing", "3-MEDIUM": "news", "4-NOT SPECIFIED": "regulation", "5-LOW": "citation"}
OUTCOME = {"click": "ok", "view": "empty", "purchase": "ok", "error": "error", "signup": "throttled"}
RUNG = {"click": "known_company", "view": "known_subject", "purchase": "edgar", "error": "network_timeout", "signup": "unresolved"}

_case = lambda column, pairs, other: "CASE " + " ".join(f"WHEN {column} = '{a}' THEN '{b}'" for a, b in pairs.items()) + f" ELSE '{other}' END"

SQL = {
    "bars": "SELECT l_suppkey AS subject_id, CAST(l_shipdate AS DATE) AS day, floor(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) * 10000 + 0.5) / 10000 AS close, CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem GROUP BY 1, 2",
    "ev": f"SELECT o_orderkey AS event_id, {_case('o_orderpriority', KINDS, 'history')} AS kind, CAST(o_orderdate AS DATE) AS day, concat('Order ', o_orderkey, ' - ', o_orderstatus) AS title FROM orders",
    "links": "SELECT l_orderkey AS event_id, l_suppkey AS subject_id, nullif(round(max(l_discount) * 10, 2), 0) AS relevance FROM lineitem GROUP BY 1, 2",
    "attest": "SELECT l_orderkey AS event_id, l_linenumber AS source_id, min(concat('https://x.test/', l_orderkey, '/', l_linenumber)) AS url, min(concat('line ', l_linenumber)) AS source_label, bool_or(l_linenumber = 1) AS is_primary FROM lineitem GROUP BY 1, 2",
    "subj": "SELECT s_suppkey AS subject_id, lower(replace(s_name, '#', '-')) AS slug, s_name AS display_name, concat('S', s_suppkey) AS ticker, s_nationkey AS industry_id FROM supplier",
    "members": "SELECT s_nationkey AS industry_id, s_suppkey AS member_id FROM supplier",
    "fetches": f"SELECT event_id AS fetch_id, user_id % 18 AS source_id, user_id AS subject_id, ts AS fetched_at, {_case('event_type', OUTCOME, 'ok')} AS outcome FROM events",
    "searches": f"SELECT event_id AS pos, concat(upper(event_type), ' #', user_id % 20, '!') AS query, CASE WHEN user_id % 3 = 0 THEN concat(event_type, ' ', user_id % 20) ELSE event_type END AS subject, {_case('event_type', RUNG, 'empty')} AS rung, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS has_events, value AS duration FROM events",
    "news": "SELECT doc_id AS pos, CASE WHEN doc_id % 5 = 0 THEN 'press' ELSE 'news' END AS kind, split_part(text, chr(10), 1) AS title, CAST('2024-01-01' AS DATE) + CAST(doc_id % 3 AS INT) AS day, CASE WHEN doc_id % 2 = 0 THEN lang END AS description, CASE WHEN doc_id % 3 = 0 THEN source END AS image_url, source AS url FROM documents",
}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Fixed value: the rows of a table that a task gets when the table is dealt by key.
ROWS_A_TASK = 200_000


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys to so many tasks that what one holds does not grow with the table. Counting reads only the files' footers."""
    return rows.repartition(max(1, -(-rows.count() // ROWS_A_TASK)), *keys)


def _mapped(column: str, pairs: dict[str, str], other: str):
    out = None
    for a, b in pairs.items():
        out = F.when(F.col(column) == a, b) if out is None else out.when(F.col(column) == a, b)
    return out.otherwise(other)


def bars(spark: SparkSession, sf: str, *by: str) -> DataFrame:
    """Dealt by subject unless ``by`` names other keys."""
    rows = _table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("subject_id"), F.to_date("l_shipdate").alias("day"), "l_extendedprice", "l_quantity")
    paid = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    return _dealt(rows, *(by or ["subject_id"])).groupBy("subject_id", "day").agg((F.floor(paid / F.sum("l_quantity") * 10000 + 0.5) / 10000).alias("close"), F.sum("l_quantity").cast("long").alias("volume"))


def ev(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), _mapped("o_orderpriority", KINDS, "history").alias("kind"), F.to_date("o_orderdate").alias("day"), F.concat(F.lit("Order "), "o_orderkey", F.lit(" - "), "o_orderstatus").alias("title"))


def links(spark: SparkSession, sf: str, *by: str) -> DataFrame:
    """Dealt by event unless ``by`` names other keys."""
    rows = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("subject_id"), "l_discount")
    scored = F.nullif(F.round(F.max("l_discount") * 10, 2), F.lit(0.0))
    return _dealt(rows, *(by or ["event_id"])).groupBy("event_id", "subject_id").agg(scored.alias("relevance"))


def attest(spark: SparkSession, sf: str) -> DataFrame:
    rows = _dealt(_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("source_id")), "event_id").distinct()
    return rows.select("event_id", "source_id", F.concat(F.lit("https://x.test/"), "event_id", F.lit("/"), "source_id").alias("url"), F.concat(F.lit("line "), "source_id").alias("source_label"), (F.col("source_id") == 1).alias("is_primary"))


def subj(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("subject_id"), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("slug"), F.col("s_name").alias("display_name"), F.concat(F.lit("S"), "s_suppkey").alias("ticker"), F.col("s_nationkey").alias("industry_id"))


def members(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "supplier").select(F.col("s_nationkey").alias("industry_id"), F.col("s_suppkey").alias("member_id"))


def fetches(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events").select(F.col("event_id").alias("fetch_id"), (F.col("user_id") % 18).alias("source_id"), F.col("user_id").alias("subject_id"), F.col("ts").alias("fetched_at"), _mapped("event_type", OUTCOME, "ok").alias("outcome"))


def searches(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("user_id") % 20
    known = F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 3 == 1)
    return _table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.concat(F.upper("event_type"), F.lit(" #"), n, F.lit("!")).alias("query"), F.when(F.col("user_id") % 3 == 0, F.concat("event_type", F.lit(" "), n)).otherwise(F.col("event_type")).alias("subject"), _mapped("event_type", RUNG, "empty").alias("rung"), known.alias("has_events"), F.col("value").alias("duration"))


def news(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return _table(spark, sf, "documents").select(d.alias("pos"), F.when(d % 5 == 0, "press").otherwise("news").alias("kind"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.date_add(F.lit("2024-01-01").cast("date"), (d % 3).cast("int")).alias("day"), F.when(d % 2 == 0, F.col("lang")).alias("description"), F.when(d % 3 == 0, F.col("source")).alias("image_url"), F.col("source").alias("url"))
