"""Queries of text, number and date functions over the tables' rows, and of small reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import dedupe, merges, reports, timeline
from ..sources import articles
from . import views as v
from .queries import day, ids, query, r4, table

#: Headlines about a part's name @, and how they mention it.
HEADLINES = [("@ wins an award", "named"), ("Harrison @ wins an award", "oblique"), ("The @ wins", "named"), ("Nothing of it here", "none"), ("ZQ beats all", "named"), ("Of zq and others", "none"), ("the @s of yore", "none")]


def _headline() -> F.Column:
    shape = F.get(F.array(*(F.lit(h) for h, _ in HEADLINES)), (F.col("p_partkey") % len(HEADLINES)).cast("int"))
    return F.replace(shape, F.lit("@"), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1))))


SAYS = "CASE " + " ".join(f"WHEN p_partkey % {len(HEADLINES)} = {k} THEN '{m}'" for k, (_, m) in enumerate(HEADLINES)) + " END"


@query(f"SELECT p_partkey, {SAYS} AS mention, CASE WHEN p_size % 2 = 0 THEN 1.0::DOUBLE WHEN {SAYS} = 'named' THEN 0.9::DOUBLE WHEN {SAYS} = 'none' THEN 0.2::DOUBLE END AS relevance FROM part")
def q_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Names are a part's first word and a ticker of two letters."""
    name = F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1)))
    aliases = text.aliases_for(name, F.lit("ZQ"))
    kind = F.when(F.col("p_size") % 2 == 0, "filing").otherwise("news")
    return table(spark, sf, "part").select("p_partkey", text.mention(_headline(), aliases).alias("mention"), text.relevance_of(kind, _headline(), aliases, strict=True).alias("relevance"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false ELSE true END AS names, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE true END AS answers, p_partkey % 4 > 1 AS fuzzy FROM part")
def q_name_tests(spark: SparkSession, sf: str) -> DataFrame:
    p, name = F.col("p_partkey"), F.col("p_name")
    first, last = F.split_part(name, F.lit(" "), F.lit(1)), F.split_part(name, F.lit(" "), F.lit(2))
    title = F.when(p % 5 == 0, F.concat(F.lit("A "), F.upper(name), F.lit(" is sold"))).when(p % 5 == 1, F.concat(last, F.lit(" made "), first)).when(p % 5 == 2, F.lit("")).when(p % 5 == 3, F.concat(F.lit("no "), last, F.lit(" here"))).otherwise(F.concat(F.lit("an "), F.lit("alias"), F.lit(" of it")))
    asked = F.when(p % 3 == 0, F.concat(last, F.lit("s"))).when(p % 3 == 1, "zzzz").otherwise("the stock")
    query_ = F.when(p % 4 == 0, "the").when(p % 4 == 1, "ab").otherwise(name)
    return table(spark, sf, "part").select("p_partkey", text.names_subject(title, name, F.array(F.lit("alias"))).alias("names"), text.answers_slug(asked, name).alias("answers"), text.worth_fuzzy(query_).alias("fuzzy"))


@query(rf"""
WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[{text.SPACE}]+', ' ', 'g')) AS t FROM documents), k AS (SELECT *, left(t, 154) AS cut FROM c), a AS (SELECT *, 155 - instr(reverse(cut), ' ') - 1 AS last FROM k)
SELECT doc_id, CASE WHEN len(t) <= 155 THEN t ELSE concat(regexp_replace(left(cut, CASE WHEN instr(cut, ' ') > 0 AND last > 40 THEN last ELSE 154 END), '[\s,;:.]+$', ''), '…') END AS said FROM a""")  # fmt: skip
def q_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.clamp_description(F.col("text")).alias("said"))


@query("SELECT p_partkey, unnest([concat(p_name, ' ', p_brand), p_name, split_part(p_name, ' ', 1)]) AS head, unnest([p_type, concat(p_brand, ' ', p_type), concat(split_part(p_name, ' ', 2), ' ', p_brand, ' ', p_type)]) AS tail FROM part")
def q_head_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return table(spark, sf, "part").select("p_partkey", F.explode(text.head_prefixes(said)).alias("x")).select("p_partkey", "x.*")


@query("SELECT c_custkey, concat('The ', left(upper(c_mktsegment), 1), lower(substr(c_mktsegment, 2)), ' News OF') AS paper, CASE WHEN c_custkey % 2 = 0 THEN 'news.test' ELSE 'x.test' END AS domain FROM customer")
def q_papers(spark: SparkSession, sf: str) -> DataFrame:
    title = F.concat(F.lit("the "), "c_mktsegment", F.lit(" news of (Town, N.Y.), 1880-1922."))
    domain = F.when(F.col("c_custkey") % 2 == 0, " https://www.News.test/a/b").otherwise("http://x.test")
    return table(spark, sf, "customer").select("c_custkey", articles.paper_name(title).alias("paper"), text.clean_domain(domain).alias("domain"))


@query("SELECT p_partkey, concat('https://x.test/#:~:text=', CASE WHEN p_partkey % 2 = 0 THEN concat(split_part(p_name, ' ', 1), '%20', split_part(p_name, ' ', 2), '%20%2D%20a%26b') ELSE 'a%20b%20c%20d%20e,h%20i%20j%20k%20l' END) AS url FROM part")
def q_quote_links(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("  - a&b "))).otherwise("a b c d e f g h i j k l")
    return table(spark, sf, "part").select("p_partkey", text.quote_url(F.lit("https://x.test/"), said).alias("url"))


@query("SELECT o_orderkey, strftime(CAST(date_trunc('week', o_orderdate) AS DATE) + 6, '%Y-%m-%d') AS week_end, floor((year(o_orderdate) + ((month(o_orderdate) - 1) + (day(o_orderdate) - 1) / 31.0) / 12.0) * 10000 + 0.5) / 10000 AS x, strftime(o_orderdate, '%Y-%m') AS bucket, strftime(o_orderdate, '%b %Y') AS label, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def q_dates(spark: SparkSession, sf: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    week = F.to_date(F.date_trunc("week", "o_orderdate"))
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + 3599
    return table(spark, sf, "orders").select("o_orderkey", day(numbers.week_end(week)).alias("week_end"), r4(numbers.year_value(d)).alias("x"), numbers.bucket_key(d, "month").alias("bucket"), numbers.period_label(d, "month").alias("label"), day(numbers.day_of_epoch(seconds)).alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN printf('$%.2f', o_orderkey + 0.25) WHEN (o_orderkey + 0.3) / 1048576.0 < 0.01 THEN printf('$%.4f', (o_orderkey + 0.3) / 1048576.0) ELSE printf('$%.2f', (o_orderkey + 0.3) / 1048576.0) END AS exact, CAST(o_orderkey AS DOUBLE) * CASE o_orderkey % 3 WHEN 0 THEN 1e9 WHEN 1 THEN 1e6 ELSE 1e3 END AS implied FROM orders")
def q_money_texts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    usd = F.when(k % 2 == 0, (k + 0.3) / 1048576.0).otherwise(k + 0.25)
    title = F.concat(F.lit("Lost $"), F.format_number(k, 0), F.when(k % 3 == 0, "bn").when(k % 3 == 1, " m").otherwise("k"), F.lit(" at once"))
    return table(spark, sf, "orders").select("o_orderkey", numbers.money_exact(usd).alias("exact"), numbers.implied_usd(title).alias("implied"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN '' ELSE 'ethereum' END AS chain, CASE o_orderkey % 3 WHEN 0 THEN concat('0x', lpad(CAST(o_orderkey AS VARCHAR), 40, '0')) END AS id, o_orderkey % 3 = 0 AS address, concat('0x000000…', right(lpad(CAST(o_orderkey AS VARCHAR), 40, '0'), 4)) AS short FROM orders")
def q_chain_refs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    long = F.concat(F.lit("0x"), F.lpad(k.cast("string"), 40, "0"))
    ref = F.when(k % 3 == 0, F.concat(F.lit("ethereum:tx:"), long)).when(k % 3 == 1, "ethereum:tx").otherwise("nothing")
    parsed = numbers.chain_ref(ref)
    return table(spark, sf, "orders").select("o_orderkey", numbers.chain_of_ref(ref).alias("chain"), parsed["id"].alias("id"), F.coalesce(numbers.is_address(parsed["id"]), F.lit(False)).alias("address"), numbers.elide_hash(long).alias("short"))


@query("SELECT s_suppkey, sha256(concat('https://x.test/', s_suppkey, ' a')) AS key, sha256(concat('1:t', chr(31), '-', chr(31), length(s_name), ':', s_name)) AS content, list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(s_name, ''), lambda c: ascii(c)::HUGEINT)), lambda a, c: (a * 31 + c) % 4294967296)::BIGINT AS hash FROM supplier")
def q_hashes(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("s_name")
    lock = numbers.lock_key(name)
    return table(spark, sf, "supplier").select("s_suppkey", numbers.dedup_key(F.concat(F.lit(" HTTPS://x.test/"), "s_suppkey", F.lit("  A. "))).alias("key"), numbers.content_hash(F.lit("t"), F.lit(None).cast("string"), name).alias("content"), F.when(lock < 0, lock + (1 << 32)).otherwise(lock).alias("hash"))


@query("SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'unknown chain' WHEN event_id % 5 = 0 THEN 'no block time' WHEN event_id % 5 = 1 THEN 'in the future' WHEN event_type = 'click' THEN '10 s old, final at 3600 s' ELSE '10 s old, final at 21600 s' END AS reason FROM events")
def q_withheld(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id") % 5
    chain = F.when(F.col("event_type") == "click", "ethereum").when(F.col("event_type") == "view", "bitcoin").otherwise("other")
    at = F.when(e == 0, F.lit(None).cast("long")).when(e == 1, 1_705_000_001).otherwise(1_704_999_990)
    return table(spark, sf, "events").select("event_id", numbers.withheld_reason(chain, at, F.lit(1_705_000_000)).alias("reason"))


@query("""
WITH i AS (SELECT concat('s', s_suppkey % 7) AS slug, s_suppkey AS pos, s_name, CASE WHEN s_suppkey % 2 = 0 THEN concat('sum ', s_suppkey) END AS summary, DATE '1990-01-01' + CAST(s_suppkey AS INT) AS d FROM supplier WHERE s_suppkey % 3 > 0),
f AS (SELECT slug, arg_min(concat('t', pos), pos) AS ticker, arg_max(s_name, pos) AS name, arg_max(summary, pos) FILTER (summary IS NOT NULL) AS summary, min(d) AS d FROM i GROUP BY 1),
c AS (SELECT DISTINCT concat('s', s_suppkey % 9) AS slug FROM supplier)
SELECT slug, CASE WHEN c.slug IS NULL THEN f.ticker ELSE 'old' END AS ticker, coalesce(f.name, 'Old') AS name, coalesce(f.summary, CASE WHEN c.slug IS NOT NULL THEN 'was' END) AS summary, CAST(least(coalesce(f.d, DATE '1992-06-01'), CASE WHEN c.slug IS NULL THEN coalesce(f.d, DATE '1992-06-01') ELSE DATE '1992-06-01' END) AS VARCHAR) AS first_on FROM f FULL JOIN c USING (slug)""")  # fmt: skip
def q_upsert_subjects(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    suppliers, none = table(spark, sf, "supplier"), F.lit(None).cast("string")
    rest = {"kind": F.lit("company"), "cik": none, "sic": none, "wikipedia_title": none, "site_domain": none}
    incoming = suppliers.filter(s % 3 > 0).select(F.concat(F.lit("s"), s % 7).alias("slug"), s.alias("pos"), F.concat(F.lit("t"), s).alias("ticker"), F.col("s_name").alias("display_name"), F.when(s % 2 == 0, F.concat(F.lit("sum "), s)).alias("summary"), F.date_add(F.lit("1990-01-01").cast("date"), s.cast("int")).alias("first_event_on")).withColumns(rest)
    current = suppliers.select(F.concat(F.lit("s"), s % 9).alias("slug")).distinct().withColumns(rest | {"ticker": F.lit("old"), "display_name": F.lit("Old"), "summary": F.lit("was"), "first_event_on": F.lit("1992-06-01").cast("date")})
    return merges.upsert_subjects(current, incoming).select("slug", "ticker", F.col("display_name").alias("name"), "summary", day("first_event_on").alias("first_on"))


@query("SELECT o_orderkey AS pos FROM orders WHERE year(o_orderdate) >= 1996 ORDER BY o_orderkey LIMIT 25")
def q_plausible_press(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), F.to_date("o_orderdate").alias("day"))
    return dedupe.plausible_press(rows, 1996).select("pos")


@query("SELECT count(*) AS subjects, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus <> 'O') AS fulfilled, count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 3 = 0) AS failed, CAST(sum(o_custkey) AS BIGINT) AS requests FROM orders")
def q_demand(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("fulfilled_at"), F.when(k % 3 == 0, "e").alias("last_error"), F.col("o_custkey").alias("requests"))
    return reports.demand(rows)


@query("SELECT event_type AS model, round(sum(event_id) * CASE event_type WHEN 'click' THEN 2 ELSE 3 END / 1e6 + sum(user_id) * CASE event_type WHEN 'click' THEN 8 ELSE 15 END / 1e6, 6) AS usd FROM events GROUP BY 1")
def q_priced(spark: SparkSession, sf: str) -> DataFrame:
    """Of five models one has a price of its own; the others cost the most."""
    usage = table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(F.sum("event_id").alias("input_tokens"), F.sum("user_id").alias("output_tokens"))
    prices = spark.sql("SELECT * FROM VALUES ('click', 2.0D, 8.0D), ('unused', 3.0D, 15.0D) AS t(model, input_price, output_price)")
    return reports.priced(usage, prices).withColumn("usd", F.round("usd", 6))


@query("SELECT fetch_id FROM fetches WHERE source_id % 3 > 0", "fetches")
def q_licensed(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the sources bars commercial use."""
    registry = spark.range(18).select(F.col("id").alias("source"), (F.col("id") % 3 > 0).alias("commercial_ok"))
    return reports.licensed(v.fetches(spark, sf).withColumnRenamed("source_id", "source"), registry).select("fetch_id")


@query("""
WITH p AS (SELECT o_custkey AS plan_id, o_orderkey AS pos, o_orderkey % 4 AS s, CASE o_orderkey % 6 WHEN 0 THEN 'see www.x.test' WHEN 1 THEN 'ab' ELSE concat('Query ', o_orderkey % 5) END AS q FROM orders),
g AS (SELECT *, row_number() OVER (PARTITION BY plan_id, s, q ORDER BY pos) AS r FROM p WHERE s < 3 AND q LIKE 'Query %' AND NOT (s = 1 AND q = 'Query 2'))
SELECT plan_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY pos) AS k FROM g WHERE r = 1) WHERE k <= 6""")  # fmt: skip
def q_valid_plans(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    plans = table(spark, sf, "orders").select(F.col("o_custkey").alias("plan_id"), k.alias("pos"), F.concat(F.lit("s"), k % 4).alias("source"), F.when(k % 6 == 0, "see www.x.test").when(k % 6 == 1, "ab").otherwise(F.concat(F.when(k % 2 == 0, "Query ").otherwise(" QUERY "), k % 5)).alias("query"))
    history = spark.sql("SELECT 's1' AS source, 'query 2' AS query")
    return reports.valid_plans(plans, history, ["s0", "s1", "s2"]).select("plan_id", "pos")


@query("SELECT CAST(o_custkey AS BIGINT) AS synthesis_id, string_agg(o_orderkey, ',' ORDER BY o_orderkey DESC) AS ids FROM orders GROUP BY 1")
def q_cited(spark: SparkSession, sf: str) -> DataFrame:
    """Citations in their own order, which is not that of ids."""
    events = v.ev(spark, sf)
    cited = table(spark, sf, "orders").select(F.col("o_custkey").alias("synthesis_id"), F.col("o_orderkey").alias("event_id"), (-F.col("o_orderkey")).alias("ordinal"))
    out = timeline.explanations(cited.select("synthesis_id").distinct(), cited, events)
    return out.select("synthesis_id", F.array_join(F.transform("cites", lambda c: c["id"].cast("string")), ",").alias("ids"))


@query("SELECT event_id, CAST(day AS VARCHAR) AS day, side FROM (SELECT event_id, day, CASE WHEN event_id % 3 = 0 THEN 'both' WHEN event_id % 3 = 1 THEN 'a' ELSE 'b' END AS side FROM ev) ORDER BY day DESC, side, event_id LIMIT 60", "ev")
def q_interleaved(spark: SparkSession, sf: str) -> DataFrame:
    """Two timelines of which each third row, of a sector, is in both."""
    rows = v.ev(spark, sf).withColumns({"kind": F.lit("filing"), "sector": F.col("event_id") % 3 == 0})
    return dedupe.interleave(rows.filter("event_id % 3 <> 2"), rows.filter("event_id % 3 <> 1")).select("event_id", day("day").alias("day"), "side")


@query("SELECT subject_id, array_to_string(list(event_id ORDER BY event_id), ',') AS ids, max(relevance) AS relevance FROM (SELECT w.subject_id, event_id, arg_min(relevance, old) AS relevance FROM (SELECT l.event_id, l.subject_id AS old, coalesce(m.winner, l.subject_id) AS subject_id, relevance FROM links l LEFT JOIN (SELECT subject_id, min(subject_id) OVER (PARTITION BY industry_id) AS winner FROM subj) m USING (subject_id)) w GROUP BY 1, 2) GROUP BY 1", "links", "subj")
def q_merged_links(spark: SparkSession, sf: str) -> DataFrame:
    """Topics of one article are those of one industry; links of the others move to the smallest id, whose own score wins."""
    topics = v.subj(spark, sf).select("subject_id", F.lit("topic").alias("kind"), "slug", F.col("industry_id").cast("string").alias("wikipedia_title"), F.lit(None).cast("string").alias("summary"))
    links = merges.merge_topics(topics, v.links(spark, sf))[2]
    return links.groupBy("subject_id").agg(F.array_sort(F.collect_list("event_id")).alias("e"), F.max("relevance").alias("relevance")).select("subject_id", ids("e").alias("ids"), "relevance")
