"""Queries of what pages show and of search prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompt
from ..operators import pages
from . import views as v
from .queries import day, query, r4, table

#: Prompts around a part's name @ and a brand #, and what they ask: subject, focus, influence.
PROMPTS = [
    ("Show me the history of @ in the United States", "@", "in the United States", None),
    ("please show me the timeline of the @?", "@", None, None),
    ("what is @", "@", None, None),
    ("@'s history", "@", None, None),
    ("@ share price", "@", None, None),
    ("#'s effect on @ stock", "@", "#", "#"),
    ("the impact of # on @", "@", "#", "#"),
    ("how did # affect @ during the strike", "@", "# · during the strike", "#"),
    ("how # has changed @", "@", "#", "#"),
    ("I'd like to know how # hurt @", "@", "#", "#"),
    ("what did # do to @ shares", "@", "#", "#"),
    ("impact of # on @ since 2020", "@", "# · since 2020", "#"),
    ("rolling stock", "rolling stock", None, None),
    ("  stock  ", "stock", None, None),
    ("Could you tell me about @ as an investment!", "@", "as an investment", None),
]


def _said(k: int) -> str:
    cases = " ".join(f"WHEN {n} THEN " + ("NULL" if x[k] is None else "replace(replace('" + x[k].replace("'", "''") + "', '@', p_name), '#', p_brand)") for n, x in enumerate(PROMPTS))
    return f"CASE p_partkey % {len(PROMPTS)} {cases} END"


@query(f"SELECT p_partkey, {_said(1)} AS subject, {_said(2)} AS focus, {_said(3)} AS influence FROM part")
def q_search_prompts(spark: SparkSession, sf: str) -> DataFrame:
    shape = F.get(F.array(*(F.lit(x[0]) for x in PROMPTS)), (F.col("p_partkey") % len(PROMPTS)).cast("int"))
    asked = F.replace(F.replace(shape, F.lit("@"), F.col("p_name")), F.lit("#"), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", prompt.parse_search_prompt(asked).alias("x")).select("p_partkey", "x.*")


@query(f"""
WITH n AS (SELECT p_name AS name, min(p_partkey) AS subject_id, CASE WHEN min(p_partkey) % 2 = 0 THEN 'company' ELSE 'topic' END AS kind FROM part GROUP BY 1),
s AS (SELECT *, CASE kind WHEN 'company' THEN concat('P', subject_id) ELSE replace(name, ' ', '-') END AS target FROM n),
q AS (SELECT s_suppkey AS query_id, CASE s_suppkey % 6 WHEN 0 THEN name WHEN 1 THEN concat('p', subject_id) WHEN 2 THEN concat(' ', upper(name), '  zqxwvbnmkjhgfdsq') WHEN 3 THEN concat('Qzx', s_suppkey) WHEN 4 THEN concat('zq', s_suppkey, ' xqz ') ELSE ' ' END AS k, s.kind, target FROM supplier JOIN s ON true WHERE subject_id = (SELECT min(subject_id) FROM s)),
x AS (SELECT query_id, query_id % 6 AS m, kind, target, query_id % 4 = 3 AS listed FROM q)
SELECT query_id, CASE WHEN m IN (0, 1) THEN CASE WHEN m = 1 AND kind <> 'company' THEN '?' WHEN kind = 'company' THEN 'known_company' ELSE 'known_subject' END WHEN m = 2 THEN 'salvaged_prefix' WHEN m = 3 AND listed THEN 'edgar' WHEN m = 5 THEN 'empty' ELSE 'unresolved' END AS rung,
CASE WHEN m < 3 THEN kind WHEN m = 3 AND listed THEN 'company' ELSE 'none' END AS kind, CASE WHEN m < 3 THEN target WHEN m = 3 AND listed THEN concat('QZX', query_id) END AS target FROM x""")  # fmt: skip
def q_search(spark: SparkSession, sf: str) -> DataFrame:
    """All rungs: an own name, an own ticker, a name with a tail, a registrant, nothing, no words."""
    part, s = table(spark, sf, "part"), F.col("s_suppkey")
    named = part.groupBy(F.col("p_name").alias("display_name")).agg(F.min("p_partkey").alias("subject_id"))
    subjects = named.select("subject_id", F.when(F.col("subject_id") % 2 == 0, "company").otherwise("topic").alias("kind"), F.replace("display_name", F.lit(" "), F.lit("-")).alias("slug"), F.when(F.col("subject_id") % 2 == 0, F.concat(F.lit("P"), "subject_id")).alias("ticker"), "display_name")
    first = F.broadcast(subjects.agg(F.min(F.struct("subject_id", "display_name")).alias("f")).select("f.*"))  # one row
    suppliers = table(spark, sf, "supplier").select(s).join(first)
    m = s % 6
    asked = F.when(m == 0, F.col("display_name")).when(m == 1, F.concat(F.lit("p"), "subject_id")).when(m == 2, F.concat(F.lit(" "), F.upper("display_name"), F.lit("  zqxwvbnmkjhgfdsq"))).when(m == 3, F.concat(F.lit("Qzx"), s)).when(m == 4, F.concat(F.lit("zq"), s, F.lit(" xqz "))).otherwise(" ")
    listed = table(spark, sf, "supplier").filter(s % 4 == 3).select(F.concat(F.lit("QZX"), s).alias("ticker"), F.lit("A title").alias("title"))
    none = part.filter("p_partkey < 0").select(F.col("p_partkey").alias("subject_id"), F.col("p_name").alias("alias"))
    return pages.search(suppliers.select(s.alias("query_id"), asked.alias("query")), subjects, none, listed)


@query("SELECT pos, kind FROM news WHERE url <> 'src1' OR title LIKE '%Was%' AND false", "news")
def q_relevance_floor(spark: SparkSession, sf: str) -> DataFrame:
    """No headline names the subject, so rows of the loose source go."""
    rows = v.news(spark, sf).withColumn("source_key", F.when(F.col("url") == "src1", "gdelt").when(F.col("url") == "src2", "sec"))
    return pages.relevance_floor(rows, F.lit("Zyxwvut Motor Company")).select("pos", "kind")


@query("SELECT event_id, subject_id FROM links JOIN ev USING (event_id) WHERE kind IN ('news', 'filing') AND relevance >= 0.35", "links", "ev")
def q_ranking(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.links(spark, sf).join(v.ev(spark, sf), "event_id").withColumnRenamed("relevance", "score")
    return pages.ranked_by_score(rows, ["news", "filing"]).select("event_id", "subject_id")


@query("SELECT l.event_id, l.subject_id, coalesce(e.day < b.first_bar, false) AS before_listing FROM links l JOIN ev e USING (event_id) LEFT JOIN (SELECT subject_id, min(day) AS first_bar FROM bars GROUP BY 1) b USING (subject_id)", "links", "ev", "bars")
def q_before_listing(spark: SparkSession, sf: str) -> DataFrame:
    events = v.links(spark, sf).join(v.ev(spark, sf), "event_id")
    return pages.before_listing(events, v.bars(spark, sf)).select("event_id", "subject_id", "before_listing")


@query("SELECT event_id, day >= DATE '1996-01-01' AS archived, concat('https://web.archive.org/web/', strftime(day, '%Y%m%d'), '/http://x.test') AS url, CASE kind WHEN 'news' THEN '/topic/order%20%C3%A9' WHEN 'filing' THEN '/industry/sic-1' ELSE concat('/company/T', event_id) END AS path FROM ev", "ev")
def q_links_out(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("kind") == "news", "topic").when(F.col("kind") == "filing", "industry").otherwise("company")
    slug = F.when(F.col("kind") == "news", "order é").otherwise("sic-1")
    return v.ev(spark, sf).select("event_id", pages.could_be_archived(F.col("day")).alias("archived"), pages.archive_url(F.lit("x.test"), F.col("day")).alias("url"), pages.subject_path(kind, slug, F.concat(F.lit("T"), "event_id")).alias("path"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2.0 ELSE least(6.0, greatest(0.0, value / 20)) END AS sigma, least(240.0, greatest(1.0, value)) AS months, CASE WHEN event_id % 2 = 0 THEN 'A,B' ELSE 'B' END AS tickers, 'abc|def' AS terms FROM events")
def q_clamps(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    listed = F.when(e % 2 == 0, " a, ,b,").otherwise("b")
    return table(spark, sf, "events").select("event_id", pages.clamped("sigma", F.when(e % 3 == 0, "much").otherwise((F.col("value") / 20).cast("string"))).alias("sigma"), pages.clamped("sinceMonths", F.col("value").cast("string")).alias("months"), F.array_join(pages.asked_tickers(listed), ",").alias("tickers"), F.array_join(pages.asked_terms(F.lit("abc, x ,def")), "|").alias("terms"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'chips' WHEN 1 THEN 'semiconductors' ELSE 'motor' END AS query FROM nation")
def q_regulation_query(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    name = F.when(k == 1, "Semiconductors & Related Devices").otherwise("Motor vehicles, trucks")
    return table(spark, sf, "nation").select("n_nationkey", pages.regulation_query(name, F.when(k == 0, F.array(F.lit("ab"), F.lit(" chips "))).otherwise(F.array(F.lit("x")))).alias("query"))


@query("SELECT event_type AS kind, strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, CASE WHEN day(ts) % 2 = 0 THEN concat('Because ', day(ts)) END AS synthesis, count(*) AS n FROM events GROUP BY 1, 2, 3")
def q_explained(spark: SparkSession, sf: str) -> DataFrame:
    signals = table(spark, sf, "events").groupBy(F.col("event_type").alias("kind"), day("ts").alias("window_start")).agg(F.count("*").alias("n"))
    told = signals.filter(F.substring("window_start", 9, 2).cast("int") % 2 == 0).withColumn("synthesis", F.concat(F.lit("Because "), F.substring("window_start", 9, 2).cast("int")))
    return pages.explained(signals, told)


@query("SELECT pos AS id FROM news WHERE pos % 3 = 0 UNION SELECT min(pos) FROM news WHERE pos % 3 > 0 AND kind = 'press' GROUP BY pos", "news")
def q_visitor_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Press does not collapse, so each row of the visitor's stays that the server lacks."""
    rows = v.news(spark, sf).withColumn("id", F.col("pos"))
    return pages.with_visitors(rows.filter("pos % 3 = 0"), rows.filter("kind = 'press'")).select("id")


@query("SELECT ticker AS label, concat('/company/', ticker) AS href, 'company' AS kind FROM links JOIN subj USING (subject_id) GROUP BY subject_id, ticker HAVING count(*) >= 10 ORDER BY count(*) DESC, subject_id LIMIT 24", "links", "subj")
def q_suggestible(spark: SparkSession, sf: str) -> DataFrame:
    return pages.suggestible(v.links(spark, sf), v.subj(spark, sf).withColumn("kind", F.lit("company")))


@query("""
WITH o AS (SELECT n_name AS label, CASE WHEN n_nationkey < 3 THEN 'topic' ELSE 'company' END AS kind FROM nation WHERE n_nationkey < 6), s AS (SELECT p_partkey AS pos, CASE WHEN p_partkey < 3 THEN lower(concat('NATION_', p_partkey)) ELSE concat('Part ', p_partkey) END AS label, CASE WHEN p_partkey % 2 = 0 THEN 'topic' ELSE 'company' END AS kind FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY pos) AS r FROM s WHERE lower(label) NOT IN (SELECT lower(label) FROM o))
SELECT label, kind, false AS padded FROM o UNION ALL SELECT label, kind, true FROM f WHERE r <= 6 - (SELECT count(*) FROM o WHERE o.kind = f.kind)""")  # fmt: skip
def q_suggestions_blend(spark: SparkSession, sf: str) -> DataFrame:
    n, p = F.col("n_nationkey"), F.col("p_partkey")
    own = table(spark, sf, "nation").filter(n < 6).select(F.col("n_name").alias("label"), F.when(n < 3, "topic").otherwise("company").alias("kind"))
    seeds = table(spark, sf, "part").select(p.alias("pos"), F.when(p < 3, F.lower(F.concat(F.lit("NATION_"), p))).otherwise(F.concat(F.lit("Part "), p)).alias("label"), F.when(p % 2 == 0, "topic").otherwise("company").alias("kind"))
    return pages.blended(own, seeds)


@query("SELECT 'events' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'subjects', count(*) FROM supplier", "links")
def q_totals(spark: SparkSession, sf: str) -> DataFrame:
    return pages.totals(events=v.ev(spark, sf), links=v.links(spark, sf), subjects=v.subj(spark, sf))


@query("""
WITH f AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '10-K' WHEN 1 THEN '8-K' WHEN 2 THEN 'DEF 14A' ELSE 'filing' END AS form FROM orders), c AS (SELECT o_custkey, form, count(*) AS n, min(o_orderkey) AS first FROM f GROUP BY 1, 2)
SELECT o_custkey, string_agg(CASE WHEN n > 1 THEN concat(form, ' ×', n) ELSE form END, ' · ' ORDER BY n DESC, first) AS summary FROM c GROUP BY 1""")  # fmt: skip
def q_form_summary(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    title = F.when(k % 4 == 0, "Co: Annual report (10-k)").when(k % 4 == 1, "Co: 8-K filing").when(k % 4 == 2, "Co: DEF 14A filing").otherwise("Co: letter")
    return pages.form_summary(table(spark, sf, "orders").select("o_custkey", k.alias("pos"), title.alias("title")), "o_custkey")


@query("SELECT user_id, CASE WHEN user_id % 3 > 0 THEN CAST(floor((100 + user_id) / (floor(1440.0 / (60 + user_id) * 10 + 0.5) / 10)) AS BIGINT) END AS subjects FROM events GROUP BY 1")
def q_capacity(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf, "events").select("user_id").distinct().select("user_id", pages.capacity(60 + u, F.when(u % 3 > 0, 100 + u)).alias("subjects"))


@query("SELECT lang, items, batches, input_tokens, output_tokens, round(input_tokens / 1e6 * 3 + output_tokens / 1e6 * 15, 6) AS usd, input_tokens / 1e6 * 3 + output_tokens / 1e6 * 15 <= 0.05 AS allowed FROM (SELECT lang, count(*) AS items, CAST(ceil(count(*) / 25.0) AS BIGINT) AS batches, CAST(ceil(sum(length(text)) / 3.0) + ceil(count(*) / 25.0) * 200 AS BIGINT) AS input_tokens, count(*) * 12 AS output_tokens FROM documents GROUP BY 1)")
def q_estimates(spark: SparkSession, sf: str) -> DataFrame:
    out = pages.estimate(table(spark, sf, "documents"), "lang", 3.0, 15.0)
    return out.withColumn("allowed", pages.within_cap(F.col("items"), F.col("usd"), 0.05)).withColumn("usd", F.round("usd", 6))


@query("SELECT slug, strftime(refreshed_at, '%Y-%m-%d') AS refreshed FROM (SELECT slug, CASE WHEN s_suppkey % 4 > 0 THEN DATE '2024-01-01' + CAST(s_suppkey % 9 AS INT) END AS refreshed_at FROM supplier JOIN subj ON subject_id = s_suppkey) ORDER BY refreshed_at NULLS FIRST, slug LIMIT 200", "subj")
def q_stalest(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("subject_id")
    rows = v.subj(spark, sf).withColumns({"kind": F.lit("company"), "refreshed_at": F.when(s % 4 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (s % 9).cast("int")))})
    return pages.stalest(rows).select("slug", day("refreshed_at").alias("refreshed"))


@query("SELECT event_id, floor(date_diff('day', lo, day) / greatest(1, date_diff('day', lo, hi)) * 100 * 10000 + 0.5) / 10000 AS x FROM ev, (SELECT min(day) AS lo, max(day) AS hi FROM ev)", "ev")
def q_overlay_positions(spark: SparkSession, sf: str) -> DataFrame:
    return pages.overlay_positions(v.ev(spark, sf)).select("event_id", r4("x").alias("x"))


@query("SELECT subject_id, event_id FROM (SELECT subject_id, event_id, row_number() OVER (PARTITION BY subject_id ORDER BY day DESC, event_id) AS r FROM links JOIN ev USING (event_id) WHERE relevance IS NULL) WHERE r <= 500", "links", "ev")
def q_backlog(spark: SparkSession, sf: str) -> DataFrame:
    return pages.backlog(v.ev(spark, sf), v.links(spark, sf)).select("subject_id", "event_id")


@query("SELECT path, concat('note-', id) AS id, date, 'annotation' AS type, substr(text, 1, 500) AS title, concat('Your ', kind) AS source FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY id) AS r FROM (SELECT concat('/u/', conv_id % 7) AS path, conv_id * 1000 + turn AS id, '2024-01-0' || (turn % 9 + 1) AS date, CASE turn % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'entry' ELSE 'exit' END AS kind, trim(text) AS text FROM conversations WHERE turn % 5 <> 4 AND trim(text) <> '')) WHERE r <= 200")
def q_notes(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("turn")
    rows = table(spark, sf, "conversations").select(F.concat(F.lit("/u/"), F.col("conv_id") % 7).alias("path"), (F.col("conv_id") * 1000 + t).alias("id"), F.when(t % 5 == 4, "soon").otherwise(F.concat(F.lit("2024-01-0"), t % 9 + 1)).alias("date"), F.when(t % 3 == 0, "note").when(t % 3 == 1, "entry").otherwise("exit").alias("kind"), "text", F.lit("2024").alias("created_at"))
    return pages.note_events(rows)


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '' WHEN m < 60 THEN concat(m, 'm ago') WHEN h < 48 THEN concat(h, 'h ago') ELSE concat(CAST(floor(h / 24.0 + 0.5) AS BIGINT), 'd ago') END AS ago FROM (SELECT *, CAST(floor(m / 60.0 + 0.5) AS BIGINT) AS h FROM (SELECT event_id, CAST(greatest(0, floor((epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(date_trunc('second', ts))) / 60 + 0.5)) AS BIGINT) AS m FROM events))")
def q_ago(spark: SparkSession, sf: str) -> DataFrame:
    at = F.when(F.col("event_id") % 9 > 0, F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", pages.ago(at, F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("ago"))


@query("SELECT o_custkey AS signal_id, sha256(concat('k|a|b|', max(c_name), string_agg(concat('|', o_orderkey, ':', o_orderstatus), '' ORDER BY o_orderkey))) AS hash FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def q_explanation_hash(spark: SparkSession, sf: str) -> DataFrame:
    cited = table(spark, sf, "orders").select(F.col("o_custkey").alias("signal_id"), F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("content_hash"))
    signals = table(spark, sf, "customer").select(F.col("c_custkey").alias("signal_id"), F.lit("k").alias("kind"), F.lit("a").alias("window_start"), F.lit("b").alias("window_end"), F.col("c_name").alias("headline"))
    return pages.explanation_hash(signals.join(cited.select("signal_id").distinct(), "signal_id", "left_semi"), cited)


@query("""
WITH a AS (SELECT o_orderkey AS pos, concat('T', o_orderkey % 90) AS wikipedia_title, lower(concat('Ask ', o_custkey)) AS term, concat('Name ', o_orderkey) AS name, CASE WHEN o_orderkey % 3 = 0 THEN concat('S', o_orderkey) END AS summary, CAST(o_orderdate AS DATE) AS d FROM orders),
f AS (SELECT wikipedia_title, arg_min(term, pos) AS term, arg_max(name, pos) AS name, arg_max(summary, pos) FILTER (summary IS NOT NULL) AS summary, min(d) AS d FROM a GROUP BY 1),
c AS (SELECT s_suppkey AS subject_id, concat('t-', s_suppkey) AS slug, concat('T', s_suppkey) AS wikipedia_title, s_name AS name, 'old' AS summary, DATE '1995-06-01' AS d FROM supplier)
SELECT wikipedia_title, c.subject_id AS subject_id, coalesce(c.slug, f.term) AS slug, coalesce(f.name, c.name) AS name, coalesce(f.summary, c.summary) AS summary, CAST(least(coalesce(f.d, c.d), coalesce(c.d, f.d)) AS VARCHAR) AS first_on FROM c FULL JOIN f USING (wikipedia_title)""")  # fmt: skip
def q_topic_identity(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    asked = table(spark, sf, "orders").select(k.alias("pos"), F.concat(F.lit("T"), k % 90).alias("wikipedia_title"), F.concat(F.lit("Ask "), "o_custkey").alias("search_term"), F.concat(F.lit("Name "), k).alias("display_name"), F.when(k % 3 == 0, F.concat(F.lit("S"), k)).alias("summary"), F.to_date("o_orderdate").alias("first_event_on"))
    s = F.col("s_suppkey")
    current = table(spark, sf, "supplier").select(s.alias("subject_id"), F.concat(F.lit("t-"), s).alias("slug"), F.concat(F.lit("T"), s).alias("wikipedia_title"), F.col("s_name").alias("display_name"), F.lit("old").alias("summary"), F.lit("1995-06-01").cast("date").alias("first_event_on"))
    return pages.topic_identity(current, asked)[0].select("wikipedia_title", "subject_id", "slug", F.col("display_name").alias("name"), "summary", day("first_event_on").alias("first_on"))
