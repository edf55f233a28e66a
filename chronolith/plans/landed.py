"""Queries of the parsers of landed payloads. Payloads are made from the driver's tables, as the sources would land them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..sources import articles, markets, onchain
from .queries import day, query, r4, table

K = "o_orderkey"


def _orders(spark: SparkSession, sf: str, *columns: Column) -> DataFrame:
    return table(spark, sf, "orders").select(*columns) if columns else table(spark, sf, "orders")


def _json(**fields: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def _body(rows: DataFrame, key: str, item: Column, path: str | None) -> DataFrame:
    """(query_id, body): the items of each key as one JSON document, in their order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(K), item.alias("x")))), lambda r: r["x"])
    return rows.groupBy(F.col(key).alias("query_id")).agg(listed.alias("a")).select("query_id", F.to_json(F.struct(F.col("a").alias(path)) if path else F.col("a")).alias("body"))


@query("SELECT o_custkey AS page_id, CAST(year(o_orderdate) AS INT) AS year, arg_min(concat('In ', year(o_orderdate), ' the customer asked for order A', o_orderkey, ' to be sent by the firm.'), o_orderkey) AS sentence FROM orders GROUP BY 1, 2")
def q_page_events(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit("In "), F.year("o_orderdate"), F.lit(" the customer asked for order A"), K, F.lit(" to be sent by the firm."))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(K, said.alias("s")))), lambda x: x["s"])
    pages = _orders(spark, sf).groupBy(F.col("o_custkey").alias("page_id")).agg(F.concat(F.lit("== In 1850 as a heading that is long enough ==\nShort of 1851.\n"), F.array_join(lines, "\n")).alias("text"), F.lit("P").alias("title"))
    return articles.events_from_pages(pages).select("page_id", "year", "sentence")


CITES = "SELECT o_custkey AS article_id, concat('Order number ', o_orderkey) AS title, concat('https://www.x.test/', o_orderkey) AS url, strftime(o_orderdate, '%Y-%m-%d') AS date, 'day' AS precision, CASE WHEN o_orderkey % 4 = 0 THEN 'x.test' ELSE concat('Paper ', o_orderstatus) END AS publication FROM orders WHERE o_orderkey % 5 > 0"


def _wikitext(spark: SparkSession, sf: str) -> DataFrame:
    named = F.when(F.col(K) % 4 == 0, "").otherwise(F.concat(F.lit("[[Paper (x)|Paper {{small|y}}"), "o_orderstatus", F.lit("]]")))
    shape = F.when(F.col(K) % 2 == 0, F.date_format("o_orderdate", "d MMMM yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    cite = F.concat(F.lit("Text {{cite news |title=Order <i>number</i> "), K, F.lit(" |url=https://www.x.test/"), K, F.lit(" |date="), F.when(F.col(K) % 5 > 0, shape).otherwise("soon"), F.lit(" |work="), named, F.lit("}} and {{other|x=1}}."))
    return _orders(spark, sf).groupBy(F.col("o_custkey").alias("article_id")).agg(F.array_join(F.collect_list(cite), "\n").alias("wikitext"))


@query(CITES)
def q_citations(spark: SparkSession, sf: str) -> DataFrame:
    """With the one parser outside the JVM: nested templates."""
    return articles.parse_citations(_wikitext(spark, sf)).drop("pos")


@query(CITES)
def q_citations_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the table function, joined laterally in SQL."""
    articles.register(spark)
    rows = spark.sql("SELECT a.article_id, c.* FROM {articles} a, LATERAL citations(a.wikitext) c", articles=_wikitext(spark, sf))
    return articles.sound_citations(rows).drop("pos")


@query("""
WITH c AS (SELECT o_orderpriority AS article_id, o_orderkey % 500 AS u, arg_min(o_orderkey, {'r': -CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END, 'p': o_orderkey}) AS pos FROM orders GROUP BY 1, 2),
r AS (SELECT article_id, pos, row_number() OVER (PARTITION BY article_id ORDER BY o_orderdate, pos) - 1 AS i, count(*) OVER (PARTITION BY article_id) AS n FROM c JOIN orders ON o_orderkey = pos),
k AS (SELECT DISTINCT article_id, CAST(floor((k * (n - 1)) / 159 + 0.5) AS BIGINT) AS i FROM (SELECT DISTINCT article_id, n FROM r), range(160) t(k))
SELECT r.article_id, pos FROM r LEFT JOIN k ON k.article_id = r.article_id AND k.i = r.i WHERE n <= 160 OR k.i IS NOT NULL""")  # fmt: skip
def q_citation_events(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col(K)
    rows = _orders(spark, sf, F.col("o_orderpriority").alias("article_id"), k.alias("pos"), F.concat(F.lit("https://x.test/"), k % 500).alias("url"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(k % 3 == 0, "day").when(k % 3 == 1, "month").otherwise("year").alias("precision"))
    return articles.citation_events(rows).select("article_id", "pos")


@query("""
WITH a AS (SELECT o_custkey AS query_id, o_orderkey, CASE WHEN o_custkey % 7 = 1 THEN 'throttled' WHEN o_custkey % 7 = 2 THEN 'error' ELSE 'ok' END AS outcome, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS s, o_orderkey % 4 AS t FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(concat('Order ', s, t)) ORDER BY o_orderkey) AS n FROM a WHERE outcome = 'ok')
SELECT query_id, outcome, concat('Order ', s, t) AS title, CAST(day AS VARCHAR) AS day, concat('paper', t, '.test · via gdelt') AS source FROM k WHERE n = 1
UNION ALL SELECT DISTINCT query_id, outcome, NULL, NULL, NULL FROM a WHERE outcome <> 'ok'""")  # fmt: skip
def q_aggregator_news(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col(K)
    item = _json(title=F.concat(F.when(k % 2 == 0, "Order ").otherwise("ORDER "), "o_orderstatus", k % 4), url=F.lit("u"), seendate=F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss'Z'"), domain=F.concat(F.lit("https://www.Paper"), k % 4, F.lit(".test/x")), socialimage=F.lit(""))
    c = F.col("query_id")
    landed = _body(_orders(spark, sf), "o_custkey", item, "articles").withColumn("body", F.when(c % 7 == 1, "Please limit requests to one every 5 seconds").when(c % 7 == 2, "<html>").otherwise(F.col("body")))
    out = articles.aggregator_news(landed)
    shown = F.when(F.col("source").endswith(" · via gdelt") & F.col("title").isNotNull(), F.lower("source"))
    return out.select("query_id", "outcome", F.concat(F.lit("Order "), F.substring("title", 7, 9)).alias("title"), day("day").alias("day"), F.regexp_replace(shown, "^unattributed", "Unattributed").alias("source"))


def _feed(name: str, stamp: str, cap: int | None) -> None:
    path, *fields, _ = articles.FEEDS[name]
    first = f" WHERE n <= {cap}" if cap else ""
    image = "concat('i', o_orderkey)" if fields[4] else "CAST(NULL AS VARCHAR)"

    def run(spark: SparkSession, sf: str) -> DataFrame:
        k = F.col(K)
        value = {"title": F.when(k % 9 > 0, F.concat(F.lit("T"), k)).otherwise(""), "url": F.concat(F.lit("https://x.test/"), k), "date": F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string") if stamp == "epoch" else F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), "description": F.col("o_orderstatus"), "image_url": F.concat(F.lit("i"), k), "source": F.lit("s")}
        item = _json(**{f: value[n] for n, f in zip(("title", "url", "date", "description", "image_url", "source"), fields, strict=True) if f})
        landed = _body(_orders(spark, sf).withColumn("g", F.expr(f"{K} div 100")), "g", item, path or None)  # pages of 100 keys, as feeds land
        return articles.feed_news(landed, name).select("query_id", "title", "url", day("day").alias("day"), "description", "image_url")

    run.__name__ = f"q_feed_{name}"
    query(f"SELECT query_id, title, url, day, description, image_url FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o_orderkey) AS n FROM (SELECT o_orderkey // 100 AS query_id, o_orderkey, concat('T', o_orderkey) AS title, concat('https://x.test/', o_orderkey) AS url, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus AS description, {image} AS image_url FROM orders WHERE o_orderkey % 9 > 0)){first}")(run)


for _name, _stamp in (("newsdata", "text"), ("gnews", "text"), ("currents", "text"), ("marketaux", "text"), ("eodhd", "text"), ("finnhub", "epoch")):
    _feed(_name, _stamp, articles.FEEDS[_name][-1])


@query("SELECT feed_id, title, url, day, image_url FROM (SELECT o_custkey AS feed_id, concat('A & B <', o_orderkey, '>') AS title, concat('https://x.test/?a=1&b=', o_orderkey) AS url, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'i.png' END AS image_url, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 25")
def q_rss_items(spark: SparkSession, sf: str) -> DataFrame:
    item = F.concat(F.lit("<item><title><![CDATA[A &amp; B &lt;"), K, F.lit("&gt;]]></title><link>https://x.test/?a=1&amp;b="), K, F.lit("</link><pubDate>"), F.date_format("o_orderdate", "EEE, d MMM yyyy"), F.lit(" 10:00:00 GMT</pubDate>"), F.when(F.col(K) % 2 == 0, '<media:content url="i.png"/>').otherwise(""), F.lit("</item>"))
    xml = F.concat(F.lit("<rss><title>no item</title>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(K, item.alias("i")))), lambda x: x["i"]), "\n"), F.lit("</rss>"))
    return articles.rss_items(_orders(spark, sf).groupBy(F.col("o_custkey").alias("feed_id")).agg(xml.alias("xml"))).select("feed_id", "title", "url", day("day").alias("day"), "image_url")


@query("SELECT o_orderkey AS item_id, concat('Item ', o_orderkey) AS title, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-01-01') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-01') ELSE strftime(o_orderdate, '%Y-01-01') END AS date, CASE o_orderkey % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'year' WHEN 2 THEN 'month' ELSE 'year' END AS precision, 'citation' AS kind FROM orders WHERE o_orderkey % 7 > 1")
def q_archive_items(spark: SparkSession, sf: str) -> DataFrame:
    k, shape = F.col(K), lambda f: F.date_format("o_orderdate", f)
    date = F.when(k % 4 == 0, shape("yyyy-MM-dd")).when(k % 4 == 1, F.concat(shape("yyyy"), F.lit("-01-01T00:00:00Z"))).when(k % 4 == 2, F.concat(F.lit('["'), shape("yyyy-MM"), F.lit('"]'))).otherwise(shape("yyyy"))
    title = F.concat(F.lit("Item "), k)
    rows = _orders(spark, sf, k.alias("item_id"), F.when(k % 7 == 0, "collection").otherwise("texts").alias("mediatype"), F.when(k % 7 == 1, "undated").otherwise(date).alias("date"), F.when(k % 3 == 0, F.concat(F.lit('["'), title, F.lit('", "other"]'))).otherwise(title).alias("title"))
    return articles.archive_items(rows)


@query("SELECT concat('d', o_custkey) AS domain, CASE WHEN o_custkey % 5 = 0 THEN 'error' ELSE 'ok' END AS outcome, CASE WHEN o_custkey % 5 > 0 THEN min(strftime(o_orderdate, '%Y%m%d000000')) END AS stamp FROM orders GROUP BY o_custkey, CASE WHEN o_custkey % 5 > 0 THEN year(o_orderdate) END")
def q_site_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("o_custkey")
    domain = F.concat(F.lit("d"), c).alias("domain")
    head = _orders(spark, sf).select("o_custkey").distinct().select(domain, F.lit(0).alias("pos"), F.when(c % 5 == 0, F.array(F.lit("error"))).otherwise(F.array(F.lit("urlkey"), F.lit("timestamp"))).alias("fields"))
    rows = _orders(spark, sf, domain, (F.col(K) + 1).cast("int").alias("pos"), F.array(F.lit("x"), F.date_format("o_orderdate", "yyyyMMdd000000")).alias("fields"))
    return articles.site_snapshots(head.union(rows))


FORM = "CASE o_orderkey % 6 WHEN 0 THEN '10-K' WHEN 1 THEN '8-K' WHEN 2 THEN '8-K' WHEN 3 THEN '497' WHEN 4 THEN 'S-1' ELSE '4' END"


def filing_blocks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The recent block of each registrant, and older shards that repeat some of it."""
    k = F.col(K) % 6
    form = F.when(k == 0, "10-K").when(k < 3, "8-K").when(k == 3, "497").when(k == 4, "S-1").otherwise("4")
    item = F.struct(F.col(K).alias("k"), form.alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filingDate"), F.concat(F.col(K), F.lit("-"), "o_custkey").alias("accessionNumber"), F.lit("doc").alias("primaryDocument"), F.when(k == 1, "2.02,9.01").when(k == 2, "5.02").otherwise("").alias("items"))
    block = lambda rows: rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list(item)).alias("x")).select(F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.concat(F.lit("Co "), "o_custkey").alias("name"), *(F.col(f"x.{c}").alias(c) for c in ("form", "filingDate", "accessionNumber", "primaryDocument", "items")))
    return block(_orders(spark, sf).filter(F.col(K) % 4 > 0)), block(_orders(spark, sf).filter(F.col(K) % 4 < 2))


@query(f"""
SELECT id, day, kind, title, url, description FROM (SELECT concat('sec-', o_orderkey, o_custkey) AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, {FORM} AS form,
CASE WHEN o_orderkey % 6 IN (0, 1) THEN 'earnings' ELSE 'filing' END AS kind,
concat('Co ', o_custkey, ': ', CASE o_orderkey % 6 WHEN 0 THEN 'Annual report (10-K)' WHEN 1 THEN 'Earnings announcement (8-K)' WHEN 2 THEN '8-K filing' WHEN 3 THEN 'Prospectus update (497)' ELSE 'S-1 filing' END) AS title,
concat('https://www.sec.gov/Archives/edgar/data/', o_custkey, '/', o_orderkey, o_custkey, '/doc') AS url, CASE o_orderkey % 6 WHEN 1 THEN 'Items: 2.02,9.01' WHEN 2 THEN 'Items: 5.02' END AS description FROM orders) WHERE form <> '4'""")  # fmt: skip
def q_filings(spark: SparkSession, sf: str) -> DataFrame:
    return markets.all_filings(*filing_blocks(spark, sf)).select("id", day("day").alias("day"), "kind", "title", "url", "description")


@query("SELECT s_suppkey AS cik, lpad(CAST(100 + s_suppkey AS VARCHAR), 4, '0') AS sic, concat('Kind ', s_nationkey) AS description FROM supplier WHERE s_suppkey % 3 > 0 AND s_suppkey < 9900")
def q_industry_codes(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(s.alias("cik"), F.when(s % 3 > 0, (100 + s).cast("string")).otherwise("n/a").alias("sic"), F.concat(F.lit(" Kind "), "s_nationkey", F.lit(" ")).alias("sicDescription"))
    return markets.industry(rows)


@query("SELECT l_suppkey AS ticker, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, floor(l_extendedprice / 7 * 100 + 0.5) / 100 AS close, CASE WHEN l_linenumber > 1 THEN CAST(l_quantity AS BIGINT) END AS volume FROM lineitem WHERE l_orderkey % 11 > 0")
def q_price_payloads(spark: SparkSession, sf: str) -> DataFrame:
    bar = F.struct(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("t"), F.when(F.col("l_orderkey") % 11 > 0, F.col("l_extendedprice") / 7).alias("c"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).alias("v"))
    landed = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("ticker")).agg(F.collect_list(bar).alias("x")).select("ticker", F.col("x.t").alias("timestamp"), F.col("x.c").alias("close"), F.col("x.v").alias("volume"))
    return markets.daily_prices(landed).withColumn("day", day("day"))


@query("SELECT o_custkey AS ticker, strftime(o_orderdate, '%Y-%m-%d') AS day, 'corporate_action' AS kind, CASE o_orderkey % 4 WHEN 1 THEN printf('Dividend of $%.2f per share', (o_orderkey % 100) / 4.0) WHEN 2 THEN '2:1 stock split' WHEN 3 THEN concat(o_orderkey % 9 + 1, ':3 stock split') ELSE 'Stock split' END AS title FROM orders")
def q_corporate_actions(spark: SparkSession, sf: str) -> DataFrame:
    k, at = F.col(K), F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    paid = F.when(k % 4 == 1, F.struct(k.cast("string"), F.struct(((k % 100) / 4.0).alias("amount"), at.alias("date"))))
    split = F.when(k % 4 != 1, F.struct(k.cast("string"), F.struct(at.alias("date"), F.when(k % 4 == 2, "2:1").otherwise("").alias("splitRatio"), F.when(k % 4 == 3, (k % 9 + 1).cast("double")).alias("numerator"), F.when(k % 4 == 3, F.lit(3.0)).alias("denominator"))))
    landed = _orders(spark, sf).groupBy(F.col("o_custkey").alias("ticker")).agg(F.map_from_entries(F.collect_list(paid)).alias("dividends"), F.map_from_entries(F.collect_list(split)).alias("splits"))
    return markets.corporate_actions(landed).withColumn("day", day("day"))


@query("SELECT s_suppkey AS page_id, concat('S', lpad(CAST(p AS VARCHAR), 9, '0')) AS series_id, concat('C', lpad(CAST(p * 10 + CASE WHEN p % 2 = 0 THEN 1 ELSE 0 END AS VARCHAR), 9, '0')) AS class_id, concat('X', p, CASE WHEN p % 2 = 0 THEN 'B' ELSE 'A' END) AS symbol FROM (SELECT s_suppkey, unnest([s_suppkey * 2, s_suppkey * 2 + 1]) AS p FROM supplier)")
def q_fund_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Two series on each page; of each the first class, or the second where that is an ETF."""
    code = lambda c, n: F.concat(F.lit(c), F.lpad(n.cast("string"), 9, "0"))

    def part(p: Column) -> Column:
        row = lambda j, letter: F.concat(F.lit("<tr><td>"), code("C", p * 10 + j), F.lit("</td><td>Class "), F.when((p % 2 == 0) & F.lit(j == 1), "ETF shares").otherwise("Investor"), F.lit("</td><td>x"), p, F.lit(letter + "</td></tr>"))
        return F.concat(F.lit("<tr><td>"), code("S", p), F.lit("</td><td>Fund &amp; co</td></tr>"), row(0, "a"), row(1, "b"), F.lit("<tr><td>C000000009</td><td>No symbol</td><td></td></tr>"))

    s = F.col("s_suppkey")
    pages = table(spark, sf, "supplier").select(s.alias("page_id"), F.concat(F.lit("<table><tr><td>C999999999</td><td>above any</td><td>ZZ</td></tr>"), part(s * 2), part(s * 2 + 1), F.lit("</table>")).alias("html"))
    return markets.preferred_class(markets.fund_classes(pages)).select("page_id", "series_id", "class_id", "symbol")


@query("SELECT concat('T', p_size) AS ticker, min(p_partkey) AS pos FROM part GROUP BY 1")
def q_ticker_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.concat(F.lit("t"), "p_size").alias("ticker"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"))
    return markets.ticker_index(rows, least=5).select("ticker", "pos")


@query("""
WITH c AS (SELECT s_suppkey AS pos, concat('t', s_suppkey) AS t, lower(s_name) AS n FROM supplier), f AS (SELECT c_custkey AS pos, concat('f', c_custkey) AS t, lower(concat(c_name, ' fund')) AS n FROM customer),
q AS (SELECT n_nationkey AS query_id, CASE n_nationkey % 5 WHEN 0 THEN concat('t', n_nationkey) WHEN 1 THEN concat('supplier#', lpad(CAST(n_nationkey AS VARCHAR), 9, '0')) WHEN 2 THEN 'supplier#0000' WHEN 3 THEN concat('f', n_nationkey) ELSE concat('customer#', lpad(CAST(n_nationkey AS VARCHAR), 9, '0'), ' f') END AS q FROM nation),
m AS (SELECT query_id, 1 AS rung, pos, 'company' AS via FROM q JOIN c ON q = t UNION ALL SELECT query_id, 2, pos, 'company' FROM q JOIN c ON q = n UNION ALL SELECT query_id, 3, pos, 'company' FROM q JOIN c ON starts_with(n, q)
UNION ALL SELECT query_id, 4, pos, 'fund' FROM q JOIN f ON q = t UNION ALL SELECT query_id, 5, pos, 'fund' FROM q JOIN f ON starts_with(n, q))
SELECT query_id, pos, rung FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rung, pos) AS k FROM m) WHERE k = 1""")  # fmt: skip
def q_resolve_company(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    padded = F.lpad(n.cast("string"), 9, "0")
    asked = F.when(n % 5 == 0, F.concat(F.lit(" T"), n)).when(n % 5 == 1, F.concat(F.lit("SUPPLIER#"), padded)).when(n % 5 == 2, "supplier#0000").when(n % 5 == 3, F.concat(F.lit("F"), n)).otherwise(F.concat(F.lit("customer#"), padded, F.lit(" f")))
    companies = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_suppkey").alias("cik"), F.concat(F.lit("T"), "s_suppkey").alias("ticker"), F.col("s_name").alias("title"))
    funds = table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("cik"), F.concat(F.lit("F"), "c_custkey").alias("symbol"), F.concat("c_name", F.lit(" fund")).alias("name"))
    return markets.resolve_company(table(spark, sf, "nation").select(n.alias("query_id"), asked.alias("query")), companies, funds).select("query_id", "pos", "rung")


@query("SELECT o_custkey AS query_id, strftime(o_orderdate, '%Y-%m-%d') AS day, concat('Rule ', o_orderkey) AS title, CASE WHEN o_orderkey % 2 = 0 THEN concat('Federal Register · Office ', o_orderstatus) ELSE 'Federal Register' END AS source, CAST(o_orderkey AS VARCHAR) AS external_id FROM orders WHERE o_orderkey % 5 > 1")
def q_regulations(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col(K)
    agencies = F.when(k % 2 == 0, F.array(F.struct(F.concat(F.lit("Office "), "o_orderstatus").alias("name"))))
    item = _json(document_number=F.when(k % 5 == 0, "").otherwise(k.cast("string")), title=F.concat(F.lit("Rule "), k), publication_date=F.when(k % 5 == 1, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), html_url=F.lit("u"), abstract=F.lit("a"), agencies=agencies)
    return markets.regulations(_body(_orders(spark, sf), "o_custkey", item, "results")).select("query_id", day("day").alias("day"), "title", "source", "external_id")


@query("SELECT e AS epoch, e * 210000 AS height, CAST(to_timestamp(1230768000 + e * 126000000) AS DATE)::VARCHAR AS day, 50.0 / pow(2, e) AS reward FROM range(1, 7) t(e) WHERE e < 5")
def q_halvings(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of all heights that are multiples of 70000, but for the fifth halving's."""
    blocks = table(spark, sf, "part").select((F.col("p_partkey") * 70_000).alias("height"), (1230768000 + F.col("p_partkey") * 42_000_000).alias("time"), F.lit("h").alias("hash")).filter("height <> 1050000")
    return onchain.halvings(blocks, 2_000_000_000).select("epoch", "height", day("day").alias("day"), "reward")


@query("SELECT p_partkey AS height, CASE WHEN p_partkey % 3 = 0 THEN 'published' ELSE 'chain' END AS source, CASE WHEN p_partkey % 3 = 0 THEN '2015-07-30' ELSE CAST(CAST(to_timestamp(1438269973 + p_partkey * 86400) AS DATE) AS VARCHAR) END AS day FROM part")
def q_milestones(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    part = table(spark, sf, "part")
    known = part.select(F.col("p_name").alias("name"), p.alias("height"), F.lit("2015-07-30").cast("date").alias("day"))
    blocks = part.filter(p % 3 > 0).select(p.alias("height"), (1438269973 + p * 86400).alias("time"))
    return onchain.milestones(known, blocks).select("height", "source", day("day").alias("day"))


@query("""
WITH t AS (SELECT o_orderpriority AS token, o_orderkey AS pos, CAST(floor(o_totalprice) AS BIGINT) AS amount, epoch(o_orderdate)::BIGINT AS time, o_orderkey % 4 AS k, o_custkey FROM orders),
m AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY pos) AS n FROM t WHERE pos % 6 > 0 AND k < 2 AND amount >= 100000 AND time <= 880000000 - 3600)
SELECT token, pos, CAST(amount AS DOUBLE) AS amount, CASE k WHEN 0 THEN 'minted' ELSE 'burned' END AS direction, concat('0x', o_custkey) AS counterparty FROM m WHERE n <= 40""")  # fmt: skip
def q_supply_moves(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col(K)
    other, nobody = F.concat(F.lit("0x"), "o_custkey"), F.lit(onchain.NULL_ADDRESS)
    rows = _orders(spark, sf, F.col("o_orderpriority").alias("token"), F.lit(6).alias("decimals"), F.lit(100_000.0).alias("minimum"), F.when(k % 6 > 0, "1").otherwise("0").alias("status"), k.alias("pos"), F.lit("h").alias("hash"), F.when(k % 4 == 0, nobody).otherwise(other).alias("from"), F.when(k % 4 == 1, nobody).otherwise(other).alias("to"), F.concat(F.floor("o_totalprice").cast("string"), F.lit("000000")).alias("value"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("time"))
    return onchain.supply_moves(rows, 880_000_000).select("token", "pos", "amount", "direction", "counterparty")


@query("SELECT pos, amount FROM (SELECT o_orderkey AS pos, CAST(floor(o_totalprice) AS DOUBLE) AS amount FROM orders WHERE floor(o_totalprice) >= 300000 ORDER BY o_orderkey % 2, o_orderkey LIMIT 40)")
def q_log_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Issues come before redemptions, and the two share the cap of 40."""
    data = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex((F.floor("o_totalprice") * 1_000_000).cast("long"))), 64, "0"))
    rows = _orders(spark, sf, (F.col(K) % 2).alias("topic_order"), F.col(K).alias("pos"), F.lit("h").alias("hash"), data.alias("data"), F.lit(1).alias("time"))
    return onchain.log_moves(rows, 300_000).select("pos", "amount")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' WHEN o_custkey % 10 = 0 THEN concat('Exchange ', o_custkey) ELSE 'unidentified' END AS label FROM orders")
def q_address_labels(spark: SparkSession, sf: str) -> DataFrame:
    address = lambda c: F.concat(F.lit("0x"), F.lpad(c.cast("string"), 40, "0"))
    c = F.col("o_custkey")
    rows = _orders(spark, sf, F.col(K), F.when(F.col(K) % 3 == 0, "none").otherwise(F.upper(address(c))).alias("who")).withColumn("who", F.regexp_replace("who", "^0X", "0x"))
    known = table(spark, sf, "customer").filter("c_custkey % 10 = 0").select(address(F.col("c_custkey")).alias("address"), F.concat(F.lit("Exchange "), "c_custkey").alias("label"))
    return onchain.label_addresses(rows, known, "who").select(K, "label")


@query("SELECT o_custkey AS space, o_orderkey AS pos, CASE o_orderkey % 3 WHEN 0 THEN 'For' WHEN 1 THEN 'No, never' ELSE 'Option B' END AS choice, CASE o_orderkey % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'rejected' ELSE 'decided' END AS outcome, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 > 0")
def q_governance(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col(K)
    choices = F.when(k % 3 == 0, F.array(F.lit("For"), F.lit("Against"))).when(k % 3 == 1, F.array(F.lit("Yes"), F.lit("No, never"))).otherwise(F.array(F.lit("Option A"), F.lit("Option B")))
    scores = F.when(k % 5 == 0, F.array(F.lit(2.0), F.lit(2.0))).when(k % 3 == 0, F.array(F.lit(3.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(3.0)))
    rows = _orders(spark, sf, F.col("o_custkey").alias("space"), k.alias("pos"), F.lit("T").alias("title"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"), choices.alias("choices"), scores.alias("scores"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("end"))
    return onchain.governance(rows).select("space", "pos", "choice", "outcome", day("day").alias("day"))


@query("""
WITH i AS (SELECT p_partkey, concat(p_name, ' ', p_partkey) AS name, p_retailprice * 100000 AS amount, p_size FROM part WHERE p_partkey % 6 > 0), s AS (SELECT * FROM i WHERE amount BETWEEN 10000000 AND 10000000000)
SELECT 'btc' AS slug, name FROM s WHERE p_size % 2 = 0 AND amount >= 100000000 UNION SELECT 'wid', name FROM s WHERE regexp_matches(name, '\\bwidget\\b')""")  # fmt: skip
def q_exploits(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    rows = table(spark, sf, "part").select(F.concat("p_name", F.lit(" "), p).alias("name"), F.when(p % 6 == 0, 0).otherwise(1_600_000_000).alias("date"), (F.col("p_retailprice") * 100_000).alias("amount"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Bitcoin"))).otherwise(F.array(F.lit("Other"))).alias("chains"))
    targets = spark.sql("SELECT * FROM VALUES ('wid', 'protocol', 'Widget'), ('btc', 'chain', 'bitcoin') AS t(slug, match, name)")
    return onchain.exploits(rows, targets).select("slug", "name")


@query("""
WITH v AS (SELECT o_orderkey AS event_id, (o_orderkey + 11) * 1000 AS usd FROM orders)
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'correct' ELSE 'delete' END AS action,
CASE WHEN event_id % 2 = 0 THEN concat('Lost ', CASE WHEN usd >= 1000000000 THEN printf('$%.2fbn', usd / 1e9) WHEN usd >= 1000000 THEN printf('$%dm', CAST(floor(usd / 1e6 + 0.5) AS BIGINT)) ELSE printf('$%dk', CAST(usd // 1000 AS BIGINT)) END) END AS title FROM v""")  # fmt: skip
def q_repair_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts that were stored a million times too large."""
    k = F.col(K)
    stored = _orders(spark, sf).select(k.alias("event_id"), F.concat(F.lit("Lost $"), k + 11, F.lit(".00bn")).alias("title"))
    return onchain.repair_amounts(stored, stored.filter("event_id % 2 = 0"))


@query("SELECT s_suppkey AS key, CASE s_suppkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'differs' WHEN 2 THEN 'differs' ELSE 'ok' END AS status FROM supplier")
def q_verify_references(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(s.alias("key"), F.col("s_name").alias("symbol"), F.lit(18).alias("decimals"))
    actual = rows.filter("key % 4 > 0").select("key", F.when(F.col("key") % 4 == 1, "X").otherwise(F.col("symbol")), F.when(F.col("key") % 4 == 2, 6).otherwise(F.col("decimals")))
    return onchain.verify(rows, actual)


@query("SELECT event_id, lpad(lower(to_hex(user_id * 1000000)), 8, '0') AS hex, floor(user_id * 10000 + 0.5) / 10000 AS amount FROM events")
def q_hex_amounts(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.lower(F.hex((F.col("user_id") * 1_000_000).cast("long")))  # read as it is: to pad is to cut what is longer
    return table(spark, sf, "events").select("event_id", F.lpad(raw, 8, "0").alias("hex"), r4(numbers.hex_units(F.concat(F.lit("0x"), raw), 6)).alias("amount"))


def _word_sql() -> str:
    """The decimal digits of 64 hexadecimal digits, by eight steps over nine limbs in whole numbers of 128 bits."""
    ctes = ["l0 AS (SELECT k, decimals, word, " + ", ".join(f"0::HUGEINT AS a{j}" for j in range(9)) + " FROM w)"]
    for i in range(8):
        carries = [f"('0x' || substr(word, {8 * i + 1}, 8))::BIGINT::HUGEINT AS c0"]
        for j in range(9):
            carries.append(f"(a{j} * 4294967296 + c{j}) // 1000000000 AS c{j + 1}, (a{j} * 4294967296 + c{j}) % 1000000000 AS b{j}")
        ctes.append(f"l{i + 1} AS (SELECT k, decimals, word, {', '.join(f'b{j} AS a{j}' for j in range(9))} FROM (SELECT *, {', '.join(carries)} FROM l{i}))")
    return ", ".join(ctes)


@query(f"""
WITH w AS (SELECT o_orderkey AS k, CAST(o_orderkey % 3 * 12 AS INT) AS decimals, substr(sha256(concat('w', o_orderkey)), 1 + CAST(o_orderkey % 64 AS INT)) AS tail, lpad(tail, 64, '0') AS word FROM orders), {_word_sql()},
d AS (SELECT k, decimals, ltrim(concat({", ".join(f"lpad(a{j}::VARCHAR, 9, '0')" for j in reversed(range(9)))}), '0') AS digits FROM l8), p AS (SELECT *, lpad(digits, CAST(greatest(len(digits), decimals + 1) AS INT), '0') AS padded FROM d)
SELECT k AS order_id, substr(padded, 1, len(padded) - decimals) AS whole, substr(padded, len(padded) - decimals + 1) AS rest FROM p""")  # fmt: skip
def q_hex_words(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts of one to 64 hexadecimal digits, exactly, before and after the point."""
    k = F.col(K)
    tail = F.substr(F.sha2(F.concat(F.lit("w"), k).cast("binary"), 256), (k % 64 + 1).cast("int"))
    rows = _orders(spark, sf).select(k.alias("order_id"), F.concat(F.lit("0x"), tail).alias("data"), (k % 3 * 12).cast("int").alias("decimals"))
    return rows.select("order_id", numbers.hex_parts(F.col("data"), F.col("decimals")).alias("p")).select("order_id", "p.whole", "p.rest")
