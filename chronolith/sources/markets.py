"""Parsers of landed market payloads: filings, prices, corporate actions, fund series, registrants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import half_up
from ..operators.dedupe import first_per

# Forms that make events, and the labels of funds' forms (True: a report of results).
FORMS = ["8-K", "10-K", "10-Q", "S-1", "DEF 14A", "20-F", "6-K", "N-CSR", "N-CSRS", "N-30D", "N-CEN", "NPORT-P", "485APOS", "485BPOS", "497", "497K", "N-1A"]
FUND_FORMS = {
    "N-CSR": ("Shareholder report (N-CSR)", True),
    "N-CSRS": ("Semi-annual shareholder report (N-CSRS)", True),
    "N-30D": ("Shareholder report (N-30D)", True),
    "N-CEN": ("Annual fund census (N-CEN)", False),
    "NPORT-P": ("Portfolio holdings (NPORT-P)", False),
    "485APOS": ("Registration amendment (485APOS)", False),
    "485BPOS": ("Registration amendment (485BPOS)", False),
    "497": ("Prospectus update (497)", False),
    "497K": ("Summary prospectus (497K)", False),
    "N-1A": ("Fund registration (N-1A)", False),
}
LABELS = {"10-K": "Annual report (10-K)", "10-Q": "Quarterly report (10-Q)"}


def filings(blocks: DataFrame) -> DataFrame:
    """Blocks of parallel arrays (cik, name, form, filingDate, accessionNumber, primaryDocument, items) as events: reports of results are earnings, other wanted forms filings."""
    rows = blocks.select("cik", "name", F.explode(F.arrays_zip("form", "filingDate", "accessionNumber", "primaryDocument", "items")).alias("x")).select("cik", "name", "x.*")
    accession = F.regexp_replace("accessionNumber", "-", "")
    form, results = F.col("form"), (F.col("form") == "8-K") & F.contains(F.coalesce("items", F.lit("")), F.lit("2.02"))
    labels = F.create_map(*(F.lit(x) for k, v in ({k: v[0] for k, v in FUND_FORMS.items()} | LABELS).items() for x in (k, v)))
    earnings = form.isin([k for k, v in FUND_FORMS.items() if v[1]] + ["10-K", "10-Q"]) | results
    kept = rows.filter(form.isin(FORMS) & (F.coalesce("filingDate", F.lit("")) != "") & (F.coalesce("accessionNumber", F.lit("")) != ""))
    label = F.when(results, "Earnings announcement (8-K)").otherwise(F.coalesce(F.try_element_at(labels, form), F.concat(form, F.lit(" filing"))))
    return kept.select(F.concat(F.lit("sec-"), accession).alias("id"), F.to_date("filingDate").alias("day"), F.when(earnings, "earnings").otherwise("filing").alias("kind"), F.concat("name", F.lit(": "), label).alias("title"), F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik").cast("long"), F.lit("/"), accession, F.lit("/"), F.coalesce("primaryDocument", F.lit(""))).alias("url"), F.when((form == "8-K") & (F.col("items") != ""), F.concat(F.lit("Items: "), "items")).alias("description"), F.concat(F.lit("sec:"), accession).alias("dedup_basis"), F.col("cik").cast("long").alias("cik"))


def all_filings(recent: DataFrame, older: DataFrame) -> DataFrame:
    """The recent block and older shards together, each registrant's filing once; shards that failed are simply not there."""
    return filings(recent.unionByName(older, allowMissingColumns=True)).dropDuplicates(["cik", "id"])


def industry(registrants: DataFrame) -> DataFrame:
    """(cik, sic, description) where the code has three or four digits, padded to four, and is described."""
    return registrants.filter(F.col("sic").rlike(r"^\d{3,4}$") & (F.trim("sicDescription") != "")).select("cik", F.lpad("sic", 4, "0").alias("sic"), F.trim("sicDescription").alias("description"))


def daily_prices(payloads: DataFrame) -> DataFrame:
    """(ticker, timestamp, close, volume arrays) as bars; a bar without a close is left out, a volume may be missing; closes to two decimals."""
    rows = payloads.select("ticker", F.explode(F.arrays_zip("timestamp", "close", "volume")).alias("x")).filter("x.close is not null")
    return rows.select("ticker", F.to_date(F.timestamp_seconds("x.timestamp")).alias("day"), (half_up(F.col("x.close") * 100) / 100).alias("close"), half_up(F.col("x.volume")).cast("long").alias("volume"))


def corporate_actions(payloads: DataFrame) -> DataFrame:
    """(ticker, dividends map<string,struct<amount,date>>, splits map<string,struct<date,splitRatio,numerator,denominator>>) as events. The values, not the keys, have the dates."""
    day = lambda c: F.to_date(F.timestamp_seconds(c))
    paid = payloads.select("ticker", F.explode(F.map_values("dividends")).alias("d")).filter("d.date is not null and d.date <> 0 and d.amount is not null")
    paid = paid.select("ticker", day("d.date").alias("day"), F.lit("corporate_action").alias("kind"), F.format_string("Dividend of $%.2f per share", "d.amount").alias("title"))
    ratio = F.coalesce(F.nullif("s.splitRatio", F.lit("")), F.when((F.col("s.numerator") > 0) & (F.col("s.denominator") > 0), F.format_string("%s:%s", F.col("s.numerator").cast("int").cast("string"), F.col("s.denominator").cast("int").cast("string"))))
    split = payloads.select("ticker", F.explode(F.map_values("splits")).alias("s")).filter("s.date is not null and s.date <> 0")
    split = split.select("ticker", day("s.date").alias("day"), F.lit("corporate_action").alias("kind"), F.coalesce(F.concat(ratio, F.lit(" stock split")), F.lit("Stock split")).alias("title"))
    return paid.union(split)


SERIES, CLASS = r"(?is)\b(S\d{9})\b.*?<td[^>]*>(?:<[^>]+>)*([^<]+)", r"(?is)\b(C\d{9})\b.*?<td[^>]*>(?:<[^>]+>)*([^<]*).*?<td[^>]*>(?:<[^>]+>)*([^<]*)"


def fund_classes(pages: DataFrame) -> DataFrame:
    """(page_id, pos, series_id, class_id, class_name, symbol) of series pages (page_id, html): a class belongs to the series above it."""
    rows = pages.select("page_id", F.posexplode(F.split("html", r"(?i)<tr[\s>]")).alias("pos", "row"))
    series = F.nullif(F.regexp_extract("row", SERIES, 1), F.lit(""))
    above = F.last("series", ignorenulls=True).over(Window.partitionBy("page_id").orderBy("pos"))
    found = rows.withColumn("series", series).withColumn("series_id", above)
    part = lambda k: F.regexp_extract("row", CLASS, k)
    out = found.filter(F.col("series").isNull() & F.col("series_id").isNotNull() & (part(1) != "")).select("page_id", "pos", "series_id", part(1).alias("class_id"), text.strip_html(part(2)).alias("class_name"), F.upper(text.strip_html(part(3))).alias("symbol"))
    return out.filter("symbol <> ''")


def preferred_class(classes: DataFrame) -> DataFrame:
    """Of each series its first class that is an ETF, else its first."""
    return first_per(classes.withColumn("other", ~F.col("class_name").rlike(r"(?i)\bETF\b")), ["page_id", "series_id"], ["other", "pos"]).drop("other")


def ticker_index(registrants: DataFrame, least: int = 5000) -> DataFrame:
    """One name for each symbol, the first by pos; too few rows are an error, so that a bad download replaces nothing."""
    kept = first_per(registrants.withColumn("ticker", F.upper("ticker")), ["ticker"], ["pos"])
    total = kept.agg(F.count("*").alias("n"))
    checked = kept.join(F.broadcast(total)).withColumn("ok", F.assert_true(F.col("n") >= least, F.lit("too few symbols")))  # one row
    return checked.filter("ok is null").drop("n", "ok")


def resolve_company(queries: DataFrame, companies: DataFrame, funds: DataFrame) -> DataFrame:
    """For each query (query_id, query) a registrant: exact ticker, exact title, prefix, fund symbol, fund name, in this order. A single prefix match counts at any length, several from three letters on, the first in the file's order (pos); fund names need three letters."""
    q = queries.select("query_id", F.lower(F.trim("query")).alias("q")).filter("q <> ''")
    c = companies.select("pos", "cik", "ticker", "title", F.lower("ticker").alias("t"), F.lower("title").alias("n"))
    f = funds.select("pos", "cik", F.col("symbol").alias("ticker"), F.col("name").alias("title"), F.lower("symbol").alias("t"), F.lower("name").alias("n"))
    keep = ["query_id", "pos", "cik", "ticker", "title"]
    heads = lambda df: df.withColumn("head", F.explode(F.transform(F.sequence(F.lit(1), F.length("n")), lambda k: F.substring(F.col("n"), F.lit(1), k))))
    exact = q.join(c, F.col("q") == F.col("t")).select(*keep, F.lit(1).alias("rung")).union(q.join(c, F.col("q") == F.col("n")).select(*keep, F.lit(2)))
    near = q.join(heads(c), F.col("q") == F.col("head")).withColumn("hits", F.count("*").over(Window.partitionBy("query_id"))).filter("hits = 1 or length(q) >= 3").select(*keep, F.lit(3))
    fund = q.join(f, F.col("q") == F.col("t")).select(*keep, F.lit(4)).union(q.filter("length(q) >= 3").join(heads(f), F.col("q") == F.col("head")).select(*keep, F.lit(5)))
    return first_per(exact.union(near).union(fund), ["query_id"], ["rung", "pos"])


def regulations(payloads: DataFrame) -> DataFrame:
    """Rules (query_id, body): a document number and an ISO date are required."""
    item = "results array<struct<document_number:string,title:string,publication_date:string,html_url:string,abstract:string,agencies:array<struct<name:string>>>>"
    rows = payloads.select("query_id", F.explode(F.from_json("body", item)["results"]).alias("x"))
    kept = rows.filter("x.document_number <> '' and x.publication_date rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'")
    agency = F.get("x.agencies", 0)["name"]
    return kept.select("query_id", F.to_date("x.publication_date").alias("day"), F.lit("regulation").alias("kind"), "x.title", F.concat(F.lit("Federal Register"), F.coalesce(F.concat(F.lit(" · "), agency), F.lit(""))).alias("source"), F.col("x.html_url").alias("url"), F.col("x.document_number").alias("external_id"))
