"""Parsers on small payloads, and golden vectors of the text functions."""

import datetime as dt
import json

from pyspark.sql import functions as F

from chronolith.functions import numbers, text
from chronolith.sources import articles, markets, onchain

DAY = dt.date


def one(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_dates_years_names(spark):
    raw = ["2015-01-05", "January 5, 2015", "5 Jan 2015", "January 2015", "2015", "n.d.", "2015-01-05/2015-02-01", "2015-02-30", "29 February 2015", "1600", "Smarch 2015"]
    got = one(spark, text.cite_date(F.col("x"), newest=F.lit(2030)), [(r,) for r in raw], "x string")
    day = ("2015-01-05", "day")
    assert [g and tuple(g) for g in got] == [day, day, day, ("2015-01-01", "month"), ("2015-01-01", "year"), None, None, None, ("2015-02-29", "day"), None, None]
    stamps = ["1936-01-01T00:00:00Z", "1936-01-01", "1936-05", "1936", "1200", ""]
    got = one(spark, text.archive_date(F.col("x"), newest=F.lit(2030)), [(r,) for r in stamps], "x string")
    assert [g and tuple(g) for g in got] == [("1936-01-01", "year"), ("1936-01-01", "day"), ("1936-05-01", "month"), ("1936-01-01", "year"), None, None]
    said = ["Founded in 1903 in Detroit", "A 1280 x 1720 screen of 1999", "SEHK: 1060 rose", "The PW1500G engine", "mid-1990s boom", "sold for $1,999", "1688.com began", "a 27in. panel in 2013,", "none"]
    assert one(spark, text.extract_year(F.col("x")), [(r,) for r in said], "x string") == [1903, 1999, None, None, 1990, None, None, 2013, None]
    names = ["Ford Motor Company", "Apple Inc.", "Holdings", "Acme Group, Inc.", "Philips N.V.", "Tesla Incorporated", "Alibaba Group Holding Limited"]
    assert one(spark, text.common_name(F.col("x")), [(r,) for r in names], "x string") == ["Ford Motor", "Apple", "Holdings", "Acme Group", "Philips", "Tesla", "Alibaba Group"]


def test_stories_tone_focus_mentions(spark):
    key = lambda *ts: one(spark, text.story_key(F.col("x"), F.lit("2024-01-02").cast("date")), [(t,) for t in ts], "x string")
    a, b, c, d = key("Exclusive: Ford recalls 1,000 cars - Reuters", "ford RECALLS 1 000 cars", "Ford recalls “1,000” cars | The Wall Street Journal", "Ford recalls vans")
    assert a == b == c != d
    tones = one(spark, text.tone(F.col("x")), [("Profit rises but deliveries miss",), ("Results were not a miss",), ("Ford beats",), ("Shares plunge",), ("Ford meets",)], "x string")
    assert tones == ["neutral", "positive", "positive", "negative", "neutral"]
    terms = one(spark, text.focus_terms(F.col("x")), [("The effects of battery fires on stocks",)], "x string")
    assert terms == [["battery", "fire"]]
    score = lambda t, r: one(spark, F.round(text.focus_score(F.col("t"), F.col("r"), text.focus_terms(F.lit("battery fires"))), 3), [(t, r)], "t string, r string")[0]
    assert score("Battery fire in plant", "") == 1.0 and score("A fire", "a battery") == 0.75 and score("x", "battery") == 0.25 and score("x", "battery fire") == 0.65
    aliases = one(spark, text.aliases_for(F.col("n"), F.col("t")), [("Ford Motor Company", "F"), ("3M Co", "MMM")], "n string, t string")
    assert aliases == [["ford", "ford motor company", "f"], ["3m", "3m co", "mmm"]]
    said = one(spark, text.mention(F.col("t"), F.array(F.lit("ford"), F.lit("ford motor company"), F.lit("f"))), [("Ford wins",), ("Harrison Ford wins award",), ("F beats estimates",), ("John F. Kennedy Airport",), ("Nothing here",)], "t string")
    assert said == ["named", "oblique", "named", "none", "none"]
    assert one(spark, text.relevance_of(F.col("k"), F.col("t"), F.array(F.lit("3m"))), [("news", "3M announces"), ("filing", "x"), ("regulation", "x"), ("news", "y")], "k string, t string") == [0.9, 1.0, None, None]
    assert one(spark, F.round(text.word_similarity(F.col("q"), F.lit("Ford Motor Company")), 3), [("forde",), ("co",), ("motor",)], "q string") == [0.667, 0.667, 1.0]
    assert one(spark, text.answers_slug(F.col("a"), F.col("b")), [("telegraph", "Telegraphy"), ("electric cars", "Electric car"), ("best buy", "TaxAct"), ("the", "x")], "a string, b string") == [True, True, False, True]
    assert one(spark, text.names_subject(F.col("t"), F.lit("Ford Motor Company")), [("Ford recalls cars",), ("Motor racing season",), ("",)], "t string") == [True, False, False]


def test_numbers(spark):
    assert one(spark, numbers.money_short(F.col("x")), [(1.234e9,), (45.6e6,)], "x double") == ["$1.23bn", "$46m"]
    assert one(spark, numbers.implied_usd(F.col("x")), [("X exploited — $1.50bn",), ("$34m",), ("none",)], "x string") == [1.5e9, 34e6, None]
    assert one(spark, numbers.hex_units(F.col("x"), 6), [("0x" + hex(1_500_000 * 10**6)[2:].zfill(64),), ("0x" + "f" * 64,)], "x string") == [1_500_000.0, float((2**256 - 1) // 10**6) + ((2**256 - 1) % 10**6) / 1e6]
    assert one(spark, numbers.final(F.col("c"), F.col("t"), F.lit(10_000)), [("ethereum", 6400), ("ethereum", 6401), ("bitcoin", 100), ("x", 1), ("ethereum", 0), ("ethereum", 20_000)], "c string, t long") == [True, False, False, False, False, False]
    assert [v and tuple(v) for v in one(spark, numbers.vote_outcome(F.col("c"), F.col("s")), [(["Yes", "No"], [3.0, 1.0]), (["For", "Against"], [1.0, 1.0]), (["A"], [0.0]), (["Against", "For"], [5.0, 1.0])], "c array<string>, s array<double>")] == [("Yes", "passed"), None, None, ("Against", "rejected")]


def test_citations(spark):
    wiki = "x {{cite news |title=A [[long|longer]] headline |url=https://www.a.com/1 |date=5 January 2015 |work=The {{small|Big}} Times}} {{Cite web|title=Another title|url=https://b.org/x|date=2016|date=2017}} {{cite web|title=bad|url=ftp://x|date=2015}} {{cite news|title=Not closed at all|url=https://c.d|date=2015"
    got = articles.parse_citations(spark.createDataFrame([(1, wiki)], "article_id long, wikitext string")).orderBy("pos").collect()
    assert [(r.title, r.url, r.date, r.precision, r.publication) for r in got] == [("A longer headline", "https://www.a.com/1", "2015-01-05", "day", "The Times"), ("Another title", "https://b.org/x", "2017-01-01", "year", "b.org")]


def test_feeds(spark):
    ok = json.dumps({"articles": [{"title": "T one", "url": "u", "seendate": "20240102T030405Z", "domain": "www.A.com"}, {"title": "t ONE", "url": "v", "seendate": "20240103T000000Z", "domain": "b"}]})
    rows = articles.aggregator_news(spark.createDataFrame([(1, ok), (2, "limit: one every 5 seconds"), (3, "<html>"), (4, "{}")], "query_id long, body string")).collect()
    assert sorted((r.query_id, r.outcome, r.title, r.day) for r in rows) == [(1, "ok", "T one", DAY(2024, 1, 2)), (2, "throttled", None, None), (3, "error", None, None), (4, "empty", None, None)]
    feed = articles.feed_news(spark.createDataFrame([(1, json.dumps([{"headline": "H", "url": "u", "datetime": 1704153600, "summary": "s"}]))], "query_id long, body string"), "finnhub").collect()
    assert [(r.title, r.day, r.description) for r in feed] == [("H", DAY(2024, 1, 2), "s")]
    rss = "<rss><item><title><![CDATA[A &amp; B]]></title><link>http://x</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><media:content url=\"i.png\"/></item></rss>"
    got = articles.rss_items(spark.createDataFrame([(1, rss)], "feed_id long, xml string")).collect()
    assert [(r.title, r.url, r.day, r.image_url) for r in got] == [("A & B", "http://x", DAY(2024, 1, 2), "i.png")]
    pages = spark.createDataFrame([(1, "P", "== H ==\n" + "In 1903 the company was founded by a group of people in a small town. In 1903 it was also something else that is long enough to count here. Later in 1950 it moved its offices to a larger town nearby, as told.")], "page_id long, title string, text string")
    assert [r.year for r in articles.events_from_pages(pages).orderBy("pos").collect()] == [1903, 1950]


def test_markets(spark):
    block = [("0000320193", "Apple", ["10-K", "8-K", "8-K", "4", "497"], ["2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05", ""], ["1-2", "1-3", "1-4", "1-5", "1-6"], ["a", "b", "c", "d", "e"], ["", "2.02,9.01", "5.02", "", ""])]
    got = markets.filings(spark.createDataFrame(block, "cik string, name string, form array<string>, filingDate array<string>, accessionNumber array<string>, primaryDocument array<string>, items array<string>")).orderBy("day").collect()
    assert [(r.kind, r.title, r.url) for r in got] == [("earnings", "Apple: Annual report (10-K)", "https://www.sec.gov/Archives/edgar/data/320193/12/a"), ("earnings", "Apple: Earnings announcement (8-K)", "https://www.sec.gov/Archives/edgar/data/320193/13/b"), ("filing", "Apple: 8-K filing", "https://www.sec.gov/Archives/edgar/data/320193/14/c")]
    bars = markets.daily_prices(spark.createDataFrame([("A", [0, 86400, 172800], [1.005, None, 2.345], [10.0, 1.0, None])], "ticker string, timestamp array<long>, close array<double>, volume array<double>")).orderBy("day").collect()
    assert [(r.day, r.volume) for r in bars] == [(DAY(1970, 1, 1), 10), (DAY(1970, 1, 3), None)]
    companies = spark.createDataFrame([(1, "1", "F", "Ford Motor Co"), (2, "2", "FC", "Ford Credit"), (3, "3", "GE", "General Electric")], "pos long, cik string, ticker string, title string")
    funds = spark.createDataFrame([(1, "9", "SPY", "Spider Trust")], "pos long, cik string, symbol string, name string")
    asked = spark.createDataFrame([(1, "f"), (2, "ford"), (3, "gen"), (4, "spy"), (5, "spider"), (6, "fo"), (7, "zz"), (8, "ge")], "query_id long, query string")
    assert sorted((r.query_id, r.cik) for r in markets.resolve_company(asked, companies, funds).collect()) == [(1, "1"), (2, "1"), (3, "3"), (4, "9"), (5, "9"), (8, "3")]


def test_onchain(spark):
    blocks = spark.createDataFrame([(210000, 1354116278, "a"), (420000, 1468082773, "b"), (840000, 1713571767, "d")], "height long, time long, hash string")
    assert [(r.epoch, r.reward, r.day) for r in onchain.halvings(blocks, 2_000_000_000).orderBy("epoch").collect()] == [(1, 25.0, DAY(2012, 11, 28)), (2, 12.5, DAY(2016, 7, 9))]
    hacks = spark.createDataFrame([("Aave V2", 1700000000, 20e6, ["Ethereum"]), ("AaveGotchi", 1700000000, 20e6, ["Polygon"]), ("Big Bridge", 1700000000, 200e6, ["Ethereum"]), ("Small", 1700000000, 1e6, ["Ethereum"]), ("Aave", 1700000000, 20e9, [])], "name string, date long, amount double, chains array<string>")
    targets = spark.createDataFrame([("aave", "protocol", "aave"), ("ethereum", "chain", "ethereum")], "slug string, match string, name string")
    assert sorted((r.slug, r.title) for r in onchain.exploits(hacks, targets).collect()) == [("aave", "Aave V2 exploited — $20m"), ("ethereum", "Big Bridge exploited — $200m")]
