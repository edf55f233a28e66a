"""Parsers of landed article payloads: prose, citations, newspapers, feeds, archives. Each is a DataFrame in and events out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

from ..functions import text
from ..functions.numbers import let
from ..operators.dedupe import first_per, spread, unique_urls

CITATION = "array<struct<title:string,url:string,raw_date:string,publication:string>>"
#: The kinds of citation templates that are read.
CITED_AS = ["news", "web", "press release", "magazine", "journal", "report", "interview", "av media", "podcast", "episode"]
_OPEN = re.compile(r"\{\{\s*cite\s+(?:" + "|".join(CITED_AS) + r")\b", re.I)
_MARK = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")
_BRACES = re.compile(r"\{\{|\}\}")
_NAMED_BY = ["work", "newspaper", "magazine", "website", "publisher", "agency"]


def events_from_pages(pages: DataFrame, most: int = 40) -> DataFrame:
    """pages (page_id, title, text) to (page_id, pos, year, sentence, url): the first sentence of 60 to 400 characters of each year, at most ``most`` a page."""
    paragraphs = pages.select("page_id", "title", F.posexplode(F.split("text", "\n")).alias("p", "para")).withColumn("para", F.trim("para")).filter("length(para) > 40 and not startswith(para, '==')")
    found = paragraphs.select("page_id", "title", "p", F.posexplode(F.regexp_extract_all("para", F.lit(r"([^.!?]*[.!?])"), 1)).alias("s", "sentence")).withColumn("sentence", F.trim("sentence"))
    dated = found.filter("length(sentence) between 60 and 400").withColumn("year", text.extract_year(F.col("sentence"))).filter("year is not null")
    first = first_per(dated, ["page_id", "year"], ["p", "s"])
    kept = first_per(first, ["page_id"], ["p", "s"], most)
    return kept.select("page_id", "title", (F.col("p") * 10_000 + F.col("s")).alias("pos"), "year", "sentence", F.lit("year").alias("precision"))


def template_fields(body: str) -> dict[str, str]:
    """The fields of a template, cut at the pipes outside any inner template or link; of repeated names the last."""
    cuts, depth = [], 0
    for m in _MARK.finditer(body):
        if m[0] == "|":
            cuts += [m.start()] * (depth == 0)
        else:
            depth += 1 if m[0] in ("{{", "[[") else -1
    parts = [body[a + 1 : b] for a, b in zip(cuts, [*cuts[1:], len(body)], strict=True)]
    pairs = [p.split("=", 1) for p in parts if "=" in p]
    return {k.strip().lower(): v.strip() for k, v in pairs}


def citations_of(wikitext: str) -> Iterator[tuple[str, str, str, str]]:
    """(title, url, date as written, publication) of the cite templates, up to the first that is not closed."""
    at = 0
    while m := _OPEN.search(wikitext, at):
        depth, end = 0, None
        for b in _BRACES.finditer(wikitext, m.start()):
            depth += 1 if b[0] == "{{" else -1
            if not depth:
                end = b.end()
                break
        if end is None:
            return
        fields = template_fields(wikitext[m.start() + 2 : end - 2])
        yield fields.get("title", ""), fields.get("url", ""), fields.get("date", ""), next((fields[k] for k in _NAMED_BY if k in fields), "")
        at = end


def _cites(wikitext: pd.Series) -> pd.Series:
    return wikitext.map(lambda t: [dict(zip(("title", "url", "raw_date", "publication"), c, strict=True)) for c in citations_of(t or "")])


def parse_citations(articles: DataFrame) -> DataFrame:
    """articles (article_id, wikitext) to (article_id, pos, title, url, date, precision, publication): citations with a web address, a title of 8 characters and a date."""
    cites = pandas_udf(_cites, CITATION)  # nested templates are no regular language: the one parser outside the JVM, in Arrow batches
    return sound_citations(articles.select("article_id", F.posexplode(cites("wikitext")).alias("pos", "c")).select("article_id", "pos", "c.*"))


def sound_citations(rows: DataFrame) -> DataFrame:
    """Citations as they are written (article_id, pos, title, url, raw_date, publication) as ``parse_citations`` gives them."""
    when = text.cite_date(F.col("raw_date"))
    host = F.regexp_replace(F.try_parse_url("url", F.lit("HOST")), r"^www\.", "")
    named = let(text.clean_cite(F.col("publication")), lambda said: F.when(said != "", said).otherwise(F.coalesce(host, F.lit("cited source"))))
    read = F.struct(text.clean_cite(F.col("title")).alias("title"), F.trim("url").alias("url"), when.alias("w"), named.alias("publication"))
    sound = lambda c: c["url"].rlike("(?i)^https?://") & (F.length(c["title"]) >= 8) & c["w"].isNotNull()
    # as an array of one that is filtered, so that each field is read once, and not again for the filter
    return rows.select("article_id", "pos", F.explode(F.filter(F.array(read), sound)).alias("c")).select("article_id", "pos", "c.title", "c.url", "c.w.date", "c.w.precision", "c.publication")


class Citations:
    """A table function for SQL: ``SELECT a.article_id, c.* FROM articles a, LATERAL citations(a.wikitext) c``."""

    def eval(self, wikitext: str) -> Iterator[tuple[int, str, str, str, str]]:
        for n, found in enumerate(citations_of(wikitext or "")):
            yield n, *found


def register(spark: SparkSession) -> None:
    """Makes ``citations(wikitext)`` known to the session's SQL; rows travel in Arrow batches."""
    spark.udtf.register("citations", udtf(Citations, returnType="pos int, title string, url string, raw_date string, publication string", useArrow=True))


def citation_events(citations: DataFrame, most: int = 160) -> DataFrame:
    """One event for each URL of an article, in the order of dates, an even sample of ``most`` from each article."""
    return spread(unique_urls(citations, ["article_id"]), ["article_id"], ["date", "pos"], most)


def press_mentions(results: DataFrame, per_year: int = 2, most: int = 40) -> DataFrame:
    """Newspaper pages (query_id, pos, date, paper, url): full dates only, the first ``per_year`` of a year and ``most`` in all."""
    dated = results.filter(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return first_per(first_per(dated.withColumn("year", F.substring("date", 1, 4)), ["query_id", "year"], ["pos"], per_year), ["query_id"], ["pos"], most)


def paper_name(title):
    """A newspaper's name without its years and place, its words capitalised; words of up to two letters stay upper-case."""
    plain = text.chain(title, (r"\s*\([^)]*\)", ""), (r",?\s*\d{4}\s*[-–].*$", ""), (r"[\s.]+$", ""))
    return F.array_join(F.transform(F.split(plain, r"\s+"), lambda w: F.when(F.length(w) > 2, F.initcap(w)).otherwise(F.upper(w))), " ")


GDELT = "articles array<struct<title:string,url:string,seendate:string,domain:string,socialimage:string>>"


def aggregator_news(payloads: DataFrame) -> DataFrame:
    """Payloads (query_id, body): outcome and events of each; a body in plain words about the rate is throttled, another that is no JSON an error; of titles equal in their first 60 letters the first."""
    body = F.ltrim("body")
    is_json = F.startswith(body, F.lit("{"))
    outcome = F.when(~is_json & F.contains("body", F.lit("one every")), "throttled").when(~is_json, "error")
    parsed = payloads.select("query_id", outcome.alias("failed"), F.when(is_json, F.from_json("body", GDELT)["articles"]).alias("a"))
    rows = parsed.select("query_id", "failed", F.posexplode_outer("a").alias("pos", "x")).filter("x is null or x.title <> ''")
    kept = first_per(rows.withColumn("k", F.coalesce(F.substring(F.lower("x.title"), 1, 60), F.lit(""))), ["query_id", "k"], ["pos"])
    day = F.try_to_date(F.substring("x.seendate", 1, 8), "yyyyMMdd")
    return kept.select("query_id", F.coalesce("failed", F.when(F.col("x").isNull(), "empty").otherwise("ok")).alias("outcome"), "pos", F.col("x.title").alias("title"), day.alias("day"), "x.url", text.source_label(text.clean_domain(F.col("x.domain")), F.lit("gdelt")).alias("source"), F.nullif("x.socialimage", F.lit("")).alias("image_url"))


#: For each keyed feed: the list in its payload, its fields for title, url, date, description, image and source, and its cap.
FEEDS = {
    "newsdata": ("results", "title", "link", "pubDate", "description", "image_url", "source_id", 25),
    "gnews": ("articles", "title", "url", "publishedAt", "description", "image", "source", None),
    "currents": ("news", "title", "url", "published", "description", "image", "author", 25),
    "marketaux": ("data", "title", "url", "published_at", "description", "image_url", "source", None),
    "eodhd": ("", "title", "link", "date", "content", "", "", None),
    "finnhub": ("", "headline", "url", "datetime", "summary", "image", "source", 40),
}


def feed_news(payloads: DataFrame, feed: str) -> DataFrame:
    """Events of a keyed feed's payloads (query_id, body), by the table of fields."""
    path, *fields, most = FEEDS[feed]
    names = ["title", "url", "date", "description", "image_url", "source"]
    used = [(n, f) for n, f in zip(names, fields, strict=True) if f]
    item = "array<struct<" + ",".join(f"`{f}`:string" for f in dict.fromkeys(f for _, f in used)) + ">>"
    items = F.from_json("body", f"`{path}` {item}")[path] if path else F.from_json("body", item)
    rows = payloads.select("query_id", F.posexplode(items).alias("pos", "x"))
    out = rows.select("query_id", "pos", *((F.col(f"x.{dict(used)[n]}") if n in dict(used) else F.lit(None).cast("string")).alias(n) for n in names))
    number = F.col("date").try_cast("long")
    day = F.coalesce(F.when(number > 10**8, F.to_date(F.timestamp_seconds(number))), F.try_to_date(F.substring("date", 1, 10), "yyyy-MM-dd"))
    kept = out.withColumn("day", day).filter("title <> '' and url <> '' and day is not null")
    return first_per(kept, ["query_id"], ["pos"], most) if most else kept


def rss_items(feeds: DataFrame, most: int = 25) -> DataFrame:
    """Items of RSS documents (feed_id, xml): title, link, day and image, at most ``most``."""
    items = feeds.select("feed_id", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?is)(<item\b.*?</item>)"), 1)).alias("pos", "item"))
    field = lambda tag: text.strip_html(F.regexp_replace(F.regexp_extract("item", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    day = F.try_to_date(F.regexp_extract("item", r"(?i)<pubDate>\s*(?:[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4})", 1), "d MMM yyyy")
    image = F.nullif(F.regexp_extract("item", r"(?i)<media:(?:content|thumbnail)\b[^>]*\burl=\"([^\"]+)\"", 1), F.lit(""))
    return items.select("feed_id", "pos", field("title").alias("title"), field("link").alias("url"), day.alias("day"), image.alias("image_url")).filter(F.col("pos") < most)


def archive_items(items: DataFrame) -> DataFrame:
    """Archive rows (item_id, mediatype, date, title as one text or a list of texts in JSON): dated ones that are no containers."""
    one = lambda c: F.coalesce(F.get(F.from_json(c, "array<string>"), 0), F.col(c))
    when = text.archive_date(F.when(F.startswith("date", F.lit("[")), F.get(F.from_json("date", "array<string>"), 0)).otherwise(F.col("date")))
    title = F.when(F.startswith("title", F.lit("[")), one("title")).otherwise(F.col("title"))
    return items.filter("mediatype not in ('collection', 'account')").select("item_id", title.alias("title"), when.alias("w")).filter("w is not null").select("item_id", "title", "w.date", "w.precision", F.lit("citation").alias("kind"))


def site_snapshots(index: DataFrame) -> DataFrame:
    """Snapshot rows (domain, pos, fields array): the header is checked, then the first of each year by its 14-digit stamp. A domain without a proper header gives outcome error."""
    header = index.filter("pos = 0").select("domain", (F.array_position("fields", "timestamp") > 0).alias("good"), F.array_position("fields", "timestamp").cast("int").alias("at"))
    rows = index.filter("pos > 0").join(header, "domain", "right")
    stamp = F.get("fields", F.col("at") - 1)
    kept = rows.withColumn("stamp", stamp).withColumn("ok", F.coalesce("good", F.lit(False)) & F.col("stamp").rlike(r"^\d{14}$"))
    first = first_per(kept.withColumn("year", F.when(F.col("ok"), F.substring("stamp", 1, 4))), ["domain", "year"], ["stamp", "pos"])
    return first.select("domain", F.when(~F.coalesce("good", F.lit(False)), "error").when(F.col("ok"), "ok").otherwise("empty").alias("outcome"), F.when(F.col("ok"), F.col("stamp")).alias("stamp"))


def page_titles(pages: DataFrame) -> DataFrame:
    """(page_id, title, host, n_links) of raw pages (page_id, url, html)."""
    return pages.select("page_id", text.strip_html(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.regexp_replace(F.try_parse_url("url", F.lit("HOST")), r"^www\.", "").alias("host"), F.size(F.regexp_extract_all("html", F.lit(r"(?i)(<a\s[^>]*href=)"), 1)).cast("long").alias("n_links"))


NYT = "response struct<docs:array<struct<headline:struct<main:string>,web_url:string,pub_date:string,abstract:string,snippet:string,byline:struct<original:string>,multimedia:string>>>"
GUARDIAN = "response struct<results:array<struct<webTitle:string,webUrl:string,webPublicationDate:string,fields:struct<thumbnail:string,trailText:string,byline:string>>>>"
_CROP = "array<struct<url:string,subtype:string>>"


def paper_image(multimedia):
    """An article's lead image: of a list of crops the xlarge, else the thumbnail, else the first; of an object its default, else its thumbnail. Relative paths are on the paper's site."""
    crops = F.from_json(multimedia, _CROP)
    named = lambda kind: F.get(F.filter(crops, lambda c: c["subtype"] == kind), 0)["url"]
    some = lambda k: F.exists(crops, lambda c: c["subtype"] == k)
    url = F.nullif(F.when(some("xlarge"), named("xlarge")).when(some("thumbnail"), named("thumbnail")).otherwise(F.get(crops, 0)["url"]), F.lit(""))
    listed = F.when(url.rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit("https://www.nytimes.com/"), F.regexp_replace(url, "^/", "")))
    whole = F.from_json(multimedia, "default struct<url:string>, thumbnail struct<url:string>")
    one = F.coalesce(whole["default"]["url"], whole["thumbnail"]["url"])
    return F.when(F.startswith(F.ltrim(multimedia), F.lit("[")), listed).when(one.rlike("(?i)^https?://"), one)


def _described(byline, summary):
    return F.nullif(F.substring(F.concat_ws(" — ", F.nullif(F.trim(byline), F.lit("")), F.nullif(F.trim(summary), F.lit(""))), 1, 240), F.lit(""))


def archive_news(payloads: DataFrame, paper: str) -> DataFrame:
    """Events of two papers' archives (query_id, page: 0 oldest or 1 newest, body), both pages after one another: what has a title, an address and a day."""
    kind, items = (NYT, "docs") if paper == "nyt" else (GUARDIAN, "results")
    rows = payloads.select("query_id", "page", F.posexplode(F.from_json("body", kind)["response"][items]).alias("pos", "x"))
    x = F.col("x")
    if paper == "nyt":
        title, url, at, image = F.trim(x["headline"]["main"]), x["web_url"], x["pub_date"], paper_image(x["multimedia"])
        said = _described(x["byline"]["original"], F.coalesce(x["abstract"], x["snippet"]))
    else:
        title, url, at, said = x["webTitle"], x["webUrl"], x["webPublicationDate"], _described(x["fields"]["byline"], text.strip_html(x["fields"]["trailText"]))
        image = F.when(x["fields"]["thumbnail"].rlike("(?i)^https?://"), x["fields"]["thumbnail"])
    day = F.try_to_date(F.substring(at, 1, 10), "yyyy-MM-dd")
    out = rows.select("query_id", "page", "pos", title.alias("title"), url.alias("url"), day.alias("day"), said.alias("description"), image.alias("image_url"))
    return out.filter("title <> '' and url <> '' and day is not null")


def official_domains(searches: DataFrame, claims: DataFrame) -> DataFrame:
    """(name, domain): searches (name, body) give an entity, claims (entity, body) its site; the bare host without www."""
    entity = F.get(F.from_json("body", "search array<struct<id:string>>")["search"], 0)["id"]
    site = "claims struct<P856:array<struct<mainsnak:struct<datavalue:struct<value:string>>>>>"
    host = F.regexp_replace(F.try_parse_url(F.get(F.from_json("body", site)["claims"]["P856"], 0)["mainsnak"]["datavalue"]["value"], F.lit("HOST")), r"^www\.", "")
    found = searches.select("name", entity.alias("entity")).join(claims.select("entity", host.alias("domain")), "entity")
    return found.filter("domain <> ''").select("name", F.lower("domain").alias("domain"))


def topic_timelines(topics: DataFrame, pages: DataFrame) -> DataFrame:
    """Events of topics (topic) from pages (title, text): the first there is of 'History of the X', 'History of X' and 'X', and the timelines of X beside it. Sentences alike in their first 80 letters count once, those of the first page first."""
    x = F.col("topic")
    wanted = topics.select("topic", F.posexplode(F.array(F.concat(F.lit("history of the "), x), F.concat(F.lit("history of "), x), x, F.concat(F.lit("timeline of the "), x), F.concat(F.lit("timeline of "), x))).alias("place", "low")).withColumn("low", F.lower("low"))
    held = wanted.join(pages.withColumn("low", F.lower("title")), "low")
    main = first_per(held.filter("place < 3"), ["topic"], ["place"])
    every = main.unionByName(held.filter("place >= 3")).withColumn("page_id", F.concat_ws("\x1f", "topic", "place"))
    found = events_from_pages(every).join(every.select("page_id", "topic", "place"), "page_id").withColumn("key", F.lower(F.substring("sentence", 1, 80)))
    return first_per(found, ["topic", "key"], ["place", "pos"]).select("topic", "title", "year", "sentence", "place", "pos")


def dispatched(wanted: DataFrame, landed: DataFrame, feed: str) -> DataFrame:
    """Of landed rows (subject_id, …, and their feed's name in a column) those that a subject (subject_id, feeds) takes."""
    return landed.join(wanted.select("subject_id", F.explode("feeds").alias(feed)).distinct(), ["subject_id", feed], "left_semi")
