"""What pages show: small reads, filters and texts over the model's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import numbers, text
from .dedupe import collapse, first_per
from .resolve import by_slug, candidates, known_company

# The aggregators that match key words only, forms in titles, the limits of requests, and prices a million tokens.
LOOSE_SOURCES = ["gdelt", "newsdata", "gnews", "currents", "marketaux"]
FORM = r"(?i)\b(10-K/?A?|10-Q/?A?|8-K/?A?|6-K/?A?|20-F|40-F|S-\d\w*|F-\d\w*|13[DG]/?A?|DEF 14A|424B\d|SC 13[DG])\b"
CLAMPS = {"floor": (5.0, 1.0, 50.0), "sigma": (2.0, 0.0, 6.0), "divergencePct": (15.0, 1.0, 500.0), "sinceMonths": (30.0, 1.0, 240.0)}
MOST_TICKERS, MOST_TERMS = 40, 5
FIRST_ARCHIVED = "1996-01-01"
RANK_FLOOR = 0.35
NOTE_CHARS, NOTES_EACH = 500, 200
NOTE_KINDS = ["note", "entry", "exit"]


def relevance_floor(events: DataFrame, subject: Column, aliases: Column | None = None) -> DataFrame:
    """Rows of key-word aggregators (source_key) stay only if their title names the subject; all others stay."""
    return events.filter(F.col("source_key").isNull() | ~F.col("source_key").isin(LOOSE_SOURCES) | text.names_subject(F.col("title"), subject, aliases))


def ranked_by_score(events: DataFrame, kinds: list[str] | None = None, floor: float = RANK_FLOOR) -> DataFrame:
    """Of the chosen kinds what scores ``floor`` or more, the best first; what has no score counts as 0."""
    score = F.coalesce("score", F.lit(0.0))
    return (events.filter(F.col("kind").isin(kinds)) if kinds else events).filter(score >= floor).orderBy(score.desc(), "event_id")


def before_listing(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds before_listing: whether an event is older than its subject's first bar; without bars nothing is."""
    first = prices.groupBy("subject_id").agg(F.min("day").alias("first_bar"))
    return events.join(first, "subject_id", "left").withColumn("before_listing", F.coalesce(F.col("day") < F.col("first_bar"), F.lit(False))).drop("first_bar")


def could_be_archived(day: Column) -> Column:
    return day >= F.lit(FIRST_ARCHIVED).cast("date")


def archive_url(domain: Column, day: Column) -> Column:
    return F.concat(F.lit("https://web.archive.org/web/"), F.date_format(day, "yyyyMMdd"), F.lit("/http://"), domain)


def subject_path(kind: Column, slug: Column, ticker: Column) -> Column:
    encoded = text.chain(F.url_encode(slug), (r"\+", "%20"), (r"%21", "!"), (r"%27", "'"), (r"%28", "("), (r"%29", ")"), (r"%7E", "~"))
    return F.when(kind == "company", F.concat(F.lit("/company/"), F.coalesce(ticker, slug))).when(kind == "industry", F.concat(F.lit("/industry/"), slug)).otherwise(F.concat(F.lit("/topic/"), encoded))


def clamped(name: str, value: Column) -> Column:
    """A request's number within its bounds; its default for anything that is no number."""
    usual, low, high = CLAMPS[name]
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), usual).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), number)))


def asked_tickers(listed: Column) -> Column:
    return F.slice(F.filter(F.transform(F.split(listed, ","), lambda t: F.upper(F.trim(t))), lambda t: t != ""), 1, MOST_TICKERS)


def asked_terms(listed: Column) -> Column:
    return F.slice(F.filter(F.transform(F.split(listed, ","), lambda t: F.trim(t)), lambda t: F.length(t) > 2), 1, MOST_TERMS)


def regulation_query(name: Column, aliases: Column) -> Column:
    """The first alias of three letters or more, else the first word of the name, in lower case."""
    own = F.get(F.filter(aliases, lambda a: F.length(F.trim(a)) > 2), 0)
    return F.coalesce(F.trim(own), F.lower(F.split(F.trim(F.split(name, "[&,]")[0]), r"\s+")[0]))


def explained(signals: DataFrame, explanations: DataFrame) -> DataFrame:
    """Signals with the explanation of their kind and week, if there is one."""
    return signals.join(explanations.select("kind", "window_start", "synthesis"), ["kind", "window_start"], "left")


def with_visitors(server: DataFrame, visitor: DataFrame) -> DataFrame:
    """The server's rows, and of a visitor's feeds, collapsed by story, those it does not have."""
    return server.unionByName(collapse(visitor).drop("place", "copies").join(server.select("id"), "id", "left_anti").select(*server.columns))


def suggestible(links: DataFrame, subjects: DataFrame, least: int = 10, most: int = 24) -> DataFrame:
    """Subjects of ``least`` events or more, those of the most first: (label, href, kind)."""
    counted = links.groupBy("subject_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    top = counted.join(subjects.filter("kind in ('company', 'topic')"), "subject_id").orderBy(F.col("n").desc(), "subject_id").limit(most)
    company = (F.col("kind") == "company") & F.col("ticker").isNotNull()
    return top.select(F.when(company, F.col("ticker")).otherwise(F.col("display_name")).alias("label"), subject_path(F.when(company, "company").otherwise("topic"), F.col("slug"), F.col("ticker")).alias("href"), F.when(company, "company").otherwise("topic").alias("kind"))


def blended(own: DataFrame, seeds: DataFrame, least: int = 12) -> DataFrame:
    """``own`` suggestions (label, kind), and of each kind that has under half of ``least`` so many seeds (pos, label, kind) of other labels; padded tells them apart."""
    need = -(-least // 2)
    have = F.broadcast(own.groupBy("kind").agg(F.count("*").alias("have")))  # a row for each kind
    low = own.select(F.lower("label").alias("low")).distinct()
    fresh = first_per(seeds.withColumn("low", F.lower("label")), ["low"], ["pos"]).join(low, "low", "left_anti")
    ranked = fresh.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("pos"))).join(have, "kind", "left").filter(F.col("r") <= need - F.coalesce("have", F.lit(0)))
    return own.select("label", "kind", F.lit(False).alias("padded")).union(ranked.select("label", "kind", F.lit(True)))


def mixed(pool: DataFrame, seed: int, count: int = 5, companies: int = 4) -> DataFrame:
    """``companies`` companies and topics for the rest, in an order drawn by ``seed``; padded ones come last within a kind."""
    drawn = F.xxhash64("label", F.lit(seed))
    ranked = pool.withColumn("draw", drawn).withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("padded", "draw")))
    first = ranked.filter((F.col("kind") == "company") & (F.col("r") <= companies))
    rest = ranked.filter("kind = 'topic'").join(F.broadcast(first.agg(F.count("*").alias("c")))).filter(F.col("r") <= count - F.col("c")).drop("c")  # one row
    return first.union(rest.select(*first.columns)).orderBy("draw").select("label", "kind", "padded")


def totals(**tables: DataFrame) -> DataFrame:
    """(name, rows) of each table, for the log of a backup."""
    return reduce(DataFrame.union, [df.agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n, df in tables.items()])


def form_summary(filings: DataFrame, scope: str) -> DataFrame:
    """(scope, summary) of filings (scope, pos, title): '8-K ×2 · 10-K', the most frequent form first, then the first seen."""
    found = F.upper(F.regexp_extract("title", FORM, 1))
    counted = filings.groupBy(scope, F.when(found == "", "filing").otherwise(found).alias("form")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    said = F.when(F.col("n") > 1, F.concat("form", F.lit(" ×"), "n")).otherwise(F.col("form"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "first", said.alias("said"))))  # a row for each form
    return counted.groupBy(scope).agg(F.array_join(F.transform(listed, lambda x: x["said"]), " · ").alias("summary"))


def capacity(minutes: Column, limit: Column) -> Column:
    """How many subjects a daily limit carries at one request each so many minutes; null without a limit, and where that is no request a day."""
    return F.floor(F.try_divide(limit, numbers.per_day(minutes))).cast("long")


def estimate(texts: DataFrame, scope: str, in_price: float, out_price: float, batch: int = 25, overhead: int = 200, answer: int = 12) -> DataFrame:
    """(scope, items, batches, input_tokens, output_tokens, usd) of a batched call over texts (scope, text)."""
    summed = texts.groupBy(scope).agg(F.count("*").alias("items"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).withColumn("batches", F.ceil(F.col("items") / batch))
    tokens = summed.select(scope, "items", "batches", (F.ceil(F.col("chars") / 3.0) + F.col("batches") * overhead).alias("input_tokens"), (F.col("items") * answer).alias("output_tokens"))
    return tokens.withColumn("usd", F.col("input_tokens") / 1e6 * in_price + F.col("output_tokens") / 1e6 * out_price)


def within_cap(items: Column, usd: Column, cap: float = 1.0) -> Column:
    return (items > 0) & (usd <= cap)


def stalest(subjects: DataFrame, most: int = 200) -> DataFrame:
    """Subjects in the order in which to refresh them: those that never were first."""
    return subjects.filter("kind in ('company', 'topic')").orderBy(F.col("refreshed_at").asc_nulls_first(), "slug").limit(most)


def overlay_positions(events: DataFrame) -> DataFrame:
    """Adds x, the per cent of the way from the first to the last day of all (side, event_id, day). One row of ends is broadcast."""
    ends = events.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    return events.join(F.broadcast(ends)).withColumn("x", F.datediff("day", "lo") / F.greatest(F.lit(1), F.datediff("hi", "lo")) * 100).drop("lo", "hi")


def backlog(events: DataFrame, links: DataFrame, most: int = 500) -> DataFrame:
    """Of each subject the newest ``most`` pairs that have no relevance yet."""
    open_ = links.filter("relevance is null").select("subject_id", "event_id").join(events, "event_id")
    return open_.withColumn("r", F.row_number().over(Window.partitionBy("subject_id").orderBy(F.col("day").desc(), "event_id"))).filter(F.col("r") <= most)


def note_ok(date: Column, kind: Column, said: Column) -> Column:
    return F.coalesce(date.rlike(r"^\d{4}-\d{2}-\d{2}$") & kind.isin(NOTE_KINDS) & (F.trim(said) != ""), F.lit(False))


def note_events(notes: DataFrame) -> DataFrame:
    """Notes (path, id, date, kind, text, created_at) as events: sound ones, the first ``NOTES_EACH`` of a page, oldest day first."""
    kept = first_per(notes.filter(note_ok(F.col("date"), F.col("kind"), F.col("text"))), ["path"], ["created_at", "id"], NOTES_EACH)
    return kept.select("path", F.concat(F.lit("note-"), "id").alias("id"), "date", F.lit("annotation").alias("type"), F.substring(F.trim("text"), 1, NOTE_CHARS).alias("title"), F.concat(F.lit("Your "), "kind").alias("source"))


def ago(at: Column, now: Column) -> Column:
    """'5m ago', '7h ago' up to 48 hours, then days; empty for never."""
    minutes = F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 60.0 + 0.5))
    hours = F.floor(minutes / 60.0 + 0.5)
    return F.when(at.isNull(), "").when(minutes < 60, F.concat(minutes, F.lit("m ago"))).when(hours < 48, F.concat(hours, F.lit("h ago"))).otherwise(F.concat(F.floor(hours / 24.0 + 0.5), F.lit("d ago")))


def explanation_hash(signals: DataFrame, cited: DataFrame) -> DataFrame:
    """(signal_id, hash) of signals (signal_id, kind, window_start, window_end, headline) and the rows they cite (signal_id, event_id, content_hash)."""
    rows = F.array_sort(F.collect_list(F.struct("event_id", "content_hash")))  # of one signal: 40 at most
    shown = cited.groupBy("signal_id").agg(F.array_join(F.transform(rows, lambda r: F.concat(F.lit("|"), r["event_id"], F.lit(":"), r["content_hash"])), "").alias("rows"))
    return signals.join(shown, "signal_id", "left").select("signal_id", F.sha2(F.concat(F.concat_ws("|", "kind", "window_start", "window_end", "headline"), F.coalesce("rows", F.lit(""))), 256).alias("hash"))


def topic_identity(current: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subjects, aliases) after topics were asked for (search_term, wikipedia_title, display_name, summary, first_event_on, pos). A topic is its article: a known one takes the newest name, what is newly known and the earliest day; each search term becomes an alias.

    current: subject_id, slug, wikipedia_title, display_name, summary, first_event_on; new topics have no id yet.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
    folded = asked.groupBy("wikipedia_title").agg(F.min_by(F.lower("search_term"), "pos").alias("term"), last("display_name"), last("summary"), F.min("first_event_on").alias("first_event_on"))
    old = current.select("wikipedia_title", "subject_id", "slug", F.col("display_name").alias("old_name"), F.col("summary").alias("old_summary"), F.col("first_event_on").alias("old_first"))
    both = old.join(folded, "wikipedia_title", "full")
    subjects = both.select("subject_id", F.coalesce("slug", "term").alias("slug"), "wikipedia_title", F.coalesce("display_name", "old_name").alias("display_name"), F.coalesce("summary", "old_summary").alias("summary"), F.least("first_event_on", "old_first").alias("first_event_on"))
    aliases = asked.select("wikipedia_title", F.lower("search_term").alias("alias")).distinct()
    return subjects, aliases


def search(queries: DataFrame, subjects: DataFrame, aliases: DataFrame, registrants: DataFrame) -> DataFrame:
    """(query_id, rung, kind, target): the best of the own subjects on one scale; else a known company; else a slug or alias; else a registrant's ticker or title; else the same for the query's heads, the longest first.

    subjects: subject_id, kind, slug, ticker, display_name; registrants: ticker, title.
    """
    asked = queries.select("query_id", F.trim(F.regexp_replace("query", r"\s+", " ")).alias("query"))
    full = asked.filter("query <> ''").select(F.col("query").alias("query_id"), F.lit(0).alias("head"), "query").distinct()  # a text is answered once
    heads = full.select("query_id", F.posexplode(text.head_prefixes(F.col("query"))).alias("k", "x")).select("query_id", (F.col("k") + 1).alias("head"), F.col("x.head").alias("query"))
    tried = full.union(heads).withColumn("try_id", F.struct("query_id", "head"))
    as_ids = tried.select(F.col("try_id").alias("query_id"), "query")
    what = subjects.select("subject_id", "kind", "slug", "ticker")
    target = F.when((F.col("kind") == "company") & F.col("ticker").isNotNull(), F.col("ticker")).otherwise(F.col("slug"))
    kind = F.when((F.col("kind") == "company") & F.col("ticker").isNotNull(), "company").otherwise("topic")
    own = candidates(as_ids, subjects, aliases, most=1).select("query_id", "subject_id").join(what, "subject_id").select("query_id", F.when(F.col("kind") == "company", 1).otherwise(2).alias("rung"), kind.alias("kind"), target.alias("target"))
    names = known_company(as_ids, subjects.filter("kind = 'company'")).select("query_id", F.lit(1), F.lit("company"), "ticker")
    slugs = by_slug(as_ids.withColumnRenamed("query", "slug"), subjects, aliases).join(what, "subject_id").select("query_id", F.lit(2), kind, target)
    low = as_ids.select("query_id", F.lower("query").alias("low"))
    listed = registrants.select(F.lower("ticker").alias("low"), "ticker").union(registrants.select(F.lower("title"), "ticker"))
    abroad = low.join(listed, "low").groupBy("query_id").agg(F.min("ticker").alias("t")).select("query_id", F.lit(3), F.lit("company"), "t")
    found = own.union(names).union(slugs).union(abroad).select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.head").alias("head"), "rung", "kind", "target")
    best = first_per(found, ["query_id"], ["head", "rung", "target"])
    said = F.when(F.col("query") == "", "empty").when(F.col("head") > 0, "salvaged_prefix").when(F.col("rung") == 1, "known_company").when(F.col("rung") == 2, "known_subject").when(F.col("rung") == 3, "edgar").otherwise("unresolved")
    return asked.join(best.withColumnRenamed("query_id", "query"), "query", "left").select("query_id", said.alias("rung"), F.coalesce("kind", F.lit("none")).alias("kind"), "target")
