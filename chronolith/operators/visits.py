"""First visits and pages for many slugs at once, with typed outcomes.

A page is served from the store if its subject is there; else its slug may be claimed for a
first pass over what the key sources answered; else the demand for it is noted. Each rung
sees only what the rung before it left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import text
from . import dedupe, merges, timeline
from .resolve import by_slug
from .stats import gate

# What becomes of a first visit, and of a page.
OUTCOMES = ["ingested", "already_attempted", "unresolvable", "unavailable"]
PAGES = ["found", "first_pass", "queued", "none"]
COMPANY_CLAIM = "co:"


def claim_key(slug: Column, kind: Column) -> Column:
    """What a claim is held on: a topic's slug, or a company's query with a prefix, so that the two never meet."""
    plain = F.lower(F.trim(slug))
    return F.when(plain == "", plain).when(kind == "company", F.concat(F.lit(COMPANY_CLAIM), plain)).otherwise(plain)


def first_visits(asked: DataFrame, ledger: DataFrame, answers: DataFrame) -> DataFrame:
    """``asked`` (pos, slug, kind, at, free) with key, outcome and missed: what a first pass over the landed ``answers`` gives.

    ledger: slug, failures, attempted_at, dead_until, keyed like ``claim_key``. answers,
    one for each key: slug, timed_out, title, events, bars. A claim is the first ask of a
    key that is past its cooldown and not dead; without a free connection there is no
    claim and no fetch. A topic is charted if its article answers the slug; a company if
    it has filings and prices. A miss counts as a failure unless the sources were late.
    """
    rows = asked.withColumn("key", claim_key(F.col("slug"), F.col("kind")))
    named = rows.filter(F.col("key") != "")
    first = named.filter("free").groupBy("key").agg(F.min(F.struct("at", "pos")).alias("f")).select(F.col("key").alias("slug"), F.col("f.at").alias("at"), F.col("f.pos").alias("first"))
    won = first.join(merges.claimable(ledger, first.select("slug", "at")).filter("claimed").select("slug"), "slug", "left_semi").select(F.col("slug").alias("key"), F.col("first").alias("pos"), F.lit(True).alias("won"))
    known = answers.select(F.col("slug").alias("key"), *(c for c in answers.columns if c != "slug"))
    both = rows.join(won, ["key", "pos"], "left").join(known, "key", "left")
    late = F.coalesce("timed_out", F.lit(False))
    topic = F.col("title").isNotNull() & text.answers_slug(F.col("key"), F.col("title"))
    company = (F.coalesce("events", F.lit(0)) > 0) & (F.coalesce("bars", F.lit(0)) > 0)
    good = ~late & F.coalesce(F.when(F.col("kind") == "company", company).otherwise(topic), F.lit(False))
    outcome = F.when(F.col("key") == "", "unresolvable").when(~F.col("free"), "unavailable").when(F.col("won").isNull(), "already_attempted").when(good, "ingested").otherwise("unresolvable")
    missed = F.coalesce(F.col("won") & ~late & ~good, F.lit(False))
    return both.select(*asked.columns, "key", outcome.alias("outcome"), missed.alias("missed"), F.coalesce("won", F.lit(False)).alias("claimed"))


def ledger_after(ledger: DataFrame, visits: DataFrame) -> DataFrame:
    """The ledger after visits: claims are tried at their time, misses wait longer each time, a success forgets them."""
    took = visits.filter("claimed").select(F.col("key").alias("slug"), "at", "missed", F.col("outcome").alias("o"))
    tried = merges.claim(ledger, took.select("slug", "at"))
    failed = merges.record_failures(tried, took.filter("missed").select("slug", "at"))
    return merges.record_successes(failed, took.filter("o = 'ingested'").select("slug"))


def _shown(subjects: DataFrame, aliases: DataFrame, links: DataFrame, bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subjects with the number of their gated events and of their bars; the names by which they are found."""
    counted = links.filter(gate(F.col("relevance"))).groupBy("subject_id").agg(F.count("*").alias("events"))
    priced = bars.groupBy("subject_id").agg(F.count("*").alias("bars"))
    full = subjects.join(counted, "subject_id", "left").join(priced, "subject_id", "left")
    return full.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("events", "bars")}), aliases


def _found(asked: DataFrame, subjects: DataFrame, aliases: DataFrame, links: DataFrame, bars: DataFrame) -> DataFrame:
    """(query_id, subject_id, display_name, ticker, events, bars) of the asked pages that can be drawn: a topic needs events, a company a ticker, events and prices."""
    full, names = _shown(subjects, aliases, links, bars)
    hit = by_slug(asked.select("query_id", "slug"), subjects, names)
    drawn = asked.select("query_id", F.col("kind").alias("page")).join(hit, "query_id").join(full, "subject_id")
    enough = (F.col("events") > 0) & ((F.col("page") != "company") | (F.col("ticker").isNotNull() & (F.col("bars") > 0)))
    return drawn.filter(enough).select("query_id", "subject_id", "display_name", "ticker", "events", "bars")


def pages(asked: DataFrame, before: dict[str, DataFrame], visits: DataFrame, after: dict[str, DataFrame]) -> DataFrame:
    """(query_id, slug, kind, at, outcome, subject_id, display_name, ticker, events, bars) of the pages asked for (query_id, slug, kind, at).

    before and after: subjects, aliases, links and bars as they were, and as the first
    passes left them; visits: query_id and outcome of first visits. A page is found; or drawn
    after a first pass; or its subject is queued; a blank slug is none.
    """
    plain = asked.withColumn("slug", F.lower(F.trim("slug")))
    open_ = plain.filter("slug <> ''")
    found = _found(open_, **before).withColumn("outcome", F.lit("found"))
    missing = open_.join(found.select("query_id"), "query_id", "left_anti")
    passed = missing.join(visits.filter(F.col("outcome").isin("ingested", "already_attempted")).select("query_id"), "query_id", "left_semi")
    late = _found(passed, **after).withColumn("outcome", F.lit("first_pass"))
    drawn = found.union(late)
    rest = F.when(F.col("slug") == "", "none").otherwise("queued")
    both = plain.join(drawn, "query_id", "left")
    return both.select("query_id", "slug", "kind", "at", F.coalesce("outcome", rest).alias("outcome"), "subject_id", "display_name", "ticker", "events", "bars")


def demand(served: DataFrame) -> DataFrame:
    """What pages add to the demand queue: those queued, and those of a first pass, which are to be deepened."""
    asked = served.filter(F.col("outcome").isin("queued", "first_pass"))
    return asked.select(F.col("query_id").alias("pos"), "slug", "kind", F.when(F.col("kind") == "company", F.upper("slug")).alias("ticker"), F.col("at").alias("asked_at"))


def company_events(companies: DataFrame, events: DataFrame, links: DataFrame, members: DataFrame, most: int = model.SECTOR_ROWS) -> DataFrame:
    """(subject_id, event_id, kind, day, title, sector) of company pages: a company's gated events and the newest ``most`` of its industry, without its prehistory.

    members: industry_id, member_id; an industry's own events are linked to its id. A
    company in several industries shows the first; an industry's rows are cut before they
    go to its members.
    """
    shown = links.filter(gate(F.col("relevance"))).select("event_id", "subject_id")
    own = shown.join(companies.select("subject_id"), "subject_id", "left_semi").join(events, "event_id").withColumn("sector", F.lit(False))
    home = members.groupBy(F.col("member_id").alias("subject_id")).agg(F.min("industry_id").alias("industry_id")).join(companies.select("subject_id"), "subject_id", "left_semi")
    of = shown.withColumnRenamed("subject_id", "industry_id").join(home.select("industry_id").distinct(), "industry_id", "left_semi").join(events, "event_id")
    sector = timeline.newest(of, ["industry_id"], "day", "event_id", most).join(home, "industry_id").drop("industry_id").withColumn("sector", F.lit(True))
    return dedupe.drop_prehistory(own.unionByName(sector.select(*own.columns)))


def compared(asked: DataFrame, subjects: DataFrame, aliases: DataFrame, registrants: DataFrame, links: DataFrame, bars: DataFrame) -> DataFrame:
    """(query_id, kind, key, label, href, subject_id) of what each side of a comparison is: an own company that can be drawn, else a registrant's company, else a topic; nothing for the rest.

    asked: query_id, query; subjects with kind, slug, ticker, display_name; registrants: ticker, title.
    """
    from .pages import subject_path

    plain = asked.select("query_id", F.trim("query").alias("query")).filter("query <> ''")
    as_is = plain.select("query_id", F.lower("query").alias("slug"))
    full, names = _shown(subjects, aliases, links, bars)
    company = (F.col("kind") == "company") & F.col("ticker").isNotNull() & (F.col("events") > 0) & (F.col("bars") > 0)
    held = by_slug(as_is, subjects, names).join(full, "subject_id")
    listed = registrants.select(F.lower("ticker").alias("slug"), "ticker", F.lit(0).alias("r")).union(registrants.select(F.lower("title"), "ticker", F.lit(1)))
    asked_for = as_is.join(listed, "slug").groupBy("query_id").agg(F.min_by("ticker", F.struct("r", "ticker")).alias("t")).select("query_id", F.lower("t").alias("slug"))
    abroad = by_slug(asked_for, subjects, names).join(full, "subject_id")
    columns = ["query_id", "subject_id", "slug", "ticker", "display_name"]
    rungs = [held.filter(company).select(*columns, F.lit(0).alias("rung")), abroad.filter(company).select(*columns, F.lit(1)), held.filter("events > 0").select(*columns, F.lit(2))]
    every = rungs[0].union(rungs[1]).union(rungs[2])
    best = every.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rung"))).filter("n = 1").join(plain, "query_id")
    kind = F.when(F.col("rung") < 2, "company").otherwise("topic")
    key = F.when(F.col("rung") < 2, F.col("ticker")).otherwise(F.col("query"))
    label = F.when(F.col("rung") < 2, F.concat("display_name", F.lit(" ("), "ticker", F.lit(")"))).otherwise(F.col("display_name"))
    return best.select("query_id", kind.alias("kind"), key.alias("key"), label.alias("label"), subject_path(kind, F.col("query"), F.col("ticker")).alias("href"), "subject_id")
