"""Reads of the event model: timelines, industries, sources, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from .stats import gate


def timeline(events: DataFrame, links: DataFrame, attestations: DataFrame) -> DataFrame:
    """Gated events of all subjects, with the primary attestation's url and label and the number of attestations.

    events: (event_id, kind, day, title); links: (event_id, subject_id, relevance); attestations: (event_id, source_id, url, source_label, is_primary). One shuffle of each table, by event.
    """
    shown = links.filter(gate(F.col("relevance")))
    facts = attestations.groupBy("event_id").agg(F.count("*").alias("sources"), F.first(F.when(F.col("is_primary"), F.struct("url", "source_label")), ignorenulls=True).alias("p"))
    joined = shown.join(events, "event_id").join(facts, "event_id", "left")
    label = F.when(F.col("sources") > 1, F.concat("p.source_label", F.lit(" · "), F.col("sources").cast("string"), F.lit(" sources"))).otherwise(F.col("p.source_label"))
    return joined.select("subject_id", "event_id", "kind", "day", "title", "relevance", F.col("p.url").alias("url"), label.alias("source"), F.coalesce("sources", F.lit(0)).alias("sources"))


def scope(industry: DataFrame, members: DataFrame) -> DataFrame:
    """(scope_id, subject_id): each industry and its members, once each."""
    return industry.select(F.col("industry_id").alias("scope_id"), F.col("industry_id").alias("subject_id")).union(members.select("industry_id", "member_id")).distinct()


def newest(rows: DataFrame, key: list[str], day: str, tie: str, most: int) -> DataFrame:
    """The ``most`` newest rows of each group; ties by ``tie``."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(day).desc(), tie))).filter(F.col("r") <= most).drop("r")


def industry_timeline(events: DataFrame, links: DataFrame, members: DataFrame, subjects: DataFrame, most: int = model.INDUSTRY_ROWS) -> DataFrame:
    """The newest gated events of each industry's members, each once, with the tickers it concerns."""
    of = links.filter(gate(F.col("relevance"))).join(members.withColumnRenamed("member_id", "subject_id"), "subject_id").join(subjects.select("subject_id", "ticker"), "subject_id")
    one = of.groupBy("industry_id", "event_id").agg(F.nullif(F.array_join(F.array_sort(F.collect_set("ticker")), ", "), F.lit("")).alias("tickers"), F.count_distinct(F.when(F.col("ticker").isNotNull(), F.col("subject_id"))).alias("companies"))
    return newest(one.join(events, "event_id"), ["industry_id"], "day", "event_id", most)


def latest(log: DataFrame, key: list[str], at: str, tie: str, outcomes: list[str] | None = None) -> DataFrame:
    """The last row of each group."""
    rows = log.filter(F.col("outcome").isin(outcomes)) if outcomes else log
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in log.columns if c not in key]), F.struct(at, tie)).alias("x")).select(*key, "x.*")


def contributions(sources: DataFrame, attested: DataFrame, fetches: DataFrame) -> DataFrame:
    """For each subject and source that has given events or was asked: distinct events (not gated), the last fetch and its outcome.

    attested: (subject_id, source_id, event_id); fetches: (subject_id, source_id, fetched_at, outcome, fetch_id).
    """
    given = attested.groupBy("subject_id", "source_id").agg(F.count_distinct("event_id").alias("events"))
    last = latest(fetches, ["subject_id", "source_id"], "fetched_at", "fetch_id").select("subject_id", "source_id", "fetched_at", "outcome")
    both = given.join(last, ["subject_id", "source_id"], "full")
    out = both.join(F.broadcast(sources), "source_id")  # the registry: a row for each kind of source
    return out.withColumn("events", F.coalesce("events", F.lit(0))).withColumn("status", status(F.col("outcome"), F.col("events"), F.col("fetched_at")))


def status(outcome: Column, events: Column, fetched_at: Column) -> Column:
    return F.when(outcome == "throttled", "throttled").when(outcome == "error", "error").when(events > 0, "events").when(fetched_at.isNotNull(), "asked").otherwise("never")


def index(links: DataFrame, subjects: DataFrame, least: int = 1, most: int = 5000) -> DataFrame:
    """Subjects with at least ``least`` events, those with the most first."""
    counts = links.groupBy("subject_id").agg(F.count("*").alias("events")).filter(F.col("events") >= least)
    return subjects.join(counts, "subject_id").orderBy(F.col("events").desc(), "display_name", "subject_id").limit(most)


def memberships(industries: DataFrame, members: DataFrame) -> DataFrame:
    """Each industry with its members' ids, an empty list if it has none."""
    lists = members.groupBy("industry_id").agg(F.array_sort(F.collect_list("member_id")).alias("members"))
    return industries.join(lists, "industry_id", "left").withColumn("members", F.coalesce("members", F.array().cast("array<long>")))


def explanations(syntheses: DataFrame, citations: DataFrame, events: DataFrame) -> DataFrame:
    """Generated texts with their cited events in the order cited."""
    cited = citations.join(events.select("event_id", "title", "day"), "event_id").groupBy("synthesis_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "event_id", "title", "day"))), lambda x: F.struct(x["event_id"].alias("id"), x["title"].alias("title"), x["day"].alias("day"))).alias("cites"))
    return syntheses.join(cited, "synthesis_id", "left")


def year_month_rows(events: DataFrame, peek: int = model.PEEK) -> DataFrame:
    """Headers and days of a timeline (subject_id, event_id, day, precision, title), as rows with a sort key: year, then its months, each with days; year-only events at 00 of their year, month-only ones at 00 of their month."""
    year, month, day = F.date_format("day", "yyyy"), F.date_format("day", "yyyy-MM"), F.date_format("day", "yyyy-MM-dd")
    key = F.when(F.col("precision") == "year", F.concat(year, F.lit("-00"))).when(F.col("precision") == "month", F.concat(month, F.lit("-00"))).otherwise(day)
    placed = events.select("subject_id", year.alias("year"), F.when(F.col("precision") == "year", None).otherwise(month).alias("month"), key.alias("key"), F.struct("event_id", "title").alias("e"))

    def rows(kind: str, sort: str) -> DataFrame:
        at = Window.partitionBy("subject_id", sort).orderBy("e.event_id")
        numbered = placed.filter(F.col(sort).isNotNull()).withColumn("first", F.when(F.row_number().over(at) <= peek, F.col("e")))
        shown = F.transform(F.array_sort(F.collect_list("first")), lambda e: e["title"])  # ``peek`` at most
        return numbered.groupBy("subject_id", sort).agg(F.count("*").alias("n"), shown.alias("peek")).select("subject_id", F.lit(kind).alias("kind"), F.col(sort).alias("sort"), "n", "peek")

    return rows("year", "year").union(rows("month", "month")).union(rows("day", "key"))


def follow_news(before: DataFrame, now: DataFrame) -> DataFrame:
    """News since a reader looked: how many more events, or one if only the latest day moved. Both: (subject_id, n, latest)."""
    old = before.select("subject_id", F.col("n").alias("n0"), F.col("latest").alias("latest0"))
    more = F.greatest(F.lit(0), F.col("n") - F.col("n0"))
    return now.join(old, "subject_id").select("subject_id", F.when(more > 0, more).when(F.col("latest") > F.col("latest0"), 1).otherwise(0).alias("new"))
