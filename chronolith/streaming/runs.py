"""A scheduled run over landed payloads: which sources are due, each as its own plan, a failing one as a row of the log.

A run takes the stalest subjects, and those most asked for, and gives each source the
subjects for which its window has passed and that it does not back off from. What a source
gives is committed to the store together with its rows of the log, so no reader sees events
of a fetch that is not logged. A source whose plan fails costs its own events only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import dedupe, merges, reports, visits
from ..operators.pages import stalest
from ..sources.store import Conflict, Store, Table, append, failing

NEWS_CAP = 75
BACKOFF_MINUTES = 30

EVENTS = Table("subject_id long, source string, dedup_key string, content_hash string, kind string, day date, precision string, title string, body string, image_url string", "dedup_key")
FETCHES = Table("fetch_id string, source string, subject_id long, fetched_at timestamp, outcome string, events long, detail string", "fetch_id")
SUBJECTS = Table("subject_id long, slug string, kind string, refreshed_at timestamp", "subject_id")
TABLES = {"events": EVENTS, "fetches": FETCHES, "subjects": SUBJECTS}

#: Subjects due (subject_id, slug) to events: subject_id, pos, kind, day, precision, title, description, image_url, url.
Read = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Source:
    name: str
    read: Read
    capped: bool = False  # wire stories: collapsed first, then the first 75 of a subject


def due(subjects: DataFrame, fetches: DataFrame, source: str, now: Column, backoff: int = BACKOFF_MINUTES) -> DataFrame:
    """The subjects for which a source's window has passed since the last answer, and whose last attempt just now was neither throttled nor failed."""
    log = fetches.filter(F.col("source") == source)
    last = log.filter("outcome in ('ok', 'empty')").groupBy("subject_id").agg(F.max("fetched_at").alias("last_at"))
    asked = subjects.join(last, "subject_id", "left").withColumn("source", F.lit(source))
    held = reports.backing_off(log.withColumnRenamed("subject_id", "subject"), now, backoff).filter("backs_off").select(F.col("subject").alias("subject_id"))
    return reports.stale(asked, now).join(held, "subject_id", "left_anti").select(*subjects.columns)


def cut(events: DataFrame, most: int = NEWS_CAP) -> DataFrame:
    """Stories of a subject collapsed, then the first ``most``: copies of one story take one place."""
    one = dedupe.collapse(events, ["subject_id"])
    return dedupe.first_per(one, ["subject_id"], ["place"], most).select(*events.columns)


def _rows(events: DataFrame, source: str) -> DataFrame:
    """Events as the store keeps them; one happening of a subject has one key, whatever source tells of it."""
    key = F.sha2(F.concat_ws("|", "subject_id", "kind", F.date_format("day", "yyyy-MM-dd"), F.lower(F.trim("title"))), 256)
    told = F.sha2(F.concat_ws("|", "title", F.coalesce("description", F.lit(""))), 256)
    return events.select("subject_id", F.lit(source).alias("source"), key.alias("dedup_key"), told.alias("content_hash"), "kind", "day", "precision", "title", F.col("description").alias("body"), "image_url", "pos")


def keep_events(current: DataFrame, came: DataFrame) -> DataFrame:
    """Upserts by key; subject and source stay those of the first row."""
    merged = merges.upsert_events(current.drop("subject_id", "source"), came.drop("subject_id", "source")).drop("change")
    came_from = came.groupBy("dedup_key").agg(F.min_by(F.struct("subject_id", "source"), "pos").alias("n"))
    held = current.select("dedup_key", F.struct("subject_id", "source").alias("o"))
    both = merged.join(held, "dedup_key", "left").join(came_from, "dedup_key", "left")
    whose = F.coalesce("o", "n")
    return both.select(whose["subject_id"].alias("subject_id"), whose["source"].alias("source"), *merged.columns)


def _logged(asked: DataFrame, counts: DataFrame | None, source: str, run: str, now: Column, error: str | None = None) -> DataFrame:
    """A row of the log for each subject asked: ok, empty, or error with what was wrong."""
    counted = asked.select("subject_id").join(counts, "subject_id", "left") if counts is not None else asked.select("subject_id", F.lit(0).alias("events"))
    n = F.coalesce("events", F.lit(0)).cast("long")
    outcome = F.lit("error") if error is not None else F.when(n > 0, "ok").otherwise("empty")
    return counted.select(F.concat_ws(":", F.lit(run), F.lit(source), "subject_id").alias("fetch_id"), F.lit(source).alias("source"), "subject_id", now.alias("fetched_at"), outcome.alias("outcome"), n.alias("events"), F.lit(error).cast("string").alias("detail"))


def _refreshed(current: DataFrame, came: DataFrame) -> DataFrame:
    both = current.join(came.select("subject_id", F.col("refreshed_at").alias("at")), "subject_id", "left")
    return both.select("subject_id", "slug", "kind", F.coalesce("at", "refreshed_at").alias("refreshed_at"))


def log_once(current: DataFrame, came: DataFrame) -> DataFrame:
    """A run that is done again logs nothing twice."""
    return append(current, came.join(current.select("fetch_id"), "fetch_id", "left_anti"))


def run(store: Store, sources: list[Source], name: str, now: Column, most: int = 200) -> dict[str, str]:
    """Refreshes the ``most`` stalest subjects of the store from all sources; gives each source's outcome. Rows of the log tell of each subject.

    All is read as of the version at which the run began. A source's rows are dealt by
    their own plan, so one with a broken payload fails alone; it is logged and tried again
    when its back-off has passed. Subjects count as refreshed if any source answered.
    """
    began = store.version()
    chosen = stalest(store.read("subjects", began), most).select("subject_id", "slug")  # ``most`` at the most
    outcomes: dict[str, str] = {}
    for source in sources:
        asked = due(chosen, store.read("fetches", began), source.name, now)
        try:
            given = source.read(asked).join(asked.select("subject_id"), "subject_id", "left_semi")
            rows = _rows(cut(given) if source.capped else given, source.name)
            counts = rows.groupBy("subject_id").agg(F.count("*").alias("events"))
            store.commit({"events": (rows, keep_events), "fetches": (_logged(asked, counts, source.name, name, now), log_once), "subjects": (asked.withColumn("refreshed_at", now), _refreshed)}, f"{name} {source.name}")
            outcomes[source.name] = "ok"
        except Exception as e:  # whatever a source's plan raises is its own
            outcomes[source.name] = failing(e)
            store.commit({"fetches": (_logged(asked, None, source.name, name, now, outcomes[source.name]), log_once)}, f"{name} {source.name} failed")
    return outcomes


def first_pass(store: Store, asked: DataFrame, answers: DataFrame, events: DataFrame, prices: DataFrame, name: str, tries: int = 5) -> DataFrame:
    """First visits (see ``visits.first_visits``) on a store that also holds ``ledger`` and ``prices``: gives them with their outcomes, after all they bring is committed at once.

    events: key and the columns that sources give; prices: key, subject_id, day, close,
    volume. Only what an ingested visit names is stored, with a row of the log for each;
    its claim, its failures, its events, prices and log are one version of the store.
    """
    for _ in range(tries):
        began = store.version()
        seen = visits.first_visits(asked, store.read("ledger", began), answers)
        good = seen.filter("outcome = 'ingested'").select("key", "at")
        rows = _rows(events.join(good, "key", "left_semi"), "first_pass")
        bars = prices.join(good, "key", "left_semi").withColumn("pos", F.lit(0))
        counted = events.groupBy("key", "subject_id").agg(F.count("*").cast("long").alias("events"))
        logged = good.join(counted, "key").select(F.concat_ws(":", F.lit(name), "key").alias("fetch_id"), F.lit("first_pass").alias("source"), "subject_id", F.col("at").alias("fetched_at"), F.lit("ok").alias("outcome"), "events", F.lit(None).cast("string").alias("detail"))
        claims = seen.filter("claimed").select(F.col("key").alias("slug"), "at", "key", "missed", "outcome", "claimed")
        try:
            store.commit({"ledger": (claims, visits.ledger_after), "events": (rows, keep_events), "prices": (bars, merges.upsert_prices), "fetches": (logged, log_once)}, name, onto=began)
            return seen
        except Conflict:  # another writer may hold a claim by now
            continue
    raise Conflict("other writers came first")


LEDGER = Table("slug string, failures int, attempted_at timestamp, dead_until timestamp", "slug")
PRICES = Table("subject_id long, day date, close double, volume long", "subject_id")
FIRST_PASS = TABLES | {"ledger": LEDGER, "prices": PRICES}
