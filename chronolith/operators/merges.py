"""Upserts as pure functions (current, incoming) -> next. ``pos`` is the order of arrival within the incoming rows; those of one key are folded first, as if applied one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model

BEFORE = "current_"


def _last(incoming: DataFrame, keys: list[str], first: list[str] = (), last: list[str] = (), last_known: list[str] = ()) -> DataFrame:
    """One row for each key: some columns of its first row, some of its last, some the last that is not null. Sums up before the shuffle."""
    every = [*(F.min_by(c, "pos").alias(c) for c in first), *(F.max_by(c, "pos").alias(c) for c in last), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in last_known)]
    return incoming.groupBy(*keys).agg(*every)


def _against(current: DataFrame, folded: DataFrame, keys: list[str]) -> DataFrame:
    old = current.select(*keys, *(F.col(c).alias(BEFORE + c) for c in current.columns if c not in keys), F.lit(True).alias("had"))
    return old.join(folded.withColumn("came", F.lit(True)), keys, "full")


def upsert_events(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """By dedup_key. Kind, day and precision stay those of the first row; if the hash differs, title, body and hash are replaced, and the image if the new one is known. Adds change: new, updated or kept.

    Both: dedup_key, content_hash, kind, day, precision, title, body, image_url.
    """
    keep, swap = ["kind", "day", "precision"], ["content_hash", "title", "body"]
    both = _against(current, _last(incoming, ["dedup_key"], first=keep, last=swap, last_known=["image_url"]), ["dedup_key"])
    new = F.col("had").isNull()
    changed = F.col("came").isNotNull() & ~new & ~F.col("content_hash").eqNullSafe(F.col(BEFORE + "content_hash"))
    pick = lambda c: F.when(new | changed, F.col(c)).otherwise(F.col(BEFORE + c)).alias(c)
    image = F.when(new, F.col("image_url")).when(changed, F.coalesce("image_url", BEFORE + "image_url")).otherwise(F.col(BEFORE + "image_url")).alias("image_url")
    return both.select("dedup_key", *(F.when(new, F.col(c)).otherwise(F.col(BEFORE + c)).alias(c) for c in keep), *map(pick, swap), image, F.when(new, "new").when(changed, "updated").otherwise("kept").alias("change"))


def upsert_attestations(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """By (event_id, source_id, external_id): url and time are replaced, the label stays; the first attestation of an event is primary for good."""
    keys = ["event_id", "source_id", "external_id"]
    folded = incoming.groupBy(*keys).agg(F.max_by("url", "pos").alias("url"), F.min_by("source_label", "pos").alias("source_label"), F.max("retrieved_at").alias("retrieved_at"), F.min("pos").alias("pos"))
    both = _against(current, folded, keys)
    new = F.col("had").isNull()
    merged = both.select(*keys, F.coalesce("url", BEFORE + "url").alias("url"), F.when(new, F.col("source_label")).otherwise(F.col(BEFORE + "source_label")).alias("source_label"), F.coalesce("retrieved_at", BEFORE + "retrieved_at").alias("retrieved_at"), F.coalesce(BEFORE + "is_primary", F.lit(False)).alias("was"), F.when(new, F.col("pos")).alias("pos"))
    first = merged.groupBy("event_id").agg(F.max("was").alias("has"), F.min("pos").alias("first"))
    return merged.join(first, "event_id").select(*keys, "url", "source_label", "retrieved_at", (F.col("was") | (~F.col("has") & F.col("pos").eqNullSafe(F.col("first")))).alias("is_primary"))


def insert_only(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rows of new keys, the first of each; what is there is never touched."""
    columns = [c for c in current.columns if c not in keys]
    fresh = _last(incoming.join(current.select(*keys), keys, "left_anti"), keys, first=columns)
    return current.unionByName(fresh.select(*current.columns))


def upsert_subjects(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """By slug: the name is replaced; sic, title, summary and domain if the new one is known; the first day is the earliest known; kind, ticker and cik stay."""
    keep, known = ["kind", "ticker", "cik"], ["sic", "wikipedia_title", "summary", "site_domain"]
    folded = incoming.groupBy("slug").agg(*(F.min_by(c, "pos").alias(c) for c in keep), F.max_by("display_name", "pos").alias("display_name"), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in known), F.min("first_event_on").alias("first_event_on"))
    both = _against(current, folded, ["slug"])
    new = F.col("had").isNull()
    return both.select("slug", *(F.when(new, F.col(c)).otherwise(F.col(BEFORE + c)).alias(c) for c in keep), F.coalesce("display_name", BEFORE + "display_name").alias("display_name"), *(F.coalesce(c, BEFORE + c).alias(c) for c in known), F.least("first_event_on", BEFORE + "first_event_on").alias("first_event_on"))


def upsert_prices(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """By (subject_id, day): the close is replaced; the volume if the new one is known."""
    keys = ["subject_id", "day"]
    both = _against(current, _last(incoming, keys, last=["close"], last_known=["volume"]), keys)
    return both.select(*keys, F.coalesce("close", BEFORE + "close").alias("close"), F.coalesce("volume", BEFORE + "volume").alias("volume"))


def bulk_prices(payloads: DataFrame) -> DataFrame:
    """Parallel arrays (subject_id, days, closes, volumes) as rows; bars without a close are left out."""
    rows = payloads.select("subject_id", F.explode(F.arrays_zip("days", "closes", "volumes")).alias("x"))
    return rows.select("subject_id", F.col("x.days").alias("day"), F.col("x.closes").alias("close"), F.col("x.volumes").alias("volume")).filter("close is not null")


def request_subjects(current: DataFrame, asked: DataFrame) -> DataFrame:
    """By slug: requests are counted, a fulfilled one is open again, the ticker is replaced if the new one is known."""
    folded = asked.groupBy("slug").agg(F.count("*").alias("more"), F.min_by("kind", "pos").alias("kind"), F.max_by("ticker", F.when(F.col("ticker").isNotNull(), F.col("pos"))).alias("ticker"), F.min("asked_at").alias("first_asked"), F.max("asked_at").alias("last_asked"))
    both = _against(current, folded, ["slug"])
    return both.select("slug", F.coalesce(BEFORE + "kind", "kind").alias("kind"), F.coalesce("ticker", BEFORE + "ticker").alias("ticker"), (F.coalesce(BEFORE + "requests", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("requests"), F.coalesce(BEFORE + "first_asked", "first_asked").alias("first_asked"), F.greatest(BEFORE + "last_asked", "last_asked").alias("last_asked"), F.when(F.col("came").isNull(), F.col(BEFORE + "fulfilled_at")).alias("fulfilled_at"))


def pending(requests: DataFrame, most: int = 25) -> DataFrame:
    return requests.filter("fulfilled_at is null").orderBy(F.col("requests").desc(), F.col("last_asked").desc(), "slug").limit(most)


def record_failures(ledger: DataFrame, failed: DataFrame) -> DataFrame:
    """One more failure each (slug, at): dead for 30, 120, 480 and then 10080 minutes."""
    both = ledger.join(failed, "slug", "full")
    now = F.coalesce("failures", F.lit(0)) + 1
    wait = F.get(F.array(*map(F.lit, model.BACKOFF_MINUTES)), F.least(now, F.lit(len(model.BACKOFF_MINUTES))) - 1)
    hit = F.col("at").isNotNull()
    return both.select("slug", F.when(hit, now).otherwise(F.col("failures")).alias("failures"), F.coalesce("at", "attempted_at").alias("attempted_at"), F.when(hit, F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), wait)).otherwise(F.col("dead_until")).alias("dead_until"))


def claimable(ledger: DataFrame, asked: DataFrame, minutes: int = model.CLAIM_COOLDOWN_MINUTES) -> DataFrame:
    """(slug, claimed) for each request (slug, at): never tried, or past its cooldown and not dead."""
    both = asked.join(ledger, "slug", "left")
    ready = F.col("attempted_at").isNull() | ((F.col("attempted_at") <= F.col("at") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))) & (F.col("dead_until").isNull() | (F.col("dead_until") <= F.col("at"))))
    return both.select("slug", ready.alias("claimed"))


def purge(log: DataFrame, at: str, now, days: float = model.RETENTION_DAYS) -> DataFrame:
    return log.filter(F.col(at) >= F.lit(now) - F.make_dt_interval(F.lit(max(1, int(days)))))


def write_scores(links: DataFrame, scores: DataFrame, scored_by: str) -> DataFrame:
    """Scores (event_id, subject_id, score) into links; the others stay."""
    both = links.join(scores, ["event_id", "subject_id"], "left")
    hit = F.col("score").isNotNull()
    return both.select("event_id", "subject_id", F.when(hit, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))).otherwise(F.col("relevance")).alias("relevance"), F.when(hit, scored_by).otherwise(F.col("scored_by")).alias("scored_by"))


def merge_topics(subjects: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Topics of one article title become the one of the smallest id: (subjects, aliases, links). Slugs of the others become aliases, their links move unless there, a missing summary is taken over."""
    topics = subjects.filter("kind = 'topic' and wikipedia_title is not null")
    groups = topics.groupBy("wikipedia_title").agg(F.min("subject_id").alias("winner"), F.max_by("summary", F.when(F.col("summary").isNotNull(), -F.col("subject_id"))).alias("any_summary"), F.count("*").alias("n")).filter("n > 1")
    losers = topics.join(groups, "wikipedia_title").filter("subject_id <> winner").select("subject_id", "slug", "winner")
    left = subjects.join(losers.select("subject_id"), "subject_id", "left_anti").join(groups.select(F.col("winner").alias("subject_id"), "any_summary"), "subject_id", "left")
    kept = left.withColumn("summary", F.coalesce("summary", "any_summary")).select(*subjects.columns)
    moved = links.join(losers.select("subject_id", "winner"), "subject_id", "left").withColumn("own", F.col("winner").isNull()).withColumn("old", F.col("subject_id")).withColumn("subject_id", F.coalesce("winner", "subject_id"))
    merged = moved.groupBy("event_id", "subject_id").agg(F.min_by("relevance", F.struct(~F.col("own"), F.col("old"))).alias("relevance"))
    return kept, losers.select(F.col("winner").alias("subject_id"), F.col("slug").alias("alias")), merged


def upsert_sources(current: DataFrame, registry: DataFrame) -> DataFrame:
    """By id: everything but the key follows the registry."""
    both = _against(current, registry, ["id"])
    rest = [c for c in current.columns if c not in ("id", "key")]
    return both.select("id", F.coalesce(BEFORE + "key", "key").alias("key"), *(F.when(F.col("came").isNotNull(), F.col(c)).otherwise(F.col(BEFORE + c)).alias(c) for c in rest))


def industry_edges(current: DataFrame, companies: DataFrame, curated: DataFrame) -> DataFrame:
    """Edges (industry, member_id, origin): those of codes (member_id, sic) go to sic-<code>, those of sectors (member_id, slug) to the sector; what is there is never touched."""
    coded = companies.select(F.concat(F.lit("sic-"), "sic").alias("industry"), "member_id", F.lit("sic").alias("origin"), F.lit(0).alias("pos"))
    chosen = curated.select(F.col("slug").alias("industry"), "member_id", F.lit("curated").alias("origin"), F.lit(1).alias("pos"))
    return insert_only(current, coded.union(chosen), ["industry", "member_id"])


def mark_requests(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes (slug, at, error): without an error a request is fulfilled; with one it stays pending, and the first 300 characters are kept."""
    both = requests.join(outcomes, "slug", "left")
    done, failed = F.col("at").isNotNull() & F.col("error").isNull(), F.col("error").isNotNull()
    return both.withColumns({"fulfilled_at": F.when(done, F.col("at")).otherwise(F.col("fulfilled_at")), "last_error": F.when(failed, F.substring("error", 1, 300)).when(~done, F.col("last_error"))}).select(*requests.columns)


def record_successes(ledger: DataFrame, slugs: DataFrame) -> DataFrame:
    """A success forgets the failures."""
    both = ledger.join(slugs.select("slug", F.lit(True).alias("good")).distinct(), "slug", "left")
    return both.withColumns({"failures": F.when(F.col("good"), 0).otherwise(F.col("failures")), "dead_until": F.when(F.col("good").isNull(), F.col("dead_until"))}).select(*ledger.columns)


def claim(ledger: DataFrame, asked: DataFrame) -> DataFrame:
    """The ledger after requests (slug, at), one for each slug: what may be claimed is tried at their time."""
    took = asked.join(claimable(ledger, asked).filter("claimed").select("slug"), "slug", "left_semi").withColumnRenamed("at", "took")
    both = ledger.join(took, "slug", "full")
    return both.select("slug", F.coalesce("failures", F.lit(0)).alias("failures"), F.coalesce("took", "attempted_at").alias("attempted_at"), "dead_until")


SYNTHESIS = ["subject_id", "kind", "window_start", "window_end", "model", "prompt_version", "input_hash"]


def save_explanations(current: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new syntheses, their citations with ordinals from 0): what was explained with the same input already is left out with all its citations.

    made: the columns of SYNTHESIS, body, cited (array of event ids, in order) and pos.
    """
    fresh = _last(made.join(current.select(*SYNTHESIS), SYNTHESIS, "left_anti"), SYNTHESIS, first=["body", "cited"])
    cited = fresh.select(*SYNTHESIS, F.posexplode("cited").alias("ordinal", "event_id"))
    return fresh.drop("cited"), cited.groupBy(*SYNTHESIS, "event_id").agg(F.min("ordinal").alias("ordinal"))


def log_rows(rows: DataFrame, texts: list[str]) -> DataFrame:
    """Rows as a log keeps them: texts trimmed and cut at 200 characters, durations not below 0."""
    out = rows.withColumns({c: F.substring(F.trim(c), 1, 200) for c in texts})
    return out.withColumn("duration_ms", F.greatest(F.lit(0), F.floor(F.col("duration_ms") + 0.5))) if "duration_ms" in rows.columns else out
