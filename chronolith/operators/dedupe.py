"""Stories, samples and noise control on timelines. ``pos`` is the order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import text


def collapse(events: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """One row for each story of a day, at the place of its first copy: the richest copy, the first of those. Only news collapse.

    events: pos, kind, title, day, description, image_url, url and any others.
    """
    scope = scope or []
    news = events.filter("kind = 'news'").withColumn("story", text.story_key(F.col("title"), F.col("day")))
    full = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), 1).otherwise(0)
    rich = full("description") * 2 + full("image_url") + full("url")
    best = news.groupBy(*scope, "story").agg(F.min("pos").alias("place"), F.min_by(F.struct(*events.columns), F.struct(-rich, F.col("pos"))).alias("e"), F.count("*").alias("copies"))
    rest = events.filter(~F.col("kind").eqNullSafe("news")).select(F.col("pos").alias("place"), F.lit(1).cast("long").alias("copies"), *events.columns)
    return best.select("place", "copies", "e.*").unionByName(rest)


def identity(events: DataFrame) -> Column:
    """What makes two rows the same happening: a sector row's id, a headline's story, else nothing but itself."""
    return F.when(F.col("sector"), F.concat(F.lit("sector-"), F.col("event_id"))).when(F.col("kind").isin(model.HEADLINE_KINDS), text.story_key(F.col("title"), F.col("day"))).otherwise(F.concat(F.lit("unshared:"), F.col("side"), F.lit(":"), F.col("event_id")))


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """The identities (key) that two timelines have in common."""
    keys = lambda df, side: df.withColumn("side", F.lit(side)).select(identity(df).alias("key")).distinct()
    return keys(a, "a").join(keys(b, "b"), "key", "left_semi")


def interleave(a: DataFrame, b: DataFrame, most: int = 60) -> DataFrame:
    """Both timelines, the newest first; what they share is one row, of side both."""
    both = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    keyed = both.withColumn("key", identity(both))
    common = shared(a, b).withColumn("common", F.lit(True))
    tagged = keyed.join(common, "key", "left")
    first = Window.partitionBy("key").orderBy("side", "event_id")
    one = tagged.withColumn("r", F.when(F.col("common"), F.row_number().over(first)).otherwise(1)).filter("r = 1")
    return one.withColumn("side", F.when(F.col("common"), "both").otherwise(F.col("side"))).drop("r", "common").orderBy(F.col("day").desc(), "side", "event_id").limit(most)


def spread(rows: DataFrame, key: list[str], order: list[str], most: int) -> DataFrame:
    """An even sample of each group by its order: the first, the last, and rows at equal steps between."""
    if most <= 0:
        return rows
    sized = rows.withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*key)))
    if most == 1:
        return sized.filter("n <= 1 or i = 0").drop("i", "n")
    at = lambda k: F.floor(k * (F.col("n") - 1) / (most - 1) + 0.5)
    # Row i is taken if at(k) is i for some k: one near i * (most - 1) / (n - 1).
    k = F.floor(F.col("i") * (most - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    taken = [at(k + d) == F.col("i") for d in (-1, 0, 1)]
    valid = [(k + d).between(0, most - 1) for d in (-1, 0, 1)]
    hit = (valid[0] & taken[0]) | (valid[1] & taken[1]) | (valid[2] & taken[2])
    return sized.filter((F.col("n") <= most) | hit).drop("i", "n")


def first_per(rows: DataFrame, key: list[str], order: list[str], most: int = 1) -> DataFrame:
    """The first ``most`` rows of each group."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("r") <= most).drop("r")


def unique_urls(citations: DataFrame, scope: list[str] = ()) -> DataFrame:
    """One citation for each URL (of a scope): the most precise date, then the first."""
    rank = F.when(F.col("precision") == "day", 2).when(F.col("precision") == "month", 1).otherwise(0)
    return first_per(citations.withColumn("rank", -rank), [*scope, "url"], ["rank", "pos"]).drop("rank")


def plausible_press(events: DataFrame, not_before: int, most: int = 25) -> DataFrame:
    return events.filter(F.year("day") >= not_before).orderBy("pos").limit(most)


def prehistory_floor(events: DataFrame, key: str = "subject_id", gap: int = model.PREHISTORY_GAP) -> DataFrame:
    """(key, floor): the year at which a subject's history begins, past leading gaps of over ``gap`` years."""
    years = events.filter(F.col("kind").isin("history", "citation")).select(key, "event_id", F.year("day").alias("y")).filter("y > 0")
    w = Window.partitionBy(key).orderBy("y", "event_id")
    steps = years.withColumn("far", F.col("y") - F.lag("y").over(w) > gap)
    # floors move while every step so far is far
    leading = steps.withColumn("all_far", F.min(F.coalesce("far", F.lit(True))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return leading.filter("all_far").groupBy(key).agg(F.max("y").alias("floor"))


def drop_prehistory(events: DataFrame, key: str = "subject_id", gap: int = model.PREHISTORY_GAP) -> DataFrame:
    floors = prehistory_floor(events, key, gap)
    old = F.col("kind").isin("history", "citation") & (F.year("day") < F.col("floor"))
    return events.join(floors, key, "left").filter(~F.coalesce(old, F.lit(False))).drop("floor")


def focus(events: DataFrame, phrase: str) -> DataFrame:
    """events with score and active: those that concern the phrase, or all if none does. One row is broadcast: whether any does, for which the scan ends at the first."""
    terms = text.focus_terms(F.lit(phrase))
    rest = F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("source", F.lit("")))
    scored = events.withColumn("score", text.focus_score(F.col("title"), rest, terms))
    any_ = scored.filter("score > 0").limit(1).agg((F.count("*") > 0).alias("active"))
    return scored.join(F.broadcast(any_)).filter("score > 0 or not active")


def ranked(focused: DataFrame) -> DataFrame:
    """What a focus matched, the best first: grade, relevance (0.7 where unscored), the newest."""
    return focused.filter("active").orderBy(F.col("score").desc(), F.coalesce("relevance", F.lit(model.UNSCORED_PRIOR)).desc(), F.col("day").desc(), "event_id")
