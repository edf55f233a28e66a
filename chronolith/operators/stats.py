"""Robust statistics and weekly signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model


def week_of(day: Column) -> Column:
    """The Monday of a day's week."""
    return F.to_date(F.date_trunc("week", day))


def gate(relevance: Column) -> Column:
    """What the timeline shows: unscored rows, and those from the threshold on."""
    return relevance.isNull() | (relevance >= model.RELEVANCE_THRESHOLD)


def robust(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, base, spread): the median, and the median of the distances from it; 0 where there is nothing."""
    base = df.groupBy(*keys).agg(F.coalesce(F.median(value), F.lit(0.0)).alias("base"))
    both = df.join(base, list(keys)) if keys else df.crossJoin(F.broadcast(base))  # one row
    return both.groupBy(*keys, "base").agg(F.coalesce(F.median(F.abs(F.col(value) - F.col("base"))), F.lit(0.0)).alias("spread"))


def is_spike(n: Column, base: Column, spread: Column, floor: Column, sigma: float) -> Column:
    return (n >= floor) & F.when(spread > 0, n >= base + sigma * spread).otherwise(n >= base + sigma + 1)


def _keys(scope: str | None) -> list[str]:
    return [scope] if scope else []


def period_counts(events: DataFrame, period: Column, most_ids: int | None = None, scope: str | None = None) -> DataFrame:
    """(scope if given, period, kind, n, ids) of gated events (event_id, kind, day, relevance): distinct events, without periods of none."""
    distinct = events.filter(gate(F.col("relevance"))).select(*_keys(scope), period.alias("period"), "kind", "event_id").distinct()
    return _with_ids(distinct, [*_keys(scope), "period", "kind"], most_ids, F.count("*").alias("n"))


def _with_ids(rows: DataFrame, keys: list[str], most_ids: int | None, *sums: Column) -> DataFrame:
    """(keys, sums, ids): the event_ids of each group in ascending order, the first ``most_ids``. Rows are numbered first, so no more are gathered."""
    listed = F.col("event_id")
    if most_ids:
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("event_id")))
        listed = F.when(F.col("r") <= most_ids, F.col("event_id"))
    return rows.groupBy(*keys).agg(*sums, F.array_sort(F.collect_list(listed)).alias("ids"))


def spikes(counts: DataFrame, floor: int = model.SIGNAL_FLOOR, sigma: float = model.SIGNAL_SIGMA, scope: str | None = None) -> DataFrame:
    """Periods of unusual volume, by kind. The number of periods and kinds, not of events, bounds what is joined."""
    stats = robust(counts, "n", *_keys(scope), "kind")
    low = F.when(F.col("kind") == "regulation", F.greatest(F.lit(2), F.lit(floor - 1))).otherwise(floor)
    hit = counts.join(stats, [*_keys(scope), "kind"]).filter(is_spike(F.col("n"), F.col("base"), F.col("spread"), low, sigma))
    magnitude = F.when(F.col("spread") > 0, F.round((F.col("n") - F.col("base")) / F.col("spread"), 1)).otherwise(F.col("n") - F.col("base"))
    return hit.withColumn("signal", F.when(F.col("kind") == "regulation", "regulatory_burst").otherwise("volume_spike")).withColumn("magnitude", magnitude)


def cross_peer(events: DataFrame, members: DataFrame, scope: str | None = None, most_ids: int | None = None) -> DataFrame:
    """(scope if given, week, shared, widest, ids): events of more than one member of a scope in a week, and the first ``most_ids`` of them. Not gated, unlike the counts."""
    peers = events.join(members.select("subject_id", *_keys(scope)), "subject_id").groupBy(*_keys(scope), "event_id", "day").agg(F.count_distinct("subject_id").alias("peers")).filter("peers > 1")
    return _with_ids(peers.withColumn("week", week_of(F.col("day"))), [*_keys(scope), "week"], most_ids, F.count("*").alias("shared"), F.max("peers").alias("widest"))


def first_last(prices: DataFrame) -> DataFrame:
    """(subject_id, first_close, last_close, d0, d1, pct) over (subject_id, day, close)."""
    ends = prices.groupBy("subject_id").agg(F.min_by("close", "day").alias("first_close"), F.max_by("close", "day").alias("last_close"), F.min("day").alias("d0"), F.max("day").alias("d1"))
    return ends.filter("first_close > 0").withColumn("pct", F.round((F.col("last_close") - F.col("first_close")) / F.col("first_close") * 100, 1))


def divergence(returns: DataFrame, scope: str, points: float = model.DIVERGENCE_POINTS) -> DataFrame:
    """Of each scope of three members or more, the one furthest from the median return, if far enough."""
    whole = returns.groupBy(scope).agg(F.median("pct").alias("sector"), F.count("*").alias("members")).filter("members >= 3")
    far = Window.partitionBy(scope).orderBy(F.abs(F.col("pct") - F.col("sector")).desc(), "subject_id")
    worst = returns.join(whole, scope).withColumn("r", F.row_number().over(far)).filter("r = 1").drop("r")
    return worst.withColumn("gap", F.round(F.col("pct") - F.col("sector"), 1)).filter(F.abs("gap") >= points)


def signals(events: DataFrame, prices: DataFrame, members: DataFrame, floor: int = model.SIGNAL_FLOOR, sigma: float = model.SIGNAL_SIGMA, points: float = model.DIVERGENCE_POINTS, scope: str | None = None) -> DataFrame:
    """All signals of one scope: (signal, kind, window_start, window_end, magnitude, event_ids), the newest and strongest first.

    events: (event_id, subject_id, kind, day, relevance); prices: (subject_id, day, close); members: (subject_id).
    With ``scope``, a column of members, one set of signals for each of its values, led by it, over its members' events.
    """
    keys, by = _keys(scope), scope or "scope"
    peers = members.select("subject_id", *keys)
    scoped = events.join(peers, "subject_id") if scope else events
    bursts = spikes(period_counts(scoped, week_of(F.col("day")), 40, scope), floor, sigma, scope)
    one = bursts.select(*keys, "signal", "kind", F.col("period").alias("window_start"), F.date_add("period", 6).alias("window_end"), F.col("magnitude").cast("double").alias("magnitude"), F.col("ids").alias("event_ids"))
    two = cross_peer(events, members, scope, 40).select(*keys, F.lit("cross_peer_cluster").alias("signal"), F.lit(None).cast("string").alias("kind"), F.col("week").alias("window_start"), F.date_add("week", 6).alias("window_end"), F.col("widest").cast("double").alias("magnitude"), F.col("ids").alias("event_ids"))
    returns = first_last(prices.join(peers, "subject_id", "left_semi"))
    worst = divergence(returns.join(peers, "subject_id") if scope else returns.withColumn(by, F.lit(1)), by, points)
    cited = events.filter(gate(F.col("relevance")) & F.col("kind").isin("earnings", "filing", "news")).join(worst.select(by, "subject_id"), "subject_id")  # one row of each scope
    newest = cited.withColumn("r", F.row_number().over(Window.partitionBy(by, "subject_id").orderBy(F.col("day").desc(), "event_id"))).filter("r <= 25")
    newest = newest.groupBy(by, "subject_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_date("day")).alias("d"), "event_id"))), lambda x: x["event_id"]).alias("event_ids"))
    three = worst.join(newest, [by, "subject_id"], "left").select(*keys, F.lit("price_divergence").alias("signal"), F.lit(None).cast("string").alias("kind"), F.col("d0").alias("window_start"), F.col("d1").alias("window_end"), F.col("gap").cast("double").alias("magnitude"), F.coalesce("event_ids", F.array().cast("array<long>")).alias("event_ids"))
    return one.union(two).union(three).orderBy(*keys, F.col("window_start").desc(), F.abs("magnitude").desc())
