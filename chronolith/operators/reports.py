"""Reports over logs, searches, costs and quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import text


def summarise(log: DataFrame) -> DataFrame:
    """(rung, searches, share, landed, unknown) for each rung, and for all as rung null: landed is over searches of known outcome. log: rung, has_events."""
    counts = [F.count("*").alias("searches"), F.count("has_events").alias("known"), F.count_if("has_events").alias("hits")]
    whole = log.agg(*counts)
    both = log.groupBy("rung").agg(*counts).union(whole.select(F.lit(None).cast("string"), "*"))
    total = whole.select(F.col("searches").alias("total"))
    rate = F.coalesce(F.col("hits") / F.nullif(F.col("known"), F.lit(0)), F.lit(0.0))
    return both.join(F.broadcast(total)).select("rung", "searches", F.coalesce(F.col("searches") / F.nullif("total", F.lit(0)), F.lit(0.0)).alias("share"), rate.alias("landed"), (F.col("searches") - F.col("known")).alias("unknown"))  # one row


def rewritten(log: DataFrame) -> DataFrame:
    """The share of searches whose subject is not the query."""
    differs = text.normalise_query(F.col("query")) != text.normalise_query(F.col("subject"))
    return log.agg(F.coalesce(F.avg(differs.cast("double")), F.lit(0.0)).alias("rewritten"))


def top_queries(log: DataFrame, most: int = 20) -> DataFrame:
    """Queries by how often they were asked, with their rungs in the order first seen. log: pos, query, rung."""
    keyed = log.select("pos", "rung", text.normalise_query(F.col("query")).alias("query")).filter("query <> ''")
    by_rung = keyed.groupBy("query", "rung").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    top = by_rung.groupBy("query").agg(F.sum("n").alias("asked"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "rung"))), lambda x: x["rung"]).alias("rungs"))
    return top.orderBy(F.col("asked").desc(), "query").limit(most)


def nearest_rank(values: DataFrame, value: str, *keys: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Percentiles by the nearest rank; 0 for no values."""
    return values.groupBy(*keys).agg(*(F.coalesce(F.expr(f"percentile_disc({p}) within group (order by {value})"), F.lit(0)).alias(f"p{round(p * 100)}") for p in shares))


def outcomes(fetches: DataFrame, source: str = "source_id") -> DataFrame:
    return fetches.groupBy(source).agg(F.count("*").alias("fetches"), *(F.count_if(F.col("outcome") == o).alias(o) for o in model.OUTCOMES[:1] + model.OUTCOMES[2:]))


def spend(enrichments: DataFrame) -> DataFrame:
    return enrichments.groupBy("model").agg(F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"), F.count_if(F.col("input_tokens").isNull()).alias("unknown"), F.count("*").alias("calls"))


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of usage (model, input_tokens, output_tokens) at prices a million tokens; an unknown model costs the most."""
    most = prices.agg(F.max("input_price").alias("most_in"), F.max("output_price").alias("most_out"))
    both = usage.join(F.broadcast(prices), "model", "left").join(F.broadcast(most))  # a row for each model
    return both.select("model", ((F.col("input_tokens") * F.coalesce("input_price", "most_in") + F.col("output_tokens") * F.coalesce("output_price", "most_out")) / 1e6).alias("usd"))


def demand(requests: DataFrame) -> DataFrame:
    open_ = F.col("fulfilled_at").isNull()
    return requests.agg(F.count("*").alias("subjects"), F.count_if(open_).alias("pending"), F.count_if(~open_).alias("fulfilled"), F.count_if(open_ & F.col("last_error").isNotNull()).alias("failed"), F.sum("requests").alias("requests"))


def stale(pairs: DataFrame, now) -> DataFrame:
    """Sources due to be asked again: never asked, asked in the future, or longer ago than their interval. pairs: source, last_at."""
    every = F.create_map(*(F.lit(x) for pair in model.RECHECK_MINUTES.items() for x in pair))
    minutes = F.coalesce(every[F.col("source")], F.lit(model.RECHECK_DEFAULT))
    age = F.timestamp_diff("MINUTE", F.col("last_at"), F.lit(now))
    return pairs.filter(F.col("last_at").isNull() | (F.col("last_at") > F.lit(now)) | (age >= minutes))


def backing_off(log: DataFrame, now, minutes: int) -> DataFrame:
    """(key, backs_off): the last attempt within so many minutes was throttled or failed. log: source, subject, fetched_at, fetch_id, outcome."""
    recent = log.filter(F.col("fetched_at") > F.lit(now) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))
    last = recent.groupBy("source", "subject").agg(F.max_by("outcome", F.struct("fetched_at", "fetch_id")).alias("outcome"))
    return last.select("source", "subject", F.col("outcome").isin("throttled", "error").alias("backs_off"))


def licensed(rows: DataFrame, registry: DataFrame, commercial: bool = True) -> DataFrame:
    """Rows of sources that may be used; a source that the registry lacks is an error."""
    both = rows.join(F.broadcast(registry.select("source", "commercial_ok")), "source", "left")  # the registry is fixed
    checked = both.withColumn("commercial_ok", F.when(F.col("commercial_ok").isNull(), F.raise_error(F.concat(F.lit("unknown source: "), F.col("source")))).otherwise(F.col("commercial_ok")))
    return checked.filter(F.col("commercial_ok") | F.lit(not commercial)).drop("commercial_ok")


def valid_plans(plans: DataFrame, history: DataFrame, sources: list[str], most: int = 6) -> DataFrame:
    """Search plans (plan_id, pos, source, query) that may run: known sources, 3 to 60 characters, no address or markup, none asked before, the first of repeats, ``most`` a plan."""
    from .dedupe import first_per

    key = F.lower(F.trim("query"))
    good = plans.withColumn("key", key).filter(F.col("source").isin(sources) & F.length(F.trim("query")).between(3, 60) & ~F.col("query").rlike(r"(?i)https?:|www\.|[<>{}\[\]\\|]"))
    fresh = good.join(history.select("source", F.lower(F.trim("query")).alias("key")), ["source", "key"], "left_anti")
    return first_per(first_per(fresh, ["plan_id", "source", "key"], ["pos"]), ["plan_id"], ["pos"], most).drop("key")
