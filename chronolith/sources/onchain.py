"""Parsers of landed chain payloads: halvings, supply moves, governance, incidents, audits of reference data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators.dedupe import first_per

NULL_ADDRESS = "0x" + "0" * 40
MATERIAL_USD, CHAIN_FLOOR_USD, CREDIBLE_USD = 10e6, 100e6, 10e9


def halvings(blocks: DataFrame, now: int, epochs: int = 6) -> DataFrame:
    """(epoch, height, day, reward) of mined halvings: none after the first height whose block (height, time, hash) is missing; final blocks only."""
    spark = blocks.sparkSession
    wanted = spark.range(1, epochs + 1).select(F.col("id").alias("epoch"), numbers.halving_height(F.col("id")).alias("height"))
    found = wanted.join(blocks, "height", "left")
    gap = found.agg(F.min(F.when(F.col("time").isNull(), F.col("epoch"))).alias("gap"))
    kept = found.join(F.broadcast(gap)).filter("time is not null and (gap is null or epoch < gap)")  # one row
    return kept.filter(numbers.final(F.lit("bitcoin"), F.col("time"), F.lit(now))).select("epoch", "height", numbers.day_of_epoch(F.col("time")).alias("day"), numbers.reward_after(F.col("epoch")).alias("reward"), "hash")


def milestones(known: DataFrame, blocks: DataFrame) -> DataFrame:
    """Published milestones (name, height, day) dated by the chain where its block is there; the source says which."""
    both = known.join(blocks.select("height", "time"), "height", "left")
    return both.select("name", "height", F.coalesce(numbers.day_of_epoch(F.col("time")), "day").alias("day"), F.when(F.col("time").isNotNull(), "chain").otherwise("published").alias("source"))


def supply_moves(transfers: DataFrame, now: int, most: int = 40) -> DataFrame:
    """Mints and burns of tokens (token, decimals, minimum, status, pos, hash, from, to, value, time): of status 1, large and final; the ``most`` newest of each token, by date."""
    amount = numbers.units(F.col("value"), F.col("decimals"))
    minted, burned = F.lower("from") == NULL_ADDRESS, F.lower("to") == NULL_ADDRESS
    kept = transfers.filter("status = '1'").withColumn("amount", amount).filter((F.col("amount") >= F.col("minimum")) & (minted | burned) & numbers.final(F.lit("ethereum"), F.col("time"), F.lit(now)))
    moves = kept.select("token", "pos", "hash", numbers.day_of_epoch(F.col("time")).alias("day"), "amount", F.when(minted, "minted").otherwise("burned").alias("direction"), F.when(minted, F.col("to")).otherwise(F.col("from")).alias("counterparty"))
    titled = first_per(moves, ["token"], ["pos"], most)
    return titled.withColumn("title", F.concat_ws(" ", numbers.money_short(F.col("amount")), "token", "direction"))


def log_moves(logs: DataFrame, minimum: float, decimals: int = 6, most: int = 40) -> DataFrame:
    """Issues and redemptions from logs (topic_order, pos, hash, data, time): topics one after the other share the cap."""
    rows = logs.withColumn("amount", numbers.hex_units(F.col("data"), decimals)).filter(F.col("amount") >= minimum)
    return rows.orderBy("topic_order", "pos").limit(most)


def label_addresses(rows: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """A known label, else unidentified for an address, else unknown. known: (address, label), a fixed list."""
    both = rows.withColumn("address", F.lower(column)).join(F.broadcast(known), "address", "left")
    return both.withColumn("label", F.coalesce("label", F.when(numbers.is_address(F.col("address")), "unidentified").otherwise("unknown"))).drop("address")


def governance(proposals: DataFrame) -> DataFrame:
    """Closed proposals (space, pos, title, state, choices, scores, end) with a clear tally."""
    tallied = proposals.filter("state = 'closed'").withColumn("v", numbers.vote_outcome(F.col("choices"), F.col("scores"))).filter("v is not null")
    return tallied.select("space", "pos", "title", "v.choice", "v.outcome", numbers.day_of_epoch(F.col("end")).alias("day"))


def exploits(incidents: DataFrame, targets: DataFrame) -> DataFrame:
    """Incidents (name, date, amount, chains) of the subjects they concern: those a protocol's name is a word of, or of a chain from CHAIN_FLOOR_USD on. Anything undated, unnamed or beyond belief is left out. targets: (slug, match: protocol or chain, name), a fixed list."""
    sound = incidents.filter((F.col("date") > 0) & (F.trim("name") != "") & F.col("amount").between(MATERIAL_USD, CREDIBLE_USD))
    words = F.array_distinct(F.split(F.lower("name"), r"[^a-z0-9_]+"))
    named = sound.withColumn("key", F.explode(words)).join(F.broadcast(targets.filter("match = 'protocol'").select("slug", F.lower("name").alias("target"), F.split(F.lower("name"), " ")[0].alias("key"))), "key")
    named = named.filter(F.expr("rlike(lower(name), concat('\\\\b', target, '\\\\b'))")).select("slug", *incidents.columns)
    on_chain = sound.filter(F.col("amount") >= CHAIN_FLOOR_USD).withColumn("key", F.explode(F.transform("chains", F.lower))).join(F.broadcast(targets.filter("match = 'chain'").select("slug", F.lower("name").alias("key"))), "key").select("slug", *incidents.columns)
    every = named.union(on_chain).dropDuplicates(["slug", "name", "date"])
    return every.withColumn("day", numbers.day_of_epoch(F.col("date"))).withColumn("title", F.concat(F.trim("name"), F.lit(" exploited — "), numbers.money_short(F.col("amount"))))


def repair_amounts(stored: DataFrame, cited: DataFrame) -> DataFrame:
    """What to do with stored incidents (event_id, title) whose stated amount is beyond belief: delete, or if cited, a title with the amount in its true unit."""
    usd = numbers.implied_usd(F.col("title"))
    suspect = stored.withColumn("usd", usd).filter(F.col("usd") > CREDIBLE_USD).join(cited.select("event_id", F.lit(True).alias("is_cited")).distinct(), "event_id", "left")
    fixed = F.concat(F.regexp_extract("title", r"^(.*?)\$", 1), numbers.money_repair(F.col("usd") / 1e6))
    return suspect.select("event_id", F.when(F.col("is_cited"), "correct").otherwise("delete").alias("action"), F.when(F.col("is_cited"), fixed).alias("title"))


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Reference data (key, symbol, decimals) against what the chain says: ok, differs or unknown."""
    both = expected.join(actual.toDF("key", "actual_symbol", "actual_decimals"), "key", "left")
    same = (F.col("symbol") == F.col("actual_symbol")) & (F.col("decimals") == F.col("actual_decimals"))
    return both.select("key", F.when(same.isNull(), "unknown").when(same, "ok").otherwise("differs").alias("status"))
