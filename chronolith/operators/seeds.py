"""Demonstration series: draws that any partition can start anywhere in, and walks with a floor, both without a loop.

The generator keeps a counter as its state, so its n-th draw is an expression of the seed
and n. A walk multiplies by 1 + drift and never falls below a floor; such a step is
x -> max(floor, m * x), and steps of that form compose to one of that form, so the value
after k steps is an expression of two running aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The mulberry32 generator's step, and the walk's centre, width, floor and volumes.
STEP = 0x6D2B79F5
CENTRE, WIDTH, FLOOR = 0.49, 0.022, 1.0
INTENSITY, VOLUME_LEAST, VOLUME_MORE = 18, 0.75, 0.5
_MASK = 0xFFFFFFFF


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product, by halves, so that 64 bits hold each step."""
    high = (a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF))
    return (a * b.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft(high, 16)).bitwiseAND(F.lit(_MASK))


def draw(seed: Column, n: Column) -> Column:
    """The n-th draw, from 1 on, of a seed: 0 to below 1. n below 2^31."""
    def first(a: Column) -> Column:
        return _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))

    def second(t: Column) -> Column:
        return (t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_MASK)).bitwiseXOR(t)

    let = lambda x, f: F.get(F.transform(F.array(x), f), 0)  # noqa: E731  names a value, so that it is computed once
    state = (seed.cast("long") + n.cast("long") * F.lit(STEP)).bitwiseAND(F.lit(_MASK))
    return let(let(let(state, first), second), lambda t: t.bitwiseXOR(F.shiftright(t, 14))) / 4294967296.0


def trading_days(rows: DataFrame, first: str, last: str) -> DataFrame:
    """``rows`` with each day from first to last; without Saturdays and Sundays unless ``every_day``."""
    days = rows.withColumn("day", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))))
    return days.filter(F.col("every_day") | ~F.dayofweek("day").isin(1, 7))


def walks(days: DataFrame, planted: DataFrame) -> DataFrame:
    """(subject_id, day, close, volume) of walks over days (subject_id, day, seed, start, base_volume); planted: subject_id, day, shock.

    Each day draws for its drift unless a shock is planted, and for its volume, which
    grows with the move. A series is one sort by subject.
    """
    w = Window.partitionBy("subject_id").orderBy("day")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = days.join(planted, ["subject_id", "day"], "left")
    drawn = moved.withColumn("used", F.sum(F.when(F.col("shock").isNull(), 2).otherwise(1)).over(so_far))
    drift = F.coalesce("shock", (draw(F.col("seed"), F.col("used") - 1) - CENTRE) * WIDTH)
    stepped = drawn.withColumn("drift", drift).withColumn("grown", F.sum(F.log(1 + F.col("drift"))).over(so_far))
    # after k steps: the larger of start and of what each time at the floor is worth at the start, grown by all k
    lifted = stepped.withColumn("from", F.greatest(F.log("start"), F.max(F.log(F.lit(FLOOR)) - F.col("grown")).over(so_far)))
    volume = F.col("base_volume") * (1 + F.abs("drift") * INTENSITY) * (VOLUME_LEAST + draw(F.col("seed"), F.col("used")) * VOLUME_MORE)
    return lifted.select("subject_id", "day", F.round(F.exp(F.col("grown") + F.col("from")), 2).alias("close"), F.floor(volume + 0.5).cast("long").alias("volume"))
