"""Weekly spikes of a stream of events, by the same rule as the batch form.

Events are counted by week and key in the usual windowed aggregation, which sums up
before its shuffle; a week's count goes on once the watermark closes the week. Behind it
each key keeps its closed weeks in two ordered halves of their counts: their inner ends
give the median, and the distances from it grow outwards in both, so the median distance
is found between the halves by bisection. A closed week moves the base of all weeks of its
key, so what comes out is a log of changes: the last row of each (key, week) stands, and
says whether the week is a spike now.

Events that come after the watermark has closed their week are left out, as a week that
was passed on is never opened again; how late an event may be is a parameter. The session
needs ``ledger.STORE``.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import model

WEEK = "7 days"
#: Windows begin at the epoch, a Thursday; weeks on Monday.
MONDAY = "4 days"
CHANGES = "kind string, week date, n long, base double, spread double, magnitude double, spike boolean, version long"


class Halves:
    """A multiset of numbers as two ordered halves; the lower is as long as the upper, or longer by one."""

    def __init__(self, low: list[int] | None = None, high: list[int] | None = None):
        self.low, self.high = list(low or ()), list(high or ())

    def add(self, x: int) -> None:
        insort(self.low if not self.high or x < self.high[0] else self.high, x)
        if len(self.low) > len(self.high) + 1:
            self.high.insert(0, self.low.pop())
        elif len(self.high) > len(self.low):
            self.low.append(self.high.pop(0))

    def median(self) -> float:
        if not self.low:
            return 0.0
        return float(self.low[-1]) if len(self.low) > len(self.high) else (self.low[-1] + self.high[0]) / 2

    def _nearest(self, k: int, m: float) -> float:
        """The k-th least distance from ``m``, from 0 on: i of the lower half and k + 1 - i of the upper are as near."""
        low, high = self.low, self.high
        a, b = max(0, k + 1 - len(high)), min(k + 1, len(low))
        while a < b:
            i = (a + b) // 2
            # one more of the lower half, or not: whether it is nearer than what the upper half would give
            if m - low[len(low) - 1 - i] < high[k - i] - m:
                a = i + 1
            else:
                b = i
        return max(m - low[len(low) - a] if a else 0.0, high[k - a] - m if a <= k else 0.0)

    def spread(self) -> float:
        """The median distance from the median."""
        n, m = len(self.low) + len(self.high), self.median()
        if not n:
            return 0.0
        upper = self._nearest(n // 2, m)
        return upper if n % 2 else (self._nearest(n // 2 - 1, m) + upper) / 2


def judged(kind: str, n: int, base: float, spread: float, floor: int, sigma: float) -> tuple[bool, float]:
    """(spike, magnitude) of a week."""
    least = max(2, floor - 1) if kind == "regulation" else floor
    spike = n >= least and (n >= base + sigma * spread if spread > 0 else n >= base + sigma + 1)
    return spike, float((n - base) / spread if spread > 0 else n - base)


class WeeklySpikes(StatefulProcessor):
    """Closed weeks (kind, week, n) to changes of what is a spike."""

    def __init__(self, floor: int = model.SIGNAL_FLOOR, sigma: float = model.SIGNAL_SIGMA):
        self.floor, self.sigma = floor, sigma

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.halves = handle.getValueState("halves", "low array<long>, high array<long>, version long")
        self.weeks = handle.getMapState("weeks", "week date", "n long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        kind = key[0]
        held = self.halves.get() if self.halves.exists() else (None, None, 0)
        halves, version = Halves(held[0], held[1]), held[2] + 1
        before = halves.median(), halves.spread()
        known = {w[0]: n[0] for w, n in self.weeks.iterator()}
        new = {r.week: r.n for r in rows}
        for week, n in new.items():
            halves.add(n)
            self.weeks.updateValue((week,), (n,))
        self.halves.update((halves.low, halves.high, version))
        base, spread = halves.median(), halves.spread()
        for week, n in sorted((known | new).items()):
            now = judged(kind, n, base, spread, self.floor, self.sigma)
            was = week in known and judged(kind, n, *before, self.floor, self.sigma)[0]
            if (now[0] or was) and (week not in known or not was or not now[0] or before != (base, spread)):
                yield Row(kind=kind, week=week, n=n, base=base, spread=spread, magnitude=now[1], spike=now[0], version=version)


def weekly_spikes(events: DataFrame, late: str = "7 days", floor: int = model.SIGNAL_FLOOR, sigma: float = model.SIGNAL_SIGMA) -> DataFrame:
    """A stream of events (kind, ts) to a log of changes: ``CHANGES``, of which ``standing`` keeps the last."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", WEEK, WEEK, MONDAY), "kind").agg(F.count("*").alias("n"))
    weeks = counts.select("kind", F.to_date("window.start").alias("week"), "n")
    return weeks.groupBy("kind").transformWithState(WeeklySpikes(floor, sigma), CHANGES, "Append", "None")


def standing(changes: DataFrame) -> DataFrame:
    """(signal, kind, week, n, base, spread, magnitude) of the weeks that are spikes after all changes."""
    newest = Window.partitionBy("kind", "week").orderBy(F.desc("version"))
    last = changes.withColumn("r", F.row_number().over(newest)).filter("r = 1 and spike")
    return last.select(F.when(F.col("kind") == "regulation", "regulatory_burst").otherwise("volume_spike").alias("signal"), "kind", "week", "n", "base", "spread", F.when(F.col("spread") > 0, F.round("magnitude", 1)).otherwise(F.col("magnitude")).alias("magnitude"))
