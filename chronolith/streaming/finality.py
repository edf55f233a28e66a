"""Rows of chains that wait until their block is final.

A row whose block is old enough goes on at once. Any other is kept in state, under the
time at which it will be final, and a timer lets it go on then, so nothing is lost and
nothing goes on early. Rows of a chain are spread over ``spread`` keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import model

SPREAD = 64


class Waiting(StatefulProcessor):
    """Rows (chain, time in seconds, …) to the same rows, once final. Chains without a rule, and times that are 0 or less, are never final and left out, as in the batch form."""

    def __init__(self, schema: str, columns: list[str], wait: dict[str, int] | None = None):
        self.schema, self.columns, self.wait = schema, columns, wait or model.FINALITY_SECONDS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "due long", f"rows array<struct<{self.schema}>>")

    def close(self) -> None:
        pass

    def _row(self, values: Any) -> Row:
        return Row(**dict(zip(self.columns, values, strict=True)))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        now, held = timerValues.getCurrentProcessingTimeInMs(), {}
        for r in rows:
            wait = self.wait.get(r.chain)
            if wait is None or r.time is None or r.time <= 0:
                continue
            values = tuple(r[c] for c in self.columns)
            due = int((r.time + wait) * 1000)
            if due <= now:
                yield self._row(values)
            else:
                held.setdefault(due, []).append(values)
        for due, more in held.items():
            before = [tuple(x) for x in self.rows.getValue((due,))[0]] if self.rows.containsKey((due,)) else []
            self.rows.updateValue((due,), ([*before, *more],))
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.rows.containsKey((due,)):
            rows = [tuple(x) for x in self.rows.getValue((due,))[0]]
            self.rows.removeKey((due,))
            for values in rows:
                yield self._row(values)


def held_back(blocks: DataFrame, key: str, wait: dict[str, int] | None = None, spread: int = SPREAD) -> DataFrame:
    """A stream of rows (chain, time, …) that pass once they are final; ``key``: a column by which a chain's rows are spread."""
    schema = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in blocks.schema)
    processor = Waiting(schema, blocks.columns, wait)
    keyed = blocks.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(spread)))
    return keyed.groupBy("chain", "_part").transformWithState(processor, blocks.schema, "Append", "ProcessingTime")
