"""Keyed state of streams: who may fetch what, and when again.

State lives in Spark's store for each key, so it is partitioned, checkpointed and
restored with the stream. With ``forget`` a key's state expires so many seconds after it
was last written; a key that comes back then is a new one, so ``forget`` should be longer
than any window, cooldown or wait (``model.RETENTION_DAYS`` is). Rows of one key are taken in the order of their time; a batch
that runs again finds the state it began with. The session needs ``STORE``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import model

#: The store that keyed state needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_MINUTE = 60.0


def _seconds(rows: Iterator[Row]) -> list[tuple[float, str, Row]]:
    """(seconds since the epoch, what, row) in the order of time."""
    return sorted(((r.at.timestamp(), r.what, r) for r in rows), key=lambda x: x[:2])


class _Keyed(StatefulProcessor):
    """One value for each key."""

    schema = ""
    forget: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.schema, self.forget * 1000 if self.forget else None)

    def close(self) -> None:
        pass

    def read(self, empty: tuple) -> tuple:
        return tuple(self.held.get()) if self.held.exists() else empty


class Claims(_Keyed):
    """(slug, at, what: ask, failure or success) to (slug, at, claimed), a row for each ask.

    An ask claims a subject that was never tried, or whose last try is ``cooldown``
    minutes ago and that is not dead; a failure makes it dead for 30, 120, 480 and then
    10080 minutes; a success forgets the failures.
    """

    schema = "attempted_at double, failures int, dead_until double"

    def __init__(self, cooldown: int = model.CLAIM_COOLDOWN_MINUTES, forget: int | None = None):
        self.cooldown, self.forget = cooldown, forget

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        tried, failures, dead = self.read((None, 0, None))
        for at, what, r in _seconds(rows):
            if what == "ask":
                ready = tried is None or (tried <= at - self.cooldown * _MINUTE and (dead is None or dead <= at))
                tried = at if ready else tried
                yield Row(slug=key[0], at=r.at, claimed=ready)
            elif what == "failure":
                failures += 1
                tried, dead = at, at + model.BACKOFF_MINUTES[min(failures, len(model.BACKOFF_MINUTES)) - 1] * _MINUTE
            else:
                failures, dead = 0, None
        self.held.update((tried, failures, dead))


class Freshness(_Keyed):
    """(source, subject, at, what: ask or an outcome) to (source, subject, at, fetch), a row for each ask.

    A source is asked again once its last good answer is as old as the source's window,
    unless its last answer of any kind was throttled or an error within ``back_off`` minutes.
    """

    schema = "good_at double, last_at double, last string"

    def __init__(self, back_off: int = 60, forget: int | None = None):
        self.back_off, self.forget = back_off, forget

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        good, last_at, last = self.read((None, None, None))
        window = model.RECHECK_MINUTES.get(key[0], model.RECHECK_DEFAULT) * _MINUTE
        for at, what, r in _seconds(rows):
            if what == "ask":
                backs_off = last in ("throttled", "error") and last_at > at - self.back_off * _MINUTE
                yield Row(source=key[0], subject=key[1], at=r.at, fetch=not backs_off and (good is None or good > at or at - good >= window))
            else:
                last_at, last = at, what
                good = at if what in ("ok", "empty") else good
        self.held.update((good, last_at, last))


def claims(stream: DataFrame, cooldown: int = model.CLAIM_COOLDOWN_MINUTES, forget: int | None = None) -> DataFrame:
    return stream.groupBy("slug").transformWithState(Claims(cooldown, forget), "slug string, at timestamp, claimed boolean", "Append", "ProcessingTime" if forget else "None")


def freshness(stream: DataFrame, back_off: int = 60, forget: int | None = None) -> DataFrame:
    return stream.groupBy("source", "subject").transformWithState(Freshness(back_off, forget), "source string, subject string, at timestamp, fetch boolean", "Append", "ProcessingTime" if forget else "None")
