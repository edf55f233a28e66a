"""The demand queue as keyed state: how often each slug was asked for, what is open, and which are the first to do.

Requests and marks of one micro-batch are summed up in each task before the shuffle, so a
slug that a third of all requests ask for reaches its state as a few rows. State is keyed
by shards of slugs. A shard holds its open requests in one map and the fulfilled ones in
another, whose entries expire; after each batch that touches it, a shard gives its first
``most`` open requests under a new version, and ``pending`` takes the newest version of
each shard and the first ``most`` of all. So what comes out, and what a task holds beside
the state store, is bounded by ``most``.

A request is open if it was asked for after it was last fulfilled, whatever the order of
arrival. A fulfilled request keeps its count until ``forget`` seconds after it was last
touched; state that expires needs processing time, whose batches go on without new data,
so such a stream runs by interval or once, not until nothing is left. The session needs
``ledger.STORE``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SHARDS, MOST = 64, 25
# Times are microseconds since the epoch on the way.
HELD = "kind string, ticker string, requests long, first_asked long, last_asked long, fulfilled_at long"
FOLDED = f"slug string, {HELD}"
QUEUE = "shard int, version long, place int, slug string, kind string, ticker string, requests long, first_asked long, last_asked long"


def folded(asks: DataFrame) -> DataFrame:
    """Rows (slug, kind, ticker, at, what: ask or fulfilled) summed up by slug in each task; the state sums up the rest."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        for rows in batches:
            if not len(rows):
                continue
            ask = rows["what"] == "ask"
            by = rows.sort_values("at", kind="stable").assign(requests=ask.astype("int64"), asked=rows["at"].astype("Int64").where(ask), fulfilled_at=rows["at"].astype("Int64").where(~ask)).groupby("slug", sort=False)
            out = by.agg(kind=("kind", "first"), ticker=("ticker", "last"), requests=("requests", "sum"), first_asked=("asked", "min"), last_asked=("asked", "max"), fulfilled_at=("fulfilled_at", "max")).reset_index()
            yield out.astype(object).where(pd.notna(out), None)

    return asks.select("slug", "kind", "ticker", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "what").mapInPandas(run, FOLDED)


def _joined(a: tuple | None, r: Row) -> tuple:
    """One slug's state with what came."""
    if a is None:
        return r.kind, r.ticker, r.requests, r.first_asked, r.last_asked, r.fulfilled_at
    known = lambda x, y, pick: pick(x, y) if x is not None and y is not None else x if y is None else y
    return a[0] if a[0] is not None else r.kind, r.ticker if r.ticker is not None else a[1], a[2] + r.requests, known(a[3], r.first_asked, min), known(a[4], r.last_asked, max), known(a[5], r.fulfilled_at, max)


class Demand(StatefulProcessor):
    """Summed requests of one shard to its first open ones."""

    def __init__(self, most: int = MOST, forget: int | None = None):
        self.most, self.forget = most, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "slug string", HELD)
        self.done = handle.getMapState("done", "slug string", HELD, self.forget * 1000 if self.forget else None)
        self.version = handle.getValueState("version", "n long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        for r in rows:
            slug = (r.slug,)
            held = next((tuple(m.getValue(slug)) for m in (self.open, self.done) if m.containsKey(slug)), None)
            now = _joined(held, r)
            is_open = now[4] is not None and (now[5] is None or now[4] > now[5])
            here, there = (self.open, self.done) if is_open else (self.done, self.open)
            here.updateValue(slug, now)
            if there.containsKey(slug):
                there.removeKey(slug)
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        first = heapq.nsmallest(self.most, ((-v[2], -v[4], s[0], tuple(v)) for s, v in self.open.iterator()))
        for place, (_, _, slug, v) in enumerate(first):
            yield Row(shard=key[0], version=version, place=place, slug=slug, kind=v[0], ticker=v[1], requests=v[2], first_asked=v[3], last_asked=v[4])
        if not first:  # a row without a slug: the shard has nothing open
            yield Row(shard=key[0], version=version, place=0, slug=None, kind=None, ticker=None, requests=None, first_asked=None, last_asked=None)


def shard_of(slug: str = "slug", shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(slug), F.lit(shards)).cast("int")


def queue(asks: DataFrame, most: int = MOST, shards: int = SHARDS, forget: int | None = None) -> DataFrame:
    """A stream of requests and marks to the first open ones of each shard: (shard, version, place, slug, kind, ticker, requests, first_asked, last_asked)."""
    rows = folded(asks).withColumn("shard", shard_of("slug", shards))
    first = rows.groupBy("shard").transformWithState(Demand(most, forget), QUEUE, "Append", "ProcessingTime" if forget else "None")
    return first.withColumns({c: F.timestamp_micros(c) for c in ("first_asked", "last_asked")})


def pending(changes: DataFrame, most: int = MOST) -> DataFrame:
    """The first open requests after all changes of a queue."""
    newest = changes.groupBy("shard").agg(F.max("version").alias("version"))  # as many rows as shards
    return changes.join(F.broadcast(newest), ["shard", "version"]).filter("slug is not null").orderBy(F.desc("requests"), F.desc("last_asked"), "slug").limit(most).drop("shard", "version", "place")
