"""Landed payloads as data sources: ``spark.read.format("chronolith.filings").load(folder)``, and the same as a stream.

A landing folder holds files of JSON lines, one payload a line, under ``landed=<date>``
folders. Each file is an input partition. Filters on ``landed`` and ``file`` are pushed
into the listing, so files that they rule out are no partitions at all; all other filters
stay with Spark. Lines that are no JSON object come as rows without payload, whose
``fault`` tells why; fields that a payload lacks, or whose type is another, are null.

A stream's offset is the newest (time of modification, path) that was listed, so a
trigger reads the files that landed since the last, each once, and a restart goes on where
the checkpoint stands. Files must be complete when they appear, as a rename makes them.
Paths are those of any file system that Arrow reaches from the executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The payloads of each kind, as DDL.
PAYLOADS = {
    "filings": "cik string, name string, form array<string>, filingDate array<string>, accessionNumber array<string>, primaryDocument array<string>, items array<string>",
    "prices": "ticker string, timestamp array<bigint>, close array<double>, volume array<double>",
    "articles": "article_id bigint, title string, wikitext string",
    "feeds": "feed string, query_id string, body string",
    "logs": "token string, block_time bigint, data string, topics array<string>",
}
WHERE = "landed date, file string, line bigint, fault string"
#: Payloads of one Arrow batch.
LINES = 1000
#: Set by ``register``, so that filters reach the listing.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_TESTS = {EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v}


@dataclass
class LandedFile(InputPartition):
    """One file; ``changed``: nanoseconds of its last modification."""

    path: str
    landed: date | None
    changed: int

    def __init__(self, path: str, landed: date | None, changed: int):
        super().__init__(path)
        self.path, self.landed, self.changed = path, landed, changed


def listed(folder: str) -> list[LandedFile]:
    """The files of a landing folder, in the order of (modified, path). A folder that isn't there has none."""
    store, inner = fs.FileSystem.from_uri(folder)
    found = []
    for f in store.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True)):
        parts = f.path.removeprefix(inner).strip("/").split("/")
        if f.type == fs.FileType.File and not any(p.startswith((".", "_")) for p in parts):
            day = next((p.removeprefix("landed=") for p in parts if p.startswith("landed=")), None)
            found.append(LandedFile(f.path, date.fromisoformat(day) if day else None, f.mtime_ns or 0))
    return sorted(found, key=lambda p: (p.changed, p.path))


def _typed(value: Any, kind: pa.DataType) -> Any:
    """A JSON value as of a type, null where it is of another."""
    if value is None:
        return None
    if pa.types.is_list(kind):
        return [_typed(x, kind.value_type) for x in value] if isinstance(value, list) else None
    if pa.types.is_string(kind):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(value, bool) or not isinstance(value, int | float):
        return None
    if pa.types.is_integer(kind):
        return int(value) if value == int(value) and abs(value) < 1 << 63 else None
    return float(value)


def rows_of(part: LandedFile, folder: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A file's lines as batches of ``schema``."""
    store, _ = fs.FileSystem.from_uri(folder)
    payload = [f for f in schema if f.name not in ("landed", "file", "line", "fault")]
    with store.open_input_stream(part.path, compression="detect") as raw:
        rows: list[dict] = []
        for n, text in enumerate(_lines(raw)):
            row: dict[str, Any] = {"landed": part.landed, "file": part.path, "line": n, "fault": None}
            try:
                found = json.loads(text)
                if not isinstance(found, dict):
                    raise ValueError("no object")
                row |= {f.name: _typed(found.get(f.name), f.type) for f in payload}
            except (ValueError, OverflowError) as e:
                row["fault"] = str(e).split(":")[0]
            rows.append(row)
            if len(rows) == LINES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def _lines(raw: Any) -> Iterator[bytes]:
    """Lines that aren't blank, read a megabyte at a time."""
    rest = b""
    while piece := raw.read(1 << 20):
        *whole, rest = (rest + piece).split(b"\n")
        yield from (x for x in whole if x.strip())
    if rest.strip():
        yield rest


class LandedReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.schema = folder, to_arrow_schema(schema)
        self.tests: list[tuple[str, type, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("landed",), ("file",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> Sequence[LandedFile]:
        def wanted(p: LandedFile) -> bool:
            values = {"landed": p.landed, "file": p.path}
            return all(values[c] is not None and _TESTS[kind](values[c], v) for c, kind, v in self.tests)

        return [p for p in listed(self.folder) if wanted(p)] or [LandedFile("", None, 0)]  # Spark asks for one at least

    def read(self, partition: LandedFile) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from rows_of(partition, self.folder, self.schema)


class LandedStreamReader(DataSourceStreamReader):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.schema = folder, to_arrow_schema(schema)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": 0, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        found = listed(self.folder)
        return {"changed": found[-1].changed, "path": found[-1].path} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[LandedFile]:
        a, b = ((x["changed"], x["path"]) for x in (start, end))
        return [p for p in listed(self.folder) if a < (p.changed, p.path) <= b]

    def read(self, partition: LandedFile) -> Iterator[pa.RecordBatch]:
        yield from rows_of(partition, self.folder, self.schema)

    def commit(self, end: dict) -> None:
        """What was read stays where it landed."""


class Landed(DataSource):
    """The source of one kind of payload; ``register`` makes one for each kind."""

    kind = ""

    @classmethod
    def name(cls) -> str:
        return f"chronolith.{cls.kind}"

    def schema(self) -> str:
        return f"{PAYLOADS[self.kind]}, {WHERE}"

    def reader(self, schema: StructType) -> LandedReader:
        return LandedReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> LandedStreamReader:  # noqa: N802
        return LandedStreamReader(self.options["path"], schema)


class Filings(Landed):
    kind = "filings"


class Prices(Landed):
    kind = "prices"


class Articles(Landed):
    kind = "articles"


class Feeds(Landed):
    kind = "feeds"


class Logs(Landed):
    kind = "logs"


SOURCES: list[type[Landed]] = [Filings, Prices, Articles, Feeds, Logs]


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session, and lets filters through to them."""
    spark.conf.set(PUSHDOWN, "true")
    for source in SOURCES:
        spark.dataSource.register(source)


def land(rows: Any, folder: str) -> None:
    """Writes payload rows with a column ``landed`` as a landing folder of JSON lines."""
    rows.write.mode("append").partitionBy("landed").option("ignoreNullFields", "false").json(folder)
