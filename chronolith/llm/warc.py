"""WARC archives of pages: a writer that stores equal payloads once, and a sequential reader.

An archive is a file of gzip members, one for each record. A ``response`` record holds
the HTTP head and the page's bytes, a ``revisit`` record the head alone and the id of the
response with the same payload. The reader inflates a file some ``PIECE`` bytes at a time,
frames records by their content length, and holds the digests of block and payload
against the bytes, so its memory goes with ``PIECE`` whatever the size of file or page.

Writing takes one shuffle of the pages, by payload. Payloads with many pages are first
dealt to several tasks: those with a ``1 / HOT``-th of all pages or more, at most ``HOT``
of them, are broadcast with the number of parts that each is cut into. A file's name has
the attempt that wrote it, and only attempts whose manifest rows are committed count, so a
task may run again at any time.

Defined results: null html is the empty payload, null page_ids stand below all others and
are written as such; of pages with equal payloads of ``least_bytes`` or more those with
the largest page_id are responses (repeated rows too) and all others revisit it; if all
their page_ids are null, all are responses; null urls leave out the target's line, and
blanks, controls and non-ASCII characters in others are percent-encoded; an empty table
gives no files; other columns are ignored. When read, a damaged member or record gives one
row with its ``fault``, and reading goes on at the next member that begins a record.
Payloads are equal if their SHA-256 is.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import drop, shared_dir, written

#: Bytes that are read, or inflated, at a time.
PIECE = 1 << 16
#: A new file is begun after so many bytes, as archives customarily are.
FILE_BYTES = 1 << 30
#: Payloads with a HOT-th of all pages or more are cut into parts of so many pages.
HOT, PART = 100_000, 10_000
#: Longest head of a record or of HTTP.
HEAD_BYTES = 1 << 16
#: Names that the format fixes.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
PAGE_URN = "urn:page:"
FILES = "path string, bytes long, records long"
RECORDS = "path string, at long, record_type string, record_id string, target_uri string, payload_bytes long, payload_digest string, refers_to_id string, fault string, payload binary"
_VISIBLE = "".join(map(chr, range(0x21, 0x7F)))


def digest(sha1: Any) -> str:
    """Bare base32 of a SHA-1."""
    return base64.b32encode(sha1.digest()).decode()


def _record(kind: str, record_id: str, more: list[str], block: bytes) -> bytes:
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", *more, f"WARC-Block-Digest: sha1:{digest(hashlib.sha1(block))}", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n") + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, response: int | None, date: str) -> bytes:
    """The member of one page; ``response``: the page that it revisits."""
    more = [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest(hashlib.sha1(payload))}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        more.append(f"WARC-Target-URI: {quote(url, safe=_VISIBLE)}")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = f"{PAGE_URN}{'null' if page_id is None else page_id}"
    if response is None:
        return _record("response", name, more, head + payload)
    return _record("revisit", name, [*more, f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{PAGE_URN}{response}>"], head)


def _responses(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages (page_id, url, payload) and ``response``: the page that each revisits, or null."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= least_bytes, F.sha2("payload", 256)))
    total = pages.count()
    shared = written(rows.filter("key is not null").groupBy("key").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1 and response is not null"))
    parts = F.when(F.col("n") * HOT >= total, F.ceil(F.col("n") / PART)).otherwise(1).cast("int")
    hot = shared.withColumn("parts", parts).filter("parts > 1").select("key", "parts")  # at most HOT rows
    dealt = shared.select("key", "response", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    # Payloads too short to be shared have no key: their pages lie anywhere.
    anywhere = F.concat(F.lit("-"), F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)).cast("string"))
    rows = rows.join(F.broadcast(hot), "key", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("page_id", "url"), F.col("parts"))).cast("int"))
    rows = rows.withColumn("key", F.coalesce("key", anywhere)).drop("parts")
    joined = rows.join(dealt, ["key", "part"], "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("response")), F.col("response")).alias("response"))


@dataclass
class Archive:
    """Files of one ``write``: their manifest (path, bytes, records), and the folder that holds all of them."""

    files: DataFrame
    folder: str

    def drop(self, spark: SparkSession) -> None:
        drop(spark, self.folder)


def write(pages: DataFrame, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> Archive:
    """Writes ``pages`` (page_id, url, html) as archives in the shared folder."""
    folder = shared_dir(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, out, size, records, path = TaskContext.get(), 0, None, 0, 0, ""
        store, inner = fs.FileSystem.from_uri(f"{folder}/files")
        store.create_dir(inner, recursive=True)

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/files/{path}"]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], ["path", "bytes", "records"])

        for batch in batches:
            for page_id, url, payload, response in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "response")), strict=True):
                if out is None:
                    path = f"pages-{task.partitionId()}-{task.taskAttemptId()}-{number}.warc.gz"
                    out, number, records = store.open_output_stream(f"{inner}/{path}", compression=None), number + 1, 0
                    size = out.write(_record("warcinfo", f"urn:archive:{path}", [f"WARC-Date: {date}", f"WARC-Filename: {path}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n"))
                size += out.write(page_record(page_id, url, payload, response, date))
                records += 1
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    files = written(_responses(pages, least_bytes).mapInArrow(run, FILES), f"{folder}/manifest")
    return Archive(files, folder)


class Fault(Exception):
    """What is wrong with a member or a record."""


class _Member:
    """The bytes of the gzip member at ``at``, inflated piece by piece; ``end``: where the next begins, once it is read."""

    def __init__(self, file: BinaryIO, at: int):
        file.seek(at)
        self.file, self.at, self.end, self.held = file, at, None, b""
        self.pieces = self._inflated()

    def _inflated(self) -> Iterator[bytes]:
        z, seen = zlib.decompressobj(31), self.at
        try:
            while not z.eof:
                data = bytes(self.file.read(PIECE))
                seen += len(data)
                if not data:
                    if rest := z.flush():
                        yield rest
                    if not z.eof:
                        raise Fault("member cut off")
                while data and not z.eof:
                    out = z.decompress(data, PIECE)
                    data = z.unconsumed_tail
                    if out:
                        yield out
        except zlib.error as e:
            raise Fault(f"bad member: {e}") from None
        self.end = seen - len(z.unused_data)

    def until(self, mark: bytes, most: int) -> bytes:
        """What comes before ``mark``, which is taken too."""
        while (i := self.held.find(mark)) < 0:
            if len(self.held) > most:
                raise Fault("head too long")
            piece = next(self.pieces, b"")
            if not piece:
                raise Fault("head cut off")
            self.held += piece
        out, self.held = self.held[:i], self.held[i + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes."""
        while n:
            piece = self.held or next(self.pieces, b"")
            if not piece:
                raise Fault("record shorter than its content length")
            out, self.held = piece[:n], piece[n:]
            n -= len(out)
            yield out

    def close(self) -> None:
        """Reads on to the member's end, where nothing may be left but a record's two line ends."""
        rest = self.held
        for piece in self.pieces:
            rest = (rest + piece)[:5]
        self.held = b""
        if rest != b"\r\n\r\n":
            raise Fault("record doesn't end with its content length")


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _length(fields: dict[str, str]) -> int | None:
    return int(x) if re.fullmatch("[0-9]{1,18}", x := fields.get("content-length", "")) else None


def _read_record(m: _Member, keep: bool, row: dict) -> None:
    """Fills ``row`` from the record that a member holds; raises what is wrong with it."""
    version, fields = _fields(m.until(b"\r\n\r\n", HEAD_BYTES))
    if not version.startswith("WARC/"):
        raise Fault("no record")
    n = _length(fields)
    kind = fields.get("warc-type")
    row |= {"record_type": kind, "record_id": fields.get("warc-record-id", "").strip("<>") or None, "target_uri": fields.get("warc-target-uri"), "refers_to_id": fields.get("warc-refers-to", "").strip("<>") or None}
    if n is None:
        raise Fault("no content length")
    block, payload, size, kept, head = hashlib.sha1(), hashlib.sha1(), 0, [], b""
    http = fields.get("content-type", "").startswith("application/http")
    in_head = http
    for piece in m.take(n):
        block.update(piece)
        if in_head:
            head += piece
            i = head.find(b"\r\n\r\n")
            if i < 0:
                if len(head) > HEAD_BYTES:
                    raise Fault("head too long")
                continue
            in_head, piece, head = False, head[i + 4 :], head[:i]
        payload.update(piece)
        size += len(piece)
        if keep:
            kept.append(piece)
    m.close()
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        row |= {"payload_bytes": _length(_fields(head)[1]), "payload_digest": said}
    else:
        row |= {"payload_bytes": size, "payload_digest": digest(payload), "payload": b"".join(kept) if keep else None}
        if in_head:
            raise Fault("HTTP head cut off")
        if said and said != row["payload_digest"]:
            raise Fault("payload digest differs")
    if (x := fields.get("warc-block-digest", "").removeprefix("sha1:")) and x != digest(block):
        raise Fault("block digest differs")


def _next_member(file: BinaryIO, at: int) -> int | None:
    """Where the next member at or after ``at`` begins that holds a record."""
    while True:
        file.seek(at)
        piece = bytes(file.read(PIECE))
        i = piece.find(MAGIC)
        if i >= 0:
            try:
                begun = b""
                for more in _Member(file, at + i).pieces:
                    begun += more
                    if len(begun) >= 5:
                        break
                if begun.startswith(b"WARC/"):
                    return at + i
            except Fault:
                pass
            at += i + 1
        elif len(piece) < len(MAGIC):
            return None
        else:
            at += len(piece) - len(MAGIC) + 1


def records(file: BinaryIO, size: int, keep: bool = False) -> Iterator[dict]:
    """The records of a file from its start to its end, as rows of ``RECORDS`` without the path."""
    at: int | None = 0
    while at is not None and at < size:
        m = _Member(file, at)
        row = dict.fromkeys(("record_type", "record_id", "target_uri", "payload_bytes", "payload_digest", "refers_to_id", "fault", "payload")) | {"at": at}
        try:
            try:
                _read_record(m, keep, row)
            except Fault as e:
                row["fault"] = str(e)
                for _ in m.pieces:  # a bad record in a sound member
                    pass
        except Fault as e:
            row["fault"] = str(e)
        at = m.end if m.end is not None else _next_member(file, at + 1)
        yield row


def read(files: DataFrame, keep_payloads: bool = False) -> DataFrame:
    """One row per record in archives (path), in any place that Arrow's file systems reach: ``RECORDS``, page_id and refers_to. Each file is read in one task."""
    schema = ["path", "at", "record_type", "record_id", "target_uri", "payload_bytes", "payload_digest", "refers_to_id", "fault", "payload"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as file:
                    rows, held = [], 0
                    for row in records(file, file.size(), keep_payloads):
                        rows.append(row | {"path": path})
                        held += len(row["payload"] or b"")
                        if len(rows) == 1000 or held > FLUSH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(schema, kinds, strict=True)], schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(schema, kinds, strict=True)], schema)

    found = files.select("path").repartition(max(1, files.count())).mapInArrow(run, RECORDS)
    page = lambda c: F.regexp_extract(c, f"^{PAGE_URN}(-?[0-9]{{1,19}})$", 1).try_cast("long")
    return found.withColumns({"page_id": page("record_id"), "refers_to": page("refers_to_id")})


FLUSH_BYTES = 8 << 20

_BASE32 = "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(sha1(html), (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31))::INT, 1) for i in range(32)], '')"

#: DuckDB's form of the query over ``pages``.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id IS NULL AND last IS NOT NULL OR page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS NULL OR page_id < last THEN last END AS refers_to, NULL::VARCHAR AS fault
FROM r
"""
