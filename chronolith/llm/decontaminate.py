"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are runs of letters and digits with A-Z lower-cased. Each benchmark item gives
its windows of ``size`` consecutive words; an item of fewer words, but not none, is
one window. Documents stream past the set once: a bit table rejects most windows, the
sorted hashes find the rest, and each hit is verified on its words.

The set is broadcast only while the benchmark is at most ``broadcast_bytes`` of text,
which is measured first. A larger benchmark is joined to the documents' windows instead,
through a shuffle, with the same results; a filter of ``FILTER_BITS`` bits, of the same
size for any benchmark, keeps back the windows that no item has.

Defined results: a null or empty text or item has no words, so it has no hits and
gives no window; repeated items each count; items with a null id are counted under the
text ``null`` (sorted among the others); repeated document rows each get their result; a
very long text is a chunk of its own; an empty table of documents gives no rows and an
empty benchmark no hits; other columns are ignored by ``scan_documents``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import written
from .wordscan import LOWER, NOT_ALNUM, Rolling, Words, chunks, covered, scan, utf8, window_starts

WINDOW = 10
#: A benchmark of more text than this is joined, not broadcast.
BROADCAST_BYTES = 32 << 20
_BITS = 22
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<begin:int,end:int>>"


def _windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each item's windows: the first word, the number of words, the hash."""
    counts, rolling = w.counts(), Rolling(w.hashes())
    at = window_starts(w.first, size)
    short = np.flatnonzero((counts > 0) & (counts < size))
    a = np.concatenate([at, w.first[short]])
    b = np.concatenate([at + size, w.first[short + 1]])
    return a, b - a, rolling.of(a, b)


class NgramSet:
    """The windows of the items, by number of words and then by hash, as arrays: some 28 bytes each beside the items' own bytes, and twice that while they are built.

    Windows of one hash share a slot. Their words are compared once, when the set is
    built; the rare slot whose windows differ is ``mixed``.
    """

    def __init__(self, ids: list[str], texts: list[str | None], size: int = WINDOW):
        self.ids = ids
        raw, offs = utf8(pa.array(texts, pa.large_string()))
        found, words, base = [], [], 0
        for i, _, part, at in chunks(raw, offs):
            w = scan(LOWER[part], at, NOT_ALNUM)
            a, n, h = _windows(w, size)
            found.append(((a + base).astype(np.int32), n.astype(np.int32), h, (np.searchsorted(w.first, a, "right") - 1 + i).astype(np.int32)))
            words.append(((w.starts + offs[i]).astype(np.int32), (w.ends + offs[i]).astype(np.int32)))
            base += len(w.starts)

        def column(parts: list[tuple], k: int, kind: type = np.int32) -> np.ndarray:
            return np.concatenate([x[k] for x in parts] + [np.zeros(0, kind)])

        self.words = Words(LOWER[raw], column(words, 0), column(words, 1), np.array([0, base]))
        a, n, h, doc = column(found, 0), column(found, 1), column(found, 2, np.uint64), column(found, 3)
        del words, found
        self.by_size: dict[int, tuple] = {}
        for k in np.unique(n).tolist():
            pick = np.flatnonzero(n == k).astype(np.int32)
            pick = pick[np.argsort(h[pick], kind="stable")]  # windows of one size come by item
            sorted_h = h[pick]
            begin = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]])).astype(np.int32)
            keys = sorted_h[begin]
            bits = np.zeros(1 << _BITS, bool)
            bits[keys >> np.uint64(64 - _BITS)] = True
            begin = np.append(begin, np.int32(len(pick)))
            at = a[pick]
            mixed = set()
            for slot in np.flatnonzero(np.diff(begin) > 1).tolist():
                first = _joined(self.words, at[begin[slot]], at[begin[slot]] + k)
                if any(_joined(self.words, x, x + k) != first for x in at[begin[slot] + 1 : begin[slot + 1]].tolist()):
                    mixed.add(slot)
            self.by_size[k] = keys, bits, begin, at, doc[pick], mixed

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of each verified window in the documents: its first word, its end, its items."""
        rolling, a, b, items = Rolling(w.hashes()), [], [], []
        for k, (keys, bits, begin, where, owner, mixed) in self.by_size.items():
            h = rolling.windows(k)
            at = np.flatnonzero(bits[h >> np.uint64(64 - _BITS)])
            slot = np.searchsorted(keys, h[at])
            slot[slot == len(keys)] = 0
            same = keys[slot] == h[at]
            at, slot = at[same], slot[same]
            doc = np.searchsorted(w.first, at, "right")
            inside = at + k <= w.first[doc]
            for i, s in zip(at[inside].tolist(), slot[inside].tolist(), strict=True):
                x, y = begin[s], begin[s + 1]
                words = _joined(w, i, i + k)
                if s in mixed:
                    got = owner[x:y][[_joined(self.words, z, z + k) == words for z in where[x:y].tolist()]]
                else:
                    got = owner[x:y] if _joined(self.words, where[x], where[x] + k) == words else owner[:0]
                if len(got):
                    a.append(i)
                    b.append(i + k)
                    items.append(got)
        return np.array(a, np.int64), np.array(b, np.int64), items


_built: dict[int, NgramSet] = {}


def _held(broadcast) -> NgramSet:
    """The set of this broadcast, built once in each Python worker."""
    key = getattr(broadcast, "_path", None) or id(broadcast)
    if key not in _built:
        _built.clear()
        _built[key] = NgramSet(*broadcast.value)
    return _built[key]


def _joined(w: Words, a: int, b: int) -> bytes:
    return b" ".join(w.raw[s:e].tobytes() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True))


_NOTHING = hashlib.sha256(b"").hexdigest()


def _rows(doc_ids: pa.Array, w: Words, a: np.ndarray, b: np.ndarray, names: list[list[str] | None]) -> pa.RecordBatch:
    """The result rows of one chunk from its verified windows and the names of each document's items."""
    n = len(w.first) - 1
    hit = covered(int(w.first[-1]), a, b)
    hit_sums = np.concatenate([[0], np.cumsum(hit)])
    n_hit = hit_sums[w.first[1:]] - hit_sums[w.first[:-1]]
    spans = [[]] * n
    for d in np.flatnonzero(n_hit).tolist():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[w.first[d] : w.first[d + 1]].view(np.int8), [0]])))
        spans[d] = [{"begin": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)]
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(w.counts(), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x or ()) for x in names], pa.int64()), pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() if x else _NOTHING for x in names], pa.string()), pa.array(n_hit > 0), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"],
    )


def _names(ngrams: NgramSet, w: Words, a: np.ndarray, items: list[np.ndarray]) -> list[list[str] | None]:
    """Of each document the names of the items that its windows are of."""
    by_doc: dict[int, list[np.ndarray]] = {}
    for d, got in zip((np.searchsorted(w.first, a, "right") - 1).tolist(), items, strict=True):
        by_doc.setdefault(d, []).append(got)
    return [[ngrams.ids[i] for i in np.unique(np.concatenate(by_doc[d])).tolist()] if d in by_doc else None for d in range(len(w.first) - 1)]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))


def scan_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and hit_spans (word numbers)."""
    items = _items(benchmark)
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if total > broadcast_bytes:
        return _joined_scan(columns, items, size)
    rows = items.collect()
    held = docs.sparkSession.sparkContext.broadcast(([r["item"] for r in rows], [r["text"] for r in rows], size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ngrams = _held(held)
        for batch in batches:
            raw, offs = utf8(batch["text"])
            for i, j, part, at in chunks(raw, offs):
                w = scan(LOWER[part], at, NOT_ALNUM)
                a, b, items = ngrams.hits(w)
                yield _rows(batch["doc_id"].slice(i, j - i), w, a, b, _names(ngrams, w, a, items))

    return columns.mapInArrow(run, RESULT)


def _joined_scan(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """For a benchmark too large to broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch["text"])
            for i, j, part, at in chunks(raw, offs):
                w = scan(LOWER[part], at, NOT_ALNUM)
                yield _rows(batch["doc_id"].slice(i, j - i), w, *_placed(w, batch[_HITS].slice(i, j - i).to_pylist()), batch[_NAMES].slice(i, j - i).to_pylist())

    return _with_hits(docs, items, size, names=True).mapInArrow(run, RESULT)


_ROW, _HITS, _NAMES = "chronolith_row", "chronolith_hits", "chronolith_names"
#: Bits of the filter of the windows' hashes that documents are held against before the join, 32 MB.
FILTER_BITS = 1 << 28


def _filter(grams: DataFrame, spark: SparkSession) -> tuple[Broadcast, int]:
    """A bit for each value that a window's hash can have modulo the bits: as large for any benchmark."""
    total = FILTER_BITS
    place = F.pmod("h", F.lit(total)) + 1  # Spark's buckets of bits begin at 1
    rows = grams.select(place.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()  # at most FILTER_BITS / 32768 rows of 4 kB
    return spark.sparkContext.broadcast({r["no"]: bytes(r["bits"]) for r in rows}), total


_filters: dict[str, np.ndarray] = {}


def _held_filter(held: Broadcast, total: int) -> np.ndarray:
    """The filter's bytes, laid out once in each Python worker."""
    key = getattr(held, "_path", None) or str(id(held))
    if key not in _filters:
        _filters.clear()
        flat = np.zeros(total // 8, np.uint8)
        for no, bits in held.value.items():
            flat[(no - 1) * 4096 : no * 4096] = np.frombuffer(bits, np.uint8)
        _filters[key] = flat
    return _filters[key]


def _with_hits(docs: DataFrame, items: DataFrame, size: int, names: bool = False) -> DataFrame:
    """``docs`` and, of each row, the windows that it shares with an item, and the names of these items; through a shuffle.

    Only windows that pass the filter are shuffled, with their words, and meet the items'
    distinct windows; the items of a window are joined to the documents that are known to
    have it.
    """
    spark = docs.sparkSession

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch["text"])
            for i, _, part, at in chunks(raw, offs):
                w = scan(LOWER[part], at, NOT_ALNUM)
                a, n, h = _windows(w, size)
                of = pa.array(np.searchsorted(w.first, a, "right") - 1 + i)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int32()), batch["no"].take(of), batch["item"].take(of), pa.array([_joined(w, x, x + k) for x, k in zip(a, n, strict=True)], pa.binary())], ["h", "n", "no", "item", "words"])

    grams = written(items.withColumn("no", F.monotonically_increasing_id()).mapInArrow(of_items, "h long, n int, no long, item string, words binary"))
    sizes = [r["n"] for r in grams.select("n").distinct().collect()]  # at most ``size`` rows
    held, total = _filter(grams, spark)
    keyed = written(docs.withColumn(_ROW, F.monotonically_increasing_id()))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _held_filter(held, total)
        for batch in batches:
            raw, offs = utf8(batch["text"])
            for i, _, part, at in chunks(raw, offs):
                w = scan(LOWER[part], at, NOT_ALNUM)
                rolling = Rolling(w.hashes())
                for k in sizes:
                    a = window_starts(w.first, k)
                    h = rolling.of(a, a + k).view(np.int64)
                    place = h % total
                    some = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                    a, h = a[some], h[some]
                    doc = np.searchsorted(w.first, a, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(a), k), pa.int32()), batch["row"].take(pa.array(doc + i)), pa.array(a - w.first[doc], pa.int32()), pa.array([_joined(w, x, x + k) for x in a.tolist()], pa.binary())], ["h", "n", "row", "at", "words"])

    texts = keyed.select(F.col(_ROW).alias("row"), F.col("text").cast("string").alias("text"))
    window = ["h", "n", "words"]
    hits = written(texts.mapInArrow(of_docs, "h long, n int, row long, at int, words binary").join(grams.select(*window).distinct(), window))
    spans = hits.groupBy(F.col("row").alias(_ROW)).agg(F.collect_list(F.struct("at", "n")).alias(_HITS))
    out = keyed.join(spans, _ROW, "left")
    if names:
        # A document's items, each once however many windows it shares with them.
        of = hits.select("row", *window).distinct().join(grams.select(*window, "no", "item").distinct(), window).select("row", "no", "item").distinct()
        out = out.join(of.groupBy(F.col("row").alias(_ROW)).agg(F.collect_list("item").alias(_NAMES)), _ROW, "left")
    return out.drop(_ROW)


def _placed(w: Words, hits: list[list | None]) -> tuple[np.ndarray, np.ndarray]:
    """The first words and ends of the documents' hits."""
    a, b = [], []
    for first, found in zip(w.first.tolist(), hits, strict=False):
        for x in found or ():
            a.append(first + x["at"])
            b.append(first + x["at"] + x["n"])
    return np.array(a, np.int64), np.array(b, np.int64)


def remove_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs``, whole and with all columns, whose text holds no window of the benchmark. In one pass without a shuffle while the benchmark is broadcast."""
    return _filtered(docs, benchmark, size, broadcast_bytes, spans=False)


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All rows of ``docs``; the bytes of hit words, and what lies between two of them, are cut from their texts."""
    return _filtered(docs, benchmark, size, broadcast_bytes, spans=True)


def _filtered(docs: DataFrame, benchmark: DataFrame, size: int, broadcast_bytes: int, spans: bool) -> DataFrame:
    items = _items(benchmark)
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    k, kind, n = docs.columns.index("text"), docs.schema, len(docs.columns)
    held = None
    if total > broadcast_bytes:
        docs = _with_hits(docs, items, size)
    else:
        rows = items.collect()
        held = docs.sparkSession.sparkContext.broadcast(([r["item"] for r in rows], [r["text"] for r in rows], size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ngrams = _held(held) if held else None
        for batch in batches:
            joined = None if ngrams else batch.column(n)
            batch = batch.select(range(n))
            raw, offs = utf8(batch.column(k))
            clean, texts = np.ones(batch.num_rows, bool), {}
            for i, j, part, at in chunks(raw, offs):
                w = scan(LOWER[part], at, NOT_ALNUM)
                a, b = ngrams.hits(w)[:2] if ngrams else _placed(w, joined.slice(i, j - i).to_pylist())
                hit = covered(int(w.first[-1]), a, b)
                for d in np.unique(np.searchsorted(w.first, a, "right") - 1).tolist():
                    clean[i + d] = False
                    if spans:
                        f, e = w.first[d], w.first[d + 1]
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[f:e].view(np.int8), [0]]))).reshape(-1, 2)
                        left, out = at[d], []
                        for x, y in edge:
                            out.append(part[left : w.starts[f + x]].tobytes())
                            left = w.ends[f + y - 1]
                        texts[i + d] = b"".join([*out, part[left : at[d + 1]].tobytes()]).decode()
            if not spans:
                yield batch.filter(pa.array(clean))
            elif texts:
                column = pa.array([texts.get(r, v) for r, v in enumerate(batch.column(k).to_pylist())], batch.schema.field(k).type)
                yield batch.set_column(k, batch.schema.field(k), column)
            else:
                yield batch

    return docs.mapInArrow(run, kind)
