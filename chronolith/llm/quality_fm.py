"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document's features are the share of its words in each of ``BUCKETS`` hash buckets,
statistics of its structure (shares of kinds of characters, word and line lengths,
repeated words and lines), each as a number and as one of ``BINS`` bins, and its size
from the column n_chars (the text's own length where that is null or missing).

    z = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

The second sum is that over all pairs of features, taken in time linear in the features
by the sum-of-squares identity. The score is 1 / (1 + exp(-z)).

The model is fitted on at most ``FIT_ROWS`` labelled documents, the first by a hash of
their doc_id, and only while their features together take ``FIT_BYTES`` at most: neither
that sample, which goes to the driver, nor the model (2.5 MB) grows with the data. All
documents are scored, in one pass.

Defined results: a null or empty text has no words and all its shares are 0, and it is
scored too; a document is labelled 1 if at least half of its non-null labels are; with
no labels every score is 0.5; repeated rows each get their score; of other columns only
n_chars is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written
from .wordscan import LOWER, WHITE, Words, chunks, scan, utf8

BUCKETS = 1 << 15
FACTORS = 8
BINS = 8
FIT_ROWS = 4000
EPOCHS, BATCH, RATE, SHRINK = 25, 128, 0.04, 1e-5
#: Features of the sample that go to the driver.
FIT_BYTES = 128 << 20
THRESHOLD = 0.7
STATS = ["log_chars", "log_words", "log_lines", "symbols", "bangs", "bars", "upper", "digits", "punctuation", "high", "white", "word_bytes", "long_words", "short_words", "distinct", "line_words", "dup_lines", "marked_words", "shouted_words", "size"]

_KIND = np.zeros((256, 7), bool)
for _k, _chars in enumerate((b"#*$%&<>^~@=", b"!?", b"|", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:'\"()-")):
    _KIND[list(_chars), _k] = True
_KIND[128:, 6] = True


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document are kept from the fit: crc32 of the doc_id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _share(flags: np.ndarray, at: np.ndarray, total: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (sums[at[1:]] - sums[at[:-1]]) / np.maximum(total, 1)


def features(part: np.ndarray, at: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(heads, buckets, shares): the words of each document; and its STATS. n_chars: negative where unknown."""
    n, size = len(at) - 1, np.diff(at)
    w = scan(part, at)
    counts, doc, length = w.counts(), w.doc(), w.ends - w.starts
    bucket = (Words(LOWER[part], w.starts, w.ends, w.first).hashes() >> np.uint64(49)).astype(np.int64)
    key, times = np.unique(doc * BUCKETS + bucket, return_counts=True)
    of = key // BUCKETS
    heads = np.searchsorted(of, np.arange(n + 1))
    shares = (times / counts[of]).astype(np.float32)
    kinds = [_KIND[:, k][part] for k in range(7)]
    breaks = part == 10
    lines = _share(breaks, at, np.ones(n)) + 1
    first = part[w.starts] if len(part) else part
    last = part[w.ends - 1] if len(part) else part
    upper = np.concatenate([[0], np.cumsum(kinds[3], dtype=np.int64)])
    marked = _KIND[:, 0][last] | _KIND[:, 1][last] | _KIND[:, 2][first]
    shouted = (upper[w.ends] - upper[w.starts]) * 2 > length
    stats = [
        np.log1p(size) / 14, np.log1p(counts) / 12, np.log(lines) / 8, *(_share(k, at, size) for k in (kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], WHITE[part])),
        _share(length, w.first, counts) / 16, _share(length > 14, w.first, counts), _share(length < 3, w.first, counts), np.diff(heads) / np.maximum(counts, 1), np.log1p(counts / lines) / 8,
        _dup_share(part, at, w, lines), _share(marked, w.first, counts), _share(shouted, w.first, counts), np.log1p(np.where(n_chars < 0, size, n_chars)) / 14,
    ]
    return heads, key % BUCKETS, shares, np.stack(stats, axis=1).astype(np.float32)


def _dup_share(part: np.ndarray, at: np.ndarray, w: Words, lines: np.ndarray) -> np.ndarray:
    """The share of a document's words in lines that it has had before; lines are told apart by their words."""
    if not len(w.starts):
        return np.zeros(len(at) - 1)
    doc, line = w.doc(), np.concatenate([[0], np.cumsum(part == 10)])[w.starts]
    heads = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])])
    mixed = w.hashes() * (np.arange(len(line)) - np.repeat(heads, np.diff(np.r_[heads, len(line)])) + 1).astype(np.uint64)
    key = np.add.reduceat(mixed, heads) + doc[heads].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, firsts = np.unique(key, return_index=True)
    again = np.ones(len(heads), bool)
    again[firsts] = False
    flags = np.repeat(again, np.diff(np.r_[heads, len(line)]))
    return _share(flags, w.first, w.counts())


@dataclass
class Machine:
    """Bin edges and scales of the statistics, and the weights."""

    edges: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def rows(self, heads: np.ndarray, index: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature, value) of all features."""
        n, s = stats.shape
        bins = np.stack([np.searchsorted(self.edges[k], stats[:, k]) for k in range(s)], axis=1)
        doc = np.concatenate([np.repeat(np.arange(n), np.diff(heads)), np.repeat(np.arange(n), 2 * s)])
        numbers = np.clip((stats - self.center) / self.scale, -4, 4) * 0.25
        extra = np.concatenate([np.broadcast_to(BUCKETS + np.arange(s), (n, s)), BUCKETS + s + np.arange(s) * BINS + bins], axis=1)
        values = np.concatenate([numbers, np.full((n, s), 0.25)], axis=1)
        return doc, np.concatenate([index, extra.ravel()]), np.concatenate([value, values.ravel()]).astype(np.float32)

    def sums(self, n: int, doc: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(z, the factors' sums) of each document."""
        z = self.bias + np.bincount(doc, self.linear[index] * value, n)
        held = np.empty((n, self.factors.shape[1]))
        for f in range(self.factors.shape[1]):
            term = self.factors[index, f] * value
            held[:, f] = np.bincount(doc, term, n)
            z += 0.5 * (held[:, f] ** 2 - np.bincount(doc, term * term, n))
        return z, held

    def score(self, *of: np.ndarray) -> np.ndarray:
        z, _ = self.sums(len(of[0]) - 1, *self.rows(*of))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(sample: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """A machine for (buckets, shares, stats) and 0/1 labels, by Adam on the logistic loss."""
    n = len(labels)
    stats = np.stack([s for *_, s in sample]) if n else np.zeros((1, len(STATS)), np.float32)
    size = BUCKETS + len(STATS) * (1 + BINS)
    rng = np.random.default_rng(0)
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    model = Machine(edges, stats.mean(axis=0), stats.std(axis=0) + 1e-3, 0.0, np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)))
    if not n:
        model.factors[:] = 0
        return model
    rate = np.clip(labels.mean(), 0.02, 0.98)
    model.bias = float(np.log(rate / (1 - rate)))
    params = [model.linear, *(model.factors[:, f] for f in range(FACTORS))]
    moments = [(np.zeros(size), np.zeros(size)) for _ in params]
    turn = 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            pick = order[k : k + BATCH]
            turn += 1
            heads = np.concatenate([[0], np.cumsum([len(sample[i][0]) for i in pick])])
            doc, index, value = model.rows(heads, np.concatenate([sample[i][0] for i in pick]), np.concatenate([sample[i][1] for i in pick]), stats[pick])
            z, held = model.sums(len(pick), doc, index, value)
            slope = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[pick]) / len(pick)
            model.bias -= RATE * float(slope.sum())
            push = slope[doc] * value
            for j, (p, (m, v)) in enumerate(zip(params, moments, strict=True)):
                term = push if not j else push * (held[doc, j - 1] - p[index] * value)
                grad = np.bincount(index, term, size) + SHRINK * p
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                p -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return model


def _known_size(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch["n_chars"].fill_null(-1))


def _columns(docs: DataFrame) -> DataFrame:
    size = F.expr("try_cast(n_chars as long)") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), size.alias("n_chars"))


def _sample(docs: DataFrame, labels: DataFrame, rows: int, most: int) -> DataFrame:
    """Features of the first ``rows`` labelled documents, as far as ``most`` bytes reach."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).filter("doc_id is not null and quality is not null")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most ``rows`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch["text"])
            sizes = _known_size(batch)
            for i, j, part, at in chunks(raw, offs):
                heads, index, value, stats = features(part, at, sizes[i:j])
                cut = [(index[a:b].astype("<i4").tobytes(), value[a:b].astype("<f4").tobytes()) for a, b in zip(heads, heads[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), batch["quality"].slice(i, j - i), pa.array([c[0] for c in cut], pa.binary()), pa.array([c[1] for c in cut], pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())], ["doc_id", "quality", "index", "value", "stats"])

    sample = _columns(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, quality double, index binary, value binary, stats binary")
    sample = written(sample)
    size = F.sum(F.octet_length("index") + F.octet_length("value") + F.octet_length("stats"))
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over ``rows`` rows at most
    return sample.join(F.broadcast(sample.groupBy("doc_id").agg(size.alias("size")).select("doc_id", upto.alias("upto")).filter(F.col("upto") <= most)), "doc_id", "left_semi")


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most: int = FIT_BYTES) -> Machine:
    """A machine fitted to ``labels`` (doc_id, quality) of documents that are not held out."""
    got = sorted(_sample(docs, labels, rows, most).collect(), key=lambda r: (r["doc_id"], r["stats"]))
    rows_of = [(np.frombuffer(r["index"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4"), np.frombuffer(r["stats"], "<f4")) for r in got]
    return fit(rows_of, np.array([float(r["quality"] >= 0.5) for r in got]))


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted. No shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch["text"])
            sizes = _known_size(batch)
            for i, j, part, at in chunks(raw, offs):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(model.value.score(*features(part, at, sizes[i:j])))], ["doc_id", "score"])

    scored = _columns(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
