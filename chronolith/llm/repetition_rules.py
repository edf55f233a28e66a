"""Quality rules: repetition within a document, read from a suffix array of its words.

Suffixes are ranked by prefix doubling over many documents at once; only suffixes whose
rank is still shared go on to the next round. Neighbours in the array share a longest
common prefix, read off the kept ranks of each round. A word position whose longest
common prefix with a neighbour is L heads a substring of L words that is found twice or
more; the union of those spans of ``MIN_REPEAT`` words and more is what a document
repeats. A document is rejected if its repeats cover more than ``MAX_COVERED`` of its
words, or if one of them has more than ``MAX_LONGEST`` words.

Defined results: a null or empty text has no words and fails the base rule (under
``MIN_WORDS`` words); repeated rows each get their result; other columns are ignored by
``measure`` and kept by ``keep_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordscan import Words, chunks, covered, mix, scan, utf8

MIN_WORDS = 10
BASE_WINDOW = 5
BASE_PERCENT = 20
#: Words of the shortest repeat that counts, the largest part of the words in repeats, and the longest repeat.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 4, 0.3, 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_covered long, longest_repeat long, kept boolean"
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _dense(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of sorted keys, in the order given: for each position the number of its first equal."""
    head = np.empty(len(key), bool)
    head[:1] = True
    np.not_equal(key[1:], key[:-1], out=head[1:])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
    return rank


def _order(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (high, low), and the pairs in this order as keys that are equal only for equal pairs. Both are below 2 ** 31."""
    n = len(high)
    bits = max(1, int(n - 1).bit_length())
    wide = max(1, int(low.max(initial=0)).bit_length())
    if int(high.max(initial=0)).bit_length() + wide + bits <= 63:  # the position rides along in the key, and a plain sort will do
        key = np.sort((((high << wide) | low) << bits) | np.arange(n))
        return key & ((1 << bits) - 1), key >> bits
    key = (high << 32) | low
    order = np.argsort(key, kind="stable")
    return order, key[order]


def repeats(w: Words) -> np.ndarray:
    """For each word, how many words from it on are also found elsewhere in its document: the larger of the LCPs with its neighbours in the suffix array."""
    n = int(w.first[-1])
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    doc, end = w.doc(), np.repeat(w.first[1:], w.counts())
    word = np.unique(w.hashes(), return_inverse=True)[1].astype(np.int64)
    order, key = _order(doc, word)
    rank = _dense(key, order)
    levels, step = [rank], 1
    at = _shared(rank)
    while len(at):
        # the next words' rank, 0 past the document's end; singles keep their rank, as no one is equal to them
        beyond = at + step
        low = np.where(beyond < end[at], rank[np.minimum(beyond, n - 1)] + 1, 0)
        order, key = _order(rank[at], low)
        within = _dense(key, order)  # numbers positions within `at`; those of one old rank stay together
        new = rank.copy()
        base = at[order]
        head = np.r_[True, rank[base][1:] != rank[base][:-1]]
        start = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        place = np.empty(len(at), np.int64)
        place[order] = start
        new[at] = rank[at] + within - place
        step *= 2
        rank = new
        levels.append(rank)
        at = _shared(rank)
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    pairs = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[pairs], b[pairs]
    x, y, common = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok, level = (x < n) & (y < n), levels.pop()
        ok[ok] = level[x[ok]] == level[y[ok]]
        x[ok] += 1 << k
        y[ok] += 1 << k
        common[ok] += 1 << k
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def _shared(rank: np.ndarray) -> np.ndarray:
    """Positions whose rank is not theirs alone."""
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def _per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[at[1:]] - sums[at[:-1]]


def _dup_lines(part: np.ndarray, at: np.ndarray, w: Words) -> np.ndarray:
    """Of each document, its lines with a word that are equal to an earlier line."""
    n = len(at) - 1
    if not len(part):
        return np.zeros(n, np.int64)
    breaks = np.flatnonzero(part == 10)
    lines = scan(np.zeros(len(part), np.uint8), at)  # one run per document; cut at the line breaks below
    starts = np.unique(np.concatenate([lines.starts, breaks + 1]))
    starts = starts[starts < len(part)]
    doc = np.searchsorted(at, starts, "right") - 1
    ends = np.minimum(np.r_[starts[1:], len(part)], at[doc + 1])
    ends = ends - ((ends > starts) & (part[ends - 1] == 10))  # the break is not part of the line
    with_word = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, doc = starts[with_word], ends[with_word], doc[with_word]
    h = Words(part, starts, ends, np.zeros(1, np.int64)).hashes()
    key = mix(h + mix(doc.astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    dup = np.ones(len(starts), bool)
    dup[first] = False
    return np.bincount(doc[dup], minlength=n)


def measured(part: np.ndarray, at: np.ndarray, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> list[np.ndarray]:
    """The columns of RESULT but doc_id for the documents of one chunk."""
    w = scan(part, at)
    n_words, total = w.counts(), int(w.first[-1])
    inside = (part & 0xC0) != 0x80
    sums = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    chars = np.concatenate([[0], np.cumsum(sums[w.ends] - sums[w.starts])])
    word_chars = chars[w.first[1:]] - chars[w.first[:-1]]
    lcp = repeats(w)
    index = np.arange(total)
    base = lcp >= BASE_WINDOW
    n_repeat = _per_doc(covered(total, index[base], (index + lcp)[base]), w.first)
    long = lcp >= min_repeat
    n_covered = _per_doc(covered(total, index[long], (index + lcp)[long]), w.first)
    longest = np.zeros(len(n_words), np.int64)
    if total:
        full = n_words > 0
        longest[full] = np.maximum.reduceat(lcp, w.first[:-1][full])
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > BASE_PERCENT * n_words)
    kept = ~failed & (n_covered <= max_covered * n_words) & (longest <= max_longest)
    return [n_words, word_chars, _per_doc(SYMBOLS[part], at), _dup_lines(part, at, w), n_repeat, failed, n_covered, longest, kept]


def measure(docs: DataFrame, **limits: float) -> DataFrame:
    """One row per document, as RESULT. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch["text"])
            for i, j, part, at in chunks(raw, offs):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), *map(pa.array, measured(part, at, **limits))], NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


def keep_documents(docs: DataFrame, **limits: float) -> DataFrame:
    """The rows of ``docs``, with all columns, that the rules keep. No shuffle."""
    k = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column(k))
            kept = [measured(part, at, **limits)[-1] for *_, part, at in chunks(raw, offs)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *kept])))

    return docs.mapInArrow(run, docs.schema)
