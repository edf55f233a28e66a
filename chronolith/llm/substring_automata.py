"""Substring dedup: words covered by windows that a document with a smaller doc_id also has.

Matching is done by suffix automata of reference shards, past which documents stream:
the automaton gives, at each word, the longest run of words ending there that is found
in the reference, and each of its states knows the smallest document that it is from.
Sending every shard to every document would take time in the square of the corpus, so a
shard holds what can match, and goes only where it can match:

* Each window of ``WINDOW`` words has an anchor, the ``ANCHOR`` words in it with the
  smallest hash. It depends on the window alone, so equal windows have equal anchors.
  Neighbouring windows with one anchor form a run of words, its span.
* Anchors of one document only are done with: none of their windows is found elsewhere.
* Each other anchor is a shard: its distinct spans, each with its smallest doc_id, become
  one automaton, and the same spans stream past it, in place of all documents that have
  them. What is kept for each window is the smallest document that has it.
* A shard of more than ``SHARD_SPANS`` distinct spans would be too large for a task. Its
  windows get longer anchors, and meet in shards of these; in the last step the anchor is
  the whole window, and a shard holds a single one.

So every removed word comes from an automaton's matching statistics, automata have at
most ``SHARD_SPANS`` spans of at most 2 * WINDOW words, and work and shuffles grow in
proportion to the input. Documents share a span if its anchor, the anchor's place and the
span's words have the same hashes (128 bits); automata compare the words themselves.

Defined results: a null text has no words; a document with fewer words than a window
keeps all; rows that share a doc_id, also exact repeats, are one document, so none makes
another lose words; a null doc_id neither loses words nor makes others lose any; other
columns are ignored by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, written
from .wordscan import Rolling, Words, chunks, covered, mix, scan, utf8, window_starts

WINDOW = 50
ANCHOR = 8
#: Distinct spans of the largest automaton: of under 100 words each, so about 0.2 million words and 150 MB.
SHARD_SPANS = 2000
NONE = np.iinfo(np.int64).max
#: Low bits of an anchor's hash that give way to its place, so that the first of equal ones is taken.
_PLACE = np.uint64((1 << 28) - 1)


class SuffixAutomaton:
    """The suffix automaton of some word sequences, each of a document; ``least[s]`` is the smallest document that has the strings of state s."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.least = [-1], [0], [NONE]

    def add(self, words: list, doc: int) -> None:
        last = 0
        for w in words:
            last = self._step(last, w)
            # All strings that end here are the document's: mark the state, `settle` hands it on to its suffixes.
            self.least[last] = min(self.least[last], doc)

    def _step(self, last: int, w: object) -> int:
        nxt, link, size = self.next, self.link, self.len
        known = nxt[last].get(w)
        if known is not None:
            return known if size[known] == size[last] + 1 else self._split(last, known, w)
        new = self._state(size[last] + 1, {})
        at = last
        while at >= 0 and w not in nxt[at]:
            nxt[at][w] = new
            at = link[at]
        if at < 0:
            link[new] = 0
        else:
            to = nxt[at][w]
            link[new] = to if size[to] == size[at] + 1 else self._split(at, to, w)
        return new

    def _state(self, size: int, following: dict) -> int:
        self.next.append(following)
        self.len.append(size)
        self.link.append(0)
        self.least.append(NONE)
        return len(self.len) - 1

    def _split(self, at: int, to: int, w: object) -> int:
        """A state of its own for the strings of ``to`` that are no longer than those of ``at`` and w."""
        copy = self._state(self.len[at] + 1, dict(self.next[to]))
        self.link[copy], self.link[to] = self.link[to], copy
        while at >= 0 and self.next[at].get(w) == to:
            self.next[at][w] = copy
            at = self.link[at]
        return copy

    def settle(self) -> None:
        """Hands each state's smallest document on to its suffixes, from the longest on."""
        least, link = self.least, self.link
        for s in sorted(range(1, len(link)), key=self.len.__getitem__, reverse=True):
            if least[s] < least[link[s]]:
                least[link[s]] = least[s]

    def stream(self, words: list, size: int) -> list[int]:
        """For each word, the smallest document that has the ``size`` words that end with it; NONE if there is none, or fewer words so far."""
        nxt, link, length = self.next, self.link, self.len
        state, matched, out = 0, 0, []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                matched += 1
            else:
                matched = 0
            while state and length[link[state]] >= size:  # a longer match than asked for: its suffix of that size
                state = link[state]
                matched = length[state]
            out.append(self.least[state] if matched >= size else NONE)
        return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchored(w: Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor's hash, span's hash) of each run of windows with one anchor; windows are numbered in their document."""
    n = int(w.first[-1])
    starts = window_starts(w.first, window)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    words = w.hashes()
    rolling = Rolling(words)
    grams = rolling.windows(anchor)
    if n > int(_PLACE):
        raise ValueError("a text of over 2 ** 28 words")
    least = _sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), window - anchor + 1)
    owner = (least[starts] & _PLACE).astype(np.int64)
    doc = np.searchsorted(w.first, starts, "right") - 1
    heads = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])])
    count = np.diff(np.r_[heads, len(starts)])
    a = starts[heads]
    b = a + count - 1 + window
    inside = mix((owner[heads] - a).astype(np.uint64) + np.uint64(1))
    return doc[heads], a - w.first[doc[heads]], count, grams[owner[heads]].view(np.int64), (rolling.of(a, b) ^ inside).view(np.int64)


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.hash("text"))


def _spans(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch["text"])
            for i, _, part, at in chunks(raw, offs):
                doc, first, count, key, span = anchored(scan(part, at), window, anchor)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(doc + i)), batch["row"].take(pa.array(doc + i)), pa.array(first, pa.int32()), pa.array(count, pa.int32()), pa.array(key), pa.array(span)], ["doc_id", "row", "first", "n", "anchor", "span"])

    return _columns(docs).filter("doc_id is not null").mapInArrow(run, "doc_id long, row int, first int, n int, anchor long, span long")


_CUT = "anchor long, span long, least long, words binary"


def _texts(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Cuts the words of spans out of their documents. wanted: doc_id, row and cuts, an array of (first, n, anchor, span, least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch["text"])
            cuts = batch["cuts"].to_pylist()
            for i, j, part, at in chunks(raw, offs):
                w, rows = scan(part, at), []
                for d in range(j - i):
                    for c in cuts[i + d]:
                        a = w.first[d] + c["first"]
                        rows.append((c["anchor"], c["span"], c["least"], w.text(a, a + c["n"] - 1 + window)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["anchor", "span", "least", "words"])

    return _columns(docs).join(wanted.hint("merge"), ["doc_id", "row"]).select("text", "cuts").mapInArrow(run, _CUT)


_RUNS = "anchor long, span long, runs array<struct<begin:int,n:int,least:long>>"
_RUN_TYPE = pa.list_(pa.struct([("begin", pa.int32()), ("n", pa.int32()), ("least", pa.int64())]))


def _as_runs(least: list[int]) -> list[dict]:
    out: list[dict] = []
    for k, doc in enumerate(least):
        if doc == NONE:
            continue
        if out and out[-1]["least"] == doc and out[-1]["begin"] + out[-1]["n"] == k:
            out[-1]["n"] += 1
        else:
            out.append({"begin": k, "n": 1, "least": doc})
    return out


def _match_shards(spans: DataFrame, window: int) -> DataFrame:
    """For the distinct spans of each anchor, the smallest document of each window, by the anchor's automaton."""

    def shard(rows: list[tuple]) -> Iterator[tuple]:
        automaton = SuffixAutomaton()
        cut = [(span, words.split(), least) for span, words, least in rows]
        for _, words, least in cut:
            automaton.add(words, least)
        automaton.settle()
        for span, words, _ in cut:
            yield span, _as_runs(automaton.stream(words, window)[window - 1 :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def out() -> pa.RecordBatch:
            got = list(shard(rows))
            return pa.RecordBatch.from_arrays([pa.array([now] * len(got), pa.int64()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], _RUN_TYPE)], ["anchor", "span", "runs"])

        for batch in batches:
            for key, span, words, least in zip(*(batch[c].to_pylist() for c in ("anchor", "span", "words", "least")), strict=True):
                if key != now:
                    if rows:
                        yield out()
                    now, rows = key, []
                rows.append((span, words, least))
        if rows:
            yield out()

    return spans.select("anchor", "span", "words", "least").repartition("anchor").sortWithinPartitions("anchor", "span").mapInArrow(run, _RUNS)


def _anchored_anew(spans: DataFrame, window: int, anchor: int) -> DataFrame:
    """(up_anchor, up_span, at, and what _CUT has) of the spans' windows by longer anchors; at: the first window's number in its span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch["words"].cast(pa.string()))
            for i, _, part, at in chunks(raw, offs):
                w = scan(part, at)
                doc, first, count, key, span = anchored(w, window, anchor)
                of, begin = pa.array(doc + i), w.first[doc] + first
                words = [w.text(x, x + n - 1 + window) for x, n in zip(begin.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["anchor"].take(of), batch["span"].take(of), pa.array(first, pa.int32()), pa.array(key), pa.array(span), batch["least"].take(of), pa.array(words, pa.binary())], ["up_anchor", "up_span", "at", "anchor", "span", "least", "words"])

    return spans.select("anchor", "span", "least", "words").mapInArrow(run, "up_anchor long, up_span long, at int, " + _CUT)


def _match(spans: DataFrame, window: int, anchors: list[int], shard_spans: int, kept: Scratch) -> DataFrame:
    """(anchor, span, begin, n, least): for the distinct spans of each anchor, the smallest document of each window, in runs of windows."""
    runs = lambda cold: _match_shards(cold, window).select("anchor", "span", F.explode("runs").alias("run")).select("anchor", "span", "run.*")
    hot = kept(spans.groupBy("anchor").agg(F.count("*").alias("k")).filter(F.col("k") > shard_spans).select("anchor")) if anchors else None
    if hot is None or hot.isEmpty():
        return kept(runs(spans))
    cold = kept(runs(spans.join(hot, "anchor", "left_anti")))
    anew = kept(_anchored_anew(spans.join(hot, "anchor", "left_semi"), window, anchors[0]))
    distinct = kept(anew.groupBy("anchor", "span").agg(F.min("least").alias("least"), F.first("words").alias("words")))
    inner = _match(distinct, window, anchors[1:], shard_spans, kept)
    back = anew.drop("least", "words").join(inner, ["anchor", "span"]).select(F.col("up_anchor").alias("anchor"), F.col("up_span").alias("span"), (F.col("at") + F.col("begin")).alias("begin"), "n", "least")
    return kept(cold.union(back))


def repeated_runs(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_spans: int = SHARD_SPANS) -> DataFrame:
    """(doc_id, row, runs): of each document (row: its text's hash) that loses words, the runs (begin, end) of word numbers to remove; they may overlap."""
    with Scratch(docs.sparkSession) as kept:
        spans = kept(_spans(docs, window, anchor))
        shared = spans.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("anchor")
        found = kept(spans.join(kept(shared).hint("merge"), "anchor"))
        distinct = found.groupBy("anchor", "span").agg(F.min(F.struct("doc_id", "row", "first")).alias("at"), F.first("n").alias("n"))
        cuts = distinct.select("at.doc_id", "at.row", F.struct(F.col("at.first").alias("first"), "n", "anchor", "span", F.col("at.doc_id").alias("least")).alias("cut"))
        cuts = kept(cuts.groupBy("doc_id", "row").agg(F.collect_list("cut").alias("cuts")))  # of one document
        # Repeated rows give their spans more than once, which changes nothing in an automaton.
        cut = kept(_texts(docs, cuts, window))
        matched = _match(cut, window, [(anchor + window) // 2, window], shard_spans, kept).withColumnRenamed("n", "many")
        matched = found.join(matched.hint("merge"), ["anchor", "span"]).filter("least < doc_id")
        matched = matched.select("doc_id", "row", (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("begin") + F.col("many") - 1 + window).alias("end"))
        return written(matched.groupBy("doc_id", "row").agg(F.collect_set(F.struct("begin", "end")).alias("runs")))  # of one document


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False, **how: int) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space), and with ``with_text`` the kept words themselves."""
    runs = repeated_runs(docs, window, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch["text"])
            cut = batch["runs"].to_pylist()
            view = memoryview(raw)
            n, gone, sums, texts = [], [], [], []
            for i, j, part, at in chunks(raw, offs):
                some = [k for k in range(i, j) if cut[k]]
                w = scan(part, at) if some else None
                for k in range(i, j):
                    if not cut[k]:
                        words = bytes(view[offs[k] : offs[k + 1]]).split()
                        lost = 0
                        total = len(words)
                    else:
                        a, b = w.first[k - i], w.first[k - i + 1]
                        total = int(b - a)
                        begin = np.minimum([r["begin"] for r in cut[k]], total)
                        hit = covered(total, begin, np.minimum([r["end"] for r in cut[k]], total))
                        lost = int(np.count_nonzero(hit))
                        keep = np.flatnonzero(~hit) + a
                        words = [part[s:e].tobytes() for s, e in zip(w.starts[keep], w.ends[keep], strict=True)]
                    text = b" ".join(words)
                    n.append(total)
                    gone.append(lost)
                    sums.append(hashlib.sha256(text).hexdigest())
                    if with_text:
                        texts.append(text.decode())
            columns, names = [batch["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return _columns(docs).join(runs.hint("merge"), ["doc_id", "row"], "left").select("doc_id", "text", "runs").mapInArrow(run, schema)
