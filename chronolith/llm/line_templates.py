"""Line dedup by log templates.

Lines are parsed by a tree of fixed depth: the number of words leads to a branch, the
first ``DEPTH`` words to a leaf. Words with variable fields (digits, mail addresses,
URLs) are generalised first, whatever they hold. In a leaf, a word stays in its place of
the template if lines of at least ``MIN_DOCS`` documents have it there; else the place
is generalised too. A template with fewer than ``SAME`` of its places left, or of its
places past the first ``DEPTH``, which all lines of a leaf share, is too vague, and lines
stand for themselves, with their variable fields generalised; lines of mostly variable
fields, such as rows of numbers, stand for themselves as they are.

Templates found in at least ``MIN_DOCS`` documents recur. Their lines are dropped, but
with ``keep_first`` those of the smallest doc_id stay, so nothing is lost altogether.

Texts are scanned once, into rows of (document, distinct line) with hashes, and shuffled
once, when the result is put back into them. Words' hashes travel with the rows, apart
from all other steps. Counts are summed before shuffles, and what rows are joined with
is a table of its own, so that Spark can split hot leaves and templates among tasks.

Defined results: a null text has no lines and stays null; lines without a word stay,
unless no line with a word is left, when the text becomes empty; rows that share a
doc_id count as one document, and each repeated row loses the same lines; a null doc_id
loses no lines and makes no template recur; an empty table gives an empty result;
``drop_lines`` keeps all other columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, written
from .wordscan import Rolling, Words, chunks, mix, scan, utf8

DEPTH = 3
MIN_DOCS = 5
SAME = 0.5
_DIGITS = np.zeros(256, bool)
_DIGITS[0x30:0x3A] = True
_FIELD = np.uint64(0x5851F42D4C957F2D)
#: Stands for a variable field, or a place that is generalised, among the 32-bit hashes of words.
FIELD = 0


class Lines:
    """The lines with a word of some documents, and their words' hashes with variable fields generalised."""

    def __init__(self, part: np.ndarray, at: np.ndarray):
        w: Words = scan(part, at)
        self.hashes = w.hashes()
        variable = np.zeros(len(part), bool)
        if len(part):
            variable = _DIGITS[part] | (part == 0x40)
            variable[:-2] |= (part[:-2] == 0x3A) & (part[1:-1] == 0x2F) & (part[2:] == 0x2F)
        sums = np.concatenate([[0], np.cumsum(variable)])
        is_field = sums[w.ends] > sums[w.starts]
        raw = self.hashes.copy()
        self.hashes[is_field] = _FIELD
        breaks = np.concatenate([[0], np.cumsum(part == 10)])
        doc, line = w.doc(), breaks[w.starts]
        self.heads = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])]) if len(line) else np.zeros(0, np.int64)
        self.tails = np.r_[self.heads[1:], len(line)] if len(line) else self.heads
        self.is_field = is_field
        self.doc = doc[self.heads]
        self.number = line[self.heads] - breaks[at[self.doc]]  # in its document, from 0
        size = self.tails - self.heads
        rolling = Rolling(self.hashes)
        self.masked = rolling.of(self.heads, self.tails).view(np.int64)
        self.leaf = mix(rolling.of(self.heads, self.heads + np.minimum(size, DEPTH)) + size.astype(np.uint64)).view(np.int64)
        fields = np.concatenate([[0], np.cumsum(is_field)])
        vague = fields[self.tails] - fields[self.heads] > (1 - SAME) * size
        self.mined = ~vague & (size > DEPTH)  # lines whose template can differ from others of the leaf
        if vague.any():  # mostly fields, such as rows of numbers: as they are, each in a leaf of its own
            whole = Rolling(raw).of(self.heads[vague], self.tails[vague])
            self.masked[vague] = mix(whole + _FIELD).view(np.int64)
            self.leaf[vague] = mix(whole ^ _FIELD).view(np.int64)

    def words(self, which: np.ndarray) -> pa.Array:
        """The words' hashes of these lines, of 32 bits each; null for lines that are not mined."""
        short = (self.hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
        short[short == FIELD] = 1
        short[self.is_field] = FIELD
        size = np.where(self.mined[which], (self.tails - self.heads)[which], 0)
        ends = np.cumsum(size)
        at = np.arange(int(size.sum())) + np.repeat(self.heads[which] - (ends - size), size)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(short[at]), mask=pa.array(~self.mined[which]))


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.hash("text"))


def _occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, row, leaf, masked, numbers, words): the distinct generalised lines of each document, where they are, and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch["text"])
            for i, _, part, at in chunks(raw, offs):
                lines = Lines(part, at)
                order = np.lexsort((lines.number, lines.masked, lines.doc))
                doc, masked = lines.doc[order], lines.masked[order]
                heads = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (masked[1:] != masked[:-1])]) if len(order) else order
                numbers = pa.ListArray.from_arrays(pa.array(np.r_[heads, len(order)], pa.int32()), pa.array(lines.number[order], pa.int32()))
                of = pa.array(doc[heads] + i)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(of), batch["row"].take(of), pa.array(lines.leaf[order][heads]), pa.array(masked[heads]), numbers, lines.words(order[heads])], ["doc_id", "row", "leaf", "masked", "numbers", "words"])

    return _columns(docs).filter("doc_id is not null").mapInArrow(run, "doc_id long, row int, leaf long, masked long, numbers array<int>, words array<int>")


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, same: float = SAME, keep_first: bool = True) -> DataFrame:
    """(doc_id, row, numbers): of each document that loses lines, their numbers."""
    with Scratch(docs.sparkSession) as kept:
        all_lines = kept(_occurrences(docs))
        leaves = all_lines.groupBy("leaf").agg(F.count("*").alias("n"), (F.min("masked") == F.max("masked")).alias("one")).filter(F.col("n") >= min_docs)
        found = kept(all_lines.drop("words").join(kept(leaves.select("leaf", "one")).hint("merge"), "leaf"))
        # Of leaves with several lines: where one example of each is, and how many documents have it.
        several = found.filter("not one").groupBy("leaf", "masked").agg(F.countDistinct("doc_id").alias("docs"), F.min(F.struct("doc_id", "row")).alias("at"))
        several = kept(several.select("leaf", "masked", "at.*", "docs"))
        examples = all_lines.filter("words is not null").drop("numbers").join(several.hint("merge"), ["leaf", "masked", "doc_id", "row"])
        examples = kept(examples.dropDuplicates(["leaf", "masked"]).select("leaf", "masked", "docs", "words"))
        placed = examples.select("leaf", "masked", "docs", F.posexplode("words").alias("place", "word"))
        common = kept(placed.groupBy("leaf", "place", "word").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("leaf", "place", "word", F.lit(True).alias("stays")))
        general = placed.join(common.hint("merge"), ["leaf", "place", "word"], "left").withColumn("word", F.when(F.col("stays"), F.col("word")).otherwise(F.lit(FIELD)))
        general = general.groupBy("leaf", "masked").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("t"))  # of one line
        stays = F.transform("t", lambda x: x["word"] != FIELD)
        left, past = F.size(F.filter(stays, lambda x: x)), F.size(F.filter(stays, lambda x, k: x & (k >= DEPTH)))  # past the leading words
        clear = (left >= same * F.size("t")) & (past >= same * (F.size("t") - DEPTH))
        general = kept(general.filter(clear).select("leaf", "masked", F.xxhash64("leaf", F.transform("t", lambda x: x["word"])).alias("template")))
        lines = found.join(general.hint("merge"), ["leaf", "masked"], "left")
        lines = kept(lines.select("doc_id", "row", "leaf", F.coalesce("template", "masked").alias("template"), "numbers"))
        recurring = lines.select("leaf", "template", "doc_id").distinct().groupBy("leaf", "template").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc")).filter(F.col("docs") >= min_docs)
        gone = lines.join(kept(recurring.select("leaf", "template", "first_doc")).hint("merge"), ["leaf", "template"])
        if keep_first:
            gone = gone.filter("doc_id <> first_doc")
        return written(gone.groupBy("doc_id", "row").agg(F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("numbers")))  # of one document


def _without(text: bytes, numbers: list[int]) -> bytes:
    gone = set(numbers)
    kept = [line for k, line in enumerate(text.split(b"\n")) if k not in gone]
    return b"\n".join(kept) if any(line.split() for line in kept) else b""


def drop_lines(docs: DataFrame, **how: float) -> DataFrame:
    """The rows of ``docs``, with all columns, and texts without the lines of recurring templates."""
    k, kind = docs.columns.index("text"), docs.schema
    joined = docs.withColumns({"chronolith_row": F.hash(F.col("text").cast("string")), "chronolith_id": F.col("doc_id").cast("long")})
    gone = recurring_lines(docs, **how).toDF("chronolith_id", "chronolith_row", "chronolith_gone")
    joined = joined.join(gone.hint("merge"), ["chronolith_id", "chronolith_row"], "left").select(*docs.columns, "chronolith_gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(batch.num_columns - 1)
            lists, texts = gone.to_pylist(), batch.column(k).to_pylist()
            cut = [t if not g else _without(t.encode(), g).decode() for t, g in zip(texts, lists, strict=True)]
            columns = [pa.array(cut, batch.schema.field(k).type) if c == k else batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, kind)


def line_report(docs: DataFrame, **how: float) -> DataFrame:
    """One row per document: doc_id, n_lines (with a word), n_dropped and kept_sha256 (of the text that is left; null: empty)."""
    gone = recurring_lines(docs, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch["text"])
            lists, counts, lost, sums, view = batch["numbers"].to_pylist(), [], [], [], memoryview(raw)
            for i, j, part, at in chunks(raw, offs):
                counts += np.bincount(Lines(part, at).doc, minlength=j - i).tolist()
            for r, numbers in enumerate(lists):
                text = bytes(view[offs[r] : offs[r + 1]])
                lost.append(len(numbers or ()))
                sums.append(hashlib.sha256(_without(text, numbers) if numbers else text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(sums, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return _columns(docs).join(gone.hint("merge"), ["doc_id", "row"], "left").select("doc_id", "text", "numbers").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
