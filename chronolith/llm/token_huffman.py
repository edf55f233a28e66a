"""Token ids as files of canonical, length-limited Huffman codes.

Format. A folder holds two Parquet tables as envelopes of binary data.

* ``codebook``: one row: ``lengths``, a byte for each id from 0 on, its code's length in
  bits or 0. Codes are canonical: numbered upwards by (length, id).
* ``segments``: rows of whole documents in ascending order: ``first_token`` (ids of all
  documents before), ``doc_ids``, ``n_tokens`` of each, ``payload`` (codes from the
  highest bit on, as big-endian 64-bit words) and ``checkpoints`` (little-endian 64-bit
  bit offsets of each ``BLOCK`` ids). Each block can be read on its own: a table over
  the next ``limit`` bits gives an id and its length, and all blocks of many segments
  advance together.

Writing takes one shuffle, of the texts by range of doc_id. Ids are found once and kept
in the shared folder while their counts are summed; what goes to the driver are one
total for each task and one count for each id of the vocabulary.

Defined results: null texts are empty (just the end id); null doc_ids come first;
documents of the same doc_id are ordered by their text's hash; an empty table gives no
segment and an empty codebook; other columns are ignored. Texts are encoded some
megabyte at a time, so memory goes with that and the longest text. Words are told apart
by 64-bit hashes.
"""

from __future__ import annotations

import array
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_backtrack import tokenizer_text
from .storage import drop, shared_dir, written
from .wordscan import chunks, scan, utf8
from .wordtable import WordIds

END_ID = 1
#: Bits of the longest code, and ids between checkpoints.
LIMIT, BLOCK = 20, 512
#: A segment ends with the document that brings it to so many ids.
SEGMENT = 1 << 16
#: Parts of words that a worker keeps the ids of, about 190 bytes each; the table is emptied when full.
PARTS_KEPT = 300_000
#: Words of letters that the library is asked for as one text.
JOINED = 1000
#: Ids that are decoded together.
TOGETHER = 1 << 21


#: The steps before the model of tokenizer files whose texts can be asked for word by word (fixed values of such files).
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_WORD_END = "</w>"
#: Letters between runs of ASCII signs other than the apostrophe.
_PARTS = re.compile(r"([!-&(-/:-@\[-`{-~]*)([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")


class LibraryWords:
    """Texts to their ids, found by the tokenizers library.

    Where the file's steps before the model are ``_NORMALIZERS`` and ``_SPLIT``, a text's
    ids are those of its words in turn, which are kept in a table:

    * No step has to do with white space but to cut at it.
    * ASCII letters are lower-cased by the file, so words that differ in them have the same ids.
    * Runs of letters and runs of other signs are pieces of their own. Each piece ends
      with an id of a token with ``_WORD_END``, and no other id is of one. A letter that
      the file's normalizer turns into a letter and a mark, or that the library does not
      take for one, would join a sign beside it; ``_stands_alone`` asks the library, and
      words with such letters are asked for whole.

    So words of letters are asked for many at once, as one text, and its ids are cut after
    word ends. If these are not as many as the words, each word is asked for on its own,
    as are words with digits and apostrophes. Other files are asked for whole texts.
    """

    def __init__(self, text: str, specials_are_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(text)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.whole.encode_special_tokens = specials_are_text
        self.bare = Tokenizer.from_str(self.whole.to_str())  # for lower-case ASCII letters, on which the normalizer does nothing
        self.bare.normalizer = None
        spec = json.loads(text)
        model, steps = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        bytes_only = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        self.by_word = (spec["normalizer"] or {}).get("normalizers") == _NORMALIZERS and len(steps) == 2 and steps[0] == _SPLIT and steps[1].items() >= bytes_only.items() and model.get("end_of_word_suffix") == _WORD_END and not model.get("continuing_subword_prefix")
        self.parts: dict[str, bytes] = {}
        self.alone: dict[str, bool] = {}  # by letter, at most as many as Unicode has
        self.words = WordIds(self.learn)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)), re.IGNORECASE) if special else None
        names = self.whole.get_vocab(with_added_tokens=False)
        self.is_end = np.zeros(max(names.values()) + 1, bool)
        self.is_end[[i for t, i in names.items() if t.endswith(_WORD_END)]] = True

    def encode(self, part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of the texts at ``at`` in the bytes ``part``, and where each text's begin and end."""
        if not self.by_word:
            view = memoryview(part)
            blobs = self._ask([bytes(view[a:b]).decode() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)])
            return np.frombuffer(b"".join(blobs), "<u4"), np.cumsum([0, *(len(x) // 4 for x in blobs)])
        return self.words.encode(scan(part, at))

    def _ask(self, texts: list[str], bare: bool = False) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in (self.bare if bare else self.whole).encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, by their parts."""
        if len(self.parts) > PARTS_KEPT:
            self.parts.clear()
        parts, fit, special = self.parts, _PARTS.fullmatch, self.special.search if self.special else lambda t: None
        cut: list[tuple[str, ...]] = []
        for w in words:
            t = w.decode()
            low = t.lower() if t.isascii() else t
            if low.isalpha():
                cut.append((low,))
            elif special(low):
                cut.append((t,))
            else:
                found = fit(low)
                cut.append(found.groups() if found and (found[2].isascii() or all(map(self._stands_alone, found[2]))) else (low,))
        self._learn([p for p in set().union(*cut) if p and p not in parts])
        parts[""] = b""
        return [parts[c[0]] if len(c) == 1 else parts[c[0]] + parts[c[1]] + parts[c[2]] for c in cut]

    def _stands_alone(self, letter: str) -> bool:
        """Whether the library keeps a letter, as it is after the normalizer, apart from the signs beside it."""
        found = self.alone.get(letter)
        if found is None:
            text, cut = self.whole.normalizer.normalize_str(letter), self.whole.pre_tokenizer.pre_tokenize_str
            after, before = cut(text + "."), cut("." + text)
            found = self.alone[letter] = len(after) == len(before) == 2 and after[1][0] == before[0][0] == "."
        return found

    def _learn(self, parts: list[str]) -> None:
        plain = [p for p in parts if p.isalpha()]
        alone = [p for p in parts if not p.isalpha()]
        for bare in (True, False):
            some = [p for p in plain if p.isascii() is bare]  # lower-case, where ASCII
            groups = [some[i : i + JOINED] for i in range(0, len(some), JOINED)]
            for group, text in zip(groups, self._ask([" ".join(g) for g in groups], bare), strict=True):
                ends = 4 * (np.flatnonzero(self.is_end[np.frombuffer(text, "<u4")]) + 1)
                if len(ends) != len(group):
                    alone += group
                    continue
                a = 0
                for p, b in zip(group, ends.tolist(), strict=True):
                    self.parts[p] = text[a:b]
                    a = b
        for i in range(0, len(alone), 20_000):
            for p, ids in zip(alone[i : i + 20_000], self._ask(alone[i : i + 20_000]), strict=True):
                self.parts[p] = ids


_tables: dict[tuple[int, bool], LibraryWords] = {}


def library_words(text: str, specials_are_text: bool = False) -> LibraryWords:
    """The table for a tokenizer file's text; a worker keeps one."""
    key = hash(text), specials_are_text
    if key not in _tables:
        _tables.clear()
        _tables[key] = LibraryWords(text, specials_are_text)
    return _tables[key]


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Of each id the bits of its code: the best under the limit, by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 2:
        out[used] = 1
        return out
    limit = max(limit, (n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.float64)
    level, is_id = coins, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([coins, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        is_id.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_id):
        singles = int(np.count_nonzero(flags[:take]))
        lengths[:singles] += 1
        take = 2 * (take - singles)
    out[order] = lengths
    return out


class Code:
    """The canonical code of some lengths: encodes, and decodes by a table."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        used = used[np.argsort(lengths[used], kind="stable")]
        bits = self.lengths[used]
        self.limit = int(bits.max(initial=1))
        spans = np.int64(1) << (self.limit - bits)
        begins = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[used] = (begins >> (self.limit - bits)).astype(np.uint64)
        size = 1 << self.limit
        self.symbol, self.step = np.zeros(size, np.uint32), np.ones(size, np.uint8)
        full = int(spans.sum())
        self.symbol[:full] = np.repeat(used, spans)
        self.step[:full] = np.repeat(bits, spans)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit words, bit offsets of each BLOCK ids)."""
        if not len(ids):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        code, size = self.codes[ids], self.lengths[ids]
        end = np.cumsum(size)
        begin = end - size
        word = begin >> 6
        room = 64 - (begin & 63) - size
        fits = room >= 0
        shifted = np.where(fits, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words = np.zeros((int(end[-1]) + 63) // 64 + 1, np.uint64)
        words[word[heads]] = np.add.reduceat(shifted, heads)
        over = np.flatnonzero(~fits)
        words[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
        return words[:-1], begin[::BLOCK]

    def decode(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of blocks that begin at bits ``starts`` and have ``sizes`` ids, one block after the other. All blocks advance by an id at a time."""
        if not len(starts):
            return np.zeros(0, np.uint32)
        words = np.concatenate([words, np.zeros(2, np.uint64)])
        last, at = len(words) - 2, starts.astype(np.int64)
        out = np.empty((int(sizes.max()), len(starts)), np.uint32)
        drop_bits, one = np.uint64(64 - self.limit), np.uint64(1)
        for k in range(len(out)):
            w = np.minimum(at >> 6, last)
            off = (at & 63).astype(np.uint64)
            ahead = ((words[w] << off) | ((words[w + 1] >> one) >> (np.uint64(63) - off))) >> drop_bits
            out[k] = self.symbol[ahead]
            at += self.step[ahead]
        if (sizes == len(out)).all():
            return out.T.ravel()
        return out.T[np.arange(len(out))[None, :] < sizes[:, None]]


def _segments(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Documents in order, as rows of whole documents with their ids."""
    held = docs.sparkSession.sparkContext.broadcast(tokenizer)
    narrow = max(end_id, _highest(tokenizer)) < 1 << 16
    kind = "<u2" if narrow else "<u4"
    end = np.array([end_id], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = library_words(held.value), TaskContext.get().partitionId()
        names, sizes, blobs, count, before = [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([count], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(blobs)], pa.binary())],
                ["part", "before", "total", "doc_ids", "n_tokens", "ids"],
            )

        for batch in batches:
            raw, offs = utf8(batch["text"])
            for i, j, piece, at in chunks(raw, offs):
                ids, ends = table.encode(piece, at)
                flat, wide = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
                for name, a, b in zip(batch["doc_id"].slice(i, j - i).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    names.append(name)
                    sizes.append(b - a + 1)
                    blobs.append(flat[wide * a : wide * b] + end)
                    count += b - a + 1
                    if count >= SEGMENT:
                        yield row()
                        before += count
                        names, sizes, blobs, count = [], [], [], 0
        if names:
            yield row()

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = columns.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, "part int, before long, total long, doc_ids array<long>, n_tokens array<long>, ids binary").withColumn("width", F.lit(2 if narrow else 4))


def _highest(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokenizer).get_vocab_size(with_added_tokens=True) - 1


def _numbers(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, f"<u{width}")


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, limit: int = LIMIT) -> None:
    """Encodes every whole text, ends it with ``end_id``, and writes the files of the format to the new folder ``path``."""
    spark = docs.sparkSession
    tokenizer = tokenizer_text(tokenizer_path)
    kept = shared_dir(spark)
    segments = written(_segments(docs, tokenizer, end_id), kept, compression="zstd")
    totals = sorted(segments.groupBy("part").agg(F.sum("total").alias("n")).collect())  # one row for each task
    offsets, sofar = [], 0
    for r in totals:
        offsets.append((r["part"], sofar))
        sofar += r["n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0, np.int64)
        for batch in batches:
            for blob, width in zip(batch["ids"].to_pylist(), batch["width"].to_pylist(), strict=True):
                got = np.bincount(_numbers(blob, width), minlength=len(sums))
                got[: len(sums)] += sums
                sums = got
        ids = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums[ids])], ["id", "n"])

    counted = segments.select("ids", "width").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most one row for each id of the vocabulary
    counts = np.zeros(max((r["id"] for r in counted), default=-1) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, limit)
    held = spark.sparkContext.broadcast(lengths)
    spark.createDataFrame([(bytearray(lengths.tobytes()), BLOCK)], "lengths binary, block int").coalesce(1).write.parquet(f"{path}/codebook")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(held.value)
        for batch in batches:
            payload, marks = [], []
            for blob, width in zip(batch["ids"].to_pylist(), batch["width"].to_pylist(), strict=True):
                words, begins = code.encode(_numbers(blob, width))
                payload.append(words.astype(">u8").tobytes())
                marks.append(begins.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch["first_token"], batch["doc_ids"], batch["n_tokens"], pa.array(payload, pa.binary()), pa.array(marks, pa.binary())], ["first_token", "doc_ids", "n_tokens", "payload", "checkpoints"])

    if offsets:
        placed = segments.join(F.broadcast(spark.createDataFrame(offsets, "part int, offset long")), "part").withColumn("first_token", F.col("before") + F.col("offset"))
        placed.select("first_token", "doc_ids", "n_tokens", "ids", "width").mapInArrow(encode, _FILE).write.option("compression", "none").parquet(f"{path}/segments")
    else:
        spark.createDataFrame([], _FILE).write.parquet(f"{path}/segments")
    drop(spark, kept)


_FILE = "first_token long, doc_ids array<long>, n_tokens array<long>, payload binary, checkpoints binary"


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files at ``path``: doc_id, start, n_tokens, ids_crc32, and with ``with_ids`` also ids array<int>."""
    book = spark.read.parquet(f"{path}/codebook").first()
    held, block = spark.sparkContext.broadcast(np.frombuffer(bytes(book["lengths"]), np.uint8)), book["block"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(held.value)
        for batch in batches:
            totals = [sum(x) for x in batch["n_tokens"].to_pylist()]
            at = 0
            while at < len(totals):
                end, n = at, 0
                while end < len(totals) and (end == at or n + totals[end] <= TOGETHER):
                    n += totals[end]
                    end += 1
                yield _decoded(code, block, batch.slice(at, end - at), totals[at:end], with_ids)
                at = end

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return spark.read.schema(_FILE).parquet(f"{path}/segments").mapInArrow(decode, schema)


def _decoded(code: Code, block: int, batch: pa.RecordBatch, totals: list[int], with_ids: bool) -> pa.RecordBatch:
    words, starts, sizes, bits = [], [], [], 0
    for payload, marks, n in zip(batch["payload"].to_pylist(), batch["checkpoints"].to_pylist(), totals, strict=True):
        words.append(np.frombuffer(payload, ">u8").astype(np.uint64))
        begins = np.frombuffer(marks, "<i8")
        starts.append(begins + bits)
        sizes.append(np.minimum(block, n - block * np.arange(len(begins))))
        bits += 64 * len(words[-1])
    ids = code.decode(np.concatenate(words), np.concatenate(starts), np.concatenate(sizes))
    n = np.concatenate([np.asarray(x, np.int64) for x in batch["n_tokens"].to_pylist()])
    inner = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(np.array(batch["first_token"].to_pylist(), np.int64) - (np.cumsum(totals) - totals), [len(x) for x in batch["doc_ids"].to_pylist()])
    view = memoryview(ids.astype("<u4").tobytes())
    sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(inner.tolist(), inner[1:].tolist(), strict=False)]
    columns = [batch["doc_ids"].flatten(), pa.array(inner[:-1] + first), pa.array(n), pa.array(sums, pa.int64())]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        columns.append(pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(ids.view(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)
