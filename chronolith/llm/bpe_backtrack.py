"""BPE encoding by backtracking, and decoding by an offset table.

A tokenizer file with merges defines the tokens a piece of text ends up as: merges are
applied in the order of their rank. The same tokens are found from left to right. At
each position take the longest token that matches there (all matches come from one
Aho-Corasick pass over the piece); accept it if it can stand next to the token before,
which depends on the two alone; else try its next shorter prefix that is a token, and
if there is none, step back over the token before and go on with its shorter prefixes.
A position from which no tokens lead to the end is marked and not tried again, so the
work is linear in the piece.

Two tokens are compatible if merging both together in rank order leaves the border
between them: undoing their merges from the last to the first, no pair that meets at
the border may have a merge that comes before those undone. Verdicts are kept in a table.

Texts are cut at ASCII white space, which no token and no step of the normalizer spans;
each distinct word is encoded once for each Python worker, while the bounded table of
words, by their 64-bit hashes, holds it.

Defined results: a null text counts as empty, and has no tokens; special tokens'
strings in a text become their ids, as in the library; repeated rows each get theirs; an
empty table gives an empty result; other columns are ignored, whatever their names. Rows
are worked on some megabyte of text at a time, a longer text on its own.
"""

from __future__ import annotations

import array
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .wordscan import chunks, scan, utf8
from .wordtable import WordIds

#: Pairs of tokens that a worker keeps the verdict of; the table, of about 7 MB, is emptied when full.
PAIRS_KEPT = 50_000
#: How a piece's last symbol differs from the others.
WORD_END = "</w>"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Vocabulary:
    """The tables of one tokenizer file of the BPE kind with word ends and byte-level symbols.

    Inside, a token is a string over 512 characters: a byte, or a byte plus 256 at the
    end of a piece. Only files whose ids are in rank order are taken.
    """

    def __init__(self, text: str):
        import ahocorasick

        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END or spec["decoder"]:
            raise ValueError("not a BPE file with word ends and without a decoder")
        ids = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.names = dict(sorted((i, t) for t, i in ids.items()))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        place = {c: b for b, c in enumerate(byte_symbols())}
        self.split: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        inside: dict[int, str] = {}
        for c, b in place.items():
            inside[ids[c]], inside[ids[c + WORD_END]] = chr(b), chr(b + 256)
        last = max(inside)
        for a, b in merges:
            x, y, t = ids[a], ids[b], ids[a + b]
            if t <= last:
                raise ValueError("ids are not in the order of the merges")
            last = t
            self.split[t], self.merge[x, y], inside[t] = (x, y), t, inside[x] + inside[y]
        self.size = {t: len(s) for t, s in inside.items()}
        self._pairs: dict[int, bool] = {}
        self._old_pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        known = {s: t for t, s in inside.items() if t not in self.split or self._meets(*self.split[t], t)}
        for s, t in known.items():
            self.automaton.add_word(s, t)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        for s, t in known.items():
            self.shorter[t] = next((known[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in known), -1)
        self._shift = max(self.names).bit_length()

    def _meets(self, a: int, b: int, before: int) -> bool:
        """Whether the border between tokens a and b stands, as far as merges before rank ``before`` go."""
        while True:
            if self.merge.get((a, b), before) < before:
                return False
            inner_a, inner_b = self.split.get(a), self.split.get(b)
            # Undo the later of the two merges; in a tie the right one, since equal pairs merge from the left.
            if inner_a and (not inner_b or a > b):
                before, a = a, inner_a[1]
            elif inner_b:
                before, b = b + 1, inner_b[0]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << self._shift | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS_KEPT:
                self._old_pairs, self._pairs = self._pairs, {}
            known = self._old_pairs.get(key)
            if known is None:
                known = self._meets(a, b, 1 << 40)
            self._pairs[key] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The token ids of one piece, a run of bytes that the pre-tokenizer keeps together."""
        n = len(piece)
        text = piece[:-1].decode("latin-1") + chr(256 + piece[-1])
        longest = [-1] * n
        size = self.size
        for end, t in self.automaton.iter(text):  # ends ascend, so the last kept for a start is the longest
            longest[end + 1 - size[t]] = t
        tokens: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token >= 0 and (dead[at + size[token]] or tokens and not self.compatible(tokens[-1], token)):
                token = self.shorter[token]
            if token >= 0:
                tokens.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = tokens.pop()
                at -= size[token]
                token = self.shorter[token]
        return tokens


#: The file's normalizer and pre-tokenizer for words below U+0300, where NFC changes nothing and lower case is plain.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_SPACES = "\x85\xa0"


class Encoder:
    """Texts to their tokens' ids, as the whole tokenizer finds them, by a table of words."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        self.vocabulary, self.words = Vocabulary(text), WordIds(self._learn)
        whole = Tokenizer.from_str(text)
        self.normalize, self.cut = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.place = {c: b for b, c in enumerate(byte_symbols())}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.vocabulary.special)) + ")") if self.vocabulary.special else None

    def pieces(self, text: str) -> Iterator[bytes]:
        if text.isascii() or (max(text) < "̀" and not any(c in text for c in _SPACES)):
            for piece in _PIECES.findall(text.lower()):
                yield piece.encode()
        else:
            for piece, _ in self.cut(self.normalize(text)):
                yield bytes(map(self.place.__getitem__, piece))

    def encode_word(self, word: bytes) -> list[int]:
        text, ids = word.decode(), []
        parts = self.special.split(text) if self.special and b"<|" in word else [text]
        for part in parts:
            if part in self.vocabulary.special:
                ids.append(self.vocabulary.special[part])
            elif part:
                for piece in self.pieces(part):
                    ids += self.vocabulary.encode_piece(piece)
        return ids

    def _learn(self, words: list[bytes]) -> list[bytes]:
        return [array.array("I", self.encode_word(w)).tobytes() for w in words]

    def encode(self, part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of the texts at ``at`` in the bytes ``part``, and where each text's begin and end."""
        return self.words.encode(scan(part, at))


class Decoder:
    """Ids to text: the tokens' bytes lie end to end, and a table holds where each begins. Without a decoder in the file, tokens are joined by a space."""

    def __init__(self, names: dict[int, str]):
        n = max(names) + 1
        parts = [(names[i] + " ").encode() if i in names else b"" for i in range(n)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        begin, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        step = np.ones(ends[-1], np.int64)
        step[0] = begin[0]
        step[ends[:-1]] = begin[1:] - (begin[:-1] + size[:-1] - 1)
        return self.bytes[np.cumsum(step)][:-1].tobytes()


_encoders: dict[str, tuple[Encoder, Decoder]] = {}


def coder(text: str) -> tuple[Encoder, Decoder]:
    """The tables for a tokenizer file's text, built once in each worker."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _encoders:
        encoder = Encoder(text)
        _encoders[key] = encoder, Decoder(encoder.vocabulary.names)
    return _encoders[key]


def tokenizer_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _shared(spark: SparkSession, path: str):
    """The file's text is read by the driver and broadcast: it has a fixed size, about 2 MB."""
    return spark.sparkContext.broadcast(tokenizer_text(path))


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """One row per document, as RESULT, and with ``keep_ids`` also ids array<int>. No shuffle.

    ids_sha256 is of the decimal ids joined by one space; decoded_sha256 is of the text
    that decoding these ids gives.
    """
    held = _shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coder(held.value)
        for batch in batches:
            raw, offs = utf8(batch["text"])
            for i, j, part, at in chunks(raw, offs):
                ids_sum, text_sum = [], []
                found, ends = encoder.encode(part, at)
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    ids = found[a:b]
                    ids_sum.append(hashlib.sha256(str(ids.tolist())[1:-1].replace(",", "").encode()).hexdigest())
                    text_sum.append(hashlib.sha256(decoder.decode(ids)).hexdigest())
                columns = [batch["doc_id"].slice(i, j - i), pa.array(np.diff(ends), pa.int64()), pa.array(ids_sum, pa.string()), pa.array(text_sum, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, RESULT + (", ids array<int>" if keep_ids else ""))
