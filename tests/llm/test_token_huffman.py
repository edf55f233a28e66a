"""The id files: exact round trip, the order, and the code against a plain Huffman code."""

import heapq
import random
import struct
import unicodedata
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from chronolith.llm import token_huffman as th
from chronolith.llm import wordtable
from chronolith.llm.storage import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def test_lengths_and_round_trip_of_the_code():
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (2, 5), (3, 9), (300, 10**6), (1000, 3)):
        counts = rng.integers(0, top, n) ** 2
        counts[0] = 1
        lengths = th.code_lengths(counts, 30)
        used = lengths[lengths > 0].astype(float)
        assert (lengths > 0).sum() == (counts > 0).sum() and (2.0**-used).sum() <= 1
        if (counts > 0).sum() > 1:
            assert (lengths * counts).sum() == plain_cost(counts.tolist())
        limited = th.code_lengths(counts, 10)
        assert limited.max() <= 10 and (2.0 ** -limited[limited > 0].astype(float)).sum() <= 1
        ids = rng.choice(np.flatnonzero(counts), 5000)
        for book in (lengths, limited):
            code = th.Code(book)
            words, marks = code.encode(ids)
            sizes = np.minimum(th.BLOCK, len(ids) - th.BLOCK * np.arange(len(marks)))
            assert (code.decode(words, marks, sizes) == ids).all()


def test_files(spark, monkeypatch):
    monkeypatch.setattr(th, "SEGMENT", 300)
    rng = random.Random(2)
    texts = [None, "", "  ", "<|endoftext|> a", "日本 naïve", "Ends here. " + "long, " * 30_000] + [" ".join(rng.choice(["the", "of", "Zebra", "x9", "don't", "ʼn"]) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    docs = [(i * 3, t, "start") for i, t in enumerate(texts)]
    docs += [docs[9], docs[9], (docs[9][0], "other text", "x")]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string, start string").repartition(5)
    path = shared_dir(spark)
    th.write(frame, PATH, path)
    got = sorted(th.read(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    tk = Tokenizer.from_file(PATH)
    want = sorted((i, tk.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _ in docs)
    assert sorted((r.doc_id, r.ids) for r in got) == want
    assert [r.doc_id for r in got] == sorted(d[0] for d in docs)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(b"".join(struct.pack("<I", i) for i in r.ids))
        at += len(r.ids)


def _blobs(table, texts):
    ids, ends = table.encode(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
    return [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:], strict=False)]


def _same(texts):
    tk = Tokenizer.from_file(PATH)
    table = th.LibraryWords(th.tokenizer_text(PATH))
    for i in range(0, len(texts), 200):
        some = texts[i : i + 200]
        want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in tk.encode_batch(some, add_special_tokens=False)]
        got = _blobs(table, some)
        assert got == want, next(t for t, a, b in zip(some, got, want, strict=True) if a != b)


def _odd_letters():
    """All code points whose composed or lower-case form holds what is not a letter."""
    for i in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        c = chr(i)
        if c.isalpha() and not (unicodedata.normalize("NFC", c).isalpha() and unicodedata.normalize("NFC", c).lower().isalpha()):
            yield c


def test_letters_that_become_marks():
    """Each letter that the normalizer turns into a letter and a mark, before and after every ASCII sign and amid letters."""
    odd = list(_odd_letters())
    assert {"İ", "\u095d", "\u09dc", "\ufb2a"} <= set(odd)
    signs = [chr(i) for i in range(0x21, 0x7F) if not chr(i).isalnum()]
    _same(["BELGESİ. TEKİ, (TCDDİ)", *(" ".join(f"{c}{s} {s}{c} {s}ab{c}{s} a{c}b{s}" for s in signs) for c in odd)])


def test_words_of_all_of_unicode():
    """A million words over all letters, marks, numbers and ASCII signs."""
    rng = np.random.default_rng(9)
    points = [i for i in range(0x21, 0x110000) if not 0xD800 <= i < 0xE000 and not chr(i).isspace()]
    letters = np.array([i for i in points if unicodedata.category(chr(i))[0] == "L"])
    marks = np.array([i for i in points if unicodedata.category(chr(i))[0] in "MN"])
    signs = np.array([i for i in range(0x21, 0x7F) if not chr(i).isalnum()])
    odd = np.array([ord(c) for c in _odd_letters()])
    pools = [letters, np.arange(0x61, 0x7B), np.arange(0x41, 0x5B), np.arange(0xC0, 0x250), signs, signs, marks, odd]
    n, words = 1_000_000, []
    size = rng.integers(1, 6, n)
    kind = rng.choice(len(pools), size.sum(), p=[0.3, 0.2, 0.05, 0.15, 0.15, 0.05, 0.05, 0.05])
    chars = np.zeros(len(kind), np.uint32)
    for k, pool in enumerate(pools):
        here = kind == k
        chars[here] = rng.choice(pool, here.sum())
    flat, at = chars.astype("<u4").tobytes().decode("utf-32-le"), np.cumsum([0, *size])
    words = [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    _same([" ".join(words[i : i + 500]) for i in range(0, n, 500)])


def test_table_of_words_in_two_levels(monkeypatch):
    """Slots against a dict, through merges, and a table that is emptied again and again."""
    monkeypatch.setattr(wordtable, "LEAST", 16)
    rng, slots, want = np.random.default_rng(3), wordtable.Slots(), {}
    for _ in range(200):
        some = np.unique(rng.integers(0, 5000, 40).astype(np.uint64))
        found = slots.find(some)
        assert found.tolist() == [want.get(x, -1) for x in some.tolist()]
        new = some[found < 0]
        slots.add(new, len(want))
        want |= {x: len(want) + i for i, x in enumerate(new.tolist())}


def test_words_as_whole_texts(monkeypatch):
    """Ids by word against whole texts: words with stops, signs on either side, marks that compose, letters whose lower case is two."""
    monkeypatch.setattr(wordtable, "TABLE_BYTES", 40_000)
    tk = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    parts = ["the", "Zebra", "İstanbul", "ΣΑΣ", "e\u0301", "n\u0303o", "=\u0338", "日本", "ﬁne", "x9", "12,345.6", "don't", "'s", "o'", "''tis", "can't've", "...", "?!", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|b", "ʼn", "\u00a0x\u00a0y", "\u200b", "½", "a_b", "_", "e.g.", "(see", '"quoted"', "end.", "end,", "(x)", "Ⅷ", "\u1e9e", "각", "\u1100\u1161", "#1"]
    texts = [" ".join(rng.choice(parts) + rng.choice(["", "", ".", ",", ")", "'", "'s", "\u0301"]) for _ in range(200)) for _ in range(100)] + [f"{a}\t{b}{c}" for a in parts for b in parts for c in (".", "'", "")]
    want = [struct.pack(f"<{len(i)}I", *i) for i in (tk.encode(t, add_special_tokens=False).ids for t in texts)]
    text = th.tokenizer_text(PATH)
    assert th.LibraryWords(text).by_word
    assert _blobs(th.LibraryWords(text), texts) == want
    other = th.LibraryWords(th.tokenizer_text(public_tokenizers.path("byte_bpe_50k.json")))
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_word and _blobs(other, texts[:9]) == [struct.pack(f"<{len(i)}I", *i) for i in (whole.encode(t, add_special_tokens=False).ids for t in texts[:9])]


def test_no_documents(spark):
    path = shared_dir(spark)
    th.write(spark.createDataFrame([], "doc_id long, text string"), PATH, path)
    assert th.read(spark, path).count() == 0
