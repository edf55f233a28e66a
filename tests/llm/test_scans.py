"""Decontamination, repetition rules and BPE against brute force on small fixtures."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import numpy as np
import pytest
from tokenizers import Tokenizer

from chronolith.llm import bpe_backtrack, decontaminate, repetition_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PATH = public_tokenizers.path("word_bpe_49k.json")


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocab = ["the", "of", "Été", "naïve", "日本", "x1", "a-b", "!!", "%%%", "$5", "<|endoftext|>", "don't", "it", "was", "Ünï"]
    docs = [None, "", " \n\t", "one", "one one", "a\n\na\n a\na", "x " * 400, "\r\n".join(["same line here"] * 5), "é" * 3000]
    for _ in range(n):
        docs.append("".join(rng.choice(vocab) + rng.choice([" ", "  ", "\n", "\t", " "]) for _ in range(rng.randint(1, 120))))
    docs += docs[-5:]
    return docs


def lowered(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def frame(spark, docs):
    rows = [(i, t, "en", "s", len(t or ""), i) for i, t in enumerate(docs)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, item_id long").repartition(3)


def brute_contamination(text, items, size=10):
    words = ALNUM.findall(lowered(text or ""))
    hit, found = [False] * len(words), set()
    for name, t in items:
        seq = ALNUM.findall(lowered(t or ""))
        wins = [seq[i : i + size] for i in range(len(seq) - size + 1)] if len(seq) >= size else [seq] if seq else []
        for win in wins:
            for i in range(len(words) - len(win) + 1):
                if words[i : i + len(win)] == win:
                    found.add(name)
                    hit[i : i + len(win)] = [True] * len(win)
    return len(words), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_decontaminate(spark, limit):
    rng = random.Random(5)
    docs = corpus()
    items = [(i, t) for i, t in enumerate([None, "", "!!", "it", "The Of", " ".join(f"w{k}" for k in range(30)), " ".join(f"w{k}" for k in range(10)), "it"])]
    long = [f"w{k}" for k in range(30)]
    for _ in range(10):
        a = rng.randint(0, 25)
        docs.append("Lead IN " + ", ".join(long[a : a + rng.randint(5, 20)]).upper() + " tail of")
    got = decontaminate.scan_documents(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=limit).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_contamination(docs[r.doc_id], [(str(a), b) for a, b in items]), r


def test_decontaminate_filters_and_empty(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    docs = frame(spark, ["keep A", "x a B c-d e f g h i j, y", None])
    assert sorted(r.doc_id for r in decontaminate.remove_documents(docs, bench).collect()) == [0, 2]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert cut == {0: "keep A", 1: "x , y", 2: None}
    assert decontaminate.scan_documents(docs.limit(0), bench).count() == 0
    assert decontaminate.scan_documents(docs, bench.limit(0)).filter("contaminated").count() == 0


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_decontaminate_alike_at_every_size(spark, limit):
    item = "a b c d e f g h i j"
    bench = spark.createDataFrame([(1, item), (1, item + " k"), (None, item), (None, "q r")], "item_id long, text string").repartition(2)
    docs = frame(spark, ["keep A", "x a B c-d e f g h i j, y", None, "Q! r", "keep A", "", "a b c, a b c d e f g h i j k"])
    got = {r.doc_id: (r.n_items, r.items_sha256) for r in decontaminate.scan_documents(docs, bench, broadcast_bytes=limit).collect()}
    sha = lambda names: hashlib.sha256(names.encode()).hexdigest()
    assert {i: got[i] for i in (0, 1, 3, 6)} == {0: (0, sha("")), 1: (3, sha("1,1,null")), 3: (1, sha("null")), 6: (3, sha("1,1,null"))}
    kept = decontaminate.remove_documents(docs, bench, broadcast_bytes=limit)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 5]
    cut = decontaminate.remove_spans(docs, bench, broadcast_bytes=limit)
    assert cut.schema == docs.schema and {r.doc_id: r.text for r in cut.collect()} == {0: "keep A", 1: "x , y", 2: None, 3: "", 4: "keep A", 5: "", 6: "a b c, "}


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_one_window_in_many_items(spark, limit):
    """Boilerplate in 3000 items, in a document that repeats it, and a very long text without a hit."""
    item = "a b c d e f g h i j"
    bench = spark.createDataFrame([(i, f"{item} only{i}") for i in range(3000)] + [(9000, "k l m n o p q r s t")], "item_id long, text string").repartition(3)
    docs = frame(spark, [f"{item} / " * 50, "k l m n o p q r s t, " + item, "word " * 300_000, "b c d e f g h i j only7 x"])
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.scan_documents(docs, bench, broadcast_bytes=limit).collect()}
    every = sorted(map(str, range(3000)))
    sha = lambda names: hashlib.sha256(",".join(names).encode()).hexdigest()
    assert got == {0: (500, 3000, sha(every)), 1: (20, 3001, sha(sorted([*every, "9000"]))), 2: (0, 0, sha([])), 3: (10, 1, sha(["7"]))}


def test_windows_of_one_hash(monkeypatch):
    """Windows that only their hash confuses are told apart by their words."""
    monkeypatch.setattr(decontaminate.Rolling, "of", lambda self, a, b: np.full(len(a), 5, np.uint64))
    monkeypatch.setattr(decontaminate.Rolling, "windows", lambda self, k: np.full(max(0, len(self.sums) - k), 5, np.uint64))
    ngrams = decontaminate.NgramSet(["x", "y", "z"], ["a b", "c d e", "a b"], 2)
    text = np.frombuffer(b"a b c d q d e", np.uint8)
    a, b, items = ngrams.hits(decontaminate.scan(text, np.array([0, len(text)]), decontaminate.NOT_ALNUM))
    assert a.tolist() == [0, 2, 5] and [x.tolist() for x in items] == [[0, 2], [1], [1]]


def brute_rules(text):
    words = WORD.findall(text or "")
    n = len(words)
    wins = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    hit = [False] * n
    lcp = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                lcp[i] = max(lcp[i], k)
    for i in range(n - 4):
        if wins[tuple(words[i : i + 5])] > 1:
            hit[i : i + 5] = [True] * 5
    cov = [False] * n
    for i in range(n):
        if lcp[i] >= repetition_rules.MIN_REPEAT:
            cov[i : i + lcp[i]] = [True] * lcp[i]
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = n < 10 or 100 * sum(hit) > 20 * n
    kept = not failed and sum(cov) <= repetition_rules.MAX_COVERED * n and max(lcp, default=0) <= repetition_rules.MAX_LONGEST
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, sum(hit), failed, sum(cov), max(lcp, default=0), kept


def test_repetition_rules(spark):
    docs = corpus(3, 40)
    got = repetition_rules.measure(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[1:] == brute_rules(docs[r.doc_id]), r
    kept = {r.doc_id for r in got if r.kept}
    assert {r.doc_id for r in repetition_rules.keep_documents(frame(spark, docs)).collect()} == kept
    assert repetition_rules.measure(frame(spark, docs).limit(0)).count() == 0


def test_bpe_is_the_librarys(spark):
    docs = corpus(7, 40) + ["ΑΣ Σas İx ǅ ﬁ é 한 ½²", "a\x1cb\x85c\xa0d", "<|endoftext|>x<|startoftext|>", "the" * 3000, "𝒜 'S 'll"]
    tk = Tokenizer.from_file(PATH)
    got = bpe_backtrack.encode_documents(frame(spark, docs), PATH, keep_ids=True).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = tk.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_backtrack.encode_documents(frame(spark, docs).limit(0), PATH).count() == 0
