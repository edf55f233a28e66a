"""Repeated windows against brute force, and the automaton against a search."""

import hashlib
import random
import re

import pytest

from chronolith.llm import substring_automata as sa

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, size):
    words = {}
    for i, t in docs:
        words.setdefault(i, []).append(WORD.findall(t or ""))
    least = {}
    for i, rows in words.items():
        for w in rows if i is not None else ():
            for k in range(len(w) - size + 1):
                key = tuple(w[k : k + size])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, rows in words.items():
        for w in rows:
            hit = [False] * len(w)
            for k in range(len(w) - size + 1) if i is not None else ():
                if least[tuple(w[k : k + size])] < i:
                    hit[k : k + size] = [True] * size
            kept = " ".join(x for x, h in zip(w, hit, strict=True) if not h)
            out.append((i, len(w), sum(hit), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, size):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "é", "the"]) if rng.random() < 0.3 else f"w{rng.randrange(5000)}"
    passages = [[word() for _ in range(rng.choice([size - 1, size, size + 1, 2 * size, 5 * size]))] for _ in range(8)]
    texts = [None, "", "x", "a " * (3 * size), "a " * (2 * size), "a b " * size]
    for _ in range(50):
        t = []
        for _ in range(rng.randint(0, 4)):
            t += [word() for _ in range(rng.randint(0, 40))]
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = word()
            t += p[rng.randrange(5) :] if rng.random() < 0.3 else p
        texts.append("".join(x + rng.choice([" ", "\n", "\t ", " "]) for x in t))
    texts += texts[-6:]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = list(zip(ids, texts, strict=True))
    return [*docs, docs[8], (docs[9][0], docs[10][1]), (None, docs[8][1])]


@pytest.mark.parametrize("size,anchor,shard", [(50, 8, 400), (12, 4, 400), (12, 4, 1)])
def test_remove_repeats(spark, size, anchor, shard):
    docs = corpus(size + shard, size)
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, runs int").repartition(3)
    got = sa.remove_repeats(frame, size, anchor=anchor, shard_spans=shard).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, size)
    assert sum(r.n_removed for r in got) > 0


def test_more_and_empty(spark):
    docs = corpus(3, 12)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sa.remove_repeats(frame, 12, anchor=4).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, 12)
    assert sa.remove_repeats(frame.limit(0)).count() == 0


def test_automaton():
    rng = random.Random(1)
    for _ in range(40):
        refs = [([rng.choice("abc") for _ in range(rng.randint(1, 30))], rng.randrange(9)) for _ in range(5)]
        auto = sa.SuffixAutomaton()
        for words, doc in refs:
            auto.add(words, doc)
        auto.settle()
        query, size = [rng.choice("abcd") for _ in range(60)], rng.randint(1, 6)
        got = auto.stream(query, size)
        for k in range(len(query)):
            cut = query[k - size + 1 : k + 1] if k + 1 >= size else None
            want = min((d for w, d in refs if cut and any(w[i : i + size] == cut for i in range(len(w)))), default=sa.NONE)
            assert got[k] == want
