"""The audit against plain loops over all terms and pairs, and its search's bounds."""

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest

from chronolith.llm import queries, source_divergence as sd

DATA = "/root/testdata/sf0.001"


def brute(docs, top=200):
    """(lang, source, part, item, value, rank) of docs (text, lang, source)."""
    counts, found = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        counts[lang, source].update(terms)
        found[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in found[lang].items() if n >= 3]
        sources = [s for x, s in counts if x == lang]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(n):
            total = sum(n[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (n[t] + 1) // total for t in kept}

        q, by_source = shares(whole), {s: shares(counts[lang, s]) for s in sources}
        for s, p in by_source.items():
            pairs = [(-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), x.encode(), x) for x, o in by_source.items() if x != s]
            terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[t] > q[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(rows)]
    return sorted(out)


def rows_of(frame):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in frame.collect())


def _docs(rng, n, words):
    vocabulary = [rng.choice(["the", "Zebra", "naïve", "日本", "x", "É", "don"]) + "abcdefghij"[rng.randrange(10)] * rng.randint(0, 3) for _ in range(words)]
    out = []
    for _ in range(n):
        source = rng.choice(["a", "a", "b", "c", None, "é", "z"])
        some = [rng.choice(vocabulary[: 10 + 30 * (len(source or "") + ord((source or "q")[0]) % 5)]) for _ in range(rng.choice([0, 1, 5, 60]))]
        out.append((rng.choice([" ", "-", "1", "\n", "_"]).join(some) or rng.choice(["", None, " 1 "]), rng.choice(["en", "en", "fr", None]), source))
    return out


@pytest.mark.parametrize("top,meet,broadcast", [(200, 1 << 20, 100_000), (7, 4, 0)])
def test_against_brute_force(spark, monkeypatch, top, meet, broadcast):
    """Nulls, empty texts, ties, repeated rows, a language without kept terms, a source without terms; joins and small steps alike."""
    monkeypatch.setattr(sd, "MEET", meet)
    monkeypatch.setattr(sd, "HELD", 20 if top == 7 else 400_000)
    docs = _docs(random.Random(top), 400, 150)
    docs += docs[:20] + [("lone words here", "qq", "s1"), ("other words", "qq", "s2"), (None, "en", "silent"), ("the " * 200_000, "en", "long")]
    random.Random(0).shuffle(docs)
    frame = spark.createDataFrame([(*d, 1) for d in docs], "text string, lang string, source string, term int").repartition(5)
    assert rows_of(sd.audit(frame, top=top, broadcast_rows=broadcast)) == brute(docs, top)


def test_search_stops_early_and_finds_all():
    """Best-first search by buckets against all values, batch by batch, with many ties; and it leaves most entries unseen."""
    rng = np.random.default_rng(5)
    p = (1 + rng.zipf(1.3, 50_000).clip(0, 10**6)) * 1000
    q = (p / rng.integers(2, 40, len(p))).astype(np.int64) + 1
    terms = np.array([f"t{i % 9973}-{i}".encode() for i in range(len(p))], object)
    search = sd.Search(50)
    for i in range(0, len(p), 10_000):
        search.offer(("l", "s"), terms[i : i + 10_000], p[i : i + 10_000], q[i : i + 10_000])
    want = sorted(zip((-sd.worth(p, q)).tolist(), terms, strict=True))[:50]
    assert list(zip((-search.values["l", "s"]).tolist(), search.terms["l", "s"], strict=True)) == want
    assert search.evaluated < len(p) / 10


def test_empty_table(spark):
    assert sd.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the driver's tables")
def test_query_equals_its_sql(spark):
    assert oracle.differences(spark, oracle.connect(DATA), queries.op13_source_divergence, sd.ORACLE, DATA) == []
