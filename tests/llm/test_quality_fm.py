"""The machine against the sum over all pairs, and against labels it has not seen."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from chronolith.llm import quality_fm as q

DATA = "/root/testdata/sf0.01"


def test_identity_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    size = q.BUCKETS + len(q.STATS) * (1 + q.BINS)
    m = q.Machine(np.sort(rng.random((len(q.STATS), q.BINS - 1)), axis=1), np.zeros(len(q.STATS)), np.ones(len(q.STATS)), 0.3, rng.normal(size=size), rng.normal(size=(size, q.FACTORS)))
    part = np.frombuffer("the cat sat!! on THE mat | 12 é\nthe cat".encode(), np.uint8)
    at = np.array([0, 0, len(part)])
    doc, index, value = m.rows(*q.features(part, at, np.array([-1, 40])))
    z, _ = m.sums(2, doc, index, value)
    for d in range(2):
        i, x = index[doc == d], value[doc == d].astype(float)
        want = m.bias + (m.linear[i] * x).sum() + sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert abs(want - z[d]) < 1e-5


def plain_features(text, n_chars):
    """The statistics of one text by plain loops, without those that need the words' hashes."""
    raw = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    lines = raw.split(b"\n")
    share = lambda some, of: sum(some) / max(1, of)
    of_bytes = [share([b in kind for b in raw], len(raw)) for kind in (b"#*$%&<>^~@=", b"!?", b"|", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:'\"()-", bytes(range(128, 256)), b" \t\n\x0b\x0c\r")]
    seen, again = set(), 0
    for line in lines:
        key = tuple(line.split())
        again += len(key) * (key in seen)
        seen.add(key)
    marks = [w[-1:] in b"#*$%&<>^~@=!?" or w[:1] == b"|" for w in words]
    shouts = [sum(65 <= b <= 90 for b in w) * 2 > len(w) for w in words]
    return [
        math.log1p(len(raw)) / 14, math.log1p(len(words)) / 12, math.log(len(lines)) / 8, *of_bytes,
        share(map(len, words), len(words)) / 16, share([len(w) > 14 for w in words], len(words)), share([len(w) < 3 for w in words], len(words)), len({w.lower() for w in words}) / max(1, len(words)), math.log1p(len(words) / len(lines)) / 8,
        again / max(1, len(words)), share(marks, len(words)), share(shouts, len(words)), math.log1p(len(raw) if n_chars < 0 else n_chars) / 14,
    ]


def test_features_by_plain_loops():
    rng = random.Random(2)
    texts = ["", " \n", "One line.", "a b c\na b c\n\nA b c\na b", "SHOUT loud!! #tag |x| naïve 日本 12"] + ["".join(rng.choice(["the ", "Cat\n", "END! ", "a|b ", "é", "9 ", "the cat\n", "\t"]) for _ in range(rng.randint(0, 300))) for _ in range(30)]
    part = np.frombuffer("".join(texts).encode(), np.uint8)
    sizes = np.array([rng.choice([-1, 7, 5000]) for _ in texts])
    heads, index, value, stats = q.features(part, np.cumsum([0, *(len(t.encode()) for t in texts)]), sizes)
    for i, t in enumerate(texts):
        assert np.allclose(stats[i], plain_features(t, sizes[i]), atol=1e-6), (t, dict(zip(q.STATS, zip(stats[i], plain_features(t, sizes[i]), strict=True), strict=True)))
        words = re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
        shares = sorted(n / len(words) for n in Counter(w.lower() if w.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words).values())
        assert np.allclose(sorted(value[heads[i] : heads[i + 1]]), shares, atol=1e-6) and len(set(index[heads[i] : heads[i + 1]])) == len(shares)


def test_one_step_of_the_fit(monkeypatch):
    """The first step of Adam against gradients by differences of the loss."""
    monkeypatch.setattr(q, "EPOCHS", 0)
    part = np.frombuffer(b"good text here bad!! words ## now", np.uint8)
    at = np.array([0, 14, 33])
    heads, index, value, stats = q.features(part, at, np.array([-1, 7]))
    sample = [(index[a:b], value[a:b], stats[i]) for i, (a, b) in enumerate(zip(heads, heads[1:], strict=False))]
    labels = np.array([1.0, 0.0])
    start = q.fit(sample, labels)
    monkeypatch.setattr(q, "EPOCHS", 1)
    after = q.fit(sample, labels)
    doc, feature, x = start.rows(heads, index, value, stats)

    def loss(m):
        z, _ = m.sums(2, doc, feature, x)
        return np.mean(np.log1p(np.exp(-np.where(labels > 0, z, -z)))) + q.SHRINK / 2 * (m.linear**2).sum() + q.SHRINK / 2 * (m.factors**2).sum()

    base = loss(start)
    assert abs(after.bias - start.bias) < q.RATE and loss(after) < base
    for i in (int(feature[0]), int(feature[-1]), int(feature[len(feature) // 2])):
        start.linear[i] += 1e-5
        slope = (loss(start) - base) / 1e-5
        start.linear[i] -= 1e-5
        if abs(slope) > 1e-6:  # the first step of Adam is RATE against the slope's sign
            assert abs(after.linear[i] + q.RATE * np.sign(slope)) < 1e-3
        start.factors[i, 0] += 1e-5
        slope = (loss(start) - base) / 1e-5
        start.factors[i, 0] -= 1e-5
        if abs(slope) > 1e-4:
            assert abs(after.factors[i, 0] - start.factors[i, 0] + q.RATE * np.sign(slope)) < 1e-2


def test_sample_is_bounded_in_bytes(spark):
    """Documents of many features fit only as far as the bound reaches."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(500))) for i in range(40)] + [(7, "again")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    every = q._sample(docs, labels, 4000, 1 << 30).collect()
    some = q._sample(docs, labels, 4000, 60_000).collect()
    size = lambda rows: sum(len(r["index"]) + len(r["value"]) + len(r["stats"]) for r in rows)
    assert size(every) > 60_000 >= size(some) > 40_000 and {r.doc_id for r in some} < {r.doc_id for r in every}


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the driver's tables")
def test_held_out_accuracy_and_edges(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = q.score(docs, q.train(docs, labels))
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == docs.count()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([(r.score >= 0.5) == r.quality for r in out]) > 0.93
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    odd = spark.createDataFrame([(1, None, 7), (None, "", 8), (2, "x " * 9000, 9), (2, "x " * 9000, 9)], "doc_id long, text string, quality int")
    assert all(0 <= r.score <= 1 for r in q.score(odd, q.train(odd, labels.limit(0))).collect())
    assert q.score(odd.limit(0), q.train(odd, labels.limit(0))).count() == 0
