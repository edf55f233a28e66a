"""Near duplicates against all pairs of full sets, and components against a union-find."""

import random
import re

import pytest

from chronolith.llm import bottomk_dedup as bd
from chronolith.llm.components import components
from chronolith.llm.storage import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, words, percent):
    sets = []
    for _, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(docs[i][0]), find(docs[j][0])))
                root[b] = a
    return {i: (len(s), find(i), find(i) == i) for (i, _), s in zip(docs, sets, strict=True)}


def near_corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)] + ["the", "Of"] * 300
    docs = [None, "", "  ", "one", "One", "one two", "ONE two", "a b c", "a b c d e f", "é 日本 x"]
    for size in (3, 6, 12, 30, 60, 90, 200, 400, 700):
        for _ in range(4):
            base = [rng.choice(vocab) for _ in range(size)]
            docs.append(" ".join(base))
            for edits in (0, 1, 2, size // 40, size // 20, size // 12, size // 9):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(len(copy))] = rng.choice(vocab)
                docs.append("  ".join(copy).upper() if edits == 2 else "\n".join(copy))
    chain = [f"c{k}" for k in range(100)]
    for _ in range(40):
        docs.append(" ".join(chain))
        chain[rng.randrange(100)] = f"x{rng.random()}"
        chain[rng.randrange(100)] = f"x{rng.random()}"
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    return list(zip(ids, docs, strict=True))


@pytest.mark.parametrize(("words", "list_size"), [(2, bd.LIST), (5, bd.LIST), (5, 2)])
def test_near_duplicates(spark, words, list_size):
    docs = near_corpus(words)
    rows = [(i, t, "label", 0) for i, t in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label string, n int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in bd.near_duplicates(frame, words, list_size=list_size).collect()}
    assert got == brute(docs, words, 80)
    if words == 5 and list_size > 2:
        left = {r.doc_id for r in bd.keep_one(frame, words).collect()}
        assert left == {i for i, r in got.items() if r[2]}


def test_copies_of_one_text(spark):
    """A large group of copies, each changed at random: many of them linked, many not, in lists of all of them."""
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(400)] + ["the", "of"] * 40
    base, other = ([rng.choice(vocab) for _ in range(90)] for _ in range(2))
    docs = []
    for k in range(160):
        copy = list(base if k % 4 else base[:45] + other[:60])
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6, 9, 15))):
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
        if k % 5 == 0:
            copy += other[: rng.randrange(12)]
        docs.append((k, " ".join(copy)))
    for words in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in bd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words).collect()}
        assert got == brute(docs, words, 80)


def test_repeated_rows_and_null_ids(spark):
    docs = [(5, "a b c d e f g"), (None, "a b c d e f g"), (2, "A b c d e f g"), (2, "A b c d e f g"), (9, "a b c d e f h")]
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in bd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2, 70).collect())
    assert got == [(-1, None, True), (2, 2, True), (2, 2, True), (5, 2, False), (9, 2, False)]
    assert bd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("few", [0, bd.FEW])
def test_frequent_words(spark, monkeypatch, few):
    """Texts of the same few words, whose pairs of words each many of them have, make no lists but for copies."""
    rng = random.Random(8)
    docs = [(k, " ".join(f"w{rng.randrange(60)}" for _ in range(200))) for k in range(400)]
    docs += [(400, docs[7][1] + " x"), (401, docs[9][1] + " y z")]
    tables, keep = [], Scratch.__call__

    def kept(self, df, **options):
        tables.append(keep(self, df, **options))
        tables[-1] = (tables[-1], tables[-1].count())
        return tables[-1][0]

    monkeypatch.setattr(Scratch, "__call__", kept)
    monkeypatch.setattr(bd, "FEW", few)
    got = {r.doc_id: r.component_id for r in bd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect()}
    assert got == {i: {400: 7, 401: 9}.get(i, i) for i, _ in docs}
    assert max(n for _, n in tables) < 2 * len(docs)  # lists of single values have 36 rows a class


@pytest.mark.parametrize("percent", [60, 70, 80, 90])
def test_common_runs(spark, percent):
    """Whole sets that are alike enough have so many runs in common, wherever their differences lie."""
    rng = random.Random(percent)
    run, shared, enough = bd._common_runs(percent)
    rows, pairs = [], []
    for u in [*range(2, 60), 80, bd.SKETCH]:
        for way in range(4):
            most = (100 - percent) * u // 100
            apart = {(j + 1) * u // (most + 1) for j in range(most)} if way == 0 else set(rng.sample(range(u), most))
            only = {j: way == 1 or rng.random() < 0.5 for j in apart}
            values = sorted(rng.sample(range(-(2**31), 2**31), u))
            a, b = ([v for j, v in enumerate(values) if only.get(j, side) == side] for side in (True, False))
            if a != b:
                pairs.append((len(rows), len(rows) + 1))
                rows += [(len(rows), a), (len(rows) + 1, b)]
    runs = {}
    for r in bd._runs(spark.createDataFrame(rows, "rep long, sketch array<int>"), run, enough).collect():
        runs.setdefault(r.rep, []).append(r.v)
    assert all(len(set(v)) == len(v) for v in runs.values())
    assert all(len({*runs[a]} & {*runs[b]}) >= shared for a, b in pairs)


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, k) for k in range(501, 540)]
    root = {x: x for l in links for x in l}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    loops = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in root if x not in loops}
