"""Line templates and the separator scan against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronolith.llm import line_templates as lt
from chronolith.llm import separator_scan as ss
from chronolith.llm.storage import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_lines(docs, min_docs, same=lt.SAME, depth=lt.DEPTH):
    places, leaves = [], defaultdict(list)
    for r, (i, t) in enumerate(docs):
        for k, line in enumerate((t or "").split("\n")):
            words = re.findall(r"[^\x20\x09-\x0D]+", line)
            if words and i is not None:
                masked = tuple("<*>" if re.search(r"[0-9@]|://", w) else w for w in words)
                if sum(w == "<*>" for w in masked) > (1 - same) * len(masked):
                    masked = ("as it is", *words)
                places.append((r, i, k, masked))
                leaves[len(masked), masked if masked[0] == "as it is" else masked[:depth]].append((i, r, masked))
    template = {}
    for rows in leaves.values():
        docs_of = defaultdict(set)
        for i, r, m in rows:
            docs_of[m].add(i)
        if len(docs_of) == 1 or len({(i, m) for i, _, m in rows}) < min_docs:
            template |= {m: (m,) for m in docs_of}
            continue
        support = defaultdict(int)
        for m, d in docs_of.items():
            for p, w in enumerate(m):
                support[p, w] += len(d)
        for m in docs_of:
            t = tuple(w if support[p, w] >= min_docs else "<*>" for p, w in enumerate(m))
            template[m] = (len(m), m[:depth], t) if sum(w != "<*>" for w in t) >= same * len(t) else (m,)
    found = defaultdict(set)
    for _, i, _, m in places:
        found[template[m]].add(i)
    gone = defaultdict(list)
    for r, i, k, m in places:
        d = found[template[m]]
        if len(d) >= min_docs and i != min(d):
            gone[r].append(k)
    out = []
    for r, (i, t) in enumerate(docs):
        lines = (t or "").split("\n")
        kept = [x for k, x in enumerate(lines) if k not in gone[r]]
        text = (t or "") if not gone[r] else "\n".join(kept) if any(x.split() for x in kept) else ""
        out.append((i, sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in lines), len(gone[r]), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_templates(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "x1", "é", "Was"])
    boiler = [lambda: f"Page {rng.randrange(99)} of {rng.randrange(99)}", lambda: "All rights reserved.", lambda: f"Licensed to {rng.choice(['Ann', 'Bob', 'Cy', 'Di'])} Smith under these terms", lambda: f"Mail a{rng.random()}@b.c or see http://x.y/{rng.random()} now", lambda: "  padded \t line", lambda: f"{rng.randrange(3)} {rng.randrange(3)} {rng.randrange(3)}"]
    docs = [(900, None), (901, ""), (902, "\n\n"), (903, "a"), (904, "a"), (None, "All rights reserved."), (905, "All rights reserved.\nAll rights reserved.\n")]
    for i in range(40):
        lines = []
        for _ in range(rng.randint(1, 8)):
            lines.append(rng.choice(boiler)() if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 6))))
        docs.append((i, "\n".join(lines)))
    docs += docs[7:20] * 3 + [(7, "another text of one id\nAll rights reserved."), (8, " ".join(word() for _ in range(20_000)))]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, row string, numbers int").repartition(3)
    got = sorted(map(tuple, lt.line_report(frame, min_docs=4).collect()), key=str)
    assert got == brute_lines(docs, 4)
    texts = lt.drop_lines(frame, min_docs=4)
    assert texts.columns == frame.columns
    sums = sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in texts.filter("doc_id is not null").collect())
    assert sums == sorted((g[0], g[3]) for g in got if g[0] is not None)
    assert lt.line_report(frame.limit(0)).count() == 0


def test_lines_that_share_only_their_opening_stay(spark):
    rest = ["Ster.", "eng eresnt.", "A, reha mofe."]
    docs = [(i, "\n".join([*(f"Was erlytion that. {r.replace('e', chr(97 + i))}" for r in rest), f"Sent to you by {'uvwxyz'[i]} from home"])) for i in range(6)]
    got = lt.drop_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect()
    assert {r.doc_id: r.text for r in got} == {i: t if i == 0 else t.rsplit("\n", 1)[0] for i, t in docs}


def test_repeated_rows_are_one_document(spark):
    docs = [(k, f"alpha beta gamma delta {w}") for k, w in enumerate(["one", "two", "six", "ten", "one"], 1)]
    cut = lambda rows: {r.doc_id: r.text for r in lt.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert cut(docs) == cut(docs[:1] * 5 + docs[1:]) == {1: docs[0][1], 2: "", 3: "", 4: "", 5: ""}
    report = lt.line_report(spark.createDataFrame(docs + docs[4:], "doc_id long, text string")).filter("doc_id = 5").collect()
    assert [(r.n_lines, r.n_dropped) for r in report] == [(1, 1)] * 2


@pytest.mark.parametrize("width", [2, 4])
def test_flat_files(spark, width):
    docs = [(i, t) for i, t in enumerate([None, "", "one", "<|endoftext|> as text", "the " * 700, "", "x y z"] * 5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    files = ss.write_flat(frame, PATH, 49407, width)
    for block in (8, 64, 1 << 20):
        got = ss.with_doc_ids(ss.count_tokens(files, 49407, width, block), files).collect()
        tk = Tokenizer.from_file(PATH)
        tk.encode_special_tokens = True
        assert sorted((r.doc_id, r.n_tokens) for r in got) == [(i, len(tk.encode(t or "", add_special_tokens=False).ids)) for i, t in docs]
        assert all(r.ended for r in got)


def test_any_flat_file(spark, tmp_path):
    rng = random.Random(3)
    rows, want = [], []
    for k, ids in enumerate([[], [7], [5], [7, 7], [1, 7, 7, 2], [rng.choice([1, 2, 7]) for _ in range(500)], [1] * 300 + [7]]):
        path = tmp_path / f"{k}.bin"
        path.write_bytes(np.array(ids, "<u2").tobytes())
        rows.append((k, f"file://{path}", 2 * len(ids)))
        start, n = 0, 0
        for i, x in enumerate(ids):
            if x == 7:
                want.append((k, n, start, i - start, True))
                start, n = i + 1, n + 1
        if start < len(ids):
            want.append((k, n, start, len(ids) - start, False))
    files = spark.createDataFrame(rows, "shard int, path string, bytes long")
    got = ss.count_tokens(files, 7, 2, 6).select("shard", "doc_no", "start", "n_tokens", "ended").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert shared_dir(spark) != shared_dir(spark)


def test_flat_files_of_odd_tables(spark):
    """Null and repeated ids, a null, an empty and a very long text, names that clash, and no rows."""
    docs = [(1, "the cat", 0, "x"), (1, "the cat", 0, "x"), (None, "a dog.", 0, "x"), (2, None, 0, "x"), (3, "", 0, "x"), (4, "word " * 40_000, 0, "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, shard int, path string").repartition(2)
    tk, end = Tokenizer.from_file(PATH), 49407
    for table, rows in ((frame, docs), (frame.limit(0), [])):
        files = ss.write_flat(table, PATH, end)
        got = ss.with_doc_ids(ss.count_tokens(files, end), files).collect()
        assert sorted(((r.doc_id or 0, r.n_tokens, r.ended) for r in got)) == sorted((i or 0, len(tk.encode(t or "", add_special_tokens=False).ids), True) for i, t, *_ in rows)
