"""Repairs against a brute force over all edits, of conversations in one block and in many."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from chronolith.llm import conversation_repair as cr

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, lines): rows are (role, text, must go, truncated). A table of the best way to each (rows taken, last role), relaxed until it rests."""
    best = {(0, ""): (0, "", ())}
    work = [(0, "")]
    while work:
        i, last = work.pop(0)
        cost, audit, lines = best[i, last]
        steps = []
        for role in ("user", "assistant"):
            steps.append((i, role, 5, "I", (f"{role}:",)))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            steps.append((i + 1, None, 2, "D", ()))
            if not gone:
                steps.append((i + 1, role, 5 * cut, "K", (f"{role}:{text}",)))
                steps += [(i + 1, r, 1 + 5 * cut, "R", (f"{r}:{text}",)) for r in ("user", "assistant")]
        for j, role, more, letter, line in steps:
            to = last if role is None else NEXT.get((last, role[:1]))
            if to is None:
                continue
            new = (cost + more, audit + letter, lines + line)
            if ((j, to) not in best or new[:2] < best[j, to][:2]) and new[0] <= 2 * len(rows):
                best[j, to] = new
                if (j, to) not in work:
                    work.append((j, to))
    return min(best[len(rows), e] for e in ("", "a") if (len(rows), e) in best)


def brute(rows):
    """The report of one conversation's rows (turn, role, text)."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, *_ in rows if t is not None]
    counts, seen, todo = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        todo.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit, lines = cheapest(todo)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **counts,
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def test_every_short_row_of_symbols():
    """The parser against the brute force, and against all audits of a few letters."""
    role = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for n in range(5):
        for word in itertools.product("suaxUA-", repeat=n):
            rows = [(role[c.lower()] if c != "-" else "user", "t", c == "-", c.isupper()) for c in word]
            assert cr.parsed("".join(word))[-1] == cheapest(rows)[:2], word


def test_audits_give_the_form():
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("suaxSUAX-") for _ in range(rng.randint(0, 40)))
        roles = [{"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool") for c in word]
        cost, audit = cr.parsed(word)[-1]
        out = "".join(r[0] for r, _ in cr.edited("start", roles, ["x"] * len(word), audit))
        assert re.fullmatch("(s?(ua)+)?", out)
        assert len(audit) - audit.count("I") == len(word)


def _conversations(rng, n, longest):
    rows = []
    for conv in range(n):
        turn = rng.randint(0, 3)
        for _ in range(rng.choice([1, 2, 3, 5, rng.randint(0, longest)])):
            turn += rng.choice([1, 1, 1, 1, 2, 0])
            text = rng.choice([f"Line {rng.randint(0, 9)}.", "Cut of", "", " \t", "Well!", "É?\n", None, "same.", " "])
            rows.append((conv, None if rng.random() < 0.04 else turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "u", "a "]), text))
    return rows


@pytest.mark.parametrize("size,longest", [(256, 12), (3, 30), (1, 9)])
def test_against_brute_force(spark, monkeypatch, size, longest):
    monkeypatch.setattr(cr, "ROWS", size)
    rng = random.Random(size)
    rows = _conversations(rng, 60, longest)
    rows += [(None, t, r, x) for _, t, r, x in rows[:9]] + rows[20:24]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, block string").repartition(5)
    got = {r.conv_id: r.asDict() for r in cr.repair(frame).collect()}
    by_conv = {}
    for conv, *row in rows:
        by_conv.setdefault(conv, []).append(tuple(row))
    assert set(got) == set(by_conv)
    for conv, its in by_conv.items():
        assert got[conv] == {"conv_id": conv, **brute(its)}, (conv, its)


def test_damage_and_lost_conversations(spark):
    """The query's rows by a plain loop, with conversations that lose all rows."""
    rng = random.Random(8)
    rows = [(c, t, r, x) for c, t, r, x in _conversations(rng, 80, 4)] + [(c, 0, "user", "Alone.") for c in range(100, 260)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r.asDict() for r in cr.repair_all(cr.damage(frame), frame).collect()}
    by_conv = {c: [] for c, *_ in rows}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        by_conv[c] += [(t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert any(not its for its in by_conv.values())
    assert got == {c: {"conv_id": c, **brute(its)} for c, its in by_conv.items()}
    assert got[next(c for c, its in by_conv.items() if not its)]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_one_long_conversation_and_long_text(spark, monkeypatch):
    """A third of all rows in one conversation, over many blocks and tasks; and a text of a megabyte."""
    monkeypatch.setattr(cr, "ROWS", 16)
    rng = random.Random(3)
    rows = [("hot", t, rng.choice(["user", "assistant", "tool"]), rng.choice([f"Say {t}.", "same.", "cut", ""])) for t in range(900)]
    rows += [(f"c{i}", t, ("user", "assistant")[t % 2], f"Fine {t}.") for i in range(300) for t in range(6)] + [("long", 0, "user", "x" * (1 << 20) + "."), ("long", 1, "assistant", "y.")]
    frame = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").repartition(7)
    got = {r.conv_id: r.asDict() for r in cr.repair(frame).collect()}
    assert len(got) == 302 and got["c7"]["audit"] == "K" * 6 and got["long"]["audit"] == "KK"
    assert got["hot"] == {"conv_id": "hot", **brute([r[1:] for r in rows if r[0] == "hot"])}


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair_all(cr.damage(frame), frame).collect() == []
