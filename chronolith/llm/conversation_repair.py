"""Repair of conversations' structure by error-correcting Earley parsing.

A conversation's rows, by turn, should read ``(system? (user assistant)+)?`` by the first
letters of their roles. The grammar of roles has productions for each edit: keep a row,
give it the role that is due, delete it, insert an empty row. The parse with the least
cost, and of those the one whose letters (K, R, D, I) come first in ASCII order, is the
repair.

A conversation may be of any length. Rows are dealt by range of (conversation, turn) and
cut into blocks of ``ROWS`` rows or ``BYTES`` bytes; most conversations lie whole in one
block and are repaired where they lie. Of the others each block is parsed on its own, once
for each role that can stand before it, with chart items for each role that can stand at
its end. The grammar puts inserts before a row or at the very end, so the audits of one
block never begin with one another, and (cost, order of the audit) is all that a fold over
the blocks of a conversation needs to find the parse of the whole. Rows seen earlier are
found by the first block of each text's hash. Only the SHA-256 of a repaired text is taken
in sequence, as its definition asks; it streams over the blocks.

Defined results: rows of one turn come in the order of role, of the text's first 32
characters and of the text's hash, so repeated rows are duplicates wherever they came in;
null turns come first and count for no gap; null roles and texts are one blank; a role
whose first letter is none of s, u and a, or that is empty, must be changed or deleted; a
null conv_id is a conversation like any other; a very long text is a block of its own; an
empty table gives no rows; other columns are ignored. Texts are equal if their MD5 is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .earley import Edit, Grammar, Value, parse
from .storage import written

ROWS, BYTES = 256, 1 << 20
WHITE = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")
#: Costs of the edits, and of a truncated row that stays (fixed values).
RETAG, DROP, ADD, CUT = 1, 2, 5, 5
#: What may stand before a row, and the role that is due then.
DUE = {"start": "user", "system": "user", "user": "assistant", "assistant": "user"}
STATES = list(DUE)
#: What a parse of a block ends with; the last only at a conversation's end.
GOALS = [*STATES, "conversation"]

# A row's symbol: the first letter of its role, x for any other; a capital if truncated; - if it must go.
_STAY = {"s": 0, "S": CUT, "u": 0, "U": CUT, "a": 0, "A": CUT}
_EDITS = {f"keep {role}": Edit("K", {c: cost for c, cost in _STAY.items() if c.lower() == role[0]}) for role in ("system", "user", "assistant")}
_EDITS["rerole"] = Edit("R", {c: RETAG + (CUT if c.isupper() else 0) for c in "suaxSUAX"})
_EDITS["delete"] = Edit("D", dict.fromkeys("suaxSUAX-", DROP))
_EDITS["insert"] = Edit("I", alone=ADD)
#: ``x`` is what ends in a row, ``x+`` that or what inserts make of it.
GRAMMAR = Grammar(
    [
        ("start", ("start", "delete")),
        ("system", ("start", "keep system")),
        ("system", ("system", "delete")),
        *(("user", (before, edit)) for before in ("start", "system", "assistant+") for edit in ("keep user", "rerole")),
        ("user", ("user+", "delete")),
        *(("assistant", ("user+", edit)) for edit in ("keep assistant", "rerole")),
        ("assistant", ("assistant+", "delete")),
        ("user+", ("user",)),
        *(("user+", (before, "insert")) for before in ("start", "system", "assistant+")),
        ("assistant+", ("assistant",)),
        ("assistant+", ("user+", "insert")),
        ("conversation", ("start",)),
        ("conversation", ("assistant+",)),
    ],
    _EDITS,
)

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@lru_cache(1 << 15)
def parsed(symbols: str, state: str = "start") -> list[Value | None]:
    """Of each of ``GOALS`` the cheapest repair of a block that ``state`` stands before."""
    return parse(GRAMMAR, symbols, state, GOALS)


def initial(role: str) -> str:
    return c if (c := role[:1]) and c in "sua" else "x"


def symbol(role: str, text: str, seen: bool) -> str:
    """A row's symbol by its first fault; blank rows are told from duplicates by ``blank``."""
    bare = text.rstrip(WHITE)
    if seen or not bare:
        return "-"
    return initial(role) if bare[-1] in STOPS else initial(role).upper()


def edited(state: str, roles: list[str], texts: list[str], audit: str) -> Iterator[tuple[str, str]]:
    """The rows that the edits of ``audit`` make, with ``state`` before them."""
    i = 0
    for e in audit:
        if e == "D":
            i += 1
            continue
        role, text = (DUE[state], "") if e == "I" else (roles[i], texts[i])
        i += e != "I"
        role = DUE[state] if e == "R" else role
        state = "system" if e == "K" and role[0] == "s" else DUE[state]
        yield role, text


def illegal(roles: list[str]) -> int:
    """Neighbours whose first letters don't follow each other."""
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


class _Block:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv: object):
        self.conv, self.turns, self.roles, self.texts, self.size = conv, [], [], [], 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text) + len(role)

    def symbols(self) -> tuple[str, int, int]:
        """The rows' symbols, blank rows, and those seen earlier in the block."""
        seen, out, blank, duplicate = set(), [], 0, 0
        for row in zip(self.roles, self.texts, strict=True):
            c = symbol(*row, row in seen)
            if c == "-":
                empty = not row[1].strip(WHITE)
                blank += empty
                duplicate += not empty
            seen.add(row)
            out.append(c)
        return "".join(out), blank, duplicate

    def gaps(self) -> int:
        known = [t for t in self.turns if t is not None]
        return max(known) - min(known) + 1 - len(set(known)) if known else 0

    def report(self) -> tuple:
        symbols, blank, duplicate = self.symbols()
        cost, audit = parsed(symbols)[-1]
        lines = "\n".join(f"{role}:{text}" for role, text in edited("start", self.roles, self.texts, audit))
        return self.gaps(), blank, duplicate, sum(c.isupper() for c in symbols), illegal(self.roles), cost, audit, hashlib.sha256(lines.encode("utf-8", "surrogatepass")).hexdigest()


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows of whole conversations' reports, or of blocks: ``block`` is null for the first kind, and else in the order of rows."""
    kind = rows.schema["conv_id"].dataType
    columns = rows.select("conv_id", F.expr("try_cast(turn as long)").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 32), F.xxhash64("text"), "n"]
    dealt = columns.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["conv_id", "block", "turns", "roles", "texts", *(c.split()[0] for c in REPORT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, out, held, b, begun, conv_type = TaskContext.get().partitionId() << 33, [], 0, None, 0, None
        fields: list[pa.DataType] = []

        def batch_of(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), fields, strict=True)], names)

        def close(whole: bool) -> None:
            nonlocal held, begun
            if whole:
                out.append((b.conv, None, None, None, None, *b.report()))
            else:
                out.append((b.conv, base + begun, b.turns, b.roles, b.texts, *[None] * 8))
                held += b.size
            held += 200
            begun += 1

        first = True  # the partition's first conversation, which may have begun in another, or one of many blocks
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            fields = [conv_type, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.int64()] * 6, pa.string(), pa.string()]
            for conv, turn, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if b is None:
                    b = _Block(conv)
                elif conv != b.conv:
                    close(not first)
                    b, first = _Block(conv), False
                elif len(b.turns) >= ROWS or b.size + len(text) > BYTES:
                    close(False)
                    b, first = _Block(conv), True
                b.add(turn, role, text)
                if held > BYTES:
                    yield batch_of(out)
                    out, held = [], 0
        if b is not None:
            close(False)
            yield batch_of(out)

    return dealt.select("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kind.simpleString()}, block long, turns array<long>, roles array<string>, texts array<string>, {REPORT}")


def _hash(role: str, text: str) -> bytes:
    return hashlib.md5(f"{role}\0{text}".encode("utf-8", "surrogatepass")).digest()


def _parse_blocks(parts: DataFrame) -> DataFrame:
    """Each block's numbers for the fold, and its repairs by (state before, goal)."""
    kind = parts.schema["conv_id"].dataType.simpleString()

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[_hash(r, t) for r, t in dict.fromkeys(zip(roles, texts, strict=True)) if t.strip(WHITE)] for roles, texts in zip(batch["roles"].to_pylist(), batch["texts"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["block"], pa.array(found, pa.list_(pa.binary()))], ["conv_id", "block", "hashes"])

    hashes = parts.mapInArrow(texts_of, f"conv_id {kind}, block long, hashes array<binary>").select("conv_id", "block", F.explode("hashes").alias("h"))
    # The first block of each text; those of one block, at most ROWS, go back to it.
    fresh = hashes.groupBy("conv_id", "h").agg(F.min("block").alias("block")).groupBy("block").agg(F.collect_list("h").alias("fresh"))
    names = ["conv_id", "block", "least", "most", "turns", "first_turn", "last_turn", "first_role", "last_role", "blank", "duplicate", "truncated", "illegal", "costs", "ranks", "audits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, block, turns, roles, texts, new in zip(*(batch[c].to_pylist() for c in ("conv_id", "block", "turns", "roles", "texts", "fresh")), strict=True):
                first, seen, symbols, blank, duplicate = set(new or ()), set(), [], 0, 0
                for role, text in zip(roles, texts, strict=True):
                    empty = not text.strip(WHITE)
                    again = (role, text) in seen or not empty and _hash(role, text) not in first
                    seen.add((role, text))
                    symbols.append(symbol(role, text, again))
                    blank += empty
                    duplicate += again and not empty
                word = "".join(symbols)
                table = [parsed(word, state) for state in STATES]
                ranks = []
                for row in table:  # the order of the audits behind one state
                    order = sorted({v[1] for v in row if v})
                    ranks += [order.index(v[1]) if v else -1 for v in row]
                known = [t for t in turns if t is not None]
                flat = [v for row in table for v in row]
                out.append((conv, block, min(known, default=None), max(known, default=None), len(set(known)), known[0] if known else None, known[-1] if known else None, roles[0][:1], roles[-1][:1], blank, duplicate, sum(c.isupper() for c in word), illegal(roles), [v[0] if v else -1 for v in flat], ranks, [v[1] if v else None for v in flat]))
            if out:
                kinds = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = f"conv_id {kind}, block long, least long, most long, turns long, first_turn long, last_turn long, first_role string, last_role string, blank long, duplicate long, truncated long, illegal long, costs array<long>, ranks array<int>, audits array<string>"
    return parts.join(fresh, "block", "left").select(*parts.columns, "fresh").mapInArrow(run, schema)


class Fold:
    """The cheapest way through a conversation's blocks, by (cost, order of the audit) of each state that can stand behind the last."""

    def __init__(self) -> None:
        self.best: dict[str, tuple[int, int]] = {"start": (0, 0)}
        self.came: list[dict[str, str]] = []  # of each block: the state before it, by the state behind it
        self.last: tuple[int, int, str] | None = None

    def add(self, costs: list[int], ranks: list[int]) -> None:
        found: dict[str, tuple[int, int, int, str]] = {}
        ends = []
        for state, (cost, rank) in self.best.items():
            at = STATES.index(state) * len(GOALS)
            for i, goal in enumerate(GOALS):
                if costs[at + i] >= 0:
                    way = (cost + costs[at + i], rank, ranks[at + i], state)
                    if goal == "conversation":
                        ends.append((way[0], rank, state))
                    elif goal not in found or way < found[goal]:
                        found[goal] = way
        order = sorted(way[1:3] for way in found.values())
        self.best = {goal: (way[0], order.index(way[1:3])) for goal, way in found.items()}
        self.came.append({goal: way[3] for goal, way in found.items()})
        self.last = min(ends)

    def ways(self) -> tuple[int, list[int]]:
        """The cost, and of each block the place of its repair among the block's."""
        cost, _, state = self.last
        out = [STATES.index(state) * len(GOALS) + len(GOALS) - 1]
        for came in reversed(self.came[:-1]):
            before = came[state]
            out.append(STATES.index(before) * len(GOALS) + STATES.index(state))
            state = before
        return cost, out[::-1]


def _fold_blocks(numbers: DataFrame) -> DataFrame:
    """Of each block the place of its repair, and its conversation's counts."""
    kind = numbers.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "block", "way", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, fold, blocks, sums, least, most, distinct, turn, role, conv_type = None, None, [], [0] * 4, None, None, 0, None, None, None

        def rows() -> pa.RecordBatch:
            cost, ways = fold.ways()
            n = len(blocks)
            gaps = most - least + 1 - distinct if least is not None else 0
            return pa.RecordBatch.from_arrays([pa.array([conv] * n, conv_type), pa.array(blocks, pa.int64()), pa.array(ways, pa.int32()), *(pa.array([x] * n, pa.int64()) for x in (gaps, *sums, cost))], names)

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for r in batch.to_pylist():
                if fold is None or r["conv_id"] != conv:
                    if fold:
                        yield rows()
                    conv, fold, blocks, sums, least, most, distinct, turn, role = r["conv_id"], Fold(), [], [0] * 4, None, None, 0, None, None
                fold.add(r["costs"], r["ranks"])
                blocks.append(r["block"])
                sums = [a + r[c] for a, c in zip(sums, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
                if role is not None:
                    sums[3] += role + r["first_role"] not in ("su", "ua", "au")
                role = r["last_role"]
                if r["least"] is not None:
                    distinct += r["turns"] - (turn == r["first_turn"])
                    least, most, turn = r["least"] if least is None else least, r["most"], r["last_turn"]
        if fold:
            yield rows()

    held = numbers.select("conv_id", "block", "least", "most", "turns", "first_turn", "last_turn", "first_role", "last_role", "blank", "duplicate", "truncated", "illegal", "costs", "ranks")
    return held.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(run, f"conv_id {kind}, block long, way int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")


def _pieces(parts: DataFrame, numbers: DataFrame, ways: DataFrame) -> DataFrame:
    """Of each block its part of the audit, and its repaired rows."""
    chosen = ways.join(numbers.select("block", "audits"), "block").select("block", "way", F.get("audits", F.col("way")).alias("audit"), *(c for c in ways.columns if c not in ("block", "way", "conv_id")))
    kind = parts.schema["conv_id"].dataType.simpleString()
    more = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[{"role": r, "text": t} for r, t in edited(STATES[way // len(GOALS)], roles, texts, audit)] for way, roles, texts, audit in zip(*(batch[c].to_pylist() for c in ("way", "roles", "texts", "audit")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("conv_id", "block", "audit", *more)), pa.array(made, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))], ["conv_id", "block", "audit", *more, "rows"])

    joined = parts.join(chosen, "block").select("conv_id", "block", "roles", "texts", "way", "audit", *more)
    return joined.mapInArrow(run, f"conv_id {kind}, block long, audit string, {', '.join(f'{c} long' for c in more)}, rows array<struct<role:string,text:string>>")


def _digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation; its blocks stream past in order."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *(c.split()[0] for c in REPORT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, audit, sha, empty, conv_type = None, [], None, True, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held["conv_id"]], conv_type), *(pa.array([held[c]], pa.int64()) for c in names[1:7]), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], names)

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if held is None or r["conv_id"] != held["conv_id"]:
                    if held:
                        yield row()
                    audit, sha, empty = [], hashlib.sha256(), True
                audit.append(r["audit"])
                if r["lines"] is not None:
                    sha.update(("" if empty else "\n").encode() + r["lines"].encode("utf-8", "surrogatepass"))
                    empty = False
                held = {k: v for k, v in r.items() if k != "lines"}
        if held:
            yield row()

    lines = F.when(F.size("rows") > 0, F.array_join(F.transform("rows", lambda r: F.concat(r.role, F.lit(":"), r.text)), "\n"))
    columns = pieces.select("conv_id", "block", *names[1:7], "audit", lines.alias("lines"))
    return columns.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(run, f"conv_id {kind}, {REPORT}")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): what is wrong with it, and its cheapest repair.

    ``gaps`` counts turns that lack between the least and the largest; ``blank``,
    ``duplicate`` and ``truncated`` rows by their first fault; ``illegal`` neighbours whose
    roles don't follow each other.
    """
    blocks = written(_blocks(rows))
    parts = blocks.filter("block is not null").select("conv_id", "block", "turns", "roles", "texts")
    numbers = written(_parse_blocks(parts))
    whole = blocks.filter("block is null").select("conv_id", *(c.split()[0] for c in REPORT.split(", ")))
    return whole.unionByName(_digests(_pieces(parts, numbers, _fold_blocks(numbers))))


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by the CRC-32 of conversation and turn: rows lost, emptied, without stops, repeated, of the wrong role."""
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    columns = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"), kind.alias("kind"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return columns.filter("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_all(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``repair`` of ``rows``, and a row of zeros for each other conv_id of ``ids``."""
    found = repair(rows).withColumnRenamed("conv_id", "id")
    every = ids.select("conv_id").distinct()
    numbers = [F.coalesce(c.split()[0], F.lit(0).cast("long")).alias(c.split()[0]) for c in REPORT.split(", ")[:6]]
    nothing = hashlib.sha256(b"").hexdigest()
    return every.join(found, every["conv_id"].eqNullSafe(found["id"]), "left").select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
