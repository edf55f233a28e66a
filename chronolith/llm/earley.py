"""An Earley parser for weighted grammars, whose chart items keep their least (cost, audit).

A grammar has rules (head, body). Bodies are of nonterminals and of terminals; a terminal
is an edit with a letter for the audit, and either takes one symbol, at a cost that goes
with the symbol, or none. The cost of a derivation is the sum of its edits' costs and its
audit their letters in order. Of the derivations of one item the chart keeps that with the
least cost, and of those the one with the least audit in ASCII order. This is sound where
no audit of an item begins with another of the same cost, as when every edit that takes no
symbol costs something.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

Value = tuple[int, str]


@dataclass(frozen=True)
class Edit:
    """A terminal: ``costs`` by symbol, or ``alone``, the cost of an edit that takes no symbol."""

    letter: str
    costs: Mapping[str, int] = field(default_factory=dict)
    alone: int | None = None


@dataclass
class Grammar:
    rules: Sequence[tuple[str, tuple[str, ...]]]
    edits: Mapping[str, Edit]

    def __post_init__(self) -> None:
        self.by_head: dict[str, list[int]] = {}
        for i, (head, _) in enumerate(self.rules):
            self.by_head.setdefault(head, []).append(i)


def parse(grammar: Grammar, symbols: str, axiom: str, goals: Sequence[str]) -> list[Value | None]:
    """Of each goal its least derivation over all ``symbols``, where ``axiom`` derives nothing at no cost."""
    rules, edits, n = grammar.rules, grammar.edits, len(symbols)
    bodies = [body for _, body in rules] + [()] + [(g,) for g in goals]
    heads = [head for head, _ in rules] + [axiom] + [f" {g}" for g in goals]
    by_head = grammar.by_head | {axiom: [*grammar.by_head.get(axiom, ()), len(rules)]}
    chart: list[dict[tuple[int, int, int], Value]] = [{} for _ in range(n + 1)]
    waiting: list[dict[str, set[tuple[int, int, int]]]] = [{} for _ in range(n + 1)]
    for g in range(len(goals)):
        chart[0][len(rules) + 1 + g, 0, 0] = (0, "")
    for k in range(n + 1):
        here, waits, work = chart[k], waiting[k], list(chart[k])
        done: dict[str, Value] = {}  # what begins and ends here
        ahead = chart[k + 1] if k < n else None
        symbol = symbols[k] if k < n else ""

        def put(item: tuple[int, int, int], value: Value, here=here, work=work) -> None:
            if item not in here or value < here[item]:
                here[item] = value
                work.append(item)

        while work:
            item = work.pop()
            rule, dot, origin = item
            cost, audit = here[item]
            body = bodies[rule]
            if dot == len(body):  # completion
                head = heads[rule]
                if origin == k and (head not in done or (cost, audit) < done[head]):
                    done[head] = (cost, audit)
                for other in tuple(waiting[origin].get(head, ())):
                    c, a = chart[origin][other]
                    put((other[0], other[1] + 1, other[2]), (c + cost, a + audit))
            elif (edit := edits.get(body[dot])) is not None:  # scan
                after = (rule, dot + 1, origin)
                if edit.alone is not None:
                    put(after, (cost + edit.alone, audit + edit.letter))
                elif ahead is not None and (price := edit.costs.get(symbol)) is not None:
                    value = (cost + price, audit + edit.letter)
                    if after not in ahead or value < ahead[after]:
                        ahead[after] = value
            else:  # prediction
                head = body[dot]
                if item not in waits.setdefault(head, set()):
                    waits[head].add(item)
                    for r in by_head.get(head, ()):
                        put((r, 0, k), (0, ""))
                if head in done:
                    c, a = done[head]
                    put((rule, dot + 1, origin), (cost + c, audit + a))
    return [chart[n].get((len(rules) + 1 + g, 1, 0)) for g in range(len(goals))]
