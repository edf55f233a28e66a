"""Audit of how sources diverge: terms that a source uses more than its language does, and how far sources are from each other.

Terms are runs of ASCII letters and non-ASCII characters, A-Z in lower case. A language
keeps the terms in ``MIN_DOCS`` of its documents. With n its count, each kept term has in
each source (and in the language) the share p = 1 + floor(10^9 (n + 1) / (N + V)), in
billionths, of the N occurrences of the V kept terms, and f(p, q) = floor((p - q)^2 / q).

* ``term``: a source's kept terms with p over the language's q, by f, the first ``TOP``.
  Terms with the same count, so the same p, lie in one bucket; f falls as q grows, so the
  bucket's least q bounds f for all of it. Buckets are taken best bound first, and a
  search stops once the bounds of all that is unseen are strictly below the last of the
  ``TOP`` found. Each task searches what it reads, batch by batch, with what it has found
  so far as the threshold; the lists of tasks are merged by rank.
* ``pair``: the sum of f(p, q) over all kept terms, q of another source. Most terms are
  absent from one of two sources. Absent terms have one share, p0 or q0, so

      sum f(p, q) = V f(p0, q0) + sum_A [f(p, q0) - f(p0, q0)] + sum_B [f(p0, q) - f(p0, q0)]
                    + sum_(A and B) [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]

  where the sums over the terms of one source come from its buckets of counts, and only
  the last from postings: the sources of one term meet in memory, and a task keeps one sum
  for each pair of sources.

Texts are counted in the tasks that read them, and counts are shuffled by (language,
source, term) and then by (language, term). A term's posting has at most as many entries
as the language has sources, whose square is the number of rows to return.

Defined results: null texts, languages and sources are empty ones; sources without terms
are returned too, with f as above; a language without kept terms has pairs of 0; repeated
rows count each; equal values are ranked by the item's UTF-8; an empty table gives no
rows; a very long text is counted like any other; other columns are ignored. Arithmetic
is exact: counts up to 10^19 in decimals, sums of f under 2^63 while V is under 2 * 10^9.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written
from .wordscan import LOWER

MIN_DOCS, TOP = 3, 200
UNIT = 1_000_000_000
#: Terms that a task counts before it passes them on.
HELD = 400_000
#: Pairs of entries that meet at once.
MEET = 1 << 20
#: Rows of groups' statistics, and entries in their buckets, that are broadcast at most.
BROADCAST_ROWS, BROADCAST_ENTRIES = 100_000, 1_000_000
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = LOWER.tobytes()


def _count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of what each task reads; a row with an empty term for each group."""

    def rows(counts: dict, found: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), n in counts.items():
            d = found[lang, source]
            terms = list(n)
            size = len(terms)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([d[t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = {}
        found: dict[tuple[str, str], Counter] = {}
        held = 0
        for batch in batches:
            texts = batch["text"].cast(pa.large_string()).cast(pa.large_binary())
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), texts, strict=True):
                group = lang, source
                if group not in counts:
                    counts[group], found[group] = Counter({b"": 0}), Counter()
                terms = _TERM.findall(text.as_py().translate(_LOWER))
                n = counts[group]
                held -= len(n)
                n.update(terms)
                held += len(n)
                found[group].update(set(terms))
                if held > HELD:
                    yield from rows(counts, found)
                    counts, found, held = {}, {}, 0
        yield from rows(counts, found)

    columns = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return columns.mapInArrow(run, "lang string, source string, term string, n long, docs long")


class Search:
    """The first ``top`` terms of groups by value, then by the term's bytes; what is offered is searched bucket by bucket, best bound first."""

    def __init__(self, top: int = TOP):
        self.top = top
        self.values: dict[tuple[str, str], np.ndarray] = {}
        self.terms: dict[tuple[str, str], np.ndarray] = {}
        self.evaluated = 0

    def offer(self, group: tuple[str, str], terms: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
        """Entries of a group with p over q; those with the same p are a bucket."""
        order = np.lexsort((q, p))
        terms, p, q = terms[order], p[order], q[order]
        begin = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        end = np.append(begin[1:], len(p))
        bounds = worth(p[begin], q[begin])  # q is least there
        values, found = self.values.get(group, np.zeros(0, np.int64)), self.terms.get(group, np.zeros(0, object))
        for b in np.argsort(-bounds, kind="stable").tolist():
            if len(values) >= self.top and bounds[b] < values[self.top - 1]:
                break
            a, z = begin[b], end[b]
            self.evaluated += z - a
            values, found = np.concatenate([values, worth(p[a:z], q[a:z])]), np.concatenate([found, terms[a:z]])
            if len(values) > self.top:
                least = np.partition(values, -self.top)[-self.top]
                values, found = values[values >= least], found[values >= least]
            best = sorted(range(len(values)), key=lambda i, v=values, t=found: (-v[i], t[i]))[: self.top]
            values, found = values[best], found[best]
        self.values[group], self.terms[group] = values, found


def worth(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f of shares; both are at most 10^9 + 1, so the square fits."""
    return (p - q) * (p - q) // q


def _share(n: str, total: str) -> str:
    """SQL of 1 + floor(10^9 (n + 1) / total)."""
    return f"1 + cast({n} + 1 as decimal(20,0)) * {UNIT} div cast({total} as decimal(20,0))"


def _worth(p: str, q: str) -> str:
    """SQL of f."""
    return f"({p} - {q}) * ({p} - {q}) div {q}"


def _small(df: DataFrame, rows: bool) -> DataFrame:
    """A table of groups, to be broadcast if it was found to be small."""
    return F.broadcast(df) if rows else df


def _search(entries: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value) of each task's first ``top`` terms by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(top)
        for batch in batches:
            lang, source = batch["lang"].dictionary_encode(), batch["source"].dictionary_encode()
            group = np.asarray(lang.indices).astype(np.int64) * len(source.dictionary) + np.asarray(source.indices)
            p, q = np.asarray(batch["p"]), np.asarray(batch["q"])
            terms = np.array(batch["term"].cast(pa.binary()).to_pylist(), object)
            order = np.argsort(group, kind="stable")
            ids, begin = np.unique(group[order], return_index=True)
            for i, pick in zip(ids.tolist(), np.split(order, begin[1:]), strict=True):
                search.offer((lang.dictionary[i // len(source.dictionary)].as_py(), source.dictionary[i % len(source.dictionary)].as_py()), terms[pick], p[pick], q[pick])
        for (lang, source), values in search.values.items():
            n = len(values)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(search.terms[lang, source].tolist(), pa.binary()).cast(pa.string()), pa.array(values, pa.int64())], ["lang", "source", "item", "value"])

    return entries.filter("n > 0 and p > q").select("lang", "source", "term", "p", "q").mapInArrow(run, "lang string, source string, item string, value long")


class PairSums:
    """Sums of what the terms that two sources share add to their f, by (place, place)."""

    def __init__(self) -> None:
        self.keys, self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        keys, values = np.concatenate([self.keys, keys]), np.concatenate([self.sums, values])
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        if len(keys):
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, values = keys[begin], np.add.reduceat(values, begin)
        self.keys, self.sums = keys, values

    def meet(self, places: np.ndarray, p: np.ndarray, p0: np.ndarray, first: np.ndarray) -> None:
        """Entries of postings that begin at ``first``, which ends with their number."""
        size = np.diff(first)
        for m in np.unique(size).tolist():
            heads = first[:-1][size == m]
            step = max(1, MEET // (m * m))
            across = max(1, min(m, MEET // m))  # one source's row of a very long posting at least
            for i in range(0, len(heads), step):
                at = heads[i : i + step, None] + np.arange(m)
                for j in range(0, m, across):
                    a, b = at[:, j : j + across, None], at[:, None, :]
                    pa_, a0, pb, b0 = p[a], p0[a], p[b], p0[b]
                    more = worth(pa_, pb) - worth(pa_, b0) - worth(a0, pb) + worth(a0, b0)
                    self.add(((places[a] << 32) | places[b]).ravel(), more.ravel())


def _meetings(entries: DataFrame) -> DataFrame:
    """(lang, source, item, more): the last sum of the pairs that share a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[tuple[str, str], int] = {}
        sums = PairSums()
        held = None  # the last posting of a batch may go on in the next
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            lang, source, term = (table[c].combine_chunks() for c in ("lang", "source", "term"))
            n = table.num_rows
            codes = np.stack([np.asarray(c.dictionary_encode().indices) for c in (lang, term)])
            first = np.concatenate([[0], 1 + np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0))]) if n else np.zeros(1, np.int64)
            held = table.slice(first[-1]).combine_chunks().to_batches()[0] if n else None
            if len(first) > 1:
                where = np.array([places.setdefault(g, len(places)) for g in zip(lang[: first[-1]].to_pylist(), source[: first[-1]].to_pylist(), strict=True)], np.int64)
                sums.meet(where, np.asarray(table["p"])[: first[-1]], np.asarray(table["p0"])[: first[-1]], first)
        if held is not None and held.num_rows:
            where = np.array([places.setdefault(g, len(places)) for g in zip(held["lang"].to_pylist(), held["source"].to_pylist(), strict=True)], np.int64)
            sums.meet(where, np.asarray(held["p"]), np.asarray(held["p0"]), np.array([0, held.num_rows]))
        names = list(places)
        for i in range(0, len(sums.keys), 100_000):
            keys, values = sums.keys[i : i + 100_000], sums.sums[i : i + 100_000]
            a, b = (keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([names[x][0] for x in a], pa.string()), pa.array([names[x][1] for x in a], pa.string()), pa.array([names[x][1] for x in b], pa.string()), pa.array(values, pa.int64())], ["lang", "source", "item", "more"])

    postings = entries.select("lang", "source", "term", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return postings.mapInArrow(run, "lang string, source string, item string, more long").groupBy("lang", "source", "item").agg(F.sum("more").alias("more"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source): each source's distinctive terms, and its distance from each other source of its language."""
    counts = _count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counts = counts.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("lang_n"), (F.min("source").over(of_term) == F.col("source")).alias("head"))
    counts = written(counts.filter((F.col("docs") >= min_docs) | (F.col("term") == "")).drop("docs"))
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if(F.col("head") & (F.col("term") != "")).alias("v"))
    groups = written(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(langs, "lang"))
    few = groups.count() <= broadcast_rows
    groups = groups.withColumn("p0", F.expr(f"CASE WHEN v > 0 THEN {_share('0', 'total + v')} END"))
    entries = counts.filter("term <> ''").join(_small(groups, few), ["lang", "source"])
    entries = entries.withColumn("p", F.expr(_share("n", "total + v"))).withColumn("q", F.expr(_share("lang_n", "lang_total + v")))

    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = _search(entries, top).withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= top)

    buckets = entries.groupBy("lang", "source", "p").agg(F.count("*").alias("k")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "k")).alias("buckets"))
    sides = written(groups.join(buckets, ["lang", "source"], "left").select("lang", "source", "v", "p0", F.coalesce("buckets", F.array().cast("array<struct<p:bigint,k:bigint>>")).alias("buckets")))
    small = few and (sides.agg(F.sum(F.size("buckets") + 1)).first()[0] or 0) <= BROADCAST_ENTRIES
    b = sides.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("buckets").alias("other"))
    pairs = sides.join(_small(b, small), "lang").filter("source <> item")
    alone = f"aggregate(buckets, 0L, (sum, x) -> sum + x.k * ({_worth('x.p', 'q0')} - {_worth('p0', 'q0')}))"
    other = f"aggregate(other, 0L, (sum, x) -> sum + x.k * ({_worth('p0', 'x.p')} - {_worth('p0', 'q0')}))"
    base = pairs.select("lang", "source", "item", F.expr(f"CASE WHEN v = 0 THEN 0L ELSE v * ({_worth('p0', 'q0')}) + {alone} + {other} END").alias("base"))
    pairs = base.join(_meetings(entries), ["lang", "source", "item"], "left").select("lang", "source", "item", (F.col("base") + F.coalesce("more", F.lit(0))).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_rank))
    parts = [df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")) for part, df in (("pair", pairs), ("term", terms))]
    return parts[0].unionByName(parts[1])


#: DuckDB's form of the query over ``documents``.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
e AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT *, 1 + ({UNIT}::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p, 1 + ({UNIT}::HUGEINT * (lang_n + 1)) // (lang_total + v) AS q FROM e JOIN l USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
found AS (SELECT 'pair' AS part, lang, source, item, value FROM every UNION ALL SELECT 'term', lang, source, term, (((p - q) * (p - q)) // q)::BIGINT FROM s WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
