"""Near-duplicate documents: bottom-k sketches from one hash function.

A document's set holds the hashes of its distinct shingles. Documents of one set are one
class, represented by the smallest doc_id. Of each class the ``SKETCH`` smallest hashes
are kept, of each its upper 32 bits. Inverted lists bring classes together: a list is of
the classes whose sketches have the same ``RUN`` values one after another. A single value,
such as that of two frequent words, is kept by a share of all classes: lists of values
would grow with the classes, and pairs with their square. Few runs are shared but by
copies. In the order of the hashes, what sets two classes apart falls at random among
what they share, so linked ones have ``MEET + SPARE`` runs in common, but for a chance of
under 1e-8. In sketches that hold whole sets it is no chance, as the differences are too
few to break more runs; small sets also have the runs over their ends. Each class leaves
the ``SPARE`` commonest of its lists, those of a line that many texts have; linked ones
still meet in ``MEET``. Pairs that do, and whose sizes allow the similarity, are estimated
on the bottom-k sketch of their union, and those left are confirmed on their full sets.

No group is expanded into all its pairs. First each list compares its members with one
of them, that whose runs are the most common (by logarithms, so that no single one decides), so that copies of one text mostly meet
at the least changed of them; classes found alike are one component from then on. What
is left are pairs of a list that are not of one component:

* Lists of up to ``LIST`` classes compare these.
* The classes of longer lists are compared by their full sets instead. Those of one hub,
  the member that a list was compared with, are compared once more with their center,
  the member most like what half of them have. For what is still apart, each enters the
  lists of so many of its rarest shingles that linked sets must meet, and two that meet
  are a pair only if what follows their place in both sets is enough. Frequencies are
  those among the classes of one hub, and among different hubs. So copies of one text that have changed too much to be
  linked with any share only the common end of their sets, and make no pairs.

The sketches' overlap of linked documents is at least half the sketch, but for a chance
of under 1e-8 for each pair at 112 values and similarity 0.8; sets of up to 0.8 times the
sketch are compared exactly throughout.

Defined results: documents without words, or with null text, have an empty set and are
linked with nothing; with fewer words than a shingle, all words are the one shingle;
rows that share a doc_id are one document; a null doc_id is linked with nothing, has no
component and is kept; other columns are ignored by ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import Scratch, written
from .wordscan import LOWER, Rolling, chunks, mix, scan, utf8, window_starts

SKETCH = 112
#: Values of a sketch that make a list, at most; lists in which linked classes must meet; lists that each class leaves.
RUN, MEET, SPARE = 4, 2, 2
#: Lists of more classes are left to the full sets.
LIST = 16
#: So many doc_ids at most are sent to the texts, else the texts are shuffled to them.
FEW = 1 << 20


def shingle_sets(part: np.ndarray, at: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted set of each document of a chunk, as signed 64-bit hashes."""
    w = scan(LOWER[part], at)
    counts, rolling = w.counts(), Rolling(w.hashes())
    a = window_starts(w.first, words)
    doc = np.searchsorted(w.first, a, "right") - 1
    h = rolling.of(a, a + words).view(np.int64)
    begin = np.searchsorted(doc, np.arange(len(counts) + 1))
    whole = rolling.of(w.first[:-1], w.first[1:]).view(np.int64)
    for d, n in enumerate(counts.tolist()):
        yield np.unique(h[begin[d] : begin[d + 1]]) if n >= words else whole[d : d + 1] if n else h[:0]


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch["text"])
            for i, j, part, at in chunks(raw, offs):
                sets = list(shingle_sets(part, at, words))
                sizes = np.array([len(s) for s in sets])
                full = np.concatenate(sets).view(np.uint64)
                heads = np.concatenate([[0], np.cumsum(sizes)])
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (full, mix(full + np.uint64(7)))]
                digest = [pa.array((s[heads[1:]] - s[heads[:-1]]).view(np.int64)) for s in sums]
                kept = np.minimum(sizes, SKETCH)
                values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), pa.array((np.concatenate([s[:SKETCH] for s in sets]) >> 32).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(sizes, pa.int64()), *digest, values], ["doc_id", "n_shingles", "set_a", "set_b", "sketch"])

    return _columns(docs).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, sketch array<int>")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(rep, shingles) of the documents whose doc_id is in ``ids`` (rep). Of more than ``FEW`` the texts are shuffled once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch["text"])
            for i, j, part, at in chunks(raw, offs):
                sets = list(shingle_sets(part, at, words))
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], ["rep", "shingles"])

    ids = ids.distinct()
    wanted = _columns(docs).join(ids.hint("broadcast" if ids.count() <= FEW else "merge"), F.col("doc_id") == F.col("rep"), "left_semi")
    return wanted.mapInArrow(run, "rep long, shingles array<long>")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("rep")).union(pairs.select("b"))


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose estimate on the union's sketch allows a link."""
    sketch = classes.select("rep", "sketch")
    both = pairs.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    return both.filter(F.size(F.array_intersect(union, F.array_intersect("sa", "sb"))) * 2 >= F.size(union)).select("a", "b").distinct()


def _alike(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose full sets are alike enough."""
    both = near.join(sets.toDF("b", "ys").hint("merge"), "b").join(sets.toDF("a", "xs").hint("merge"), "a")
    common = F.size(F.array_intersect("xs", "ys"))
    return both.filter(100 * common >= percent * (F.size("xs") + F.size("ys") - common)).select("a", "b").distinct()


def _chance(percent: int, run: int, least: int) -> float:
    """That of ``SKETCH`` values, each shared with ``percent``, fewer than ``least`` runs of ``run`` are."""
    p, at = percent / 100, {(0, 0): 1.0}  # by the shared values just seen and the runs so far
    for _ in range(SKETCH):
        new: dict[tuple[int, int], float] = {}
        for (k, m), x in at.items():
            for to, q in (((0, m), 1 - p), ((min(k + 1, run), m + (k + 1 >= run)), p)):
                if to[1] < least:
                    new[to] = new.get(to, 0.0) + x * q
        at = new
    return sum(at.values())


def _common_runs(percent: int) -> tuple[int, int, int]:
    """The length of runs; how many any two linked classes share; the size from which sets do without the runs over their ends."""
    for run in range(RUN, 0, -1):
        lost = run * (100 - percent)  # runs, of each 100 values of both sets, that hold one of only one set
        least = max((m for m in range(1, MEET + SPARE + 1) if _chance(percent, run, m) < 1e-8), default=1)
        if run == 1 or lost <= 80 and least >= MEET:
            break
    enough = -(-100 * (least + run - 1) // (100 - lost)) if lost < 100 else 0
    ends = [u + run - 1 - run * ((100 - percent) * u // 100) for u in range(1, enough) if (100 - percent) * u >= 100]
    return run, max(1, min([least, *ends])), enough


def _runs(classes: DataFrame, run: int, enough: int) -> DataFrame:
    """(v, rep): hashes of each ``run`` values of a sketch that follow one another, and in smaller sets than ``enough`` of those over its ends."""
    pad = run - 1

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["sketch"].value_lengths().to_numpy().astype(np.int64)
            doc, n = np.arange(len(sizes)), int(sizes.sum())
            values = np.zeros(n + 2 * pad * len(sizes), np.uint64)  # zeros mark the ends
            values[np.arange(n) + pad * (2 * np.repeat(doc, sizes) + 1)] = batch["sketch"].flatten().to_numpy().view(np.uint32)
            begin, count = np.cumsum(sizes) - sizes + 2 * pad * doc, sizes + pad
            inner = sizes >= enough
            begin[inner] += pad
            count[inner] -= 2 * pad
            a = np.arange(int(count.sum())) + np.repeat(begin - np.cumsum(count) + count, count)
            h = mix(values[a])
            for k in range(1, run):
                h = mix(h + values[a + k])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.repeat(batch["rep"].to_numpy(), count))], ["v", "rep"])

    return classes.select("rep", "sketch").mapInArrow(hashes, "v long, rep long")


def _lists(classes: DataFrame, run: int, enough: int, spare: int) -> DataFrame:
    """(v, rep, n, common): each class in the lists of its runs, but for the ``spare`` commonest; lists of one are left out. ``common``: how common its runs are."""
    entries = _runs(classes, run, enough)
    shared = entries.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    listed = entries.join(shared, "v").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("by_df"), F.sum(F.floor(16 * F.log2("df"))).alias("common"))  # SKETCH runs at most
    taken = listed.filter(F.size("by_df") > spare).join(classes.select("rep", F.col("n_shingles").alias("n")), "rep")
    return taken.select("rep", "n", "common", F.explode(F.slice("by_df", F.lit(1), F.size("by_df") - spare)).alias("x")).select("x.v", "rep", "n", "common")


def _centers(entries: DataFrame, kept: Scratch) -> DataFrame:
    """(hub, center): of the members of each hub the one most like what at least half of them have."""
    size = kept(entries.select("hub", "rep").distinct().groupBy("hub").agg(F.count("*").alias("m")))
    core = kept(entries.groupBy("hub", "v").agg(F.count("*").alias("df")).join(size, "hub").filter("2 * df >= m").select("hub", "v"))
    wide = kept(core.groupBy("hub").agg(F.count("*").alias("k")))
    inside = entries.join(core, ["hub", "v"]).groupBy("hub", "rep", "n").agg(F.count("*").alias("c")).join(wide, "hub")
    return kept(inside.groupBy("hub").agg(F.max_by("rep", F.struct(F.col("c") / (F.col("n") + F.col("k") - F.col("c")), -F.col("rep"))).alias("center")))


def _by_full_sets(entries: DataFrame, percent: int, kept: Scratch) -> DataFrame:
    """Pairs (a, b) of different labels that the full sets of ``entries`` (rep, label, hub, n, v) allow to be linked.

    Members of one hub, mostly copies of one text, meet in lists of their own, in the
    order of their own frequencies; those of different hubs by the values that several
    hubs' members have.
    """
    return _meeting(entries, ["hub", "v"], percent, kept).union(_meeting(entries, ["v"], percent, kept)).distinct()


def _meeting(entries: DataFrame, by: list[str], percent: int, kept: Scratch) -> DataFrame:
    """Pairs (a, b) that meet in the lists of ``by`` by the rarest values of their sets; without the hub in it, pairs of different hubs."""
    apart = "hub" not in by
    shared = entries.groupBy(*by).agg(F.count("*").alias("df"), (F.min("hub") < F.max("hub")).alias("hubs")).filter("hubs" if apart else "df > 1")
    ranked = entries.join(kept(shared.select(*by, "df")), by).groupBy("rep", "label", "hub", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("by_df"))  # of one set
    # Values that no other has come first; of a set of n, linked with one of percent / 100 * n or more, n - need + 1 must hold a common one.
    placed = ranked.select("rep", "label", "hub", "n", F.size("by_df").alias("s"), F.posexplode("by_df").alias("k", "x")).select("rep", "label", "hub", "n", (F.col("n") - F.col("s") + F.col("k") + 1).alias("place"), "x.v")
    large = kept(placed.filter(f"place <= n - ceil({percent} * n / 100) + 1"))
    small = large.filter(f"place <= n - ceil({2 * percent} * n / {100 + percent}) + 1")  # as the smaller of the two
    other = large.toDF("rep2", "label2", "hub2" if apart else "hub", "n2", "place2", "v")
    met = small.join(other, by).filter(f"label <> label2 and (n < n2 or (n = n2 and rep < rep2)) and 100 * n >= {percent} * n2 and {100 + percent} * (1 + least(n - place, n2 - place2)) >= {percent} * (n + n2)")
    return (met.filter("hub <> hub2") if apart else met).select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, list_size: int = LIST) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to, its own included) and kept (it is the smallest)."""
    with Scratch(docs.sparkSession) as kept:
        sketches = kept(_sketches(docs, words))
        one = sketches.filter("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles")
        classes = kept(one.agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")))
        run, shared, enough = _common_runs(percent)
        meet = min(MEET, shared)
        lists = kept(_lists(classes, run, enough, shared - meet))

        def met(rows: DataFrame) -> DataFrame:
            able = rows.filter(f"100 * least(n, n2) >= {percent} * greatest(n, n2)")
            pairs = able.groupBy(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).agg(F.count("*").alias("k"))
            return pairs.filter(f"k >= {meet}").select("a", "b")

        other = [F.col(c).alias(f"{c}2") for c in ("rep", "n")]
        hubs = lists.groupBy("v").agg(F.count("*").alias("m"), F.max_by(F.struct("rep", "n"), F.struct("common", F.xxhash64("rep"))).alias("hub")).filter("m > 1")
        hubs = kept(hubs.select("v", "m", "hub.*").select("v", "m", *other))
        first = kept(met(lists.join(hubs.drop("m"), "v").filter("rep <> rep2")))
        near = kept(_estimated(first, classes))
        links = kept(_alike(near, kept(_sets(docs, _ends(near), words)), percent))

        labels = kept(components(links, kept))
        named = kept(lists.join(labels, lists.rep == labels.node, "left").select("v", "rep", "n", F.coalesce("label", "rep").alias("label")))
        mixed = kept(named.groupBy("v").agg(F.count("*").alias("m"), (F.min("label") != F.max("label")).alias("mixed")).filter("mixed").select("v", "m"))
        short = kept(named.join(mixed.filter(F.col("m") <= list_size), "v"))
        long = named.join(mixed.filter(F.col("m") > list_size), "v").join(hubs.select("v", F.col("rep2").alias("hub")), "v")
        long = kept(long.groupBy("rep", "label").agg(F.max_by("hub", F.struct("m", "hub")).alias("hub")))  # of the longest list
        long = kept(long.join(long.select(F.col("rep").alias("hub"), F.col("hub").alias("above")).distinct(), "hub", "left").groupBy("rep", "label").agg(F.min(F.coalesce("above", "hub")).alias("hub")))
        rest = met(short.join(short.select("v", *other, F.col("label").alias("label2")), "v").filter("label <> label2 and rep < rep2"))
        near = kept(_estimated(rest.join(first, ["a", "b"], "left_anti"), classes))
        sets = kept(_sets(docs, _ends(near).union(long.select("rep")), words))
        entries = kept(long.join(sets, "rep").select("rep", "label", "hub", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("v")))
        beside = long.join(_centers(entries, kept), "hub").filter("rep <> center and label <> center").select(F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b")).distinct()
        beside = kept(beside.join(first, ["a", "b"], "left_anti"))
        links = kept(links.union(_alike(near.union(_estimated(beside, classes)).distinct(), sets, percent)))

        labels = kept(components(links, kept))
        entries = kept(entries.drop("label").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep")))
        wide = _by_full_sets(entries, percent, kept).join(first.union(beside), ["a", "b"], "left_anti")
        links = kept(links.union(_alike(_estimated(wide, classes), sets, percent)))

        labels = kept(components(links, kept))
        member = sketches.join(classes.select("set_a", "set_b", "n_shingles", "rep"), ["set_a", "set_b", "n_shingles"], "left")
        component = F.when(F.col("n_shingles") > 0, F.coalesce("label", "rep")).otherwise(F.col("doc_id"))
        out = member.join(labels, member.rep == labels.node, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
        return written(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all columns, but of each component only its smallest doc_id."""
    gone = near_duplicates(docs, words, percent).filter("not kept").select(F.col("doc_id").alias("chronolith_id")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"].cast("long") == F.col("chronolith_id"), "left_anti").select(*docs.columns)
