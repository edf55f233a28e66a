"""Licences of files: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Terms are runs of a-z and 0-9 with A-Z lower-cased. A term's inverse document frequency
is over all files; a term that no template has counts as one of no file. Templates are
short notices, header blocks and licence texts. Each line of a file is compared with
each template, and so is each block of lines (up to a line without a term) and each
whole file. A file takes the licence of what is most similar, at a cosine of ``LEAST``
or more. A file that is as a whole as similar is a licence file, and gives its licence
to its directory; the most similar one decides. Files without a licence of their own
take that of the nearest directory above that has one.

Only what has a cue is weighed. Cues are picked from the frequencies such that the terms
of a template that are not cues have a norm of under ``LEAST`` times the whole; by the
Cauchy-Schwarz inequality nothing without a cue can be that similar, so none is lost.
Texts are scanned where they are, and never shuffled.

All of it is DataFrame operations; what goes to the driver is one count for each of the
templates' terms, which are fixed. Paths meet on directories: distinct directories, not
files, are expanded into their ancestors.

Defined results: a null or empty text has no terms and no licence of its own; a null path
is in no directory; ties of the rounded cosine go to the first licence by name; rows that
share a doc_id are one file; a null doc_id has no licence of its own; other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import NOTICES, TEXTS
from .storage import written

LEAST = 0.6
TEMPLATES = NOTICES + TEXTS
#: Between two blocks: line breaks with nothing but signs between them.
_GAP = r"\n(?:[^a-z0-9\n]*\n)+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_terms(text: str) -> dict[str, int]:
    """The terms of a template and how often it has each."""
    out: dict[str, int] = {}
    for t in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split():
        out[t] = out.get(t, 0) + 1
    return out


VOCABULARY = sorted({t for _, text in TEMPLATES for t in template_terms(text)})


def _terms(text: Column) -> Column:
    return F.filter(F.split(text, "[^a-z0-9]+"), lambda t: t != "")


def _weights(idf: dict[str, float]) -> list[dict[str, float]]:
    """Each template's weights, of norm 1."""
    out = []
    for _, text in TEMPLATES:
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in template_terms(text).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out.append({t: x / norm for t, x in raw.items()})
    return out


def cues(idf: dict[str, float], weights: list[dict[str, float]], least: float) -> list[str]:
    """Terms one of which any text has whose cosine to a template is ``least`` or more."""
    rest = [0.0] * len(weights)
    out = []
    for t in sorted(idf, key=lambda t: (idf[t], t)):
        more = [r + w.get(t, 0.0) ** 2 for r, w in zip(rest, weights, strict=True)]
        if max(more) < (least - 1e-6) ** 2:
            rest = more
        else:
            out.append(t)
    return out


def _any_of(words: list[str]) -> str:
    """A pattern of these words that looks at each letter once."""
    if not words:
        return "(?!)"
    tails: dict[str, list[str]] = {}
    for w in words:
        if w:
            tails.setdefault(w[0], []).append(w[1:])
    out = "|".join(c + (f"(?:{_any_of(rest)})" if any(rest) else "") for c, rest in sorted(tails.items()))
    return f"(?:{out})?" if "" in words and out else out


def scan_licenses(files: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per file (doc_id, path, text): doc_id, path, license, origin (header, directory or none), cosine of a header, license_dir."""
    spark = files.sparkSession
    low = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    files = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), low.alias("text"))
    vocabulary = F.array(*map(F.lit, VOCABULARY))
    every = F.lit("")  # counted once for each file: their number
    held = files.select(F.explode(F.concat(F.array(every), F.coalesce(F.array_intersect(_terms(F.col("text")), vocabulary), F.array().cast("array<string>")))).alias("term"))
    counts = {r["term"]: r["n"] for r in held.groupBy("term").agg(F.count("*").alias("n")).collect()}  # at most one row for each term of the templates
    total = counts.get("", 0)
    idf = {t: math.log((total + 1) / (counts.get(t, 0) + 1)) + 1 for t in VOCABULARY}
    unknown = math.log(total + 1) + 1
    weights = _weights(idf)
    rows = ", ".join(f"('{t}', {idf[t]!r}D, " + ", ".join(f"{w.get(t, 0.0)!r}D" for w in weights) + ")" for t in VOCABULARY)
    names = [f"w{k}" for k in range(len(TEMPLATES))]
    known = F.broadcast(spark.sql(f"SELECT * FROM VALUES {rows} AS t(term, idf, {', '.join(names)})"))

    cue = f"(?:^|[^a-z0-9])(?:{_any_of(cues(idf, weights, least))})(?:$|[^a-z0-9])"
    owned = files.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(cue))

    def likest(units: DataFrame, key: list[str]) -> DataFrame:
        """(key, best: cosine and licence) of units (key, text) as similar to a template as asked for."""
        terms = units.select(*key, F.explode(_terms(F.col("text"))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
        w = (1 + F.log(F.col("tf").cast("double"))) * F.coalesce("idf", F.lit(unknown))
        sums = terms.join(known, "term", "left").withColumn("w", w).groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *(F.sum(F.col("w") * F.coalesce(n, F.lit(0.0))).alias(n) for n in names))
        options = [F.struct((-F.round(F.col(n) / F.col("norm"), 6)).alias("minus"), F.lit(name).alias("license")) for n, (name, _) in zip(names, TEMPLATES, strict=True)]
        return sums.select(*key, F.least(*options).alias("best")).filter(F.col("best.minus") <= -least)

    parts = owned.select("doc_id", "path", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.split("text", by).alias("units")) for k, by in enumerate(("\n", _GAP))))).alias("x"))
    parts = parts.select("doc_id", "path", "x.kind", F.posexplode("x.units").alias("unit", "text")).filter(F.col("text").rlike(cue))
    units = parts.union(owned.select("doc_id", "path", F.lit(2), F.lit(0), "text"))
    best = written(likest(units, ["doc_id", "path", "kind", "unit"]))  # read for files and for directories: weighed once
    headers = best.groupBy("doc_id").agg(F.min("best").alias("best"))
    given = best.filter(F.col("path").isNotNull() & (F.col("kind") == 2)).groupBy(_directory(F.col("path")).alias("up")).agg(F.min("best").alias("dir_best"))

    placed = files.select("doc_id", "path", _directory(F.col("path")).alias("dir"))
    dirs = placed.select("dir").filter(F.col("dir").isNotNull()).distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.when(F.col("dir") == "", F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")).alias("up")))).alias("x")).select("dir", "x.*").distinct()
    nearest = above.join(given, "up").groupBy("dir").agg(F.max_by(F.struct("up", "dir_best"), "depth").alias("near"))
    out = placed.join(headers, "doc_id", "left").join(nearest, "dir", "left")
    return out.select(
        "doc_id", "path",
        F.coalesce("best.license", "near.dir_best.license").alias("license"),
        F.when(F.col("best").isNotNull(), "header").when(F.col("near").isNotNull(), "directory").otherwise("none").alias("origin"),
        (-F.col("best.minus")).alias("cosine"),
        F.when(F.col("best").isNull(), F.col("near.up")).alias("license_dir"),
    )


def _directory(path: Column) -> Column:
    """What is before the last slash; without one the root, which is empty."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), ""))


def oracle(files_sql: str, least: float = LEAST) -> str:
    """DuckDB SQL for the same over a query of (doc_id, path, text), all lines of it weighed."""
    templates = ", ".join(f"({k}, '{name}', '{t}', {n})" for k, (name, text) in enumerate(TEMPLATES) for t, n in template_terms(text).items())
    directory = lambda p: f"CASE WHEN instr({p}, '/') > 0 THEN regexp_replace({p}, '/[^/]*$', '') WHEN {p} IS NOT NULL THEN '' END"

    def likest(units: str, key: str) -> str:
        return f"""(SELECT {key}, min(best) best FROM (
            SELECT {key}, {{'minus': -round(dot / norm, 6), 'license': license}} best FROM (
                SELECT {key}, k, license, sum(u.w * t.w) dot, any_value(norm) norm FROM (
                    SELECT {key}, term, (1 + ln(tf)) * coalesce(idf, (SELECT ln(n + 1) + 1 FROM total)) w,
                        sqrt(sum(((1 + ln(tf)) * coalesce(idf, (SELECT ln(n + 1) + 1 FROM total))) ** 2) OVER (PARTITION BY {key})) norm
                    FROM (SELECT {key}, term, count(*) tf FROM (SELECT {key}, unnest(string_split_regex(text, '[^a-z0-9]+')) term FROM {units}) WHERE term <> '' GROUP BY ALL) LEFT JOIN idf USING (term)
                ) u JOIN weights t USING (term) GROUP BY {key}, k, license)
            WHERE -round(dot / norm, 6) <= -{least}) GROUP BY {key})"""

    return f"""
WITH files AS (SELECT doc_id, path, translate(text, '{_UPPER}', '{_LOWER}') AS text FROM ({files_sql})),
total AS (SELECT count(*) n FROM files),
templates AS (SELECT * FROM (VALUES {templates}) v(k, license, term, tf)),
df AS (SELECT term, count(*) n FROM (SELECT DISTINCT r, term FROM (SELECT row_number() OVER () r, unnest(string_split_regex(text, '[^a-z0-9]+')) term FROM files)) WHERE term IN (SELECT term FROM templates) GROUP BY term),
idf AS (SELECT DISTINCT term, ln(((SELECT n FROM total) + 1) / (coalesce(df.n, 0) + 1)) + 1 AS idf FROM templates LEFT JOIN df USING (term)),
weights AS (SELECT k, license, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) w FROM (SELECT k, license, term, (1 + ln(tf)) * idf w FROM templates JOIN idf USING (term))),
units AS (
    SELECT doc_id, path, 0 kind, unnest(range(len(l))) unit, unnest(l) text FROM (SELECT doc_id, path, string_split(text, chr(10)) l FROM files WHERE doc_id IS NOT NULL)
    UNION ALL SELECT doc_id, path, 1, unnest(range(len(l))), unnest(l) FROM (SELECT doc_id, path, string_split_regex(text, '{_GAP}') l FROM files WHERE doc_id IS NOT NULL)
    UNION ALL SELECT doc_id, path, 2, 0, text FROM files WHERE doc_id IS NOT NULL),
bests AS (SELECT * FROM {likest('units', 'doc_id, path, kind, unit')}),
headers AS (SELECT doc_id, min(best) best FROM bests GROUP BY doc_id),
given AS (SELECT {directory('path')} up, min(best) dir_best FROM bests WHERE path IS NOT NULL AND kind = 2 GROUP BY 1),
placed AS (SELECT doc_id, path, {directory('path')} dir FROM files),
above AS (SELECT dir, unnest(range(0, len(p) + 1)) depth, p FROM (SELECT DISTINCT dir, string_split(dir, '/') p FROM placed WHERE dir IS NOT NULL)),
nearest AS (SELECT dir, arg_max({{'up': up, 'best': dir_best}}, depth) near FROM (SELECT dir, depth, array_to_string(p[1:depth], '/') up FROM above) JOIN given USING (up) GROUP BY dir)
SELECT doc_id, path, coalesce(best.license, near.best.license) AS license,
    CASE WHEN best IS NOT NULL THEN 'header' WHEN near IS NOT NULL THEN 'directory' ELSE 'none' END AS origin,
    -best.minus AS cosine, CASE WHEN best IS NULL THEN near.up END AS license_dir
FROM placed LEFT JOIN headers USING (doc_id) LEFT JOIN nearest USING (dir)
"""
