"""Which subject a query meant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import text


def known_company(queries: DataFrame, companies: DataFrame) -> DataFrame:
    """For each query (query_id, query) the company (subject_id, ticker, display_name) of that ticker, that name, or a name that begins with it and a space; then the shortest name.

    Three equality joins, none of which pairs all queries with all companies.
    """
    q = queries.select("query_id", F.upper(F.trim("query")).alias("t"), F.lower(F.trim("query")).alias("name")).filter("t <> ''")
    c = companies.filter("ticker is not null").select("subject_id", "ticker", "display_name", F.upper("ticker").alias("t"), F.lower("display_name").alias("low"))
    words = F.split("low", " ")
    heads = c.select("subject_id", "ticker", "display_name", F.explode(F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).otherwise(F.array().cast("array<string>"))).alias("name"))
    found = q.join(c.drop("low"), "t").select("query_id", "subject_id", "ticker", "display_name", F.lit(1).alias("rung"))
    found = found.union(q.drop("t").join(c.withColumnRenamed("low", "name"), "name").select("query_id", "subject_id", "ticker", "display_name", F.lit(2)))
    found = found.union(q.join(heads, "name").select("query_id", "subject_id", "ticker", "display_name", F.lit(3)))
    best = Window.partitionBy("query_id").orderBy("rung", F.length("display_name"), "subject_id")
    return found.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r")


def candidates(queries: DataFrame, subjects: DataFrame, aliases: DataFrame, floor: float = model.SIMILARITY_FLOOR, most: int = 5) -> DataFrame:
    """The subjects each query may mean, on one scale: 1.0 ticker, 0.97 name, 0.93 alias, 0.90 prefix, else the word similarity of trigrams to the name or an alias.

    Fuzzy pairs come from an inverted index of trigrams: a similarity of ``floor`` needs
    that share of the query's trigrams, so any pair meets in one of so many of the
    query's rarest, and only pairs with enough in common are compared. Common trigrams,
    whose lists are long, are left alone.
    Subjects: (subject_id, slug, ticker, display_name); aliases: (subject_id, alias).
    """
    asked = queries.select("query_id", F.trim("query").alias("query")).filter("query <> ''")
    q = asked.select("query").distinct()  # a text is answered once, however often it is asked
    names = subjects.select("subject_id", F.col("display_name").alias("name"), F.lit(True).alias("own")).union(aliases.select("subject_id", "alias", F.lit(False)))
    fuzzy = q.filter(text.worth_fuzzy(F.col("query")))
    grams = fuzzy.select("query", F.array_distinct(text.trigram_list(F.col("query"))).alias("g"))
    of_name = F.array_distinct(text.trigram_list(F.col("name")))
    held = names.select("subject_id", "name", F.explode(of_name).alias("gram"))
    wanted = grams.select("query", "g", F.explode("g").alias("gram")).join(held.groupBy("gram").agg(F.count("*").alias("df")), "gram", "left")
    rarest = Window.partitionBy("query").orderBy(F.coalesce("df", F.lit(0)), "gram")
    kept = wanted.withColumn("r", F.row_number().over(rarest)).filter(F.col("r") <= F.size("g") - F.ceil(floor * F.size("g")) + 1)
    met = kept.join(held, "gram").select("query", "g", "subject_id", "name").distinct()
    close = met.filter(F.size(F.array_intersect("g", of_name)) >= floor * F.size("g"))
    near = close.select("query", "subject_id", text.word_similarity(F.col("query"), F.col("name")).alias("score"), F.lit(5).alias("via"))
    low = q.withColumn("low", F.lower("query"))
    exact = low.join(subjects.select("subject_id", F.lower("ticker").alias("low")), "low").select("query", "subject_id", F.lit(1.0), F.lit(1))
    exact = exact.union(low.join(subjects.select("subject_id", F.lower("display_name").alias("low")), "low").select("query", "subject_id", F.lit(0.97), F.lit(2)))
    exact = exact.union(low.join(aliases.select("subject_id", F.lower("alias").alias("low")), "low").select("query", "subject_id", F.lit(0.93), F.lit(3)))
    words = F.split(F.lower("display_name"), " ")
    heads = subjects.select("subject_id", F.explode(F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).otherwise(F.array().cast("array<string>"))).alias("low"))
    exact = exact.union(low.join(heads, "low").select("query", "subject_id", F.lit(0.90), F.lit(4)))
    scored = near.union(exact).groupBy("query", "subject_id").agg(F.max("score").alias("score"), F.min("via").alias("v")).filter(F.col("score") >= floor)
    via = F.get(F.array(*map(F.lit, ["ticker", "name", "alias", "prefix", "fuzzy"])), F.col("v") - 1)
    out = scored.join(subjects.select("subject_id", "slug", "display_name"), "subject_id").select("query", "subject_id", "slug", "display_name", F.round("score", 6).alias("score"), via.alias("via"))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.length("display_name"), "slug")
    ranked = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
    return asked.join(ranked, "query").drop("query")


def by_slug(queries: DataFrame, subjects: DataFrame, aliases: DataFrame) -> DataFrame:
    """For each query (query_id, slug) the subject of that slug, else of that alias; the smallest id of several."""
    low = queries.select("query_id", F.lower("slug").alias("slug"))
    own = low.join(subjects.select("slug", "subject_id"), "slug").select("query_id", "subject_id", F.lit(0).alias("rung"))
    other = low.join(aliases.select(F.lower("alias").alias("slug"), "subject_id"), "slug").select("query_id", "subject_id", F.lit(1))
    return own.union(other).groupBy("query_id").agg(F.min_by("subject_id", F.struct("rung", "subject_id")).alias("subject_id"))


def has_events(targets: DataFrame, subjects: DataFrame, aliases: DataFrame, links: DataFrame) -> DataFrame:
    """(target, has_events): whether a subject of that slug, ticker or alias has events. Alternatives are joined one by one."""
    low = targets.select(F.lower("target").alias("target")).distinct()
    names = subjects.select("subject_id", F.lower("slug").alias("target")).union(subjects.filter("ticker is not null").select("subject_id", F.lower("ticker"))).union(aliases.select("subject_id", F.lower("alias")))
    hit = low.join(names, "target").join(links.select("subject_id").distinct(), "subject_id", "left_semi").select("target").distinct().withColumn("hit", F.lit(True))
    return low.join(hit, "target", "left").select("target", F.coalesce("hit", F.lit(False)).alias("has_events"))
