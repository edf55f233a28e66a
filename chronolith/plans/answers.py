"""Queries of models' replies, made from the tables in all the shapes that replies come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import replies
from .queries import query, table

#: What stands before and after an array: nothing, a code fence, prose with brackets, a bracket that is no array, a cut.
AROUND = [("", ""), ("Here you are:\n```json\n", "\n```\nAnything else?"), ("", " (see [1] and {2})"), ("[sic] ", ""), ("", None)]


@query("""
WITH r AS (SELECT o_custkey AS k, o_orderkey AS e, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders),
b AS (SELECT k, e, n // 25 AS batch, n % 25 + 1 AS place, (k + n // 25) % 5 AS shape FROM r)
SELECT e AS event_id, k AS subject_id, CAST(batch AS INT) AS batch, CASE WHEN place = 1 AND k % 3 = 0 AND k % 4 <> 1 THEN 0.25 ELSE least(1.0, greatest(0.0, (e % 150 - 20) / 100.0)) END AS score
FROM b WHERE shape < 3 AND NOT (k % 4 = 1 AND place > 9) AND (e % 7 <> 0 OR place = 1 AND k % 3 = 0 AND k % 4 <> 1)""")  # fmt: skip
def q_model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Headlines by subject in requests of 25; replies with strings that hold brackets, scores beyond 0 to 1 or in quotes, places that no headline has, a null amid the items, and a second score of the first."""
    e, k = F.col("o_orderkey"), F.col("o_custkey")
    rows = replies.batches(table(spark, sf, "orders").select(k.alias("subject_id"), e.alias("event_id")), "subject_id", ["event_id"])
    s = ((F.col("event_id") % 150 - 20) / 100.0).cast("string")
    item = F.concat(F.lit('{"why":"a ] \\\\ \\" [","i":'), F.when(F.col("place") % 2 == 0, F.concat(F.lit('"'), "place", F.lit('"'))).otherwise(F.col("place").cast("string")), F.lit(',"s":'), F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('"'), s, F.lit('"'))).otherwise(s), F.lit("}"))
    said = rows.groupBy("subject_id", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("item")))), lambda x: x["item"]).alias("items"))
    k = F.col("subject_id")
    cut = F.when(k % 4 == 1, F.concat(F.slice("items", 1, 9), F.array(F.lit("null")), F.slice("items", 10, 25))).otherwise(F.col("items"))
    more = F.concat(cut, F.array(F.lit('{"i":99,"s":1}'), F.lit("7"), F.lit('{"s":0.5}')), F.when(k % 3 == 0, F.array(F.lit('{"i":1,"s":0.25}'))).otherwise(F.array().cast("array<string>")))
    array = F.concat(F.lit("["), F.array_join(more, ", "), F.lit("]"))
    shape = (k + F.col("batch")) % len(AROUND)
    text = F.when(shape == 4, F.substring(array, 1, F.length(array) - 2))
    for i, (before, after) in enumerate(AROUND[:4]):
        text = text.when(shape == i, F.concat(F.lit(before), array, F.lit(after)))
    return replies.scores(said.select("subject_id", "batch", text.alias("text")), rows, ["subject_id", "batch"]).select("event_id", "subject_id", "batch", "score")


@query("""
WITH p AS (SELECT o_custkey AS batch_id, o_orderkey AS e, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders),
q AS (SELECT *, CASE e % 6 WHEN 0 THEN concat('see https://x.test/', e) WHEN 1 THEN 'ab' WHEN 2 THEN concat('supply chain ', e % 3) ELSE concat('Ore of ', e % 50) END AS q FROM p WHERE e % 5 < 3),
f AS (SELECT batch_id, pos, e, q, row_number() OVER (PARTITION BY batch_id, lower(q) ORDER BY pos) AS r FROM q WHERE e % 6 > 1 AND NOT lower(q) IN ('supply chain 1', 'ore of 7'))
SELECT batch_id, CAST(pos AS INT) AS pos, CASE e % 5 WHEN 0 THEN 'gdelt' ELSE 'loc_chronam' END AS source, q AS query, concat('why ', e) AS rationale FROM f WHERE r = 1 QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY pos) <= 6""")  # fmt: skip
def q_model_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Search plans of each customer's reply: known and unknown sources, addresses, short terms, repeats in other case, controls and runs of blanks, what was asked before."""
    e, k = F.col("o_orderkey"), F.col("o_custkey")
    term = F.when(e % 6 == 0, F.concat(F.lit("see https://x.test/"), e)).when(e % 6 == 1, F.lit("ab")).when(e % 6 == 2, F.concat(F.lit(" supply\\u0007\\n chain "), e % 3)).otherwise(F.concat(F.lit("Ore  of\\t"), e % 50))
    source = F.when(e % 5 == 0, '"gdelt"').when(e % 5 < 3, '"loc_chronam"').when(e % 5 == 3, '"the web"').otherwise("3")
    item = F.concat(F.lit('{"source":'), source, F.lit(',"query":"'), term, F.lit('","rationale":"why  '), e, F.lit('"}'))
    said = table(spark, sf, "orders").groupBy(k.alias("batch_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(e.alias("e"), item.alias("item")))), lambda x: x["item"]).alias("items"))
    answers = said.select("batch_id", F.concat(F.lit("```json\n["), F.array_join("items", ","), F.lit("]\n```")).alias("text"))
    asked = answers.select("batch_id", F.explode(F.array(F.lit("Supply chain 1 "), F.lit("ORE OF 7"))).alias("query"))
    return replies.plans(answers, asked, ["gdelt", "loc_chronam", "federal_register"])
