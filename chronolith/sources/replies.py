"""Replies of language models as rows: scores of headlines, search plans, explanations.

A reply is free text that holds one JSON value somewhere: the first array, or the first
object, from its first bracket to the bracket that closes it, whatever prose, code fences
or further brackets stand around it. Brackets in strings, and escaped quotes, close
nothing. Spark's own JSON reader finds the end, as it stops where the first value ends, so
all of it stays in the JVM; a value that is cut off or malformed is null, and then nothing
of that reply counts. What the value holds is typed leniently, as a reply is not to be
trusted: a field of another type is as good as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dedupe import first_per

# Headlines of one request, plans of one reply and their lengths, and what no plain search term holds.
BATCH, MOST_PLANS, LEAST_QUERY, MOST_QUERY, MOST_RATIONALE = 25, 6, 3, 60, 200
NO_TERM = r"https?:|//|[<>{}\\|`$]"
NUMBERS = ["BIGINT", "DOUBLE", "FLOAT"]


def _from(text: Column, bracket: str, kind: str) -> Column:
    at = F.instr(text, F.lit(bracket))
    return F.when(at > 0, F.from_json(F.substring(text, at, F.length(text)), kind, {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}))


def first_array(text: Column) -> Column:
    """The items of the first JSON array in a text."""
    return _from(text, "[", "array<variant>")


def first_object(text: Column) -> Column:
    """The first JSON object in a text, as a variant."""
    return _from(text, "{", "variant")


def is_number(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return F.coalesce(kind.isin(NUMBERS) | kind.startswith("DECIMAL"), F.lit(False))


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def field(item: Column, name: str) -> Column:
    """A field of an object, still typed; null where the item is no object."""
    return F.try_variant_get(item, f"$.{name}", "variant")


def as_text(item: Column, name: str) -> Column:
    """A field that is a string, else null."""
    return F.when(is_string(field(item, name)), F.try_variant_get(item, f"$.{name}", "string"))


def place_of(value: Column) -> Column:
    """The place, from 1 on, that a value names: a whole number, or a text or a truth that stands for one."""
    number = F.try_variant_get(value, "$", "double")
    return F.when((number == F.floor(number)) & (number >= 1) & (number < 2**31), number.cast("int"))


def bodies(landed: DataFrame) -> DataFrame:
    """(batch_id, text, input_tokens, output_tokens) of landed answers (batch_id, body): the first part that is text; numbers of tokens that lack are 0."""
    x = F.from_json("body", "content array<struct<type:string,text:string>>, usage struct<input_tokens:bigint,output_tokens:bigint>")
    rows = landed.select("batch_id", x.alias("x"))
    first = F.get(F.filter("x.content", lambda c: c["type"] == "text"), 0)["text"]
    return rows.select("batch_id", F.coalesce(first, F.lit("")).alias("text"), *(F.coalesce(F.col(f"x.usage.{c}"), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")))


def batches(rows: DataFrame, by: str, order: list[str], size: int = BATCH) -> DataFrame:
    """``rows`` with the batch of each request (batch) and the place in it (place, from 1 on), in order within each ``by``."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return rows.withColumn("n", n).withColumns({"batch": F.floor(F.col("n") / size).cast("int"), "place": (F.col("n") % size + 1).cast("int")}).drop("n")


def scores(replies: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys of their batch, place, …) that a reply (keys, text) scores, with ``score`` from 0 to 1.

    An item without a number as its score, or with a place that the batch lacks, counts
    for nothing; of several items of one place the last counts; an item that is null ends
    the reply. A reply without a sound array scores no row of its batch.
    """
    items = first_array(F.col("text"))
    end = F.array_position(F.transform("items", lambda x: F.coalesce(F.is_variant_null(x), F.lit(True))), True)
    sound = replies.select(*keys, items.alias("items")).withColumn("items", F.when(end > 0, F.slice("items", F.lit(1), (end - 1).cast("int"))).otherwise(F.col("items")))
    each = sound.select(*keys, F.posexplode("items").alias("at", "item"))
    s = field(F.col("item"), "s")
    named = each.select(*keys, "at", place_of(field(F.col("item"), "i")).alias("place"), F.when(is_number(s), F.try_variant_get("item", "$.s", "double")).alias("score")).filter("place is not null and score is not null")
    last = named.groupBy(*keys, "place").agg(F.max_by("score", "at").alias("score"))
    return rows.join(last, [*keys, "place"]).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))))


def plans(replies: DataFrame, asked: DataFrame, sources: list[str]) -> DataFrame:
    """(batch_id, pos, source, query, rationale) of replies (batch_id, text): plain search terms for known sources.

    Controls and runs of blanks in a query become one blank; its length, its characters,
    and that it was not ``asked`` (batch_id, query) before, in any case, are tested then.
    Of repeats the first counts, and the first six of a reply.
    """
    each = replies.select("batch_id", F.posexplode(first_array(F.col("text"))).alias("pos", "item"))
    text = F.trim(F.regexp_replace(F.regexp_replace(as_text(F.col("item"), "query"), r"[\x00-\x1f\x7f]", " "), r"\s+", " "))
    why = F.substring(F.trim(F.regexp_replace(as_text(F.col("item"), "rationale"), r"\s+", " ")), 1, MOST_RATIONALE)
    rows = each.select("batch_id", "pos", as_text(F.col("item"), "source").alias("source"), text.alias("query"), F.coalesce(why, F.lit("")).alias("rationale"))
    good = rows.filter(F.col("source").isin(sources) & F.length("query").between(LEAST_QUERY, MOST_QUERY) & ~F.col("query").rlike(NO_TERM)).withColumn("key", F.lower("query"))
    fresh = good.join(asked.select("batch_id", F.lower(F.trim("query")).alias("key")), ["batch_id", "key"], "left_anti")
    return first_per(first_per(fresh, ["batch_id", "key"], ["pos"]), ["batch_id"], ["pos"], MOST_PLANS).drop("key")


def explanations(replies: DataFrame, offered: DataFrame) -> DataFrame:
    """(batch_id, body, cited) of replies (batch_id, text): an explanation, and the events of those ``offered`` (batch_id, place, event_id) that it cites, each once, in the order of its citations. Without a body or a known citation there is none."""
    found = replies.select("batch_id", first_object(F.col("text")).alias("x"))
    found = found.select("batch_id", F.trim(as_text(F.col("x"), "explanation")).alias("body"), F.try_variant_get("x", "$.cites", "array<variant>").alias("cites")).filter("body <> ''")
    cited = found.select("batch_id", F.posexplode("cites").alias("at", "c")).select("batch_id", "at", place_of(F.col("c")).alias("place")).join(offered, ["batch_id", "place"])
    first = cited.groupBy("batch_id", "event_id").agg(F.min("at").alias("at"))
    listed = first.groupBy("batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_id"))), lambda r: r["event_id"]).alias("cited"))
    return found.select("batch_id", "body").join(listed, "batch_id")
