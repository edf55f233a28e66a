"""The first JSON value of a reply, and what counts of it."""

import json

import pytest
from pyspark.sql import functions as F

from chronolith.sources import replies

SOUND = [
    ('[{"i":1,"s":0.9}]', [{"i": 1, "s": 0.9}]),
    ('Sure:\n```json\n[{"i":1}, [2, []], "]"]\n``` and [3]', [{"i": 1}, [2, []], "]"]),
    ('["a \\" ] [", "\\\\"] tail ]', ['a " ] [', "\\"]),
    ("[]", []),
    ('{"a":[1]} [2]', [1]),
    ('[null, true, "é \\u00e9"]', [None, True, "é é"]),
]
UNSOUND = ["", "none", '[{"i":1,"s":0.9}, {"i":2', "[1,]", "[sic] [1]", "['a']", '["a]', "]["]


@pytest.mark.parametrize("text,want", SOUND + [(t, None) for t in UNSOUND])
def test_first_array(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(F.transform(replies.first_array(F.col("t")), lambda x: F.to_json(x)).alias("x")).first().x
    assert got == want or [json.loads(x) for x in got] == want


def test_scores_of_a_batch(spark):
    rows = spark.createDataFrame([(b, p, 10 * b + p) for b in (1, 2, 3, 4) for p in (1, 2, 3)], "batch int, place int, event_id int")
    texts = ['[{"i":"2","s":7},{"i":1,"s":-3},{"i":1.5,"s":1},{"i":0,"s":1},{"i":9,"s":1},{"i":3,"s":"0.5"},{"i":3,"s":null},{"i":true,"s":0.75}]', '[{"i":1,"s":0.5},null,{"i":2,"s":0.5}]', '[{"i":1,"s":0.5},{"i":2,"s":', None]
    said = spark.createDataFrame(list(enumerate(texts, 1)), "batch int, text string")
    got = sorted((r.event_id, r.score) for r in replies.scores(said, rows, ["batch"]).collect())
    assert got == [(11, 0.75), (12, 1.0), (21, 0.5)]


def test_explanations_cite_what_was_offered(spark):
    offered = spark.createDataFrame([(b, p, 100 + p) for b in range(6) for p in (1, 2, 3)], "batch_id int, place int, event_id int")
    texts = ['Well: {"explanation":" It {rose}. ","cites":[3,"1",3,9,0,null]} done }', '{"explanation":"","cites":[1]}', '{"explanation":"x","cites":[9]}', '{"explanation":"x","cites":"1"}', '{"explanation":5,"cites":[1]}', '{"explanation":"cut","cites":[1']
    got = replies.explanations(spark.createDataFrame(list(enumerate(texts)), "batch_id int, text string"), offered).collect()
    assert [tuple(r) for r in got] == [(0, "It {rose}.", [103, 101])]


def test_answers_without_text(spark):
    rows = [(1, '{"content":[{"type":"tool"},{"type":"text","text":"a"},{"type":"text","text":"b"}],"usage":{"input_tokens":5}}'), (2, "{}"), (3, "no json"), (4, None)]
    got = replies.bodies(spark.createDataFrame(rows, "batch_id int, body string")).orderBy("batch_id").collect()
    assert [tuple(r) for r in got] == [(1, "a", 5, 0), (2, "", 0, 0), (3, "", 0, 0), (4, "", 0, 0)]
