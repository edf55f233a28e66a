"""The pipeline on planted documents: what must go goes, clean documents stay, and ids are the library's."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}".replace("1", "x") for _ in range(n))
    item = words(30)
    clean = [words(rng.randint(60, 150)) for _ in range(20)]
    docs = [(i, t) for i, t in enumerate(clean)]
    near = clean[3].split()
    near[5] = "changed"
    docs += [(100, clean[0]), (101, " ".join(near)), (102, words(20) + " " + item[:200] + " " + words(20)), (103, "too short"), (104, "a b c d e f g h " * 20), (105, None), (106, "")]
    for i in range(6):
        docs.append((200 + i, words(50) + "\nAll rights reserved, page " + str(i)))
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(20), *range(200, 206)}
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = dict(docs)
    for i in range(20):
        assert list(got[i].ids) == tk.encode(text[i], add_special_tokens=False).ids
    assert list(got[200].ids) == tk.encode(text[200], add_special_tokens=False).ids
    assert list(got[203].ids) == tk.encode(text[203].split("\n")[0], add_special_tokens=False).ids


def test_stages_take_empty_tables_and_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
