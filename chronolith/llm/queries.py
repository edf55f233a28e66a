"""The queries opN_<name> over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottomk_dedup, bpe_backtrack, conversation_repair, decontaminate, license_scan, line_templates, quality_fm, repetition_rules, separator_scan, source_divergence, substring_automata, token_huffman, warc
from .storage import shared_dir, written

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
WORD_BPE_END = 49407


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.line_report(table(spark, sf_dir, "documents"))


def op2_token_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    token_huffman.write(table(spark, sf_dir, "documents"), WORD_BPE, path)
    return token_huffman.read(spark, path)


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = separator_scan.write_flat(table(spark, sf_dir, "documents"), WORD_BPE, WORD_BPE_END)
    return separator_scan.with_doc_ids(separator_scan.count_tokens(files, WORD_BPE_END), files)


def op4_substring_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_automata.remove_repeats(table(spark, sf_dir, "documents"))


def op5_bottomk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op6_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_fm.score(docs, quality_fm.train(docs, table(spark, sf_dir, "labels")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_spans")


def op8_bpe_backtrack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_backtrack.encode_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan_licenses(docs.withColumn("path", F.concat_ws("/", "source", "lang", F.expr("doc_id div 100"), "doc_id")))


def op10_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules.measure(table(spark, sf_dir, "documents"))


def op11_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(table(spark, sf_dir, "pages"))
    pages = warc.read(archive.files).filter("record_type is null or record_type <> 'warcinfo'")
    found = written(pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "fault"))
    archive.drop(spark)
    return found


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_all(conversation_repair.damage(rows), rows)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_templates": op1_line_templates,
    "op2_token_huffman": op2_token_huffman,
    "op3_separator_scan": op3_separator_scan,
    "op4_substring_automata": op4_substring_automata,
    "op5_bottomk_dedup": op5_bottomk_dedup,
    "op6_quality_fm": op6_quality_fm,
    "op7_decontaminate": op7_decontaminate,
    "op8_bpe_backtrack": op8_bpe_backtrack,
    "op9_license_scan": op9_license_scan,
    "op10_repetition_rules": op10_repetition_rules,
    "op11_warc_records": op11_warc_records,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op9_license_scan": license_scan.oracle("SELECT doc_id, concat_ws('/', source, lang, doc_id // 100, doc_id) AS path, text FROM documents"),
    "op11_warc_records": warc.ORACLE,
    "op13_source_divergence": source_divergence.ORACLE,
}
