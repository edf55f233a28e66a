"""Token counts of documents in flat token files without an index, by a scan for separators.

A flat file is a row of little-endian ids of 2 or 4 bytes; an end id follows each
document. Files are cut into blocks of ``BLOCK_BYTES`` wherever these fall, and blocks
are read and searched on their own, each by one vectorised comparison. A document may
begin in one block and end many blocks later: a prefix scan over the blocks of a file
carries the place of the last separator, and the number of separators, from block to
block. Only a few numbers of each block take part in it.

Defined results: an empty file has no documents; ids after a file's last end id are a
document that has not ``ended``; a document may have no ids. In ``write_flat`` null
texts are empty, null doc_ids and repeated rows are written like any others, and special
tokens' strings in a text are ordinary text, so the end id comes from nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_backtrack import tokenizer_text
from .storage import shared_dir, written
from .token_huffman import library_words
from .wordscan import chunks, utf8

BLOCK_BYTES = 4 << 20
IDS_A_ROW = 10_000
FILES = "shard int, path string, bytes long"


def write_flat(docs: DataFrame, tokenizer_path: str, end_id: int, width: int = 2) -> DataFrame:
    """Writes each partition of ``docs`` to a flat file in the shared folder: rows (shard, path, bytes, first, doc_ids). No shuffle.

    A row holds the ids of the documents from the file's number ``first`` on, some tens
    of thousands at most; the last of a file has its bytes, the others 0.

    A file's name has the attempt that wrote it, and only attempts whose rows are kept
    count, so a task may run again at any time.
    """
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))
    folder = shared_dir(docs.sparkSession)
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, task = library_words(held.value, specials_are_text=True), TaskContext.get()
        store, inner = fs.FileSystem.from_uri(folder)
        store.create_dir(inner, recursive=True)
        name = f"tokens-{task.partitionId()}-{task.taskAttemptId()}.bin"
        names, done, size = [], 0, 0

        def row(upto: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([upto], pa.int64()), pa.array([done], pa.int64()), pa.array([names], pa.list_(pa.int64()))], ["shard", "path", "bytes", "first", "doc_ids"])

        with store.open_output_stream(f"{inner}/{name}") as out:
            for batch in batches:
                raw, offs = utf8(batch["text"])
                names += batch["doc_id"].to_pylist()
                for *_, piece, at in chunks(raw, offs):
                    found, ends = table.encode(piece, at)
                    ids = np.insert(found.astype(np.uint32), ends[1:], end_id)
                    if width == 2 and len(ids) and ids.max() >> 16:
                        raise ValueError("ids of over 16 bits need a width of 4")
                    out.write(ids.astype(kind).tobytes())
                    size += width * len(ids)
                if len(names) >= IDS_A_ROW:
                    yield row(0)
                    done, names = done + len(names), []
        if size:
            yield row(size)

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(columns.mapInArrow(run, FILES + ", first long, doc_ids array<long>"))


def count_tokens(files: DataFrame, end_id: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document in flat files (shard, path, bytes): shard, doc_no in its file, start, n_tokens without the end id, and ended."""
    block_bytes -= block_bytes % width

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, inner = fs.FileSystem.from_uri(r["path"])
                with store.open_input_file(inner) as f:
                    ids = np.frombuffer(f.read_at(r["size"], r["block"] * block_bytes), f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + r["block"] * (block_bytes // width)
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"]], pa.int32()), pa.array([r["block"]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["shard", "block", "n", "ends"])

    blocks = files.filter("bytes > 0").select("shard", "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block_bytes))).alias("block"))
    blocks = blocks.select("shard", "path", "block", F.least(F.lit(block_bytes), F.col("bytes") - F.col("block") * block_bytes).alias("size"))
    found = written(blocks.repartition("shard", "block").mapInArrow(search, "shard int, block long, n long, ends array<long>"))
    by_file = Window.partitionBy("shard").orderBy("block")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("shard", "block", "n", F.size("ends").cast("long").alias("k"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    carried = summary.select("shard", "block", F.coalesce(F.last("last", ignorenulls=True).over(before) + 1, F.lit(0)).alias("from"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("docs"), F.lead("block").over(by_file).isNull().alias("final"), F.sum("n").over(by_file).alias("upto"))
    # A last piece without an end id ends where the file does.
    stop = F.coalesce(F.try_element_at("ends", F.lit(-1)) + 1, F.col("from"))
    open_end = F.when(F.col("final") & (stop < F.col("upto")), F.array("upto")).otherwise(F.array().cast("array<long>"))
    ends = found.join(carried, ["shard", "block"]).withColumn("all", F.concat("ends", open_end)).withColumn("heads", F.concat(F.array("from"), F.transform("ends", lambda e: e + 1)))
    rows = ends.select("shard", "docs", F.size("ends").alias("k"), F.posexplode(F.arrays_zip("all", F.slice("heads", F.lit(1), F.size("all")).alias("heads"))).alias("i", "x"))
    return rows.select("shard", (F.col("docs") + F.col("i")).alias("doc_no"), F.col("x.heads").alias("start"), (F.col("x.all") - F.col("x.heads")).alias("n_tokens"), (F.col("i") < F.col("k")).alias("ended"))


def with_doc_ids(counts: DataFrame, files: DataFrame) -> DataFrame:
    """Adds the doc_id that ``write_flat`` had at each place of a file."""
    order = files.select("shard", "first", F.posexplode("doc_ids").alias("i", "doc_id")).select("shard", (F.col("first") + F.col("i")).alias("doc_no"), "doc_id")
    return counts.join(order, ["shard", "doc_no"])
