"""Token files: whole texts as ids, coded by a static range asymmetric numeral system, in ascending doc_id order.

Documents are dealt to partitions by ranges of doc_id. Each partition encodes its texts in order and closes a file
whenever it has FILE_IDS ids, always after a whole document. A file has its own frequency table, shared by its
blocks, so texts are tokenized once and nothing is gathered from other partitions. Files are rows of a Parquet
table in shared storage, beside the documents' lengths; a file's bytes stand for themselves (see `rans`).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.llm import rans
from trailmark.llm.shared import documents, new_path
from trailmark.llm.tokens import worker_tokenizer

END, FILE_IDS = 1, 1 << 21
FILES = "part int, file int, n_ids long, doc_ids array<bigint>, lengths array<bigint>, data binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Writes token files of docs (doc_id, text) to `path`, each document with an end id.

    Null texts count as empty; null ids come first; rows of equal doc_id follow each other, ordered by text.
    """
    vocabulary = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, file, held, docs_, count = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            lengths = [len(x) for x in held]
            data = rans.encode(np.concatenate(held))
            values = ([part], [file], [count], [docs_], [lengths], [data])
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["part", "file", "n_ids", "doc_ids", "lengths", "data"])

        for b in batches:
            found = worker_tokenizer(vocabulary).encode_all(b.column(1))
            for doc, ids in zip(b.column(0).to_pylist(), found, strict=True):
                held.append(np.append(ids, np.uint32(END)))
                docs_.append(doc)
                count += len(held[-1])
                if count >= FILE_IDS:
                    yield close()
                    file, held, docs_, count = file + 1, [], [], 0
        if held:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FILES).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (little-endian unsigned 32-bit) of each document of the files in `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, file, docs_, lengths, data in zip(*(b.column(i).to_pylist() if i < 4 else b.column(i) for i in range(5)), strict=True):
                ids = rans.decode(data.as_py()).astype("<u4")
                ends = np.cumsum(lengths)
                own = [ids[e - n : e].tobytes() for n, e in zip(lengths, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(own), pa.int32()), pa.array([file] * len(own), pa.int32()), pa.array(docs_, pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary())],
                    names=["part", "file", "doc_id", "at", "n_tokens", "ids_crc32", "ids"],
                )

    stored = spark.read.schema(FILES).parquet(path)
    decoded = stored.select("part", "file", "doc_ids", "lengths", "data").mapInArrow(run, "part int, file int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    # ids before each file: those of earlier partitions (one row each in a single ordered window), then of earlier files
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("all"))
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))
    within = Window.partitionBy("part").orderBy("file")
    files = stored.select("part", "file", (F.sum("n_ids").over(within) - F.col("n_ids")).alias("before")).join(parts, "part")
    files = files.select("part", "file", (F.col("base") + F.col("before")).alias("before"))
    return decoded.join(files, ["part", "file"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
