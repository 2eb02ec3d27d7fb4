"""From raw documents to packed training sequences: five stages, each an operator of trailmark.llm.

A stage takes (spark, docs, sf_dir) and returns what it leaves of docs, in the columns of `documents`; the last one
returns the packing. `run` writes each stage's result to shared storage and reads it again, so that a lost executor
costs no earlier stage. Null or empty texts, repeated rows and empty tables are treated as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm import op3, op4, op5, op7, op8, shared


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return op8.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return op3.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return op5.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are masked; all documents stay."""
    return op4.mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in the sequences."""
    return op7.pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]
#: A classifier and a tokenizer are no SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared.new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
