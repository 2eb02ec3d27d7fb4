"""Document frequencies of terms, kept up to date as pages are analysed anew or deleted.

A log with retractions: a batch writes, under its own number, the terms its pages have now and what that changes in
the frequencies (+1 for a term a page gains, -1 for one it loses). The sum of the changes is the frequency. A retried
batch replaces its own folder and does not see it while it works, so each batch counts once. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from trailmark.operators import content
from trailmark.storage import kept

PAGES = "page_id long, terms array<string>, seq long, batch string"
CHANGES = "term string, delta long, batch string"


def _none():
    return F.array().cast("array<string>")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def merge_terms(spark: SparkSession, root: str, pages: DataFrame, name: str) -> None:
    """`pages` (page_id, terms: the distinct terms it has now, none if it is gone) becomes batch `name` of the log."""
    pages = kept(pages)
    others = _stored(spark, f"{root}/pages", PAGES).filter(F.col("batch") != name)
    seq = (others.agg(F.max("seq")).first()[0] or 0) + 1
    before = others.join(pages.select("page_id"), "page_id", "left_semi").groupBy("page_id").agg(F.max_by("terms", "seq").alias("had"))
    # a page's lists are compared in its row, so only terms that it gains or loses are shuffled
    both = pages.join(before, "page_id", "left").withColumn("had", F.coalesce("had", _none()))
    change = lambda more, less, d: F.transform(F.array_except(more, less), lambda t: F.struct(t.alias("term"), F.lit(d).alias("d")))
    moved = both.select(F.explode(F.concat(change("terms", "had", 1), change("had", "terms", -1))).alias("c"))
    changes = moved.groupBy("c.term").agg(F.sum("c.d").alias("delta")).filter("delta <> 0")
    changes.write.mode("overwrite").parquet(f"{root}/changes/batch={name}")
    pages.withColumn("seq", F.lit(seq).cast("long")).write.mode("overwrite").parquet(f"{root}/pages/batch={name}")


def keep_frequencies(root: str, stop: list[str]) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` sink for analysed pages: page_id, text, emphasis, at, deleted. Of several rows of a page the newest counts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("page_id").agg(F.max_by(F.struct("text", "emphasis", "deleted"), "at").alias("r")).select("page_id", "r.*")
        lists = content.term_lists(newest, stop, keep=("deleted",))
        pages = lists.select("page_id", F.when(F.col("deleted"), _none()).otherwise(F.transform("terms", lambda t: t["term"])).alias("terms"))
        merge_terms(batch.sparkSession, root, pages, f"live-{batch_id}")

    return write


def frequencies(spark: SparkSession, root: str) -> DataFrame:
    """term, df as of the batches written so far."""
    return _stored(spark, f"{root}/changes", CHANGES).groupBy("term").agg(F.sum("delta").alias("df")).filter("df > 0")


def compact(spark: SparkSession, source: str, target: str) -> None:
    """The whole log as one batch, in a new folder."""
    latest = _stored(spark, f"{source}/pages", PAGES).groupBy("page_id").agg(F.max_by("terms", "seq").alias("terms"))
    latest.filter(F.size("terms") > 0).withColumn("seq", F.lit(0).cast("long")).write.mode("overwrite").parquet(f"{target}/pages/batch=base-0")
    frequencies(spark, source).withColumnRenamed("df", "delta").write.mode("overwrite").parquet(f"{target}/changes/batch=base-0")
