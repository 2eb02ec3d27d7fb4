"""Distinct pages over any window, from stored bitmaps.

Counts of distinct pages do not add up over days; sets do. Pages are numbered once, and each day and key (a crawler,
an assistant) stores one bitmap per bucket of numbers. A window's distinct pages are the bits of the union, exact
whatever days and keys it spans, without a look at raw rows. Buckets have the fixed width of Spark's bitmaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Bits of one of Spark's bitmaps; pages per bucket when a numbering begins, so that it has room to grow.
WIDTH, FILL = 32768, 16384


def numbered(keys: DataFrame, known: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """(url_hash) -> url_hash, bucket, pos: numbers of new keys, after those in `known`, which keep theirs.

    A key's bucket is given by its hash, its place by the order in the bucket; a full bucket overflows into
    another of its own. So no task orders more than one bucket. Repeated keys count once, null ones not at all.
    """
    new = keys.select("url_hash").filter("url_hash is not null").distinct()
    used = None
    if known is not None:
        new = new.join(known, "url_hash", "left_anti")
        buckets = buckets or known.agg(F.max("buckets")).first()[0]
        used = known.groupBy(F.pmod("bucket", "buckets").alias("slot")).agg(F.max(F.floor(F.col("bucket") / F.col("buckets")) * WIDTH + F.col("pos") + 1).alias("used"))
    buckets = buckets or max(1, -(-new.count() // FILL))
    slot = F.pmod(F.xxhash64("url_hash"), F.lit(buckets))
    out = new.withColumn("slot", slot).withColumn("nth", F.row_number().over(Window.partitionBy("slot").orderBy("url_hash")) - 1)
    out = out.join(used, "slot", "left").withColumn("nth", F.col("nth") + F.coalesce("used", F.lit(0))) if used is not None else out
    nth = F.col("nth").cast("long")
    return out.select("url_hash", (F.col("slot") + F.floor(nth / WIDTH) * buckets).cast("long").alias("bucket"), (nth % WIDTH).cast("long").alias("pos"), F.lit(buckets).cast("long").alias("buckets"))


def page_sets(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """(day, key, url_hash) -> day, key, bucket, pages: what to store per day. Keys without a number are ignored."""
    return rows.join(numbers.select("url_hash", "bucket", "pos"), "url_hash").groupBy("day", "key", "bucket").agg(
        F.bitmap_construct_agg("pos").alias("pages"))


def distinct_pages(sets: DataFrame, *by: str) -> DataFrame:
    """Distinct pages of all given sets, per value of `by`: n."""
    unions = sets.groupBy(*by, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("pages")).alias("n"))
    return unions.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
