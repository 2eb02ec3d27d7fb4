"""Published address ranges, bucketed for equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailmark.config import Config, DAY
from trailmark.functions import net

FRESH_DAYS = 7


def extract_cidrs(documents: DataFrame) -> DataFrame:
    """(file, fetched_at, body) -> every CIDR or address anywhere in the JSON text."""
    found = F.regexp_extract_all(F.col("body"), F.lit(r'"([0-9a-fA-F.:]+(?:/\d{1,3})?)"'), 1)
    each = documents.select("file", "fetched_at", F.explode(found).alias("cidr"))
    each = each.filter((F.length("cidr") <= 50) & net.cidr_bounds(F.col("cidr")).isNotNull())
    return each.groupBy("file", "cidr").agg(F.max("fetched_at").alias("fetched_at"))


def read_range_files(spark: SparkSession, path: str, fetched_at: int) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.lit(fetched_at).cast("bigint").alias("fetched_at"),
        F.col("value").alias("body"),
    )
    return extract_cidrs(raw)


def _v4_bucket(key: Column, digits: int) -> Column:
    return F.conv(F.substring(key, 2, digits), 16, 10).cast("int")


def bucketed(ranges: DataFrame) -> DataFrame:
    """Explode (…, cidr) to (…, bucket, lo, hi).

    Narrow ranges are keyed by /16 (IPv4) or the first 32 bits (IPv6); wide
    ones by the first octet or hex digit, so every lookup is an equality on
    one of two keys and no range is compared with every address.
    """
    r = ranges.withColumn("b", net.cidr_bounds(F.col("cidr"))).filter("b is not null")
    lo, hi = F.col("b.lo"), F.col("b.hi")
    v4 = lo.startswith("4")
    narrow_v4 = (_v4_bucket(hi, 4) - _v4_bucket(lo, 4)) <= 255
    wide_digit = lambda k: F.conv(F.substring(k, 2, 1), 16, 10).cast("int")
    keys = (
        F.when(v4 & narrow_v4, F.transform(F.sequence(_v4_bucket(lo, 4), _v4_bucket(hi, 4)),
                                           lambda k: F.concat(F.lit("n4:"), k.cast("string"))))
        .when(v4, F.transform(F.sequence(_v4_bucket(lo, 2), _v4_bucket(hi, 2)),
                              lambda k: F.concat(F.lit("w4:"), k.cast("string"))))
        .when(F.col("b.len") >= 32, F.array(F.concat(F.lit("n6:"), F.substring(lo, 2, 8))))
        .otherwise(F.transform(F.sequence(wide_digit(lo), wide_digit(hi)),
                               lambda k: F.concat(F.lit("w6:"), k.cast("string"))))
    )
    return r.select(
        *[c for c in ranges.columns], lo.alias("lo"), hi.alias("hi"), F.explode(keys).alias("bucket")
    )


def lookup_keys(key: Column) -> Column:
    """The two buckets an address can fall in."""
    digit = F.conv(F.substring(key, 2, 1), 16, 10)
    return F.when(
        key.startswith("4"),
        F.array(F.concat(F.lit("n4:"), _v4_bucket(key, 4).cast("string")),
                F.concat(F.lit("w4:"), _v4_bucket(key, 2).cast("string"))),
    ).otherwise(F.array(F.concat(F.lit("n6:"), F.substring(key, 2, 8)), F.concat(F.lit("w6:"), digit)))


def status(ranges: DataFrame, config: Config) -> DataFrame:
    """Count and freshness of each range file."""
    return ranges.groupBy("file").agg(
        F.count("*").alias("prefixes"),
        F.max("fetched_at").alias("fetched_at"),
    ).withColumns({
        "fresh": F.col("fetched_at") > config.as_of - FRESH_DAYS * DAY,
        "stale": F.col("fetched_at") < config.as_of - 14 * DAY,
    })


def bot_files(registry, spark: SparkSession) -> DataFrame:
    rows = [(b["id"], i, b["ip_only"], f) for i, b in enumerate(registry.bots) for f in b["ranges"]]
    return spark.createDataFrame(rows, "bot string, bot_order int, ip_only boolean, file string")
