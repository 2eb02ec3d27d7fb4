"""Rollup tables, folded once.

`fold` reduces raw events to one compact frame keyed by (day, bot, path, cls)
with a map-side combine. Every rollup is a re-aggregation of that frame, so
the raw table is read and shuffled once however many rollups are built. Its
buffers are all fixed-width (hash aggregation, no sort): paths are grouping
keys and are hashed only after the fold, and "last status" orders by a packed
number instead of a struct.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from trailmark.config import Config
from trailmark.functions import paths

GENUINE = ("ai", "search")


def seen_order(ts: Column, id: Column) -> Column:
    """(ts, id) as one sortable number of fixed width."""
    return (ts.cast("decimal(12,0)") * F.lit(Decimal(10**19)) + id.cast("decimal(19,0)")).cast(
        "decimal(38,0)")


def fold(events: DataFrame) -> DataFrame:
    """Raw events -> day × bot × path × class partial aggregates."""
    error = F.col("status") >= 400
    object_id = F.col("object_id") if "object_id" in events.columns else F.lit(0).cast("bigint")
    order = seen_order(F.col("ts"), F.col("id"))
    return (
        events.groupBy("day", "bot", "cls", "path").agg(
            F.count("*").alias("hits"),
            F.count_if(error).alias("errors"),
            F.count_if(F.col("vstate") == "verified").alias("verified"),
            F.sum("ms").alias("ms_total"),
            F.max("ms").alias("ms_max"),
            F.max(object_id).alias("object_id"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            F.max("id").alias("max_id"),
            F.max_by("status", "id").alias("status_by_id"),
            F.max(order).alias("seen"),
            F.max_by("status", order).alias("status_by_seen"),
        )
        .withColumn("url_hash", paths.url_hash(F.col("path")))
    )


def genuine(cube: DataFrame) -> DataFrame:
    return cube.filter(F.col("cls").isin(*GENUINE))


def daily(cube: DataFrame) -> DataFrame:
    """Day × bot × page of genuine crawls."""
    return genuine(cube).groupBy("day", "bot", "url_hash").agg(
        F.max("path").alias("path"),
        F.max("object_id").alias("object_id"),
        F.sum("hits").alias("hits"),
        F.sum("errors").alias("errors"),
        F.sum("ms_total").alias("ms_total"),
        F.max("ms_max").alias("ms_max"),
        F.max_by("status_by_id", "max_id").alias("last_status"),
        F.max("max_id").alias("max_id"),
    )


def daily_pages(cube: DataFrame) -> DataFrame:
    """Day × page, AI crawlers only."""
    return cube.filter("cls = 'ai'").groupBy("day", "url_hash").agg(
        F.sum("hits").alias("hits"), F.sum("errors").alias("errors"), F.sum("ms_total").alias("ms_total"),
    )


def daily_pages_from_daily(daily: DataFrame, ai_ids) -> DataFrame:
    """Backfill of `daily_pages` from `daily`."""
    return daily.filter(F.col("bot").isin(*ai_ids)).groupBy("day", "url_hash").agg(
        F.sum("hits").alias("hits"), F.sum("errors").alias("errors"), F.sum("ms_total").alias("ms_total"),
    )


def daily_bots(cube: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """Day × bot; impersonations are counted apart under the bot they claim to be."""
    own = F.col("cls") != "spoofed"
    only = lambda c: F.when(own, F.col(c)).otherwise(0)
    rows = cube.select(
        "day", F.when(F.col("bot") == "", "_unknown").otherwise(F.col("bot")).alias("bot"),
        only("hits").alias("hits"), only("verified").alias("verified"),
        F.when(own, 0).otherwise(F.col("hits")).alias("spoofed"),
        only("errors").alias("errors"), only("ms_total").alias("ms_total"),
    )
    if counters is not None:
        rows = rows.unionByName(counters)
    return merge_daily_bots(rows)


def counters(events: DataFrame) -> DataFrame:
    """Requests that only count: one row per day and crawler, no page, no address."""
    rows = events.filter("route = 'counter'")
    spoofed = F.col("cls") == "spoofed"
    return rows.groupBy(
        "day", F.when(F.col("bot") == "", "_unknown").otherwise(F.col("bot")).alias("bot")
    ).agg(
        F.count_if(~spoofed).alias("hits"),
        F.count_if(F.col("vstate") == "verified").alias("verified"),
        F.count_if(spoofed).alias("spoofed"),
        F.count_if(F.col("status") >= 400).alias("errors"),
        F.sum("ms").alias("ms_total"),
    )


def page_bots(cube: DataFrame) -> DataFrame:
    """First and last crawl per page × bot."""
    return genuine(cube).groupBy("url_hash", "bot").agg(
        F.max("path").alias("path"),
        F.max("object_id").alias("object_id"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("hits").alias("hits"),
        F.max_by("status_by_seen", "seen").alias("last_status"),
        F.max("seen").alias("seen"),
    )


def bots_seen(cube: DataFrame) -> DataFrame:
    """First and last visit per bot, and impersonations of bots that really came."""
    counted = F.col("cls").isin("ai", "search", "potential")
    return (
        cube.filter("bot <> ''").groupBy("bot").agg(
            F.min(F.when(counted, F.col("first_seen"))).alias("first_seen"),
            F.max(F.when(counted, F.col("last_seen"))).alias("last_seen"),
            F.coalesce(F.sum(F.when(counted, F.col("hits"))), F.lit(0)).alias("hits"),
            F.coalesce(F.sum(F.when(counted, F.col("verified"))), F.lit(0)).alias("verified"),
            F.coalesce(F.sum(F.when(F.col("cls") == "spoofed", F.col("hits"))), F.lit(0)).alias("spoofed"),
        )
        .filter("hits > 0")
    )


def referrals(visits: DataFrame) -> DataFrame:
    """Day × assistant × page visits; `visits` carries the source in `referral`."""
    return visits.filter("referral is not null").groupBy(
        "day", F.col("referral").alias("source"), "url_hash"
    ).agg(F.max("path").alias("path"), F.count("*").alias("hits"))


def agents(classified: DataFrame, config: Config) -> DataFrame:
    """Unrecognised agents by the hash of their name, with their newest class; imported logs do not count hits."""
    rows = classified.filter(F.col("cls").isin("unknown", "potential"))
    if not config.track_unknown:
        rows = rows.limit(0)
    return (
        rows.groupBy("ua").agg(
            F.max_by("cls", F.struct("ts", "cls")).alias("cls"),
            F.count_if(F.col("source") == "live").alias("hits"),
            F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        )
        .select(F.md5("ua").alias("ua_hash"), "ua", "cls", F.lit("new").alias("state"), "hits", "first_seen",
                "last_seen")
    )


def new_bots(cube: DataFrame, seen: DataFrame) -> DataFrame:
    """AI crawlers not met before."""
    return cube.filter("cls = 'ai'").groupBy("bot").agg(F.min("first_seen").alias("first_seen")).join(
        seen.select("bot"), "bot", "left_anti")


def first_crawls(events: DataFrame, known: DataFrame) -> DataFrame:
    """(page, bot) pairs an AI crawler read successfully for the first time."""
    good = events.filter("cls = 'ai' and status < 400").groupBy("bot", "path").agg(F.min("ts").alias("ts"))
    return (
        good.withColumn("url_hash", paths.url_hash(F.col("path")))
        .groupBy("url_hash", "bot").agg(F.min("ts").alias("ts"), F.max("path").alias("path"))
        .join(known.select("url_hash", "bot"), ["url_hash", "bot"], "left_anti")
    )


def flooding(events: DataFrame, config: Config, seconds: int = 600, limit: int = 600) -> DataFrame:
    """Addresses with more than `limit` unverified requests in the last `seconds` seconds."""
    return (
        events.filter((F.col("ts") > config.as_of - seconds) & (F.col("vstate") != "verified") & (F.col("ip_hash") != ""))
        .groupBy("ip_hash").agg(F.count("*").alias("requests")).filter(F.col("requests") > limit)
    )


# merging batches ---------------------------------------------------------
# Each merge takes any union of partial rollups; the newest batch has the largest `max_id` / `seen`.

def merge_daily(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "bot", "url_hash").agg(
        F.max_by("path", "max_id").alias("path"),
        F.max("object_id").alias("object_id"),
        F.sum("hits").alias("hits"), F.sum("errors").alias("errors"), F.sum("ms_total").alias("ms_total"),
        F.max("ms_max").alias("ms_max"), F.max_by("last_status", "max_id").alias("last_status"),
        F.max("max_id").alias("max_id"),
    )


def merge_daily_pages(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "url_hash").agg(
        F.sum("hits").alias("hits"), F.sum("errors").alias("errors"), F.sum("ms_total").alias("ms_total"),
    )


def merge_daily_bots(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "bot").agg(
        *[F.sum(c).alias(c) for c in ("hits", "verified", "spoofed", "errors", "ms_total")]
    )


def merge_page_bots(rows: DataFrame) -> DataFrame:
    return rows.groupBy("url_hash", "bot").agg(
        F.max_by("path", "seen").alias("path"),
        F.max("object_id").alias("object_id"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("hits").alias("hits"),
        F.max_by("last_status", "seen").alias("last_status"), F.max("seen").alias("seen"),
    )


def merge_bots_seen(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bot").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        *[F.sum(c).alias(c) for c in ("hits", "verified", "spoofed")],
    )


def merge_referrals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "source", "url_hash").agg(F.max("path").alias("path"), F.sum("hits").alias("hits"))


def merge_agents(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ua_hash").agg(
        F.max("ua").alias("ua"), F.max_by("cls", "last_seen").alias("cls"), F.max("state").alias("state"),
        F.sum("hits").alias("hits"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )


def prune(table: str, rows: DataFrame, config: Config, watermark: int | None = None) -> DataFrame:
    """Rows inside the retention period; partitioned tables prune by their day column."""
    history = config.back(config.retention_history)
    if table == "events":
        old = F.col("ts") < config.from_ts(config.retention_events)
        return rows.filter(~(old & (F.col("id") <= watermark)) if watermark is not None else ~old)
    if table in ("daily", "daily_pages", "daily_bots", "referrals", "snapshots"):
        return rows.filter(F.col("day") >= F.lit(history))
    if table == "sessions":
        return rows.filter(F.col("ended") >= config.from_ts(config.retention_sessions))
    if table == "agents":
        return rows.filter(~((F.col("last_seen") < config.from_ts(180)) & F.col("state").isin("new", "ignored")))
    if table == "alerts":
        return rows.filter(F.col("created_at") >= config.from_ts(180))
    if table == "findings":
        return rows.filter(
            ~((F.col("status") == "resolved") & (F.coalesce("resolved_at", F.lit(2**40)) < config.from_ts(365))))
    if table == "page_bots":
        return rows.filter(F.col("last_seen") >= config.from_ts(config.retention_history))
    raise ValueError(f"no retention rule for {table}")


def build_rollups(events: DataFrame, root: str) -> None:
    """Fold events once, write the fold, and derive every rollup table from it side by side."""
    spark = events.sparkSession
    fold(events).write.mode("overwrite").parquet(f"{root}/cube")
    cube = spark.read.parquet(f"{root}/cube")
    tables = {"daily": daily, "daily_pages": daily_pages, "daily_bots": daily_bots, "page_bots": page_bots, "bots_seen": bots_seen}
    # the tables are independent jobs over the small fold; the scheduler runs them together
    with ThreadPoolExecutor(len(tables)) as pool:
        jobs = [pool.submit(_replace, make(cube), f"{root}/{name}") for name, make in tables.items()]
        for job in jobs:
            job.result()


def _replace(rows: DataFrame, path: str) -> None:
    """Writes a whole table; one with days has a folder for each, so that reports read the days they show."""
    if "day" in rows.columns:
        rows.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(path)


def write_partitioned(rows: DataFrame, path: str) -> None:
    """Replace only the days present in `rows`; a day is written by as many tasks as its size asks for."""
    (
        rows.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("day").parquet(path)
    )
