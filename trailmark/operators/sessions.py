"""Crawl sessions: a gap over 30 minutes, or a run longer than 6 hours, starts a new one.

A busy crawler may hold a third of all requests, so nothing here sorts a
crawler's requests in one task. Requests are first reduced to the distinct
seconds a crawler was active in; gaps are found per (bot, day) with the state
of earlier days carried in by a window over one row per day. The cap is then
applied to each run as a stream of seconds with constant memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from trailmark.operators.rollups import GENUINE
from trailmark.storage import kept

GAP = 1800
CAP = 6 * 3600
BROADCAST_SLOTS = 250_000


def _runs(seconds: DataFrame, gap: int) -> DataFrame:
    """(bot, ts) -> + run, the first second of the gap-free run it belongs to."""
    s = seconds.withColumn("d", F.floor(F.col("ts") / 86400))
    within = Window.partitionBy("bot", "d").orderBy("ts")
    marked = s.withColumn("prev", F.lag("ts").over(within))
    starts = marked.withColumn(
        "start", F.when(F.col("ts") - F.col("prev") > gap, F.col("ts"))
    )
    # one row per bot and day: when it began, when it ended, its last run start
    per_day = starts.groupBy("bot", "d").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("start").alias("last_start")
    )
    days = Window.partitionBy("bot").orderBy("d")
    before = days.rowsBetween(Window.unboundedPreceding, -1)
    opened = per_day.withColumn("prev_last", F.lag("last").over(days)).withColumn(
        "opens", F.when(F.col("prev_last").isNull() | (F.col("first") - F.col("prev_last") > gap), F.col("first"))
    )
    carried = opened.withColumn(
        "day_last_start", F.coalesce("last_start", "opens")
    ).withColumn(
        "carry", F.coalesce("opens", F.last("day_last_start", ignorenulls=True).over(before))
    ).select("bot", "d", "carry")
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        starts.withColumn("run", F.last("start", ignorenulls=True).over(running))
        .join(carried, ["bot", "d"])
        .select("bot", "ts", F.coalesce("run", "carry").alias("run"))
    )


def _cap_runs(cap: int):
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start = None, 0
        for batch in batches:
            bots, runs, ts = batch["bot"].to_numpy(), batch["run"].to_numpy(), batch["ts"].to_numpy()
            out = []
            edges = np.flatnonzero((bots[1:] != bots[:-1]) | (runs[1:] != runs[:-1])) + 1
            for lo, hi in zip(np.r_[0, edges], np.r_[edges, len(ts)]):
                if (bots[lo], runs[lo]) != key:
                    key, start = (bots[lo], runs[lo]), runs[lo]
                at = lo
                while at < hi:  # one step per session, not per second
                    end = at + np.searchsorted(ts[at:hi], start + cap, side="right")
                    if end > at:
                        out.append((*key, start, ts[end - 1]))
                    at = end
                    if at < hi:
                        start = ts[at]
            yield pd.DataFrame(out, columns=["bot", "run", "started", "ended"])

    return walk


def session_spans(seconds: DataFrame, gap: int = GAP, cap: int = CAP) -> DataFrame:
    """(bot, ts) distinct seconds -> (bot, started, ended, run, run_end), one row per session."""
    # A run has a row per second at most, whatever the traffic, and passes one task in batches.
    parts = (
        _runs(seconds, gap).repartition("bot", "run").sortWithinPartitions("bot", "run", "ts")
        .mapInPandas(_cap_runs(cap), "bot string, run bigint, started bigint, ended bigint")
    )
    # a session that goes on in the next batch of rows has a row from each
    spans = parts.groupBy("bot", "started").agg(F.max("ended").alias("ended"), F.min("run").alias("run"))
    return spans.withColumn("run_end", F.max("ended").over(Window.partitionBy("bot", "run")))


def grain(events: DataFrame) -> DataFrame:
    """Genuine requests by bot, second, page and address: all a session needs."""
    return events.filter(F.col("cls").isin(*GENUINE)).groupBy("bot", "ts", "url_hash", "ip_hash").agg(
        F.count("*").alias("hits"), F.count_if(F.col("status") >= 400).alias("errors")
    )


def sessions(events: DataFrame, gap: int = GAP, cap: int = CAP) -> DataFrame:
    return sessions_from_grain(grain(events), gap, cap)


def sessions_from_grain(rows: DataFrame, gap: int = GAP, cap: int = CAP) -> DataFrame:
    return sessions_of_runs(rows, gap, cap).drop("run", "run_end")


def sessions_of_runs(rows: DataFrame, gap: int = GAP, cap: int = CAP) -> DataFrame:
    """Sessions with the run they are cut from: its first and last second.

    Sessions of a crawler do not overlap, so a request finds its own by the hour: sessions are few, are entered under the
    clock hours they reach, and are broadcast up to 250,000 entries; beyond, requests are shuffled by crawler and hour.
    """
    hour = lambda c: F.floor(c / 3600)
    spans = kept(session_spans(rows.select("bot", "ts").distinct(), gap, cap))
    slots = spans.withColumn("hour", F.explode(F.sequence(hour(F.col("started")), hour(F.col("ended")))))
    if slots.count() <= BROADCAST_SLOTS:
        slots = F.broadcast(slots)
    placed = rows.withColumn("hour", hour(F.col("ts"))).join(slots, ["bot", "hour"]).filter(F.col("ts").between(F.col("started"), F.col("ended")))
    return placed.groupBy("bot", "started").agg(
        F.max("ended").alias("ended"), F.sum("hits").alias("hits"),
        F.countDistinct("url_hash").alias("pages"), F.countDistinct("ip_hash").alias("ips"),
        F.sum("errors").alias("errors"), F.min("run").alias("run"), F.max("run_end").alias("run_end"),
    )


def touched_runs(seconds: DataFrame, runs: DataFrame, gap: int = GAP) -> DataFrame:
    """The rows of `runs` (bot, run, run_end) that new seconds (bot, ts) fall into, prolong or join to others.

    Both sides are entered under the days they reach, so that runs meet by equality on crawler and day.
    """
    day = lambda c: F.floor(c / 86400)
    own = _runs(seconds.select("bot", "ts").distinct(), gap).groupBy("bot", "run").agg((F.min("ts") - gap).alias("lo"), (F.max("ts") + gap).alias("hi"))
    near = own.select("bot", "lo", "hi", F.explode(F.sequence(day(F.col("lo")), day(F.col("hi")))).alias("day"))
    held = runs.select("bot", "run", "run_end", F.explode(F.sequence(day(F.col("run")), day(F.col("run_end")))).alias("day"))
    return held.join(near, ["bot", "day"]).filter("run <= hi and run_end >= lo").select("bot", "run", "run_end").distinct()
