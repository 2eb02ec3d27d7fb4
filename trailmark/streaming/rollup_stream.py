"""Incremental rollups over a stream of requests.

Exactly once by construction: every micro-batch writes its partial rollups
under its own batch number and replaces that folder when it is retried, so a
lost executor or a restarted driver cannot count a batch twice. Readers merge
the partial rollups; `compact` folds finished batches into one. Sessions are cut when they are read, from the rows that
batches have added since the last compaction and the runs these touch.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from trailmark.operators import rollups, sessions
from trailmark.storage import kept

MERGE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "daily": rollups.merge_daily,
    "daily_pages": rollups.merge_daily_pages,
    "daily_bots": rollups.merge_daily_bots,
    "page_bots": rollups.merge_page_bots,
    "bots_seen": rollups.merge_bots_seen,
}
WATERMARK = "2 days"


def event_time(events: DataFrame) -> DataFrame:
    return events.withColumn("event_time", F.timestamp_seconds("ts"))


def deduplicated(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Drop requests seen again within the watermark (`dedup` key)."""
    return event_time(events).withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["dedup"])


def _partials(batch: DataFrame) -> dict[str, DataFrame]:
    cube = rollups.fold(batch).persist()  # one scan of the batch serves every rollup
    counted = F.col("cls").isin("ai", "search", "potential")
    seen = cube.filter("bot <> ''").groupBy("bot").agg(
        F.min(F.when(counted, F.col("first_seen"))).alias("first_seen"), F.max(F.when(counted, F.col("last_seen"))).alias("last_seen"),
        *[F.coalesce(F.sum(F.when(counted, F.col(c))), F.lit(0)).alias(c) for c in ("hits", "verified")],
        F.coalesce(F.sum(F.when(F.col("cls") == "spoofed", F.col("hits"))), F.lit(0)).alias("spoofed"))
    return {
        "cube": cube,
        "daily": rollups.daily(cube),
        "daily_pages": rollups.daily_pages(cube),
        "daily_bots": rollups.daily_bots(cube),
        "page_bots": rollups.page_bots(cube),
        # impersonations of a crawler that comes later must not be lost, so rows without hits are kept until read
        "bots_seen": seen,
    }


TABLES = (*MERGE, "sessions")


def fold_batch(root: str, kind: str = "live", tables: Sequence[str] = TABLES) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` sink that writes the partial rollups of a batch under its kind and number.

    Numbers of the stream, of late imports (`late`) and of compacted history (`base`) never meet. `tables` are those
    the job keeps: all, if not said otherwise.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if "sessions" in tables:
            merge_sessions(batch.sparkSession, root, sessions.grain(batch), f"{kind}-{batch_id}")
        wanted = [name for name in MERGE if name in tables]
        if not wanted:
            return
        parts = _partials(batch)
        cube = parts.pop("cube")
        try:
            for name in wanted:
                parts[name].write.mode("overwrite").parquet(f"{root}/{name}/batch={kind}-{batch_id}")
        finally:
            cube.unpersist()

    return write


SESSIONS = "bot string, started long, ended long, hits long, pages long, ips long, errors long, run long, run_end long, batch string"
GRAIN = "bot string, ts long, url_hash string, ip_hash string, hits long, errors long, batch string, day long"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The batches of a table, or no rows before the first."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("r")).select("r.*")


def merge_sessions(spark: SparkSession, root: str, new: DataFrame, name: str) -> None:
    """Add the grain of a batch to what sessions are cut from; a retried batch replaces its own rows.

    A batch is written once and reads nothing back: however many batches reach into a run, it is cut when sessions are
    read or compacted, once for all of them.
    """
    day = F.floor(F.col("ts") / 86400).cast("long")
    new.withColumn("day", day).hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{root}/session_grain/batch={name}")


def _sessions_now(spark: SparkSession, root: str) -> DataFrame:
    """Sessions and their runs: those of the last compaction, and anew those of the runs that batches have touched since.

    A session depends on nothing outside its run, and a run only changes where a new second lies within the gap of
    it. So the touched runs (late rows may join two into one) are read again from the days they cover and cut
    together with the new rows; all other runs are as compacted.
    """
    grain = _stored(spark, f"{root}/session_grain", GRAIN)
    compacted = F.col("batch").startswith("base-")
    base = _stored(spark, f"{root}/sessions", SESSIONS).filter(compacted).drop("batch")
    rows = grain.filter(~compacted).drop("batch")
    if base.isEmpty():
        return sessions.sessions_of_runs(rows)
    lo, hi = rows.agg(F.min("ts"), F.max("ts")).first()
    if lo is None:
        return base
    gap = sessions.GAP
    # only runs near the new rows are read
    near = base.filter((F.col("run") <= hi + gap) & (F.col("run_end") >= lo - gap)).select("bot", "run", "run_end").distinct()
    touched = kept(sessions.touched_runs(rows, near))
    first, last = touched.agg(F.min("run"), F.max("run_end")).first()
    if first is not None:
        days = touched.withColumn("day", F.explode(F.sequence(F.floor(F.col("run") / 86400), F.floor(F.col("run_end") / 86400))))
        again = grain.filter(compacted & F.col("day").between(first // 86400, last // 86400)).join(days, ["bot", "day"]).filter(
            F.col("ts").between(F.col("run"), F.col("run_end"))).select(*rows.columns)
        rows = rows.unionByName(again)
    return base.join(touched, ["bot", "run"], "left_anti").unionByName(sessions.sessions_of_runs(rows))


def read_rollup(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A rollup as of the batches written so far."""
    merged = MERGE[name](spark.read.parquet(f"{root}/{name}").drop("batch"))
    return merged.filter("hits > 0") if name == "bots_seen" else merged


def read_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions over everything received, whatever order it arrived in."""
    return _sessions_now(spark, root).drop("run", "run_end")


def compact(spark: SparkSession, source: str, target: str) -> None:
    """Merge every batch into one, in a new folder; the old folder stays valid until readers move over."""
    for name, merge in MERGE.items():
        merge(spark.read.parquet(f"{source}/{name}").drop("batch")).write.mode("overwrite").parquet(f"{target}/{name}/batch=base-0")
    compact_sessions(spark, source, target)


def compact_sessions(spark: SparkSession, source: str, target: str) -> None:
    """The grain of every batch as one, and the sessions cut from it."""
    grain = _stored(spark, f"{source}/session_grain", GRAIN).groupBy("bot", "ts", "url_hash", "ip_hash", "day").agg(
        F.sum("hits").alias("hits"), F.sum("errors").alias("errors"))
    grain.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{target}/session_grain/batch=base-0")
    _sessions_now(spark, source).write.mode("overwrite").parquet(f"{target}/sessions/batch=base-0")


def start_rollups(events: DataFrame, root: str, checkpoint: str, trigger: dict | None = None, tables: Sequence[str] = TABLES) -> StreamingQuery:
    return (
        events.writeStream.foreachBatch(fold_batch(root, tables=tables)).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 minutes"})).start()
    )


def backfill(events: DataFrame, root: str, batch_id: int) -> None:
    """Late or imported requests: the same tables, under a batch number of their own."""
    fold_batch(root, "late")(events, batch_id)


# streaming aggregations ----------------------------------------------------------

def daily_counts(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Day × bot totals as a stream (tumbling windows of one day)."""
    own = F.col("cls") != "spoofed"
    return event_time(events).withWatermark("event_time", delay).groupBy(F.window("event_time", "1 day"), "bot").agg(
        F.count_if(own).alias("hits"), F.count_if(~own).alias("spoofed"),
        F.count_if(own & (F.col("status") >= 400)).alias("errors"), F.sum(F.when(own, F.col("ms")).otherwise(0)).alias("ms_total"),
    ).select(F.col("window.start").alias("day"), "bot", "hits", "spoofed", "errors", "ms_total")


def _floods(events: DataFrame, limit: int, width: str, slide: str | None, delay: str) -> DataFrame:
    unverified = event_time(events).withWatermark("event_time", delay).filter("vstate <> 'verified' and ip_hash <> ''")
    window = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    return unverified.groupBy(window, "ip_hash").agg(F.count("*").alias("requests")).filter(F.col("requests") > limit)


def flood_windows(events: DataFrame, limit: int = 600, width: str = "10 minutes", slide: str | None = "1 minute",
                  delay: str = "10 minutes") -> DataFrame:
    """Addresses that pass `limit` unverified requests in a window; throttled for an hour after it."""
    return _floods(events, limit, width, slide, delay).select(
        "ip_hash", "requests", F.unix_seconds("window.start").alias("started"), (F.unix_seconds("window.end") + 3600).alias("until"))


def throttled(events: DataFrame, limit: int = 600, width: str = "10 minutes", slide: str | None = "1 minute",
              delay: str = "10 minutes", salts: int = 8) -> DataFrame:
    """The requests (id, ip_hash, ts) of an address within the hour after a window in which it flooded; each once.

    Two stateful steps in one stream: the windows, then an interval join back to the requests. A window is entered
    under the two clock hours it reaches, so a request meets the windows of its own hour and not all of its address.
    One address may send a third of all requests, so they are spread over `salts` keys and its few windows are copied
    to each.
    """
    hour = lambda c: F.floor(F.unix_seconds(c) / 3600)
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    windows = _floods(events, limit, width, slide, delay).select(
        F.col("ip_hash").alias("flood_hash"), F.window_time("window").alias("flooded"), salt.alias("flood_salt"))
    began = hour(F.col("flooded"))
    windows = windows.select("*", F.explode(F.array(began, began + 1)).alias("flood_hour"))
    asked = event_time(events).withWatermark("event_time", delay).filter("ip_hash <> ''").select(
        "id", "ip_hash", "ts", "event_time", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), hour(F.col("event_time")).alias("hour"))
    # the window's time is its last microsecond
    after = F.expr("ip_hash = flood_hash and salt = flood_salt and hour = flood_hour and event_time > flooded and event_time <= flooded + interval 1 hour")
    return asked.join(windows, after).select("id", "ip_hash", "ts", "event_time").dropDuplicatesWithinWatermark(["id"]).drop("event_time")


def gap_sessions(events: DataFrame, gap_minutes: int = 30, delay: str = WATERMARK) -> DataFrame:
    """Live view of crawl sessions by gap; the six-hour cap is applied by `read_sessions`."""
    live = event_time(events).filter(F.col("cls").isin("ai", "search")).withWatermark("event_time", delay)
    return live.groupBy(F.session_window("event_time", f"{gap_minutes} minutes"), "bot").agg(
        F.count("*").alias("hits"), F.count_if(F.col("status") >= 400).alias("errors"), F.min("ts").alias("started"), F.max("ts").alias("ended"),
    ).select("bot", "started", "ended", "hits", "errors")


HOLD, TRUST = 2 * 86400, 7 * 86400


class HoldBack(StatefulProcessor):
    """Pending events of one crawler, address and day, until no verdict for them can come any more.

    State: the events and the verdicts, as lists. Every call of the state is a message to the JVM and most keys get only a
    few rows, so a batch of a key makes one for its events, one for its verdicts and one for its timer; verdicts are put
    in order when the key is released. The timer is set to when the day's last event has been held for two days (setting
    it again changes nothing); then every event leaves with the newest verdict from a week before to two days after it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "at long, event string")
        self.verdicts = handle.getListState("told", "decided_at long, verdict string")

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            pending, told = [], set()
            for at, verdict, event in zip(frame["at"].tolist(), frame["verdict"].tolist(), frame["event"].tolist(), strict=True):
                if isinstance(event, str):
                    pending.append((at, event))
                else:
                    told.add((at, verdict))
            if pending:
                self.events.appendList(pending)
            if told:
                self.verdicts.appendList(list(told))
        # a key whose time has passed already is released with the next batch
        self.handle.registerTimer(max((int(key[2]) + 1) * 86400 + HOLD, timerValues.getCurrentWatermarkInMs() // 1000 + 1) * 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        decided = {}
        for at, verdict in self.verdicts.get():
            if decided.get(at) != "failed":  # of those decided in the same second a failure counts
                decided[at] = verdict
        times = sorted(decided)
        out = []
        for at, event in self.events.get():
            k = bisect.bisect_right(times, at + HOLD) - 1
            out.append((event, decided[times[k]] if k >= 0 and times[k] >= at - TRUST else "none"))
        self.events.clear()
        self.verdicts.clear()
        if out:  # most keys have verdicts only
            yield pd.DataFrame(out, columns=["event", "verdict"])

    def close(self) -> None:
        pass


def settled(events: DataFrame, verdicts: DataFrame, delay: str = WATERMARK, salts: int = 4) -> DataFrame:
    """Hold pending events for two days, then let them go with the newest verdict (`none` without one); others pass at once.

    verdicts: bot, ip_hash, verdict, decided_at (unix seconds). A verdict serves events up to two days older and a
    week younger than it, as a cached one does; of several the newest counts, whichever came first, and in the same
    second a failure. Events are keyed by crawler, address and day, and a hot address is spread over `salts` keys;
    verdicts, which are few, are copied to the days and keys they may serve. Needs the RocksDB state store.
    """
    waiting = F.coalesce(F.col("vstate") == "pending", F.lit(False))
    day = lambda c: F.floor(c / 86400)
    payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns]))
    held = event_time(events.filter(waiting)).withWatermark("event_time", delay).select(
        "bot", "ip_hash", day(F.col("ts")).alias("day"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"),
        F.col("ts").alias("at"), F.lit(None).cast("string").alias("verdict"), payload.alias("event"), "event_time")
    at = F.col("decided_at")
    told = verdicts.withColumn("event_time", F.timestamp_seconds(at)).withWatermark("event_time", delay).withColumn(
        "day", F.explode(F.sequence(day(at - HOLD), day(at + TRUST)))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    told = told.select("bot", "ip_hash", "day", "salt", at.alias("at"), "verdict", F.lit(None).cast("string").alias("event"), "event_time")
    out = held.unionByName(told).groupBy("bot", "ip_hash", "day", "salt").transformWithStateInPandas(
        HoldBack(), "event string, verdict string", "append", "EventTime")
    back = F.from_json("event", events.schema)
    done = out.select(back.alias("e"), "verdict").select("e.*", "verdict").withColumns({
        "cls": F.when(F.col("verdict") == "failed", "spoofed").otherwise(F.col("cls")), "vstate": F.col("verdict")}).select(*events.columns)
    return events.filter(~waiting).unionByName(done)


# keyed state -------------------------------------------------------------------

def first_seen(keys: DataFrame, delay: str = "365 days") -> DataFrame:
    """The first row of each (kind, key): a new crawler, a page's first crawl, a new unknown agent.

    Duplicates are dropped map-side by the deduplication state, so a key with
    most of the traffic costs one state entry.
    """
    return event_time(keys).withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["kind", "key"]).drop("event_time")


def cooled_alerts(candidates: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Alert cooldown with keyed state: a key fires again only after its cooldown (dedupe, at, cooldown).

    The state is one time per key and leaves once the watermark has passed its cooldown. Within a batch a key's
    distinct times are gathered as numbers, frame by frame.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fire(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = pd.DataFrame({"at": [], "cooldown": []}, dtype="int64")
        for b in batches:
            times = pd.concat([times, b[["at", "cooldown"]]]).drop_duplicates()
        times = times.sort_values("at")
        fired, wait = [], 0
        for at, cooldown in times.itertuples(index=False):
            if last is None or last <= at - cooldown:
                fired.append(at)
                last, wait = int(at), int(cooldown)
        if last is not None:
            state.update((last,))
            # not before the watermark, which may be ahead of late candidates
            state.setTimeoutTimestamp(max((last + wait) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"dedupe": [key[0]] * len(fired), "created_at": fired})

    timed = candidates.withColumn("event_time", F.timestamp_seconds("at")).withWatermark("event_time", delay)
    return timed.groupBy("dedupe").applyInPandasWithState(
        fire, "dedupe string, created_at bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def import_batches(done_path: str, out_path: str) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` sink that skips import batches already recorded (file_key, batch)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            # a retried batch must not be stopped by its own record
            done = spark.read.schema("file_key string, batch bigint, epoch bigint").parquet(done_path).filter(
                F.col("epoch") != batch_id).drop("epoch")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            # nothing is recorded yet
            done = spark.createDataFrame([], "file_key string, batch bigint")
        fresh = batch.join(done, ["file_key", "batch"], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out_path}/epoch={batch_id}")
        fresh.select("file_key", "batch").distinct().write.mode("overwrite").parquet(f"{done_path}/epoch={batch_id}")

    return write
