"""Snapshots, trends and alerts.

Every rule is a frame of candidate alerts (rule, key, severity, at, cooldown,
subject, n); `raise_alerts` drops candidates whose key fired within its cooldown.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trailmark.config import Config, DAY
from trailmark.plans.traffic import important
from trailmark.sources.registry import Registry, lookup

WEEK, YEAR = 7 * DAY, 365 * DAY
_CANDIDATE = ("rule", "key", "severity", "at", "cooldown", "subject", "n")


def _candidate(df: DataFrame, rule, key: Column, severity, cooldown: int, config: Config, subject: Column | None = None,
               n: Column | None = None) -> DataFrame:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        as_col(rule).alias("rule"), key.cast("string").alias("key"), as_col(severity).alias("severity"),
        F.lit(config.as_of).cast("bigint").alias("at"), F.lit(cooldown).cast("bigint").alias("cooldown"),
        (subject if subject is not None else F.lit("")).cast("string").alias("subject"),
        (n if n is not None else F.lit(None)).cast("bigint").alias("n"))


def new_bot(new_bots: DataFrame, registry: Registry, config: Config) -> DataFrame:
    rows = new_bots.filter(registry.attr(F.col("bot"), "id").isNotNull())
    return _candidate(rows, "new_bot", F.col("bot"), "info", YEAR, config, F.col("bot"))


def _fingerprint(col: str) -> Column:
    """Identity of a set of ids, computed without gathering them."""
    # fifteen hex digits of each id's digest fit a long
    mixed = F.bit_xor(F.conv(F.substring(F.md5(F.col(col).cast("string")), 1, 15), 16, 10).cast("bigint"))
    return F.md5(F.concat_ws(":", F.count("*").cast("string"), mixed.cast("string"), F.sum(col).cast("string")))


def first_crawl_pages(first_crawls: DataFrame, pages: DataFrame, config: Config) -> DataFrame:
    """Important pages read for the first time, with the crawlers that read them."""
    live = pages.filter(~F.col("deleted") & important(config) & (F.col("pinned") >= 0)).select("url_hash", "page_id")
    return first_crawls.join(live, "url_hash").groupBy("page_id").agg(
        F.array_sort(F.collect_set("bot")).alias("bots"))  # bounded by the registry


def first_crawl(first_pages: DataFrame, config: Config) -> DataFrame:
    """One alert: for the page when there is one, else for the batch."""
    total = first_pages.agg(
        F.count("*").alias("n"), F.min("page_id").alias("one"), _fingerprint("page_id").alias("print")).filter("n > 0")
    single = F.col("n") == 1
    out = _candidate(
        total, "first_crawl", F.when(single, F.concat(F.lit("p"), F.col("one").cast("string"))).otherwise(
            F.concat(F.lit("batch"), "print")), "info", DAY, config, n=F.col("n"))
    return out.withColumn("cooldown", F.when(F.col("key").startswith("p"), YEAR).otherwise(DAY).cast("bigint"))


PAGE_CODES = ("robots_blocked", "noindex", "http_error", "bot_errors")
SITE_CODES = ("site_noindex", "robots_blocks_search", "robots_blocks_user", "edge_blocks_bot", "impersonation")


def findings_opened(synced: DataFrame, pages: DataFrame, config: Config) -> DataFrame:
    """Serious new findings of important pages, and new site-wide ones."""
    opened = synced.filter("event = 'opened'")
    imp = pages.filter(F.col("importance") >= config.importance_min).select("page_id")
    page = opened.filter(F.col("code").isin(*PAGE_CODES)).join(imp, "page_id", "left_semi")
    site = opened.filter((F.col("page_id") == 0) & F.col("code").isin(*SITE_CODES))
    return _candidate(
        page, F.concat(F.lit("page_"), "code"), F.concat_ws(":", F.col("page_id").cast("string"), "bot"), "critical", 3 * DAY,
        config, F.col("page_id"),
    ).unionByName(_candidate(site, F.concat(F.lit("site_"), "code"), F.col("bot"), F.col("severity"), 3 * DAY, config, F.col("bot")))


def robots_changed(changes: DataFrame, config: Config) -> DataFrame:
    """One alert for newly blocked and one for newly allowed crawlers (registry-sized input)."""
    per = changes.groupBy("change").agg(
        F.array_sort(F.collect_set("bot")).alias("bots"),
        F.bool_or(F.col("category").isin("ai_search", "ai_user", "search")).alias("search"))
    blocked = F.col("change") == "blocked"
    joined = F.array_join("bots", ",")
    return _candidate(
        per, F.when(blocked, "robots_blocked").otherwise("robots_allowed"), F.md5(joined),
        F.when(~blocked, "info").when(F.col("search"), "critical").otherwise("warning"), DAY, config, joined, F.size("bots"))


def activity(daily_bots: DataFrame, registry: Registry, config: Config) -> DataFrame:
    """Last 7 days against the weekly mean of the 4 weeks before; needs 21 days of history."""
    split = F.lit(config.back(7))
    ids = registry.ids("ai")
    rows = daily_bots.filter((F.col("day") >= F.lit(config.back(35))) & F.col("bot").isin(*ids)).groupBy("bot").agg(
        F.coalesce(F.sum(F.when(F.col("day") >= split, F.col("hits"))), F.lit(0)).alias("recent"),
        (F.coalesce(F.sum(F.when(F.col("day") < split, F.col("hits"))), F.lit(0)) / 4).alias("weekly"))
    if config.as_of - config.monitoring_since < 21 * DAY:
        rows = rows.limit(0)
    recent, weekly = F.col("recent"), F.col("weekly")
    kind = (
        F.when((weekly >= 5) & (recent == 0), "bot_stopped")
        .when((weekly >= 20) & (recent >= weekly * 2) & (recent >= 50), "activity_up")
        .when((weekly >= 20) & (recent <= weekly * 0.4), "activity_down"))
    return rows.withColumn("kind", kind).filter("kind is not null")


def activity_alerts(daily_bots: DataFrame, registry: Registry, config: Config) -> DataFrame:
    rows = activity(daily_bots, registry, config)
    answers = registry.category(F.col("bot")).isin("ai_search", "ai_user")
    severity = F.when(F.col("kind") == "activity_down", "warning").when(
        (F.col("kind") == "bot_stopped") & answers, "warning").otherwise("info")
    out = _candidate(rows, F.col("kind"), F.col("bot"), severity, WEEK, config, F.col("bot"), F.col("recent"))
    return out.withColumn("cooldown", F.when(F.col("rule") == "bot_stopped", 2 * WEEK).otherwise(WEEK).cast("bigint"))


def hot_pages(daily: DataFrame, pages: DataFrame, registry: Registry, config: Config, min_hits: int = 10, k: int = 10,
              days: int = 1) -> DataFrame:
    """Pages assistants keep fetching for users: the last two days."""
    rows = daily.filter((F.col("day") >= F.lit(config.back(days))) & F.col("bot").isin(*registry.ids("ai_user")))
    often = rows.groupBy("url_hash").agg(F.sum("hits").alias("hits")).filter(F.col("hits") >= min_hits)
    live = pages.filter(~F.col("deleted")).select("url_hash", "page_id")
    return often.join(live, "url_hash").orderBy(F.desc("hits"), "url_hash").limit(k)


def hot_page_alerts(hot: DataFrame, config: Config) -> DataFrame:
    return _candidate(hot, "hot_page", F.concat(F.lit("p"), F.col("page_id").cast("string")), "info", WEEK, config,
                      F.col("page_id"), F.col("hits"))


def dropped_pages(pages: DataFrame, page_bots: DataFrame, config: Config, k: int | None = None) -> DataFrame:
    """Important pages crawled before that no crawler read for 30 to 120 days; the first k of them where k is given."""
    last = page_bots.filter("hits >= 3").groupBy("url_hash").agg(F.max("last_seen").alias("last_seen"))
    rows = pages.filter(~F.col("deleted") & important(config)).join(last, "url_hash")
    out = rows.filter(
        (F.col("last_seen") < config.from_ts(30)) & (F.col("last_seen") > config.from_ts(120)) & (F.col("pinned") >= 0)
    ).select("page_id", "path", "importance", "last_seen")
    return out if k is None else out.orderBy(F.desc("importance"), "page_id").limit(k)


def dropped_alert(dropped: DataFrame, config: Config) -> DataFrame:
    total = dropped.agg(F.count("*").alias("n"), _fingerprint("page_id").alias("print")).filter("n > 0")
    return _candidate(total, "page_dropped", F.col("print"), "warning", WEEK, config, n=F.col("n"))


def never_crawled_alert(findings: DataFrame, pages: DataFrame, config: Config) -> DataFrame:
    live = pages.filter(~F.col("deleted")).select("page_id")
    n = findings.filter("code = 'never_crawled' and status = 'open'").join(live, "page_id", "left_semi").agg(
        F.count("*").alias("n")).filter("n > 0")
    return _candidate(n, "never_crawled", F.lit("weekly"), "warning", WEEK, config, n=F.col("n"))


def potential_agents(agent_rows: DataFrame, checked_at: int, config: Config, k: int = 5) -> DataFrame:
    rows = agent_rows.filter((F.col("cls") == "potential") & (F.col("state") == "new") & (F.col("first_seen") > checked_at)).orderBy(
        F.desc("hits"), "ua_hash").limit(k)
    return _candidate(rows, "potential_bot", F.col("ua_hash"), "info", YEAR, config, F.col("ua"), F.col("hits"))


def opportunities(inferred: DataFrame, pages: DataFrame, config: Config) -> DataFrame:
    """Important pages with at least three suggested gaps and questions."""
    n = inferred.filter(F.col("code").isin("content_gaps", "faq_opportunities")).groupBy("page_id").agg(F.sum("n").alias("n"))
    imp = pages.filter(F.col("importance") >= config.importance_min).select("page_id")
    rows = n.filter("n >= 3").join(imp, "page_id", "left_semi")
    return _candidate(rows, "opportunity", F.concat(F.lit("p"), F.col("page_id").cast("string")), "info", 2 * WEEK, config,
                      F.col("page_id"), F.col("n"))


def publish_guard(audit: DataFrame, config: Config) -> DataFrame:
    """Pages published with failing checks; audit: page_id, check, status, important, first_published."""
    fails = audit.filter("status = 'fail'").groupBy("page_id", "important", "first_published").agg(
        F.array_sort(F.collect_set("check")).alias("checks")).filter("important or first_published")  # five checks
    key = F.concat_ws(":", F.col("page_id").cast("string"), F.array_join("checks", ","))
    return _candidate(fails, "publish_guard", key, F.when(F.col("important"), "critical").otherwise("warning"), DAY, config,
                      F.col("page_id"), F.size("checks"))


def snapshot_alerts(snapshots: DataFrame, config: Config) -> DataFrame:
    """Drops between neighbouring snapshots (one row per day): score ≥ 8, readiness ≥ 10, critical issues up ≥ 3."""
    w = Window.orderBy("day")  # one row per day of history
    lagged = snapshots.select(
        "day", "score", "readiness", "critical", *[F.lag(c).over(w).alias(f"_{c}") for c in ("score", "readiness", "critical")])
    rule = lambda name, cond, n: F.when(cond, F.struct(F.lit(name).alias("rule"), n.cast("bigint").alias("n")))
    drop, ready = F.col("_score") - F.col("score"), F.col("_readiness") - F.col("readiness")
    up = F.col("critical") - F.col("_critical")
    fired = F.array_compact(F.array(
        rule("score_drop", drop >= 8, drop), rule("readiness_drop", ready >= 10, ready), rule("critical_up", up >= 3, up)))
    # the score alert is keyed by calendar year and ISO week
    week = F.format_string("%d-%02d", F.year("day"), F.weekofyear("day"))
    return lagged.select("day", F.explode(fired).alias("f")).select(
        F.col("f.rule").alias("rule"),
        F.when(F.col("f.rule") == "score_drop", week).otherwise(F.date_format("day", "yyyy-MM-dd")).alias("key"),
        F.when(F.col("f.rule") == "critical_up", "critical").otherwise("warning").alias("severity"),
        (F.datediff("day", F.lit("1970-01-01").cast("date")).cast("bigint") * DAY).alias("at"),
        F.when(F.col("f.rule") == "score_drop", 3 * DAY).otherwise(DAY).cast("bigint").alias("cooldown"),
        F.lit("").alias("subject"), F.col("f.n").alias("n"))


def _fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Times that fire, from rows ordered by key and time; `last` is the key's last time before them."""
    key, last = None, None
    for b in batches:
        keys, times = [], []
        for dedupe, at, cooldown, before in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if dedupe != key:
                key, last = dedupe, before
            if last is None or last <= at - cooldown:
                keys.append(dedupe)
                times.append(at)
                last = at
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(times, pa.int64())], names=["dedupe", "at"])


def union_rules(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select(*_CANDIDATE)


def raise_alerts(candidates: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Candidates whose key did not fire within the cooldown, in time order.

    stored: dedupe, created_at of earlier alerts. Distinct candidate times, which
    merge map-side, are walked in order, key after key; the walk keeps one number
    and never a key's list of times.
    """
    dedupe = F.concat_ws(":", "rule", "key")
    rows = candidates.withColumn("dedupe", dedupe)
    first = Window.partitionBy("dedupe", "at").orderBy(F.desc("severity"), "subject")
    rows = rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    times = rows.groupBy("dedupe", "at").agg(F.min("cooldown").alias("cooldown"))
    if stored is not None:
        last = stored.groupBy("dedupe").agg(F.max("created_at").alias("last"))
        times = times.join(last, "dedupe", "left")
    else:
        times = times.withColumn("last", F.lit(None).cast("bigint"))
    ordered = times.select("dedupe", F.col("at").cast("bigint"), F.col("cooldown").cast("bigint"), F.col("last").cast("bigint")
                           ).repartition("dedupe").sortWithinPartitions("dedupe", "at")
    kept = ordered.mapInArrow(_fire, "dedupe string, at bigint")
    return rows.join(kept, ["dedupe", "at"]).select(
        "rule", "dedupe", "severity", "subject", "n", F.lit("unread").alias("status"), F.col("at").alias("created_at"))


# snapshots ---------------------------------------------------------------

def snapshot(coverage: DataFrame, daily_bots: DataFrame, referrals: DataFrame, counts: DataFrame, site: DataFrame,
             readiness_scores: DataFrame, registry: Registry, config: Config) -> DataFrame:
    """One row of daily metrics."""
    ai = daily_bots.filter(registry.is_ai(F.col("bot")) & (F.col("day") >= F.lit(config.since(7))))
    week = ai.agg(F.struct(
        F.coalesce(F.sum(F.when(F.col("day") == F.lit(config.back(1)), F.col("hits"))), F.lit(0)).alias("d1"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("d7"),
        F.countDistinct(F.when(F.col("hits") > 0, F.col("bot"))).alias("bots")).alias("v"))
    sent = referrals.filter(F.col("day") >= F.lit(config.since(7))).agg(F.coalesce(F.sum("hits"), F.lit(0)))
    one = lambda df, *cols: df.select(F.struct(*cols).alias("v")).scalar()
    total = readiness_scores.filter("group = 'all'").select("score")
    out = coverage.select("pages", "crawled", "important", "important_crawled").withColumns({
        "w": week.scalar(), "referrals_7d": sent.scalar(), "c": one(counts, "critical", "warning", "info", "total"),
        "s": one(site, "score", "penalty"), "readiness": total.scalar(),
    })
    return out.select(
        F.lit(config.local_date()).alias("day"), F.col("w.d1").alias("ai_requests_1d"), F.col("w.d7").alias("ai_requests_7d"),
        F.col("w.bots").alias("ai_bots_7d"), "pages", F.col("crawled").alias("pages_crawled_30d"), "important",
        F.col("important_crawled").alias("important_crawled_30d"),
        F.when(F.col("important") > 0, F.round(100 * F.col("important_crawled") / F.col("important"), 1)).alias("coverage"),
        F.col("s.score").alias("score"), "readiness", F.col("c.critical").alias("critical"), F.col("c.warning").alias("warning"),
        F.col("c.total").alias("findings"), "referrals_7d")


def trend(snapshots: DataFrame, metric: str, config: Config, days: int = 90) -> DataFrame:
    return snapshots.filter((F.col("day") >= F.lit(config.since(days))) & F.col(metric).isNotNull()).select(
        "day", F.col(metric).alias("value")).orderBy("day")


# delivery selections -----------------------------------------------------

def digest(alerts: DataFrame, config: Config, last_digest: int = 0, k: int = 30) -> DataFrame:
    """Alerts of the next digest: since the last one, at most two days back, worst first."""
    from trailmark.operators.quality import severity_rank

    if config.as_of - last_digest < DAY:
        return alerts.limit(0)
    start = max(last_digest, config.from_ts(2))
    return alerts.filter(F.col("created_at") > start).orderBy(
        F.desc(severity_rank(F.col("severity"))), F.desc("created_at"), "dedupe").limit(k)


def deliverable(alerts: DataFrame, config: Config) -> DataFrame:
    """Which alerts qualify for mail and for the webhook."""
    from trailmark.operators.quality import SEVERITY, severity_rank

    mail = {"all": F.lit(True), "critical": F.col("severity") == "critical"}.get(config.notify_mode, F.lit(False))
    return alerts.withColumns({
        "mail": mail, "webhook": severity_rank(F.col("severity")) >= SEVERITY[config.webhook_level]})


def agents_to_share(agent_rows: DataFrame, k: int = 200) -> DataFrame:
    """Unknown agents not handed over since they were last seen."""
    return agent_rows.filter(
        (F.col("state") == "new") & F.col("cls").isin("unknown", "potential") & (F.col("shared_at") < F.col("last_seen"))
    ).orderBy(F.desc("hits"), "ua_hash").limit(k)


def merge_classes(agent_rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Put returned classes (ua, ai) on agents still marked new."""
    a = answers.select(F.md5("ua").alias("ua_hash"), F.when(F.col("ai"), "potential").otherwise("unknown").alias("_cls")).dropDuplicates(["ua_hash"])
    return agent_rows.join(a, "ua_hash", "left").withColumn(
        "cls", F.when(F.col("state") == "new", F.coalesce("_cls", "cls")).otherwise(F.col("cls"))).drop("_cls")
