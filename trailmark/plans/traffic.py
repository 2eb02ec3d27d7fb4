"""Crawler reports over the rollup tables.

Each report picks the smallest rollup that answers it, filters on the day
column first (partition pruning), aggregates, and joins page attributes only
to the rows it returns. One-row figures are combined with scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trailmark.config import Config
from trailmark.functions import agents, paths
from trailmark.operators import page_sets
from trailmark.operators.classify import event_view, local_day
from trailmark.sources.registry import ASSISTANT_OF, Registry, lookup


def _sum_if(cond: Column, col: str) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0))


def day_spine(spark: SparkSession, config: Config, days: int) -> DataFrame:
    return spark.range(days).select(
        F.date_add(F.lit(config.since(days)), F.col("id").cast("int")).alias("day"))


def live_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(~F.col("deleted"))


def important(config: Config) -> Column:
    return (F.col("importance") >= config.importance_min) | (F.col("pinned") > 0)


# overview ----------------------------------------------------------------

def overview(daily_bots: DataFrame, page_bots: DataFrame | None, referrals: DataFrame, registry: Registry,
             config: Config, days: int = 30, crawled_sets: DataFrame | None = None) -> DataFrame:
    """Totals of the window and the one before it; one row.

    `crawled_sets` (day, key: the crawler, bucket, pages; see `operators.page_sets`) gives the distinct pages from
    stored bitmaps; without it they are counted from page_bots.
    """
    since, prev = F.lit(config.since(days)), F.lit(config.since(2 * days))
    cur = F.col("day") >= since
    if crawled_sets is not None:
        crawled = page_sets.distinct_pages(crawled_sets.filter((F.col("day") >= since) & registry.is_ai(F.col("key"))))
    else:
        crawled = page_bots.filter(
            (F.col("last_seen") >= config.from_ts(days)) & registry.is_ai(F.col("bot"))
        ).agg(F.countDistinct("url_hash").alias("n"))
    visits = referrals.filter(F.col("day") >= prev).agg(
        F.struct(_sum_if(cur, "hits").alias("cur"), _sum_if(~cur, "hits").alias("prev")).alias("v"))
    user = F.col("bot").isin(*registry.user_ids)
    totals = daily_bots.filter((F.col("day") >= prev) & registry.is_ai(F.col("bot"))).agg(
        _sum_if(cur, "hits").alias("ai_requests"),
        _sum_if(~cur, "hits").alias("ai_requests_prev"),
        _sum_if(cur, "verified").alias("verified"),
        _sum_if(cur, "spoofed").alias("impersonations"),
        F.countDistinct(F.when(cur & (F.col("hits") > 0), F.col("bot"))).alias("ai_bots"),
        _sum_if(cur & user, "hits").alias("user_fetches"),
    )
    return totals.withColumn("pages_crawled", crawled.scalar()).withColumn("_v", visits.scalar()).select(
        "*", F.col("_v.cur").alias("ai_referrals"), F.col("_v.prev").alias("ai_referrals_prev")).drop("_v")


def coverage(pages: DataFrame, page_bots: DataFrame, registry: Registry, config: Config, days: int = 30) -> DataFrame:
    """Pages crawled by AI in the window, ever and never; one row."""
    last = page_bots.filter(registry.is_ai(F.col("bot"))).groupBy("url_hash").agg(F.max("last_seen").alias("last_ai"))
    imp, recent = important(config), F.coalesce(F.col("last_ai") >= config.from_ts(days), F.lit(False))
    return (
        live_pages(pages).filter("pinned >= 0").select("url_hash", "importance", "pinned")
        .join(last, "url_hash", "left").agg(
            F.count("*").alias("pages"),
            F.count_if(recent).alias("crawled"),
            F.count("last_ai").alias("crawled_ever"),
            F.count_if(imp).alias("important"),
            F.count_if(imp & recent).alias("important_crawled"),
            F.count_if(imp & F.col("last_ai").isNull()).alias("important_never"),
        )
        .withColumn("not_crawled", F.col("pages") - F.col("crawled"))
        .withColumn("learning", F.lit(config.learning))
    )


TIMELINE = ("ai_search", "ai_user", "ai_training", "ai_other", "search", "other")


def _timeline_category(registry: Registry, bot: Column) -> Column:
    cat = F.coalesce(registry.category(bot), F.when(bot == "_signed", "ai_agent").otherwise("other"))
    cat = F.when(cat == "ai_agent", "ai_user").otherwise(cat)
    return F.when(cat.isin(*TIMELINE), cat).otherwise("other")


def timeline(spark: SparkSession, daily_bots: DataFrame, registry: Registry, config: Config, days: int = 30) -> DataFrame:
    """Requests per day and category, zero-filled."""
    cat = _timeline_category(registry, F.col("bot"))
    rows = daily_bots.filter(F.col("day") >= F.lit(config.since(days))).groupBy("day").agg(
        *[_sum_if(cat == c, "hits").alias(c) for c in TIMELINE], F.sum("spoofed").alias("spoofed"))
    return day_spine(spark, config, days).join(rows, "day", "left").fillna(0, [*TIMELINE, "spoofed"])


# crawlers ----------------------------------------------------------------

def crawlers(daily_bots: DataFrame, page_bots: DataFrame, bots_seen: DataFrame, registry: Registry,
             config: Config, days: int = 30, matrix: DataFrame | None = None) -> DataFrame:
    """One row per crawler with its 30-day spark line; `matrix` adds the robots.txt state."""
    since, first = F.lit(config.since(days)), min(config.since(2 * days), config.since(30))
    in_cmp = F.col("day") >= F.lit(config.since(2 * days))
    cur, day30 = F.col("day") >= since, F.col("day") >= F.lit(config.since(30))
    known = registry.attr(F.col("bot"), "id").isNotNull() | F.col("bot").isin("_signed", "_potential")
    spark_day = F.when(day30, F.struct("day", "hits"))
    base = daily_bots.filter((F.col("day") >= F.lit(first)) & known).groupBy("bot").agg(
        _sum_if(cur, "hits").alias("requests"),
        _sum_if(in_cmp & ~cur, "hits").alias("requests_prev"),
        _sum_if(cur, "verified").alias("verified"),
        _sum_if(cur, "spoofed").alias("impersonations"),
        _sum_if(cur, "errors").alias("errors"),
        _sum_if(cur, "ms_total").alias("ms"),
        F.map_from_entries(F.collect_list(spark_day)).alias("by_day"),
    ).filter("requests + impersonations > 0")
    days30 = F.sequence(F.lit(config.since(30)), F.lit(config.since(1)))
    n_pages = page_bots.filter(F.col("last_seen") >= config.from_ts(days)).groupBy("bot").agg(F.count("*").alias("pages"))
    out = base.join(n_pages, "bot", "left").join(bots_seen.select("bot", "first_seen", "last_seen"), "bot", "left")
    verifiable = {b["id"]: bool(b["ranges"] or b["rdns"] or b["signature_hosts"]) for b in registry.bots}
    category = F.coalesce(registry.category(F.col("bot")),
                          F.when(F.col("bot") == "_potential", "potential").otherwise("ai_agent"))
    columns = [
        "bot", registry.label(F.col("bot")).alias("name"),
        F.coalesce(registry.attr(F.col("bot"), "provider"), F.lit("")).alias("provider"),
        category.alias("category"), F.coalesce(registry.attr(F.col("bot"), "ai"), F.lit(True)).alias("ai"),
        "requests", "requests_prev", "verified", "impersonations", "errors",
        F.when(F.col("requests") > 0, F.round(F.col("ms") / F.col("requests")).cast("bigint")).alias("avg_ms"),
        F.coalesce("pages", F.lit(0)).alias("pages"), "first_seen", "last_seen",
        F.coalesce(lookup(verifiable, F.col("bot")), F.lit(False)).alias("verifiable"),
        F.transform(days30, lambda x: F.coalesce(F.try_element_at(F.col("by_day"), x), F.lit(0))).alias("spark"),
        F.coalesce(agents.purpose(registry.category(F.col("bot"))), F.lit("")).alias("purpose"),
    ]
    if matrix is not None:
        out = out.join(matrix.select("bot", F.col("site_allowed").alias("robots_allowed"), F.col("rule").alias("robots_rule")),
                       "bot", "left")
        columns += ["robots_allowed", "robots_rule"]
    return out.select(*columns).orderBy(F.desc("ai"), F.desc("requests"), "bot")


def slots(bots_seen: DataFrame, registry: Registry) -> DataFrame:
    """Chart slots 1–4: the AI crawlers with the most requests ever."""
    top = bots_seen.filter(registry.is_ai(F.col("bot"))).select("bot", "hits").orderBy(F.desc("hits"), "bot").limit(4)
    return top.select("bot", F.row_number().over(Window.orderBy(F.desc("hits"), "bot")).alias("slot"))


def crawler_series(spark: SparkSession, daily_bots: DataFrame, bots_seen: DataFrame, registry: Registry,
                   config: Config, days: int = 30) -> DataFrame:
    """Daily requests of the four slotted crawlers plus `other`, zero-filled, with totals."""
    rows = daily_bots.filter(
        (F.col("day") >= F.lit(config.since(days))) & registry.is_ai(F.col("bot")) & (F.col("hits") > 0)
    ).join(F.broadcast(slots(bots_seen, registry)), "bot", "left")  # at most four rows
    named = F.when(F.col("slot").isNotNull(), F.col("bot")).otherwise("other")
    series = rows.groupBy(named.alias("series"), F.coalesce("slot", F.lit(0)).alias("slot"), "day").agg(
        F.sum("hits").alias("hits"))
    totals = rows.groupBy(named.alias("series"), F.coalesce("slot", F.lit(0)).alias("slot")).agg(
        F.sum("hits").alias("total"), F.countDistinct("bot").alias("bots"))
    days_list = F.sequence(F.lit(config.since(days)), F.lit(config.since(1)))
    grid = totals.withColumn("day", F.explode(days_list))
    return grid.join(series.drop("slot"), ["series", "day"], "left").fillna(0, ["hits"])


def crawler_timeline(spark: SparkSession, daily_bots: DataFrame, config: Config, bot: str, days: int = 30) -> DataFrame:
    own = daily_bots.filter((F.col("bot") == bot) & (F.col("day") >= F.lit(config.since(days)))).select(
        "day", F.col("hits").alias("requests"), "verified", "spoofed", "errors")
    return day_spine(spark, config, days).join(own, "day", "left").fillna(0)


BREAKDOWNS = {"status": 12, "verification": 10**6, "network": 15, "user_agent": 10}


#: Grouping ids of the sets below, in the order of their columns.
_FACETS = {0b001111: "status", 0b010011: "verification", 0b011001: "network", 0b011110: "user_agent"}


def crawler_breakdowns(events: DataFrame, config: Config, days: int = 30) -> DataFrame:
    """Status, verification, network and agent counts over all requests of each crawler in the window.

    One aggregate over four grouping sets: requests are counted map-side under each, so a crawler with a third of
    them sends each task's few distinct keys.
    """
    recent = events.filter((F.col("ts") >= config.from_ts(days)) & (F.col("bot") != ""))
    c = lambda *names: [F.col(n) for n in names]
    sets = [c("bot", "status"), c("bot", "cls", "vstate"), c("bot", "ip_net", "vstate"), c("bot", "ua")]
    counted = recent.groupingSets(sets, *c("bot", "status", "cls", "vstate", "ip_net", "ua")).agg(
        F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = lookup(_FACETS, F.col("g"))
    key = F.when(kind == "status", F.col("status").cast("string")).when(kind == "verification", F.col("cls")).when(
        kind == "network", F.col("ip_net")).otherwise(F.col("ua"))
    detail = F.when(kind.isin("verification", "network"), F.col("vstate")).otherwise("")
    counts = counted.select("bot", "n", kind.alias("kind"), key.alias("key"), detail.alias("detail")).filter("not (kind = 'network' and key = '')")
    rank = F.row_number().over(Window.partitionBy("bot", "kind").orderBy(F.desc("n"), "key", "detail"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= lookup(BREAKDOWNS, F.col("kind")))


def crawler_top_pages(daily: DataFrame, pages: DataFrame, config: Config, bot: str, days: int = 30, k: int = 25) -> DataFrame:
    rows = daily.filter((F.col("bot") == bot) & (F.col("day") >= F.lit(config.since(days)))).groupBy("url_hash").agg(
        F.max("path").alias("path"), F.sum("hits").alias("hits"), F.sum("errors").alias("errors"),
        F.max("last_status").alias("status"))
    top = rows.orderBy(F.desc("hits"), "path").limit(k)
    return _with_page(top, pages, "title", "importance")


def _with_page(few: DataFrame, pages: DataFrame, *columns: str) -> DataFrame:
    """Page attributes for a top-k result: the few rows are broadcast, the inventory is scanned once.

    Join order keeps the small side broadcast even for a left join, by
    restricting the inventory to the wanted pages first.
    """
    wanted = live_pages(pages).join(F.broadcast(few.select("url_hash")), "url_hash", "left_semi")
    attrs = wanted.groupBy("url_hash").agg(
        F.max("page_id").alias("page_id"), *[F.max(c).alias(c) for c in columns])
    return few.join(attrs, "url_hash", "left")


def latest_sessions(sessions: DataFrame, bot: str, k: int = 20) -> DataFrame:
    return sessions.filter(F.col("bot") == bot).orderBy(F.desc("ended"), F.desc("started")).limit(k)


def latest_requests(events: DataFrame, registry: Registry, k: int, bot: str | None = None,
                    url_hash: str | None = None, genuine: bool = False) -> DataFrame:
    """Newest requests of one crawler or one URL."""
    rows = events
    if bot is not None:
        rows = rows.filter(F.col("bot") == bot)
    if url_hash is not None:
        rows = rows.filter(F.col("url_hash") == url_hash)
    if genuine:
        rows = rows.filter("cls <> 'spoofed'")
    return event_view(rows.orderBy(F.desc("ts"), F.desc("id")).limit(k), registry)


def latest_per_page(events: DataFrame, registry: Registry, k: int = 8) -> DataFrame:
    """Newest k genuine requests of every page."""
    order = Window.partitionBy("url_hash").orderBy(F.desc("ts"), F.desc("id"))
    rows = events.filter("cls <> 'spoofed'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return rows.select("url_hash", "rank", "id", "ts", "bot", "status",
                       agents.confidence(registry, F.col("cls"), F.col("vstate"), F.col("bot")).alias("conf"))


# pages -------------------------------------------------------------------

def top_pages(daily: DataFrame, daily_pages: DataFrame, page_bots: DataFrame, referrals: DataFrame,
              pages: DataFrame, registry: Registry, config: Config, days: int = 30, k: int = 10) -> DataFrame:
    """Most crawled pages, then enriched: only k rows are joined to anything."""
    since = F.lit(config.since(days))
    top = daily_pages.filter(F.col("day") >= since).groupBy("url_hash").agg(F.sum("hits").alias("hits")).orderBy(
        F.desc("hits"), "url_hash").limit(k)
    few = F.broadcast(top.select("url_hash"))
    ai = registry.is_ai(F.col("bot"))
    readers = page_bots.filter(ai & (F.col("last_seen") >= config.from_ts(days))).join(few, "url_hash", "left_semi").groupBy(
        "url_hash").agg(F.max("path").alias("path"), F.count("*").alias("bots"))
    by_bot = daily.filter(ai & (F.col("day") >= since)).join(few, "url_hash", "left_semi").groupBy("url_hash", "bot").agg(
        F.sum("hits").alias("h"))
    first = Window.partitionBy("url_hash").orderBy(F.desc("h"), "bot")
    best = by_bot.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select(
        "url_hash", F.col("bot").alias("top_bot"))
    visits = referrals.filter(F.col("day") >= since).join(few, "url_hash", "left_semi").groupBy("url_hash").agg(
        F.sum("hits").alias("visits"))
    out = top.join(readers, "url_hash", "left").join(best, "url_hash", "left").join(visits, "url_hash", "left")
    return _with_page(out.fillna(0, ["visits", "bots"]), pages, "title", "importance").orderBy(F.desc("hits"), "url_hash")


def page_list(pages: DataFrame, page_bots: DataFrame, daily: DataFrame, daily_pages: DataFrame,
              open_findings: DataFrame, registry: Registry, config: Config, days: int = 30,
              show: str = "all", bot: str = "", search: str = "", subtype: str = "", sort: str = "importance",
              page: int | None = 1, per: int = 50) -> DataFrame:
    """The page list: crawl state, hits, open issues; filtered, ordered, paged (page=None for all)."""
    since = F.lit(config.since(days))
    who = F.col("bot") == bot if bot else registry.is_ai(F.col("bot"))
    crawled = page_bots.filter(who).groupBy("url_hash").agg(
        F.max("last_seen").alias("last_ai"), F.count("*").alias("nbots"),
        # at most one entry per registered crawler
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("last_seen")).alias("o"), "bot"))),
                    lambda s: s["bot"]).alias("bots"))
    source = daily.filter(F.col("bot") == bot) if bot else daily_pages
    window = source.filter(F.col("day") >= since).groupBy("url_hash").agg(
        F.sum("hits").alias("hits"), F.sum("errors").alias("errors"))
    opened = open_findings.filter("status = 'open' and page_id > 0")
    issues = opened.groupBy("page_id").agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warnings"))
    rows = live_pages(pages)
    if search:
        rows = rows.filter(paths.contains_text(F.col("title"), search) | paths.contains_text(F.col("path"), search))
    if subtype:
        rows = rows.filter(F.col("subtype") == subtype)
    imp = important(config) & (F.col("pinned") >= 0)
    if show in ("important", "never", "dropped"):
        rows = rows.filter(imp)
    with_codes = {
        "errors": ("bot_errors", "http_error"),
        "blocked": ("robots_blocked", "noindex", "canonical_elsewhere", "noai"),
    }
    if show in with_codes:
        rows = rows.join(opened.filter(F.col("code").isin(*with_codes[show])).select("page_id"), "page_id", "left_semi")
    out = rows.join(crawled, "url_hash", "left").join(window, "url_hash", "left").join(issues, "page_id", "left")
    out = out.fillna(0, ["hits", "errors", "critical", "warnings"])
    extra = {
        "crawled": F.col("hits") > 0,
        "uncrawled": F.col("hits") == 0,
        "never": F.col("last_ai").isNull(),
        "dropped": F.col("last_ai") < config.from_ts(30),
    }
    if show in extra:
        out = out.filter(extra[show])
    orders = {
        "importance": [F.desc("importance"), F.asc("page_id")],
        "hits": [F.desc("hits"), F.desc("importance"), F.asc("page_id")],
        "last": [F.desc_nulls_last("last_ai"), F.asc("page_id")],
        "score": [F.asc_nulls_first("score"), F.desc("importance"), F.asc("page_id")],
        "title": [F.lower("title").asc(), F.asc("page_id")],
    }
    out = out.select(
        "page_id", "object_type", "subtype", "path", "title", "importance", imp.alias("important"), "pinned",
        "score", "word_count", "inlinks", "last_ai", "bots", "hits", "errors", "critical", "warnings",
    ).orderBy(*orders[sort])
    return paged(out, page, per) if page is not None else out


def paged(rows: DataFrame, page: int, per: int) -> DataFrame:
    return rows.offset((page - 1) * per).limit(per)


def page_count(rows: DataFrame, per: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).withColumn(
        "pages", F.greatest(F.lit(1), F.ceil(F.col("total") / per)).cast("bigint"))


def page_column(pages: DataFrame, daily_pages: DataFrame, config: Config) -> DataFrame:
    """30-day hits and score per stored object, sortable."""
    hits = daily_pages.filter(F.col("day") >= F.lit(config.since(30))).groupBy("url_hash").agg(F.sum("hits").alias("hits"))
    posts = live_pages(pages).filter("object_type = 'post'").select("object_id", "url_hash", "score")
    score = F.col("score")
    level = F.when(score.isNull(), "none").when(score >= 70, "good").when(score >= 40, "warn").otherwise("crit")
    return posts.join(hits, "url_hash", "left").groupBy("object_id", "score").agg(
        F.coalesce(F.sum("hits"), F.lit(0)).alias("hits")).withColumn("level", level).orderBy(F.desc("hits"), "object_id")


def page_timeline(spark: SparkSession, daily: DataFrame, registry: Registry, config: Config, url_hash: str,
                  days: int = 90) -> DataFrame:
    own = daily.filter((F.col("url_hash") == url_hash) & (F.col("day") >= F.lit(config.since(days))))
    ai = F.coalesce(registry.attr(F.col("bot"), "ai"), F.lit(False))
    rows = own.groupBy("day").agg(_sum_if(ai, "hits").alias("ai"), _sum_if(~ai, "hits").alias("search"))
    return day_spine(spark, config, days).join(rows, "day", "left").fillna(0)


def page_crawlers(registry_rows: DataFrame, page_bots: DataFrame, allowed: DataFrame, config: Config, url_hash: str) -> DataFrame:
    """Crawlers of one page: what each did and what robots.txt says; quiet, allowed, minor ones are left out.

    `allowed`: bot, allowed, rule for this page.
    """
    own = page_bots.filter(F.col("url_hash") == url_hash).select("bot", "first_seen", "last_seen", "hits", "last_status")
    rows = registry_rows.filter("ai or category = 'search'").select(
        F.col("id").alias("bot"), "name", "category", "robots_only")
    joined = rows.join(own, "bot", "left").join(allowed, "bot", "left")
    ok = F.coalesce("allowed", F.lit(True))
    keep = F.col("last_seen").isNotNull() | F.col("bot").isin(*config.priority_bots) | ~ok
    return joined.filter(keep).select(
        "bot", "name", "category", "robots_only", "first_seen", "last_seen", F.coalesce("hits", F.lit(0)).alias("hits"),
        F.col("last_status").alias("status"), ok.alias("allowed"), F.coalesce("rule", F.lit("")).alias("rule"))


def url_detail(page_bots: DataFrame, registry: Registry, url_hash: str | None = None) -> DataFrame:
    """Totals, first visit and last answer of a URL (or of every URL)."""
    rows = page_bots.filter(registry.is_ai(F.col("bot")))
    if url_hash is not None:
        rows = rows.filter(F.col("url_hash") == url_hash)
    return rows.groupBy("url_hash").agg(
        F.max("path").alias("path"), F.sum("hits").alias("total"), F.min("first_seen").alias("first_at"),
        F.min_by("bot", F.struct("first_seen", "bot")).alias("first_bot"),
        F.max("last_seen").alias("last_at"),
        F.max_by("last_status", F.struct("last_seen", "bot")).alias("status"),
        F.count("*").alias("bots"),
    ).withColumn("first_bot", registry.label(F.col("first_bot")))


def url_crawlers(page_bots: DataFrame, registry: Registry, url_hash: str | None = None) -> DataFrame:
    """AI crawlers of a URL (or of every URL): requests and last visit of each."""
    rows = page_bots.filter(registry.is_ai(F.col("bot")))
    if url_hash is not None:
        rows = rows.filter(F.col("url_hash") == url_hash)
    return rows.select("url_hash", "bot", registry.label(F.col("bot")).alias("name"), "hits", F.col("last_seen").alias("last"))


def url_visits(referrals: DataFrame, registry: Registry, config: Config, days: int = 30, url_hash: str | None = None) -> DataFrame:
    """Visits that each assistant sent to a URL (or to every URL) in the window."""
    rows = referrals.filter(F.col("day") >= F.lit(config.since(days)))
    if url_hash is not None:
        rows = rows.filter(F.col("url_hash") == url_hash)
    return rows.groupBy("url_hash", "source").agg(F.sum("hits").alias("visits")).withColumn("name", registry.referrer_name(F.col("source")))


# pivots ------------------------------------------------------------------

def _top_columns(rows: DataFrame, key: str, k: int = 3) -> list[str]:
    """Names of the k largest columns of a pivot."""
    top = rows.groupBy(key).agg(F.sum("hits").alias("h")).orderBy(F.desc("h"), key).limit(k)
    return [r[0] for r in top.select(key).collect()]


def last_answer(page_bots: DataFrame, registry: Registry) -> DataFrame:
    """Status each page last gave an AI crawler."""
    return page_bots.filter(registry.is_ai(F.col("bot"))).groupBy("url_hash").agg(
        F.max_by("last_status", F.struct("last_seen", "bot")).alias("status"))


def crawler_pages(daily: DataFrame, daily_bots: DataFrame, page_bots: DataFrame, pages: DataFrame,
                  registry: Registry, config: Config, days: int = 30, bot: str = "", search: str = "",
                  status: str = "", page: int | None = 1, per: int = 20) -> DataFrame:
    """Requests per page with one column for each of the three busiest crawlers."""
    since, ai = F.lit(config.since(days)), registry.is_ai(F.col("bot"))
    rows = daily.filter((F.col("day") >= since) & ai)
    columns = _top_columns(daily_bots.filter((F.col("day") >= since) & ai), "bot")
    if bot:
        read = daily.filter((F.col("bot") == bot) & (F.col("day") >= since)).select("url_hash").distinct()
        rows = rows.join(read, "url_hash", "left_semi")
    if search:
        rows = rows.filter(paths.contains_text(F.col("path"), search))
    wide = rows.groupBy("url_hash").agg(
        F.max("path").alias("path"), F.sum("hits").alias("hits"),
        *[_sum_if(F.col("bot") == c, "hits").alias(f"top{i + 1}") for i, c in enumerate(columns)])
    counted = [F.col(f"top{i + 1}") for i in range(len(columns))]
    other = F.col("hits")
    for c in counted:
        other = other - c
    out = wide.join(last_answer(page_bots, registry), "url_hash", "left")
    if status:
        low = int(status[0]) * 100
        out = out.filter((F.col("status") >= low) & (F.col("status") < low + 100))
    out = out.withColumn("other", F.greatest(F.lit(0), other)).withColumn("columns", F.lit(",".join(columns)))
    out = out.orderBy(F.desc("hits"), "path")
    if page is None:
        return out
    return _with_page(paged(out, page, per), pages, "title")


def referral_sources(referrals: DataFrame, registry: Registry, config: Config, days: int = 30,
                     visited_sets: DataFrame | None = None) -> DataFrame:
    """Visits and distinct pages per assistant; from stored bitmaps (day, key: the source, bucket, pages) if given."""
    if visited_sets is not None:
        recent = F.col("day") >= F.lit(config.since(days))
        visits = referrals.filter(recent).groupBy("source").agg(F.sum("hits").alias("visits"))
        pages = page_sets.distinct_pages(visited_sets.filter(recent), "key").select(F.col("key").alias("source"), F.col("n").alias("pages"))
        return visits.join(pages, "source").withColumn("name", registry.referrer_name(F.col("source"))).orderBy(F.desc("visits"), "source")
    return referrals.filter(F.col("day") >= F.lit(config.since(days))).groupBy("source").agg(
        F.sum("hits").alias("visits"), F.countDistinct("url_hash").alias("pages")
    ).withColumn("name", registry.referrer_name(F.col("source"))).orderBy(F.desc("visits"), "source")


def referral_pages(referrals: DataFrame, daily_pages: DataFrame, pages: DataFrame, config: Config, days: int = 30,
                   engine: str = "", search: str = "", page: int | None = 1, per: int = 20) -> DataFrame:
    """Visits per page with one column for each of the three largest assistants, next to crawler hits."""
    since = F.lit(config.since(days))
    in_range = referrals.filter(F.col("day") >= since)
    columns = _top_columns(in_range, "source")
    rows = in_range
    if engine:
        rows = rows.join(in_range.filter(F.col("source") == engine).select("url_hash").distinct(), "url_hash", "left_semi")
    if search:
        rows = rows.filter(paths.contains_text(F.col("path"), search))
    wide = rows.groupBy("url_hash").agg(
        F.max("path").alias("path"), F.sum("hits").alias("total"),
        *[_sum_if(F.col("source") == c, "hits").alias(f"top{i + 1}") for i, c in enumerate(columns)])
    other = F.col("total")
    for i in range(len(columns)):
        other = other - F.col(f"top{i + 1}")
    out = wide.withColumn("other", F.greatest(F.lit(0), other)).withColumn("columns", F.lit(",".join(columns)))
    out = out.orderBy(F.desc("total"), "path")
    if page is None:
        return out
    few = paged(out, page, per)
    bots = daily_pages.filter(F.col("day") >= since).join(
        F.broadcast(few.select("url_hash")), "url_hash", "left_semi"  # one page of rows
    ).groupBy("url_hash").agg(F.sum("hits").alias("bot_hits"))
    return _with_page(few.join(bots, "url_hash", "left").fillna(0, ["bot_hits"]), pages, "title")


def crawled_and_cited(pages: DataFrame, daily_pages: DataFrame, referrals: DataFrame, page_bots: DataFrame,
                      registry: Registry, config: Config, days: int = 30) -> DataFrame:
    """Pages read by AI and visited, only read, and never read; one row."""
    since = F.lit(config.since(days))
    read = daily_pages.filter(F.col("day") >= since).groupBy("url_hash").agg(F.sum("hits").alias("n"))
    sent = referrals.filter(F.col("day") >= since).groupBy("url_hash").agg(F.sum("hits").alias("h"))
    ever = page_bots.filter(registry.is_ai(F.col("bot"))).select("url_hash").distinct().withColumn("ever", F.lit(True))
    joined = live_pages(pages).filter("pinned >= 0").select("url_hash").join(read, "url_hash", "left").join(
        sent, "url_hash", "left").join(ever, "url_hash", "left")
    return joined.agg(
        F.count_if((F.col("n") > 0) & (F.col("h") > 0)).alias("cited"),
        F.count_if((F.col("n") > 0) & (F.coalesce("h", F.lit(0)) == 0)).alias("read_only"),
        F.count_if(F.col("ever").isNull()).alias("never"),
    )


# opportunities -----------------------------------------------------------

def assistant_pages(daily: DataFrame, pages: DataFrame, registry: Registry, config: Config, k: int = 15) -> DataFrame:
    """Pages assistants fetch on behalf of users."""
    rows = daily.filter((F.col("day") >= F.lit(config.since(30))) & F.col("bot").isin(*registry.user_ids))
    top = rows.groupBy("url_hash").agg(
        F.max("path").alias("path"), F.sum("hits").alias("fetches"),
        F.array_sort(F.collect_set("bot")).alias("bots"),  # bounded by the registry
    ).orderBy(F.desc("fetches"), "path").limit(k)
    return _with_page(top, pages, "title")


def never_crawled(pages: DataFrame, page_bots: DataFrame, registry: Registry, config: Config) -> DataFrame:
    """Important pages no AI crawler ever fetched."""
    read = page_bots.filter(registry.is_ai(F.col("bot"))).select("url_hash")
    return live_pages(pages).filter(important(config)).join(read, "url_hash", "left_anti").select(
        "page_id", "path", "title", "importance")


def weak_but_popular(daily: DataFrame, pages: DataFrame, registry: Registry, config: Config, k: int = 10) -> DataFrame:
    """Often crawled pages with a score under 60."""
    weak = live_pages(pages).filter("score < 60").select("url_hash", "page_id", "path", "title", "score")
    rows = daily.filter((F.col("day") >= F.lit(config.since(30))) & registry.is_ai(F.col("bot")))
    per_page = rows.groupBy("url_hash").agg(F.sum("hits").alias("hits"), F.countDistinct("bot").alias("bots"))
    return weak.join(per_page, "url_hash").orderBy(F.desc("hits"), "page_id").limit(k)


def erroring_pages(daily: DataFrame, pages: DataFrame, registry: Registry, config: Config, k: int = 10) -> DataFrame:
    rows = daily.filter((F.col("day") >= F.lit(config.since(14))) & registry.is_ai(F.col("bot")) & (F.col("errors") > 0))
    top = rows.groupBy("url_hash").agg(
        F.max("path").alias("path"), F.sum("errors").alias("errors"), F.sum("hits").alias("hits"),
        F.max("last_status").alias("status")).orderBy(F.desc("errors"), "path").limit(k)
    return _with_page(top, pages, "title")


def slow_pages(daily: DataFrame, pages: DataFrame, registry: Registry, config: Config, k: int = 10,
               min_hits: int = 5, min_ms: int = 1500) -> DataFrame:
    rows = daily.filter((F.col("day") >= F.lit(config.since(30))) & registry.is_ai(F.col("bot")))
    mean = F.round(F.sum("ms_total") / F.greatest(F.sum("hits"), F.lit(1))).cast("bigint")
    top = rows.groupBy("url_hash").agg(
        F.max("path").alias("path"), F.sum("hits").alias("hits"), mean.alias("avg_ms")
    ).filter((F.col("hits") >= min_hits) & (F.col("avg_ms") >= min_ms)).orderBy(F.desc("avg_ms"), "path").limit(k)
    return _with_page(top, pages, "title")


def blocked_crawlers(matrix: DataFrame, referrals: DataFrame, daily_bots: DataFrame, registry: Registry,
                     config: Config, k: int = 8) -> DataFrame:
    """AI crawlers robots.txt keeps out although their assistant sends visits."""

    assistants = {b["id"]: ASSISTANT_OF[b["provider"]] for b in registry.bots if b["provider"] in ASSISTANT_OF}
    refs = referral_sources(referrals, registry, config).select("source", "visits", F.col("name").alias("assistant"))
    tries = daily_bots.filter(F.col("day") >= F.lit(config.since(30))).groupBy("bot").agg(F.sum("hits").alias("attempts"))
    kept_out = matrix.filter(
        F.coalesce(registry.attr(F.col("bot"), "ai"), F.lit(False)) & (~F.col("site_allowed") | (F.col("blocked_count") > 0))
    ).withColumn("source", lookup(assistants, F.col("bot")))
    out = kept_out.join(refs, "source", "left").join(tries, "bot", "left")
    passive = registry.category(F.col("bot")).isin("ai_training", "ai_other")
    out = out.filter(~(passive & F.col("visits").isNull()))
    return out.select(
        "bot", registry.label(F.col("bot")).alias("name"), registry.attr(F.col("bot"), "provider").alias("provider"),
        registry.category(F.col("bot")).alias("category"), "site_allowed",
        F.col("blocked_count").alias("blocked_pages"), F.col("bot").isin(*config.priority_bots).alias("priority"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.coalesce("assistant", registry.referrer_name(F.col("source")), F.lit("")).alias("assistant"),
        F.coalesce("visits", F.lit(0)).alias("visits"),
    ).orderBy(F.desc("visits"), F.desc("priority"), F.desc("blocked_pages"), "bot").limit(k)


def unknown_agents(agent_rows: DataFrame, k: int = 200, state: str = "new") -> DataFrame:
    rank = F.when(F.col("cls") == "potential", 1).otherwise(2)
    return agent_rows.filter(F.col("state") == state).orderBy(rank, F.desc("hits"), "ua_hash").limit(k).withColumn(
        "token", agents.agent_token(F.col("ua")))


# history -----------------------------------------------------------------

def period(day: Column, group: str) -> Column:
    if group == "week":
        return F.format_string("%d-W%02d", F.expr("extract(YEAROFWEEK FROM day)"), F.weekofyear(day))
    return F.date_format(day, "yyyy-MM" if group == "month" else "yyyy-MM-dd")


HISTORY = ("ai_search", "ai_user", "ai_training", "ai_other", "search")


def history(daily_bots: DataFrame, registry: Registry, config: Config, days: int = 90, group: str = "day") -> DataFrame:
    cat = F.coalesce(registry.category(F.col("bot")), F.lit("other"))
    cat = F.when(cat == "ai_agent", "ai_user").otherwise(cat)
    return daily_bots.filter(F.col("day") >= F.lit(config.since(days))).groupBy(
        period(F.col("day"), group).alias("period")
    ).agg(*[_sum_if(cat == c, "hits").alias(c) for c in HISTORY], F.sum("spoofed").alias("spoofed")).orderBy("period")


def history_by_bot(daily_bots: DataFrame, registry: Registry, config: Config, days: int = 90, group: str = "day",
                   k: int = 10) -> DataFrame:
    """Series of the k busiest AI crawlers."""
    ai = F.coalesce(registry.attr(F.col("bot"), "ai"), F.lit(False))
    rows = daily_bots.filter((F.col("day") >= F.lit(config.since(days))) & ai).groupBy(
        "bot", period(F.col("day"), group).alias("period")).agg(F.sum("hits").alias("hits"))
    top = rows.groupBy("bot").agg(F.sum("hits").alias("total")).orderBy(F.desc("total"), "bot").limit(k)
    return rows.join(F.broadcast(top), "bot")  # k rows


def new_crawlers(bots_seen: DataFrame, registry: Registry, config: Config, days: int = 90) -> DataFrame:
    return bots_seen.filter(F.col("first_seen") >= config.from_ts(days)).select(
        "bot", registry.label(F.col("bot")).alias("name"), "first_seen").orderBy("first_seen", "bot")


def issue_history(findings: DataFrame, config: Config, days: int = 90, group: str = "day") -> DataFrame:
    """Issues opened and resolved per period."""
    start = config.from_ts(days)
    opened = findings.filter(F.col("first_seen") >= start).select(
        local_day(F.col("first_seen"), config.tz).alias("day"), F.lit(1).alias("o"), F.lit(0).alias("r"))
    resolved = findings.filter((F.col("status") == "resolved") & (F.col("resolved_at") >= start)).select(
        local_day(F.col("resolved_at"), config.tz).alias("day"), F.lit(0).alias("o"), F.lit(1).alias("r"))
    return opened.unionByName(resolved).groupBy(period(F.col("day"), group).alias("period")).agg(
        F.sum("o").alias("opened"), F.sum("r").alias("resolved")).orderBy("period")


def crawl_history(page_bots: DataFrame, referrals: DataFrame, registry: Registry, config: Config) -> DataFrame:
    """AI hits, last visit, crawlers from the busiest on and 30-day visits of every URL."""
    ai = F.coalesce(registry.attr(F.col("bot"), "ai"), F.lit(False))
    seen = page_bots.filter(ai).groupBy("url_hash").agg(
        F.sum("hits").alias("hits"), F.max("last_seen").alias("last"),
        # at most one entry per registered crawler
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("hits")).alias("o"), "bot"))),
                    lambda s: s["bot"]).alias("bots"))
    sent = referrals.filter(F.col("day") >= F.lit(config.back(30))).groupBy("url_hash").agg(F.sum("hits").alias("referrals"))
    return seen.join(sent, "url_hash", "full").fillna(0, ["hits", "last", "referrals"])
