"""Importance, crawl state, findings with a lifecycle, page and site scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailmark.config import Config, DAY
from trailmark.sources.registry import Registry, lookup

# Every issue, as code: severity, kind, scope, group.
CATALOG = {
    "robots_blocked": ("critical", "observed", "coverage", "access"),
    "noindex": ("critical", "observed", "content", "access"),
    "noai": ("info", "observed", "content", "access"),
    "http_error": ("critical", "observed", "content", "access"),
    "redirects": ("info", "observed", "content", "access"),
    "canonical_elsewhere": ("warning", "observed", "content", "access"),
    "bot_errors": ("critical", "observed", "coverage", "access"),
    "slow_for_bots": ("warning", "observed", "coverage", "access"),
    "never_crawled": ("warning", "observed", "coverage", "discovery"),
    "stale_crawl": ("info", "observed", "coverage", "discovery"),
    "training_only": ("info", "observed", "coverage", "discovery"),
    "orphan": ("warning", "observed", "content", "discovery"),
    "few_inlinks": ("info", "observed", "content", "discovery"),
    "thin_content": ("warning", "observed", "content", "content"),
    "no_subheadings": ("warning", "observed", "content", "content"),
    "no_question_headings": ("info", "observed", "content", "content"),
    "no_direct_answer": ("info", "observed", "content", "content"),
    "no_faq": ("info", "observed", "content", "content"),
    "no_lists": ("info", "observed", "content", "content"),
    "no_structured_data": ("warning", "observed", "content", "trust"),
    "schema_mismatch": ("warning", "observed", "content", "trust"),
    "no_author": ("info", "observed", "content", "trust"),
    "outdated": ("info", "observed", "content", "trust"),
    "missing_alt": ("info", "observed", "content", "content"),
    "no_meta_description": ("info", "observed", "content", "content"),
    "content_gaps": ("warning", "inferred", "inferred", "content"),
    "keyword_gaps": ("info", "inferred", "inferred", "content"),
    "faq_opportunities": ("info", "inferred", "inferred", "content"),
    "site_noindex": ("critical", "observed", "site", "access"),
    "robots_blocks_search": ("critical", "observed", "site", "access"),
    "robots_blocks_user": ("warning", "observed", "site", "access"),
    "robots_blocks_training": ("info", "observed", "site", "access"),
    "edge_blocks_bot": ("critical", "observed", "site", "access"),
    "impersonation": ("info", "observed", "site", "security"),
    "verification_stale": ("warning", "observed", "site", "system"),
    "worker_stalled": ("critical", "observed", "site", "system"),
    "proxy_unconfigured": ("warning", "observed", "site", "system"),
    "no_sitemap_in_robots": ("info", "observed", "site", "discovery"),
}
SEVERITY = {"critical": 3, "warning": 2, "info": 1}


def meta(code: Column, field: int) -> Column:
    return lookup({c: m[field] for c, m in CATALOG.items()}, code)


def severity_rank(severity: Column) -> Column:
    return F.coalesce(lookup(SEVERITY, severity), F.lit(0))


# importance --------------------------------------------------------------

def importance(pages: DataFrame, config: Config) -> DataFrame:
    """importance 0–100 with reasons.

    Signals, all optional: is_front, is_hub, in_menu, cornerstone (booleans),
    sales, referrals (30-day assistant visits).
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in pages.columns else F.lit(False)
    num = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in pages.columns else F.lit(0)
    post = F.col("object_type") == "post"
    sales, inlinks, visits = num("sales"), num("inlinks"), num("referrals")
    fresh = F.coalesce(F.col("modified") > config.as_of - 90 * DAY, F.lit(False))
    product = post & (F.col("subtype") == "product")
    signals = [
        ((F.col("object_type") == "home") | (post & flag("is_front")), F.lit(60), "home"),
        (post & flag("is_hub"), F.lit(30), "hub"),
        (flag("in_menu"), F.lit(25), "menu"),
        (post & flag("cornerstone"), F.lit(30), "cornerstone"),
        (product, F.lit(10), "product"),
        (product & (sales > 0), F.least(F.lit(15), F.round(F.log2(sales + 1) * 2).cast("int")), "sales"),
        (post & (F.col("subtype") == "page"), F.lit(10), "page"),
        (F.col("object_type") == "term", F.lit(5), "archive"),
        (inlinks > 0, F.least(F.lit(25), inlinks * 3), "inlinks"),
        (visits > 0, F.least(F.lit(20), visits + 5), "ai_referrals"),
        (num("word_count") >= 1000, F.lit(5), "in_depth"),
        (fresh, F.lit(5), "fresh"),
    ]
    total = F.lit(0)
    for cond, points, _ in signals:
        total = total + F.when(cond, points).otherwise(0)
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(why)) for cond, _, why in signals]))
    pinned = F.col("pinned")
    fixed = lambda why: F.array(F.lit(why))
    return pages.withColumns({
        "importance": F.when(pinned < 0, 0).when(pinned > 0, 100)
        .otherwise(F.least(F.lit(99), F.greatest(F.lit(0), total))).cast("int"),
        "imp_reasons": F.when(pinned < 0, fixed("excluded")).when(pinned > 0, fixed("pinned")).otherwise(reasons),
    })


# crawl state -------------------------------------------------------------

def crawl_state(crawls: DataFrame, registry: Registry) -> DataFrame:
    """What AI crawlers did on each page, from `page_bots` or from the genuine rows of a fold."""
    cat = registry.category(F.col("bot"))
    ai = crawls.filter(F.col("bot").isin(*registry.ids("ai")))
    return ai.groupBy("url_hash").agg(
        F.lit(True).alias("ai_any"),
        F.bool_or(cat.isin("ai_search", "ai_user", "ai_agent")).alias("ai_search"),
        F.bool_or(cat == "ai_training").alias("training"),
        F.max("last_seen").alias("last_ai"),
    )


def recent_crawls(daily: DataFrame, registry: Registry, config: Config) -> DataFrame:
    """Errors and latency of the last 14 days: one row per page, failing crawlers as an array."""
    rows = daily.filter((F.col("day") >= F.lit(config.back(14))) & F.col("bot").isin(*registry.ids("ai")))
    per_bot = rows.groupBy("url_hash", "bot").agg(
        F.sum("hits").alias("hits"), F.sum("errors").alias("errors"), F.sum("ms_total").alias("ms"),
        F.max("last_status").alias("status"))
    failing = (F.col("errors") >= 2) | ((F.col("errors") >= 1) & (F.col("status") >= 500))
    return per_bot.groupBy("url_hash").agg(
        F.sum("hits").alias("recent_hits"), F.sum("ms").alias("recent_ms"),
        # at most one entry per registered crawler
        F.collect_list(F.when(failing, F.struct("bot", "errors", "status"))).alias("failing"))


def is_learning(bots_seen: DataFrame, config: Config) -> Column:
    """Too little history to judge: under 14 days, or no crawler in the last 14."""
    active = bots_seen.filter(F.col("last_seen") > config.from_ts(14)).agg(F.count("*")).scalar()
    return F.lit(config.learning) | (active == 0)


# findings ----------------------------------------------------------------

def _finding(cond: Column, code: str, severity: Column | None = None, bot: Column | None = None, n: Column | None = None) -> Column:
    return F.when(cond, F.struct(
        F.lit(code).alias("code"),
        (severity if severity is not None else F.lit(CATALOG[code][0])).alias("severity"),
        (bot if bot is not None else F.lit("")).alias("bot"),
        (n if n is not None else F.lit(None)).cast("bigint").alias("n"),
    ))


def page_profile(facts: DataFrame, pages: DataFrame, state: DataFrame, recent: DataFrame, blocked: DataFrame,
                 config: Config, learning: Column) -> DataFrame:
    """Everything the findings and the score of a page are decided from, one row per page.

    facts: those the caller's findings read; `has_facts` is there if `words` is.
    """
    own = ["page_id", "url_hash", "object_type", "subtype", "pinned", "inlinks", "modified", "importance", "imp_reasons"]
    taken = set(own) | {"path", "url", "text"}
    narrow = facts.select("page_id", *[c for c in facts.columns if c not in taken])
    joined = (
        pages.filter(~F.col("deleted")).select(*own)
        .join(narrow, "page_id", "left").join(state, "url_hash", "left").join(recent, "url_hash", "left")
        .join(blocked, "page_id", "left")
    )
    return joined.withColumns(({"has_facts": F.col("words").isNotNull()} if "words" in narrow.columns else {}) | {
        "important": F.col("importance") >= config.importance_min,
        "is_home": (F.col("object_type") == "home") | F.array_contains("imp_reasons", "home"),
        "learning": learning,
        "blocked": F.coalesce("blocked", F.expr("array()").cast("array<struct<bot: string, rule: string>>")),
        "ai_any": F.coalesce("ai_any", F.lit(False)),
        "ai_search": F.coalesce("ai_search", F.lit(False)),
        "training": F.coalesce("training", F.lit(False)),
        "analyzed_pages": facts.agg(F.count("*")).scalar(),
    })


def coverage_findings(profile: DataFrame, config: Config) -> DataFrame:
    """Findings from observed requests and robots.txt."""
    imp = F.col("important")
    graded = F.when(imp, "critical").otherwise("warning")
    per_bot = lambda code, bot, n: F.struct(
        F.lit(code).alias("code"), graded.alias("severity"), bot.alias("bot"), n.cast("bigint").alias("n"))
    empty = F.expr("array()").cast("array<struct<code: string, severity: string, bot: string, n: bigint>>")
    mean = F.col("recent_ms") / F.col("recent_hits")
    modified = F.col("modified")
    one_each = F.array_compact(F.array(
        _finding((F.col("recent_hits") >= 3) & (mean >= 3000), "slow_for_bots", n=F.round(mean)),
        _finding(imp & ~F.col("ai_any") & ~F.col("learning") & (F.size("blocked") == 0) & ~F.coalesce("noindex", F.lit(False)),
                 "never_crawled"),
        _finding(imp & (modified > F.col("last_ai")) & (modified < config.as_of - 7 * DAY), "stale_crawl", n=F.col("last_ai")),
        _finding(imp & F.col("training") & ~F.col("ai_search"), "training_only"),
    ))
    every = F.concat(
        F.transform("blocked", lambda b: per_bot("robots_blocked", b["bot"], F.lit(None))),
        F.coalesce(F.transform("failing", lambda f: per_bot("bot_errors", f["bot"], f["errors"])), empty),
        one_each,
    )
    return _explode(profile, every)


def content_findings(profile: DataFrame, config: Config) -> DataFrame:
    """Findings from what the page contains; archives and the home page are not judged as articles."""
    c = F.col
    imp = c("important")
    down = F.when(imp, "critical").otherwise("warning")
    soft = F.when(imp, "warning").otherwise("info")
    home, words, intent = c("is_home"), c("words"), c("intent.intent")
    article = ~home & (c("object_type") != "term")
    has = lambda *names: F.arrays_overlap("schema", F.array(*[F.lit(n) for n in names]))
    some_schema = F.size("schema") > 0
    orphan = ~home & (c("inlinks") == 0) & (c("analyzed_pages") > 5)
    wants = lambda *kinds: intent.isin(*kinds)
    thin = F.when(c("subtype") == "product", 120).otherwise(300)
    rules = [
        _finding(c("noindex"), "noindex", down),
        _finding(c("noai"), "noai"),
        _finding(c("status") >= 400, "http_error", down, n=c("status")),
        _finding(c("status").between(300, 399), "redirects", n=c("status")),
        _finding(c("canonical_elsewhere"), "canonical_elsewhere"),
        _finding(orphan, "orphan", soft),
        _finding(imp & ~home & c("inlinks").between(1, 2) & ~orphan, "few_inlinks", n=c("inlinks")),
        _finding(article & (words < thin), "thin_content", soft, n=words),
        _finding(article & (words >= 400) & (c("h2") + c("h3") == 0), "no_subheadings"),
        _finding(article & wants("informational") & (words >= 500) & (F.size("question_headings") == 0), "no_question_headings"),
        _finding(article & wants("informational", "commercial") & (words >= 300)
                 & ((c("first_para_words") > 80) | (c("first_para_words") == 0)), "no_direct_answer", n=c("first_para_words")),
        _finding(article & imp & wants("informational", "commercial", "transactional") & ~c("faq") & (words >= 500), "no_faq"),
        _finding(article & (words >= 800) & (c("lists") + c("tables") == 0), "no_lists"),
        _finding(article & c("fetched") & ~some_schema, "no_structured_data", soft),
        _finding(article & some_schema & (c("object_type") == "post") & (
            ((c("subtype") == "product") & ~has("Product"))
            | ((c("subtype") == "post") & ~has("Article", "BlogPosting", "NewsArticle", "TechArticle"))), "schema_mismatch"),
        _finding(article & c("author_known") & ~c("author_bio"), "no_author"),
        _finding(article & (c("subtype") == "post") & wants("informational") & (c("modified_days") > 365), "outdated", n=c("modified_days")),
        _finding(article & (c("images_no_alt") > 0) & (c("images_no_alt") / F.greatest(c("images"), F.lit(1)) >= 0.3),
                 "missing_alt", n=c("images_no_alt")),
        _finding(article & c("fetched") & (F.coalesce("description", F.lit("")) == ""), "no_meta_description"),
    ]
    return _explode(profile.filter("has_facts"), F.array_compact(F.array(*rules)))


def _explode(profile: DataFrame, found: Column) -> DataFrame:
    return profile.select("page_id", F.explode(found).alias("f")).select(
        "page_id", "f.*", meta(F.col("f.code"), 1).alias("kind"))


def site_findings(spark: SparkSession, matrix: DataFrame, sitemaps: DataFrame, daily_bots: DataFrame, range_status: DataFrame,
                  probes: DataFrame, registry: Registry, config: Config, proxy_seen_at: int = 0) -> DataFrame:
    """Site-wide findings (page_id 0). probes: bot, refused."""
    row = lambda df, code, bot, sev=None, n=None: df.select(
        F.lit(code).alias("code"), (sev if sev is not None else F.lit(CATALOG[code][0])).alias("severity"),
        bot.alias("bot"), (n if n is not None else F.lit(None)).cast("bigint").alias("n"))
    closed = matrix.filter("not site_allowed").withColumn("category", registry.category(F.col("bot")))
    bot, none = F.col("bot"), F.lit("")
    priority = bot.isin(*config.priority_bots)
    week = daily_bots.filter(F.col("day") >= F.lit(config.back(7))).groupBy("bot").agg(
        F.sum("spoofed").alias("spoofed"), (F.sum("verified") - F.sum("errors")).alias("through"))
    refused = probes.filter("refused").join(week, "bot", "left").filter(F.coalesce("through", F.lit(0)) <= 0)
    one = spark.range(1)
    parts = [
        row(closed.filter("category in ('ai_search', 'search')"), "robots_blocks_search", bot,
            F.when(priority, "critical").otherwise("warning")),
        row(closed.filter("category in ('ai_user', 'ai_agent')"), "robots_blocks_user", bot),
        row(closed.filter("category = 'ai_training'"), "robots_blocks_training", bot),
        row(sitemaps.agg(F.count("*").alias("k")).filter("k = 0"), "no_sitemap_in_robots", none),
        row(refused, "edge_blocks_bot", bot),
        row(week.filter("spoofed >= 20"), "impersonation", bot, n=F.col("spoofed")),
        row(range_status.agg(F.count_if("stale").alias("k")).filter("k > 0"), "verification_stale", none),
    ]
    if not config.site_public:
        parts.append(row(one, "site_noindex", none))
    if not config.proxy_header and proxy_seen_at > config.as_of - 7 * DAY:
        parts.append(row(one, "proxy_unconfigured", none))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(0).cast("bigint").alias("page_id"), "*", meta(F.col("code"), 1).alias("kind"))


def sync_findings(stored: DataFrame, current: DataFrame, scopes, config: Config, pages: DataFrame | None = None) -> DataFrame:
    """New state of the findings table after a run that re-stated everything in `scopes`.

    stored: page_id, code, bot, severity, kind, status, n, first_seen, last_seen, resolved_at.
    current: page_id, code, bot, severity, kind, n. `pages` limits the run to some pages (page_id).
    The result adds `event`: 'opened' for new or returning findings, 'resolved' for fixed ones.
    """
    codes = [c for c, m in CATALOG.items() if m[2] in scopes]
    key = ["page_id", "code", "bot"]
    now = F.lit(config.as_of).cast("bigint")
    fresh = current.filter(F.col("code").isin(*codes)).groupBy(*key).agg(
        F.max("severity").alias("c_severity"), F.max("kind").alias("c_kind"), F.max("n").alias("c_n")
    ).withColumn("reported", F.lit(True))
    both = stored.join(fresh, key, "full")
    if pages is not None:
        both = both.join(pages.select("page_id", F.lit(True).alias("judged")), "page_id", "left")
    else:
        both = both.withColumn("judged", F.lit(True))
    mine = F.col("code").isin(*codes) & F.coalesce("judged", F.lit(False))
    reported = F.coalesce("reported", F.lit(False))
    old, new = F.col("status").isNotNull(), F.col("status").isNull()
    ignored = F.col("status") == "ignored"
    live = reported & (new | ~ignored)
    fixed = mine & ~reported & (F.col("status") == "open")
    return both.select(
        *key,
        F.when(live, F.col("c_severity")).otherwise(F.col("severity")).alias("severity"),
        F.coalesce("kind", "c_kind").alias("kind"),
        F.when(live, "open").when(fixed, "resolved").otherwise(F.col("status")).alias("status"),
        F.when(reported, F.col("c_n")).otherwise(F.col("n")).alias("n"),
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(reported, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(live, F.lit(None)).when(fixed, now).otherwise(F.col("resolved_at")).cast("bigint").alias("resolved_at"),
        F.when(new | (reported & old & (F.col("status") == "resolved")), "opened").when(fixed, "resolved").alias("event"),
    )


def finding_counts(findings: DataFrame, pages: DataFrame, config: Config) -> DataFrame:
    """Open issues by severity and kind, and how many were resolved in 30 days; one row."""
    live = pages.filter(~F.col("deleted")).select("page_id").withColumn("live", F.lit(True))
    rows = findings.join(live, "page_id", "left")
    shown = (F.col("status") == "open") & ((F.col("page_id") == 0) | F.coalesce("live", F.lit(False)))
    n = lambda col, v: F.count_if(shown & (F.col(col) == v)).alias(v)
    return rows.agg(
        *[n("severity", s) for s in SEVERITY], n("kind", "observed"), n("kind", "inferred"),
        F.count_if(shown).alias("total"),
        F.count_if((F.col("status") == "resolved") & (F.col("resolved_at") > config.from_ts(30))).alias("resolved_30d"),
    )


def technical_issues(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Open page issues by code and severity."""
    live = pages.filter(~F.col("deleted")).select("page_id")
    return findings.filter("status = 'open'").join(live, "page_id", "left_semi").groupBy("code", "severity").agg(
        F.count("*").alias("n")).withColumn("group", meta(F.col("code"), 3)).orderBy(F.desc("n"), "code", "severity")


def recommendations(findings: DataFrame, pages: DataFrame, severity: str = "", kind: str = "", code: str = "",
                    group: str = "", page: int | None = 1, limit: int = 50) -> DataFrame:
    """Open issues, worst first; site-wide ones rank as very important."""
    rows = findings.filter("status = 'open'")
    for name, value in (("severity", severity), ("kind", kind), ("code", code)):
        if value:
            rows = rows.filter(F.col(name) == value)
    if group:
        rows = rows.filter(F.col("code").isin(*[c for c, m in CATALOG.items() if m[3] == group]))
    p = pages.select("page_id", "path", "title", "importance", "pinned", "deleted")
    joined = rows.join(p, "page_id", "left").filter("page_id = 0 or (not deleted and pinned >= 0)")
    rank = severity_rank(F.col("severity")) * 1000 + F.when(F.col("page_id") == 0, 150).otherwise(F.coalesce("importance", F.lit(0)))
    out = joined.select("page_id", "code", "bot", "severity", "kind", meta(F.col("code"), 3).alias("group"), "path", "title",
                        "importance", rank.alias("priority")).orderBy(F.desc("priority"), "page_id", "code", "bot")
    return out.offset((page - 1) * limit).limit(limit) if page is not None else out


def recently_resolved(findings: DataFrame, pages: DataFrame, k: int = 15) -> DataFrame:
    newest = findings.filter("status = 'resolved'").orderBy(F.desc("resolved_at"), "page_id", "code", "bot").limit(k)
    return newest.join(pages.select("page_id", "path"), "page_id", "left")


# scores ------------------------------------------------------------------

PARTS = ("access", "discovery", "structure", "depth", "trust", "linking")


def page_scores(profile: DataFrame) -> DataFrame:
    """Score 0–100 of every analysed page with its six parts."""
    c = F.col
    clamp = lambda x: F.greatest(F.lit(0), x)
    status = c("status")
    after_noindex = F.lit(30) - F.when(c("noindex"), 25).otherwise(0)
    reachable = F.when(status >= 400, 0).when(status >= 300, after_noindex - 10).otherwise(after_noindex)
    access = clamp(reachable - F.when(c("canonical_elsewhere"), 10).otherwise(0) - F.least(F.lit(20), F.size("blocked") * 7))
    discovery = F.when(c("ai_search"), 15).when(c("ai_any"), 10).when(c("learning"), 8).otherwise(0)
    words = c("words")
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    structure = (
        points((c("h2") + c("h3") >= 2) | (words < 300), 5) + points(F.size("question_headings") > 0, 4)
        + points(c("first_para_words").between(10, 80), 4) + points(c("lists") + c("tables") > 0, 3)
        + points(c("faq") | F.array_contains("schema", "FAQPage"), 4))
    short = (c("subtype") == "product") | (c("object_type") == "term")
    steps = lambda *s: F.when(words >= s[0], 15).when(words >= s[1], 12).when(words >= s[2], 9).when(words >= s[3], 5).otherwise(2)
    depth = F.when(short, steps(400, 250, 150, 80)).otherwise(steps(1200, 800, 500, 300))
    age = c("modified_days")
    trust = (
        points(F.size("schema") > 0, 5) + points(~c("author_known") | c("author_bio"), 3)
        + F.when(age.isNull() | (age <= 365), 4).when(age <= 730, 2).otherwise(0))
    linking = F.when(c("is_home") | (c("inlinks") >= 3), 8).when(c("inlinks") >= 1, 4).otherwise(0)
    made = dict(zip(PARTS, (access, discovery, structure, depth, trust, linking)))
    rows = profile.filter("has_facts").select(
        "page_id", "importance", "pinned", *[made[p].cast("int").alias(p) for p in PARTS])
    total = sum((F.col(p) for p in PARTS[1:]), F.col(PARTS[0]))
    return rows.withColumn("score", total)


def site_score(scores: DataFrame, matrix: DataFrame, registry: Registry, config: Config) -> DataFrame:
    """Importance-weighted mean of the page scores minus site-wide blocks; one row."""
    w = F.col("importance") + 1
    mean = lambda c: F.sum(w * F.col(c)) / F.sum(w)
    cat = registry.category(F.col("bot"))
    closed = matrix.filter(~F.col("site_allowed") & cat.isin("ai_search", "search") & F.col("bot").isin(*config.priority_bots))
    penalty = closed.agg(F.count("*") * 10).scalar() + (0 if config.site_public else 30)
    agg = scores.filter("pinned >= 0").agg(
        mean("score").alias("raw"), *[F.round(mean(p), 1).alias(p) for p in PARTS], F.count("*").alias("pages"))
    return agg.withColumn("penalty", F.least(F.lit(40), penalty)).select(
        F.greatest(F.lit(0), F.round(F.col("raw") - F.col("penalty"))).cast("int").alias("score"), *PARTS, "pages", "penalty")
