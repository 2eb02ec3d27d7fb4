"""AI readiness: 18 weighted checks, group scores and the queue of what to fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailmark.config import Config
from trailmark.plans.traffic import coverage
from trailmark.sources.registry import Registry, lookup

# Check: group, weight, effort, finding codes (in display order).
CHECKS = {
    "site_indexable": ("access", 8, "quick", ("site_noindex",)),
    "ai_search_access": ("access", 8, "quick", ("robots_blocks_search",)),
    "ai_user_access": ("access", 4, "quick", ("robots_blocks_user",)),
    "edge_access": ("access", 5, "medium", ("edge_blocks_bot",)),
    "pages_accessible": ("access", 6, "medium", ("robots_blocked", "noindex", "http_error")),
    "canonicals": ("access", 3, "quick", ("canonical_elsewhere", "redirects")),
    "sitemap": ("discovery", 4, "quick", ("no_sitemap_in_robots",)),
    "llms_txt": ("discovery", 5, "quick", ()),
    "ai_crawl_coverage": ("discovery", 8, "larger", ("never_crawled",)),
    "internal_links": ("discovery", 5, "medium", ("orphan",)),
    "crawler_health": ("discovery", 4, "medium", ("bot_errors", "slow_for_bots")),
    "content_depth": ("content", 6, "larger", ("thin_content",)),
    "answer_structure": ("content", 6, "medium", ("no_subheadings", "no_direct_answer")),
    "question_coverage": ("content", 4, "medium", ("no_question_headings", "no_faq")),
    "structured_data": ("content", 6, "medium", ("no_structured_data", "schema_mismatch")),
    "summaries": ("content", 4, "quick", ("no_meta_description", "missing_alt")),
    "authorship": ("trust", 6, "quick", ("no_author",)),
    "freshness": ("trust", 8, "medium", ("outdated", "stale_crawl")),
}
GROUPS = ("access", "discovery", "content", "trust")
MIN_IMPORTANT = 5
CONTENT_CHECKS = ("content_depth", "answer_structure", "question_coverage", "structured_data", "summaries", "freshness", "authorship")
PAGE_CHECKS = ("pages_accessible", "canonicals", "internal_links", *CONTENT_CHECKS)


def page_scope(pages: DataFrame, findings: DataFrame, config: Config) -> DataFrame:
    """Pages in force with the set of codes open on each (at most one entry per catalogue code)."""
    codes = findings.filter("status = 'open' and page_id > 0").groupBy("page_id").agg(F.collect_set("code").alias("codes"))
    live = pages.filter(~F.col("deleted") & (F.col("pinned") >= 0))
    return live.join(codes, "page_id", "left").withColumns({
        "codes": F.coalesce("codes", F.array().cast("array<string>")),
        "imp": (F.col("pinned") > 0) | (F.col("importance") >= config.importance_min),
        "home": (F.col("object_type") == "home") | F.array_contains("imp_reasons", "home"),
    })


def _page_counts(scope: DataFrame) -> DataFrame:
    """One row: affected and total pages of every page check, over important pages and over all."""
    content = (F.col("object_type") == "post") & F.col("analyzed") & ~F.array_contains("imp_reasons", "home")
    extra = {"internal_links": ~F.col("home"), "authorship": F.col("subtype") == "post"}
    wanted = [*PAGE_CHECKS, "crawler_health"]
    cols = [F.count_if("imp").alias("important"), F.count("*").alias("all_pages")]
    for basis, cond in (("imp", F.col("imp")), ("all", F.lit(True))):
        for check in wanted:
            own = cond & extra.get(check, F.lit(True))
            if check in CONTENT_CHECKS:
                own = own & content
            hit = F.arrays_overlap("codes", F.array(*[F.lit(c) for c in CHECKS[check][3]]))
            cols += [F.count_if(own & hit).alias(f"{check}_{basis}_n"), F.count_if(own).alias(f"{check}_{basis}_t")]
    return scope.agg(*cols)


def checks(pages: DataFrame, findings: DataFrame, matrix: DataFrame, sitemaps: DataFrame, probes: DataFrame,
           page_bots: DataFrame, daily_bots: DataFrame, registry: Registry, config: Config,
           guide_live: bool | None = None, has_sitemap: bool = True) -> DataFrame:
    """One row per check: status (na or scored), fraction, affected, total."""
    cat = registry.category(F.col("bot"))
    priority = F.col("bot").isin(*config.priority_bots)
    search = (cat == "ai_search") | ((cat == "search") & priority)
    user = cat.isin("ai_user", "ai_agent")
    shares = matrix.agg(F.struct(
        F.count_if(search).alias("st"), F.count_if(search & ~F.col("site_allowed")).alias("sn"),
        F.count_if(user).alias("ut"), F.count_if(user & ~F.col("site_allowed")).alias("un")).alias("v"))
    edge = findings.filter("page_id = 0 and code = 'edge_blocks_bot' and status = 'open'").agg(F.count("*"))
    health = daily_bots.filter((F.col("day") >= F.lit(config.back(14))) & F.col("bot").isin(*registry.ids("ai"))).agg(
        F.struct(F.coalesce(F.sum("hits"), F.lit(0)).alias("h"), F.coalesce(F.sum("errors"), F.lit(0)).alias("e")).alias("v"))
    cov = coverage(pages, page_bots, registry, config, 30).select(F.struct("important", "important_crawled").alias("v"))
    base = _page_counts(page_scope(pages, findings, config)).withColumns({
        "share": shares.scalar(), "edge_n": edge.scalar(), "edge_t": probes.agg(F.count("*")).scalar(),
        "health": health.scalar(), "cov": cov.scalar(), "maps": sitemaps.agg(F.count("*")).scalar(),
    })
    by_important = F.col("important") >= MIN_IMPORTANT
    pick = lambda check, part: F.when(by_important, F.col(f"{check}_imp_{part}")).otherwise(F.col(f"{check}_all_{part}"))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def result(n: Column, total: Column, frac: Column, na: Column = F.lit(False)):
        return (
            F.when(na, zero).otherwise(n).cast("bigint"), F.when(na, zero).otherwise(total).cast("bigint"),
            F.when(na, 1.0).otherwise(frac).cast("double"), na)

    def share(n: Column, total: Column):
        return result(n, total, 1 - n / F.nullif(total, F.lit(0)), total == 0)

    def binary(ok: bool):
        return result(F.lit(0 if ok else 1), one, F.lit(1.0 if ok else 0.0))

    h, e = F.col("health.h"), F.col("health.e")
    rate = e / F.nullif(h, F.lit(0))
    health_frac = F.when(rate <= 0.02, 1.0).when(rate <= 0.05, 0.7).when(rate <= 0.10, 0.4).otherwise(0.0)
    ill = pick("crawler_health", "n")
    health_frac = F.when((ill > 0) & (health_frac > 0.5), health_frac - 0.2).otherwise(health_frac)
    imp, imp_crawled = F.col("cov.important"), F.col("cov.important_crawled")
    in_scope = F.when(by_important, F.col("important")).otherwise(F.col("all_pages"))
    listed = F.col("maps") > 0
    rows = {
        "site_indexable": binary(config.site_public),
        "ai_search_access": share(F.col("share.sn"), F.col("share.st")),
        "ai_user_access": share(F.col("share.un"), F.col("share.ut")),
        "edge_access": result(F.col("edge_n"), F.col("edge_t"),
                              1 - F.least(F.lit(1.0), F.col("edge_n") / F.nullif(F.col("edge_t"), F.lit(0))), F.col("edge_t") == 0),
        "sitemap": result(F.when(listed, 0).otherwise(1), one, F.when(listed, 1.0).otherwise(0.6 if has_sitemap else 0.0)),
        "llms_txt": binary(guide_live) if guide_live is not None else (
            result(zero, one, F.lit(0.6)) if config.guide_enabled else binary(False)),
        "ai_crawl_coverage": result(imp - imp_crawled, imp, F.least(F.lit(1.0), imp_crawled / F.nullif(imp, F.lit(0))),
                                    F.lit(config.learning) | (imp == 0)),
        "crawler_health": result(ill, in_scope, health_frac, h < 20),
        **{c: share(pick(c, "n"), pick(c, "t")) for c in PAGE_CHECKS},
    }
    each = F.array(*[F.struct(
        F.lit(i).alias("ord"), F.lit(check).alias("check"), F.lit(g).alias("group"), F.lit(w).alias("weight"), F.lit(effort).alias("effort"),
        *[v.alias(k) for k, v in zip(("n", "total", "frac", "na"), rows[check])],
    ) for i, (check, (g, w, effort, _)) in enumerate(CHECKS.items())])
    frac = F.col("frac")
    return base.select(F.explode(each).alias("c")).select("c.*").withColumn(
        "status", F.when(F.col("na"), "na").when(frac >= 0.9, "pass").when(frac >= 0.6, "warn").otherwise("fail")).drop("na")


def with_state(checks: DataFrame, state: DataFrame, config: Config) -> DataFrame:
    """Add accepted, since and resolved_at from the previous run.

    state: check, accepted, since. A failing check keeps its first failing time;
    one that passes again is resolved now.
    """
    failing = F.col("status").isin("warn", "fail")
    j = checks.join(state.select("check", "accepted", F.col("since").alias("was")), "check", "left")
    return j.select(
        *checks.columns, F.coalesce("accepted", F.lit(False)).alias("accepted"),
        F.when(failing, F.coalesce("was", F.lit(config.as_of).cast("bigint"))).alias("since"),
        F.when((F.col("status") == "pass") & F.col("was").isNotNull(), F.lit(config.as_of).cast("bigint")).alias("resolved_at"),
        F.when((F.col("status") == "pass"), F.col("was")).alias("failed_since"))


def _counted(checks: DataFrame) -> Column:
    accepted = F.col("accepted") if "accepted" in checks.columns else F.lit(False)
    return (F.col("status") != "na") & ~accepted


def scores(checks: DataFrame) -> DataFrame:
    """Score per group and in total (group 'all'), over the checks that apply."""
    w = F.when(_counted(checks), F.col("weight"))
    earned = F.sum(w * F.col("frac"))
    return checks.rollup("group").agg(
        F.sum("weight").alias("max"), F.coalesce(F.sum(w), F.lit(0)).alias("weight"),
        F.coalesce(F.round(earned, 1), F.lit(0.0)).alias("earned"),
        F.round(100 * earned / F.sum(w)).cast("int").alias("score"),
    ).withColumn("group", F.coalesce("group", F.lit("all")))


def queue(checks: DataFrame) -> DataFrame:
    """What to fix: critical first, then the biggest gain."""
    total = checks.filter(_counted(checks)).agg(F.sum("weight")).scalar()
    gain = F.round(100 * F.col("weight") * (1 - F.col("frac")) / total, 1)
    severity = F.when((F.col("status") == "fail") & (F.col("group") == "access"), "critical").when(
        F.col("status") == "fail", "warning").when(F.col("gain") >= 3, "warning").otherwise("info")
    rank = lookup({"critical": 0, "warning": 1, "info": 2}, F.col("severity"))
    return checks.filter(_counted(checks) & F.col("status").isin("warn", "fail")).withColumn("gain", gain).withColumn(
        "severity", severity).select("check", "group", "status", "severity", "gain", "effort", "n", "total", "ord").orderBy(
        rank, F.desc("gain"), "ord")


def affected_pages(pages: DataFrame, findings: DataFrame, config: Config, check: str, k: int = 10) -> DataFrame:
    """The most important pages a check fails on."""
    codes = CHECKS[check][3]
    bad = findings.filter((F.col("status") == "open") & F.col("code").isin(*codes)).select("page_id")
    return pages.filter(~F.col("deleted") & (F.col("pinned") >= 0)).join(bad, "page_id", "left_semi").orderBy(
        F.desc("pinned"), F.desc("importance"), "page_id").limit(k)
