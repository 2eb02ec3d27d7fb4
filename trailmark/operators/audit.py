"""Changes between two page snapshots: publication audit and redirects."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trailmark.config import Config
from trailmark.functions import paths
from trailmark.sources.registry import Registry


def audit_changes(old: DataFrame, new: DataFrame, blocked: DataFrame, history: DataFrame, registry: Registry,
                  config: Config) -> DataFrame:
    """One row per page × check (indexing, robots, canonical, url_change, content) with its status.

    old: page_id, path, words (the published state). new: page_id, path, noindex,
    canonical, home_host, words, subtype, importance, pinned, builder. blocked:
    page_id, blocked. history: url_hash, hits, referrals of the old paths.
    """
    hard_bots = [b for b in config.priority_bots if (registry.get(b) or {}).get("category") in ("ai_search", "search")]
    before = old.select("page_id", F.col("path").alias("old_path"), F.col("words").alias("old_words"))
    seen = history.select("url_hash", (F.col("hits") + F.col("referrals") > 0).alias("visited"))
    j = (
        new.join(before, "page_id", "left").join(blocked.select("page_id", "blocked"), "page_id", "left")
        .withColumn("url_hash", paths.url_hash(F.coalesce("old_path", F.lit(""))))
        .join(seen, "url_hash", "left")
    )
    imp = (F.col("pinned") > 0) | ((F.col("importance") >= config.importance_min) & (F.col("pinned") >= 0))
    closed = F.coalesce(F.size("blocked"), F.lit(0)) > 0
    hard = F.coalesce(F.exists("blocked", lambda b: b["bot"].isin(*hard_bots)), F.lit(False))
    host = paths.url_host(F.col("canonical"))
    elsewhere = (F.coalesce("canonical", F.lit("")) != "") & (
        ((host != "") & ~paths.same_site(host, F.col("home_host")))
        | (F.lower(paths.normalize_path(F.col("canonical"))) != F.lower("path")))
    visited = F.coalesce("visited", F.lit(False))
    same = F.col("old_path") == F.col("path")
    least = F.when(F.col("subtype") == "product", round(config.guard_thin_words * 0.4)).otherwise(config.guard_thin_words)
    lost = (F.col("old_words") >= 300) & (F.col("words") < F.col("old_words") / 2)
    status = {
        "indexing": F.when(~F.lit(config.site_public) | F.col("noindex"), "fail").otherwise("pass"),
        "robots": F.when(~closed, "pass").when(hard, "fail").otherwise("warn"),
        "canonical": F.when(elsewhere, "warn").otherwise("pass"),
        "url_change": F.when(F.col("old_path").isNull(), "na").when(same, "pass").when(F.lit(config.guard_redirects), "pass")
        .when(visited, "fail").otherwise("warn"),
        "content": F.when(F.col("builder"), "na").when(F.coalesce(lost, F.lit(False)), F.when(imp, "fail").otherwise("warn"))
        .when(F.col("words") < least, "warn").otherwise("pass"),
    }
    each = F.array(*[F.struct(F.lit(c).alias("check"), s.alias("status")) for c, s in status.items()])
    return j.select("page_id", imp.alias("important"), F.col("old_path").isNull().alias("first_published"),
                    F.explode(each).alias("c")).select("page_id", "important", "first_published", "c.*")


def redirect_candidates(old: DataFrame, new: DataFrame, config: Config) -> DataFrame:
    """Old paths of pages that moved, and of children that moved with their parent.

    old, new: page_id, path; new also parents: array of ancestor page ids. The
    root is never redirected and a path in use keeps its page.
    """
    moved = new.join(old.select("page_id", F.col("path").alias("source")), "page_id").filter(
        (F.col("source") != F.col("path")) & (F.col("source") != "/") & (F.col("path") != "/"))
    own = moved.select("page_id", "source", F.lit("slug").alias("reason"), F.lit(0).alias("prio"))
    parents = moved.select(F.col("page_id").alias("parent_id"), F.col("source").alias("old_parent"), F.col("path").alias("new_parent"))
    below = new.select("page_id", "path", F.explode("parents").alias("parent_id")).join(parents, "parent_id").filter(
        F.startswith("path", F.concat("new_parent", F.lit("/")))
    ).select("page_id", F.concat("old_parent", F.substr("path", F.length("new_parent") + 1)).alias("source"),
             F.lit("parent").alias("reason"), F.lit(1).alias("prio"))
    all_rows = own.unionByName(below).withColumn("source_hash", paths.url_hash(F.col("source")))
    one = all_rows.groupBy("source_hash").agg(
        F.min_by(F.struct("source", "page_id", "reason"), F.struct("prio", "page_id")).alias("r")).select("source_hash", "r.*")
    live = new.select(paths.url_hash(F.col("path")).alias("source_hash"))
    return one.join(live, "source_hash", "left_anti").withColumn("created_at", F.lit(config.as_of).cast("bigint"))


def resolve_redirects(requests: DataFrame, redirects: DataFrame) -> DataFrame:
    """Hits of 404 requests per redirect, by crawlers and in all.

    Requests are counted per path before the join, so a popular dead URL is one row.
    """
    counted = requests.filter("status = 404").groupBy("url_hash").agg(
        F.count("*").alias("hits"), F.count_if((F.col("bot") != "") & (F.col("cls") != "spoofed")).alias("bot_hits"),
        F.max("ts").alias("last_hit"))
    return redirects.join(counted, redirects["source_hash"] == counted["url_hash"], "left").select(
        "source_hash", "source", "page_id", "reason", F.coalesce("hits", F.lit(0)).alias("hits"),
        F.coalesce("bot_hits", F.lit(0)).alias("bot_hits"), "last_hit")
