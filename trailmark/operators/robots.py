"""robots.txt as crawlers see it (RFC 9309): groups, longest match, access matrix."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailmark.config import Config
from trailmark.sources.registry import Registry
from trailmark.storage import kept


def effective_body(sites: DataFrame, generated: str) -> DataFrame:
    """(site, status, body) -> the text in force: 4xx means no restriction, other failures the default."""
    ok = F.col("status") == 200
    gone = F.col("status").between(400, 499)
    return sites.select(
        "site",
        F.when(ok, F.col("body")).when(gone, "").otherwise(generated).alias("body"),
        F.when(ok | gone, "http").otherwise("generated").alias("source"),
    )


def generated_body(config: Config, base: str = "") -> str:
    rule = "Disallow: /" if not config.site_public else f"Disallow: {base}/wp-admin/\nAllow: {base}/wp-admin/admin-ajax.php"
    return f"User-agent: *\n{rule}\n"


def lines(sites: DataFrame) -> DataFrame:
    """(site, body) -> site, pos, key, value of every directive."""
    raw = sites.select("site", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("pos", "line"))
    text = F.trim(F.regexp_replace("line", "#.*$", ""))
    parts = F.split(F.col("text"), ":", 2)
    return raw.withColumn("text", text).filter(F.col("text").contains(":")).select(
        "site", "pos", F.lower(F.trim(F.get(parts, F.lit(0)))).alias("key"), F.trim(F.get(parts, F.lit(1))).alias("value"))


def sitemaps(sites: DataFrame) -> DataFrame:
    return lines(sites).filter("key = 'sitemap'").select("site", F.col("value").alias("sitemap"))


def groups(sites: DataFrame) -> DataFrame:
    """site, grp, pos, key, value: consecutive user-agent lines open a group that lasts until the next one."""
    # a window has the lines of one file
    order = Window.partitionBy("site").orderBy("pos")
    used = lines(sites).filter(F.col("key").isin("user-agent", "allow", "disallow"))
    agent = F.col("key") == "user-agent"
    opens = agent & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    return used.withColumn("opens", opens.cast("int")).withColumn(
        "grp", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).filter("grp > 0").drop("opens")


def _rule() -> Column:
    value = F.col("value")
    anchored = value.endswith("$")
    bare = F.when(anchored, F.substr(value, F.lit(1), F.length(value) - 1)).otherwise(value)
    quoted = F.regexp_replace(bare, r"([\\.+?()\[\]{}|^$])", r"\\$1")
    return F.struct(
        F.octet_length(value).alias("len"),
        (F.col("key") == "allow").alias("allow"),
        # equal rules: the later allow, the earlier disallow
        F.when(F.col("key") == "allow", F.col("pos")).otherwise(-F.col("pos")).alias("ord"),
        value.alias("pattern"),
        (~value.contains("*") & ~anchored).alias("literal"),
        F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(anchored, "$").otherwise("")).alias("regex"),
    )


class Index(NamedTuple):
    """Who obeys which group of a site, and the rules of those groups, each under its longest literal end.

    groups: site, bot, token, agent ('': no group). rules: site, agent, rule, kind ('P': `key` is the hash of the
    `n` bytes a matching path begins with, 'S': of those it ends with).
    """

    groups: DataFrame
    rules: DataFrame


def _chosen(sites: DataFrame, agents: DataFrame, bots: list[tuple[str, str]]) -> DataFrame:
    """site, bot, token, agent: the longest of a token's dash-prefixes that the file names, else `*`, else ''.

    An equality on those prefixes, not a comparison of every token with every agent.
    """
    each = F.array(*[F.struct(F.lit(b).alias("bot"), F.lit(t).alias("token")) for b, t in bots])
    everyone = sites.select("site", F.explode(each).alias("b")).select("site", "b.*")
    parts = F.split(F.lower("token"), "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))
    wanted = everyone.select("site", "bot", F.explode(F.concat(prefixes, F.array(F.lit("*")))).alias("agent"))
    rank = F.when(F.col("agent") == "*", 0).otherwise(F.length("agent"))
    chosen = wanted.join(agents.select("site", "agent").distinct(), ["site", "agent"]).groupBy("site", "bot").agg(
        F.max_by("agent", rank).alias("agent"))
    return everyone.join(chosen, ["site", "bot"], "left").select("site", "bot", "token", F.coalesce("agent", F.lit("")).alias("agent"))


def _named_rules(sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(site, grp, agent) and (site, agent, rule) of the files."""
    g = groups(sites)
    agents = g.filter("key = 'user-agent'").select("site", "grp", F.lower("value").alias("agent")).distinct()
    rules = g.filter("key <> 'user-agent' and value <> ''").select("site", "grp", _rule().alias("rule"))
    return agents, agents.join(rules, ["site", "grp"]).select("site", "agent", "rule").distinct()


def index(sites: DataFrame, bots: list[tuple[str, str]]) -> Index:
    """(site, body) and the registry's (bot, token) list -> who obeys what, and where a path finds its rules."""
    agents, named = _named_rules(sites)
    groups_ = kept(_chosen(sites, agents, bots))
    pattern = F.col("rule.pattern")
    bare = F.when(pattern.endswith("$"), F.substr(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    head = F.substring_index(bare, "*", 1)
    tail = F.when(pattern.endswith("$"), F.substring_index(bare, "*", -1)).otherwise("")
    by_tail = F.length(tail) > F.length(head)
    end = F.when(by_tail, tail).otherwise(head)
    obeyed = named.join(groups_.select("site", "agent").distinct(), ["site", "agent"], "left_semi")
    return Index(groups_, kept(obeyed.select("site", "agent", "rule", F.when(by_tail, "S").otherwise("P").alias("kind"), F.length(end).alias("n"), F.xxhash64(end).alias("key"))))


def page_verdicts(policy: Index, pages: DataFrame) -> DataFrame:
    """site, page_id, agent, allowed, rule: the rule that decides, where one speaks (all else is allowed).

    pages: site, page_id, path. A path is cut only to the lengths that the literal ends of its site's rules have;
    the pieces meet the rules by equality on their hash, and just the rules found are tried on the path.
    """
    lengths = policy.rules.select("site", "kind", "n").distinct().groupBy("site").agg(F.collect_list(F.struct("kind", "n")).alias("ends"))
    path = F.col("_path")
    piece = lambda e: F.when(e["kind"] == "S", F.substr(path, F.length(path) - e["n"] + 1, e["n"])).otherwise(F.substr(path, F.lit(1), e["n"]))
    cut = F.transform(F.filter("ends", lambda e: e["n"] <= F.length(path)), lambda e: F.struct(e["kind"].alias("kind"), e["n"].alias("n"), F.xxhash64(piece(e)).alias("key")))
    probes = (
        pages.select("site", "page_id", decoded(F.col("path")).alias("_path")).join(lengths, "site")
        .select("site", "page_id", "_path", F.explode(cut).alias("e")).select("site", "page_id", "_path", "e.*")
    )
    hits = probes.join(policy.rules, ["site", "kind", "n", "key"]).filter(
        F.when(F.col("rule.literal"), path.startswith(F.col("rule.pattern"))).otherwise(F.rlike(path, F.col("rule.regex"))))
    best = hits.groupBy("site", "page_id", "agent").agg(F.max("rule").alias("best"))
    return best.select("site", "page_id", "agent", allowed(F.col("best")).alias("allowed"), rule_text(F.col("best")).alias("rule"))


def page_access(policy: Index, pages: DataFrame) -> DataFrame:
    """site, page_id, bot, token, agent, allowed, rule: one verdict for every page (site, page_id, path) and crawler.

    A page's verdicts, at most one for each group of its site, are gathered before the crawlers are added, so that
    pages and verdicts are shuffled but not their product.
    """
    found = page_verdicts(policy, pages).groupBy("site", "page_id").agg(
        F.map_from_entries(F.collect_list(F.struct("agent", F.struct("allowed", "rule")))).alias("found"))
    crawlers = policy.groups.groupBy("site").agg(F.collect_list(F.struct("bot", "token", "agent")).alias("crawlers"))  # registry-sized
    each = pages.select("site", "page_id").join(found, ["site", "page_id"], "left").join(crawlers, "site").select(
        "site", "page_id", "found", F.explode("crawlers").alias("c"))
    verdict = F.try_element_at("found", F.col("c.agent"))
    return each.select("site", "page_id", "c.*", F.coalesce(verdict["allowed"], F.lit(True)).alias("allowed"), F.coalesce(verdict["rule"], F.lit("")).alias("rule"))


def policies(sites: DataFrame, bots: list[tuple[str, str]]) -> DataFrame:
    """site, bot, token, agent, rules: each crawler's rules in one array, to check single paths."""
    agents, named = _named_rules(sites)
    found = named.groupBy("site", "agent").agg(F.collect_list("rule").alias("rules"))
    return _chosen(sites, agents, bots).join(found, ["site", "agent"], "left").select(
        "site", "bot", "token", "agent", F.coalesce("rules", F.array().cast(found.schema["rules"].dataType)).alias("rules"))


def decoded(path: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def best_rule(rules: Column, path: Column) -> Column:
    """The longest matching rule (allow wins a tie), or null."""
    hit = lambda r: F.when(r["literal"], path.startswith(r["pattern"])).otherwise(F.rlike(path, r["regex"]))
    return F.array_max(F.filter(rules, hit))


def allowed(best: Column) -> Column:
    return F.coalesce(best["allow"], F.lit(True))


def rule_text(best: Column) -> Column:
    return F.when(best.isNull(), "").otherwise(
        F.concat(F.when(best["allow"], "Allow: ").otherwise("Disallow: "), best["pattern"]))


def check(policy: DataFrame, paths: DataFrame) -> DataFrame:
    """One verdict per crawler of `policies` for each of a few (site, path); many pages go through `page_verdicts`."""
    joined = paths.join(policy, "site").withColumn("best", best_rule(F.col("rules"), decoded(F.col("path"))))
    return joined.select(*paths.columns, "bot", "token", allowed(F.col("best")).alias("allowed"),
                         rule_text(F.col("best")).alias("rule"), "agent")


def blocked_pages(policy: Index, pages: DataFrame) -> DataFrame:
    """page_id, blocked: array of (bot, rule) that may not read the page; pages open to all are absent."""
    shut = page_verdicts(policy, pages).filter("not allowed").join(policy.groups, ["site", "agent"])
    return shut.groupBy("page_id").agg(F.collect_list(F.struct("bot", "rule")).alias("blocked"))  # registry-sized


def robots_bots(registry: Registry, only=None) -> list[tuple[str, str]]:
    """Crawlers robots.txt can address, with the token they obey."""
    return [(b["id"], b["robots_tokens"][0]) for b in registry.bots
            if b["robots_tokens"] and (b["ai"] or b["category"] == "search") and (only is None or b["id"] in only)]


def access_matrix(policy: Index, pages: DataFrame, config: Config, max_pages: int | None = None) -> DataFrame:
    """Per site and crawler: is the site open, which group and rule applies, how many important pages are closed.

    All important pages are checked, or the `max_pages` most important ones. Pages are counted per group of a file,
    and crawlers take the number of theirs.
    """
    roots = policy.groups.select("site").distinct().select("site", F.lit(None).cast("long").alias("page_id"), F.lit("/").alias("path"))
    chosen = pages.filter(~F.col("deleted") & (F.col("importance") >= config.importance_min))
    if max_pages is not None:
        chosen = chosen.orderBy(F.desc("importance"), "page_id").limit(max_pages)
    found = page_verdicts(policy, chosen.select("site", F.col("page_id").cast("long"), "path").unionByName(roots))
    root = F.col("page_id").isNull()
    per_group = found.groupBy("site", "agent").agg(
        F.count_if(~root & ~F.col("allowed")).alias("blocked_count"), F.max(F.when(root, F.struct("allowed", "rule"))).alias("root"))
    return policy.groups.join(per_group, ["site", "agent"], "left").select(
        "site", "bot", "token", F.coalesce("root.allowed", F.lit(True)).alias("site_allowed"), F.coalesce("root.rule", F.lit("")).alias("rule"),
        F.col("agent").alias("group"), F.coalesce("blocked_count", F.lit(0)).alias("blocked_count"))


def access_changes(before: DataFrame, after: DataFrame, registry: Registry) -> DataFrame:
    """Crawlers newly blocked or newly allowed on a site between two matrices."""
    old = before.select("site", "bot", F.col("site_allowed").alias("was"))
    now = after.select("site", "bot", F.col("site_allowed").alias("now"), "rule")
    # a crawler absent from the old matrix counts as allowed; one that left the registry is no change
    both = old.join(now, ["site", "bot"], "full").filter("now is not null")
    was = F.coalesce("was", F.lit(True))
    change = F.when(was & ~F.col("now"), "blocked").when(~was & F.col("now"), "allowed")
    return both.withColumn("change", change).filter("change is not null").select(
        "site", "bot", "change", "rule", registry.category(F.col("bot")).alias("category"))
