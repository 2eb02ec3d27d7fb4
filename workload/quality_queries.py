"""robots.txt, importance, findings, scores, readiness."""

from pyspark.sql import functions as F

from trailmark.operators import content, quality as q, robots, rollups
from trailmark.plans import readiness, traffic
from workload import bridge as b
from workload.content_queries import EDGES, FACTS, INTENT, INTENT_CASE, facts, links

QUERIES, ORACLE = {}, {}
C, R = b.CONFIG, b.REGISTRY


def query(name, sql=None, extra="", recursive=False):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = b.sql(sql, extra, recursive)
        return fn
    return add


# robots.txt: one text per language section of the derived site, so rules meet the driver's paths
ROBOTS = """# derived site
User-agent: *
Disallow: /de/1
Allow: /de/12
Disallow: /*.html$

User-agent: GPTBot
Disallow: /

User-agent: Googlebot
User-agent: PerplexityBot # two agents
Disallow: /fr/
Allow: /fr/
Disallow: /es*7
Disallow:

User-agent: meta
Disallow: /en/9
Sitemap: https://example.com/sitemap.xml
"""


def sites(spark):
    return spark.createDataFrame([("main", 200, ROBOTS)], "site string, status int, body string")


def policy(spark, only=None):
    return robots.index(robots.effective_body(sites(spark), robots.generated_body(C)), robots.robots_bots(R, only))


def site_pages(spark, d, inventory=None):
    return (b.inventory(spark, d) if inventory is None else inventory).withColumn("site", F.lit("main"))


_VERDICT = """CASE agent
  WHEN 'gptbot' THEN 'Disallow: /'
  WHEN 'googlebot' THEN CASE WHEN starts_with(path, '/fr/') THEN 'Allow: /fr/' WHEN regexp_matches(path, '^/es.*7') THEN 'Disallow: /es*7' ELSE '' END
  WHEN 'meta' THEN CASE WHEN starts_with(path, '/en/9') THEN 'Disallow: /en/9' ELSE '' END
  ELSE CASE WHEN regexp_matches(path, '\\.html$') THEN 'Disallow: /*.html$' WHEN starts_with(path, '/de/12') THEN 'Allow: /de/12'
            WHEN starts_with(path, '/de/1') THEN 'Disallow: /de/1' ELSE '' END END"""
ACCESS = f"""
tokens AS (SELECT bot, token, CASE WHEN bot = 'gptbot' THEN 'gptbot' WHEN bot IN ('googlebot', 'perplexitybot') THEN 'googlebot'
    WHEN bot = 'meta-externalagent' THEN 'meta' ELSE '*' END AS agent FROM bots WHERE token IS NOT NULL AND (ai OR category = 'search')),
access AS (SELECT page_id, path, importance, bot, agent, {_VERDICT} AS rule, NOT starts_with({_VERDICT}, 'Disallow') AS allowed
  FROM live, tokens),
matrix AS (SELECT 'main' AS site, t.bot, token, t.agent <> 'gptbot' AS site_allowed, CASE WHEN t.agent = 'gptbot' THEN 'Disallow: /' ELSE '' END AS rule,
    CASE WHEN t.bot = 'perplexitybot' THEN 'perplexitybot' ELSE agent END AS "group",
    (SELECT count(*) FROM access a WHERE a.bot = t.bot AND NOT allowed AND importance >= 40) AS blocked_count FROM tokens t)"""


@query("robots_matrix", "SELECT * FROM matrix", ACCESS)
def robots_matrix(spark, d):
    return robots.access_matrix(policy(spark), site_pages(spark, d), C, max_pages=None)


@query("robots_check", "SELECT page_id, bot, allowed, rule FROM access", ACCESS)
def robots_check(spark, d):
    """Every page and every crawler, with the rule that decides if there is one."""
    rows = site_pages(spark, d).filter("not deleted").select("site", "page_id", "path")
    return robots.page_access(policy(spark), rows).select("page_id", "bot", "allowed", "rule")


# many sites: one for each language section and fifth of the pages, whose robots.txt names their own pages. One fifth
# answers 404, one 503; before the change, one closed everything to all and one did not close itself to GPTBot

def section(path, page_id):
    return F.concat(F.regexp_extract(path, "^/([a-z]+)", 1), F.lit("-"), (page_id % 5).cast("string"))


def many_sites(spark, d, old=False):
    """(site, status, body) of the sections."""
    pid, path = F.col("page_id"), F.col("path")
    line = lambda when, kind, text: F.when(when, F.struct(F.lit(kind).alias("kind"), pid.alias("page_id"), text.alias("text")))
    each = F.array_compact(F.array(
        line(pid % 3 == 0, 1, F.concat(F.lit("Disallow: "), path)), line(pid % 7 == 1, 2, F.concat(F.lit("Allow: "), path, F.lit("$"))),
        line(pid % 11 == 2, 3, F.concat(F.lit("Disallow: /*"), F.right(path, F.lit(2)), F.lit("$"))), line(pid % 4 == 1, 4, F.concat(F.lit("Disallow: "), path))))
    rows = b.inventory(spark, d).select(section(path, pid).alias("site"), F.explode_outer(each).alias("l"))
    per = rows.groupBy("site").agg(F.array_sort(F.collect_list("l")).alias("l"))
    text = lambda cond: F.array_join(F.transform(F.filter("l", cond), lambda x: x["text"]), "\n")
    n = F.split_part("site", F.lit("-"), F.lit(2))
    closed, shut = (F.when(n == "4", "\nDisallow: /").otherwise(""), F.lit("")) if old else (F.lit(""), F.when(n == "3", "\nDisallow: /").otherwise(""))
    body = F.concat(F.lit("User-agent: *\nDisallow: /nothing/here\n"), text(lambda x: x["kind"] < 4), closed, F.lit("\n\nUser-agent: GPTBot\nUser-agent: ClaudeBot\n"), text(lambda x: x["kind"] == 4), shut)
    status = F.when(n == "1", 404).when(n == "2", 503).otherwise(200)
    return per.select("site", status.alias("status"), body.alias("body"))


def section_index(spark, d, old=False):
    table = b.written(spark, many_sites(spark, d, old), "robots")
    return robots.index(robots.effective_body(table, robots.generated_body(C)), robots.robots_bots(R))


def section_pages(spark, d):
    return b.inventory(spark, d).withColumn("site", section(F.col("path"), F.col("page_id")))


SECTIONS = """
tokens AS (SELECT bot, token, CASE WHEN lower(token) IN ('gptbot', 'claudebot') THEN lower(token) ELSE '*' END AS named, category FROM bots WHERE token IS NOT NULL AND (ai OR category = 'search')),
section AS (SELECT *, regexp_extract(path, '^/([a-z]+)', 1) || '-' || (page_id % 5) AS site FROM inventory),
lines AS (SELECT site, '*' AS who, 1 AS kind, page_id, path AS pattern, FALSE AS allow FROM section WHERE page_id % 3 = 0
  UNION ALL SELECT site, '*', 2, page_id, path || '$', TRUE FROM section WHERE page_id % 7 = 1
  UNION ALL SELECT site, '*', 3, page_id, '/*' || right(path, 2) || '$', FALSE FROM section WHERE page_id % 11 = 2
  UNION ALL SELECT site, 'named', 4, page_id, path, FALSE FROM section WHERE page_id % 4 = 1
  UNION ALL SELECT DISTINCT site, 'named', 5, 0, '/', FALSE FROM section WHERE site LIKE '%-3'),
rules AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY kind, page_id) * CASE WHEN allow THEN 1 ELSE -1 END AS ord FROM lines WHERE site NOT LIKE '%-1' AND site NOT LIKE '%-2'),
probed AS (SELECT DISTINCT site, NULL AS page_id, '/' AS path FROM section UNION ALL SELECT site, page_id, path FROM section WHERE NOT deleted AND importance >= 40),
hits AS (SELECT p.site, p.page_id, who, allow, CASE WHEN allow THEN 'Allow: ' ELSE 'Disallow: ' END || pattern AS rule,
    row_number() OVER (PARTITION BY p.site, p.page_id, who ORDER BY length(pattern) DESC, allow DESC, ord DESC) AS r
  FROM probed p JOIN rules r ON r.site = p.site AND CASE kind WHEN 2 THEN p.path || '$' = pattern WHEN 3 THEN regexp_matches(p.path, '^/.*' || regexp_escape(substr(pattern, 3, length(pattern) - 3)) || '$') ELSE starts_with(p.path, pattern) END),
counted AS (SELECT site, who, count(*) FILTER (page_id IS NOT NULL AND NOT allow) AS blocked, bool_and(allow) FILTER (page_id IS NULL) AS root, max(rule) FILTER (page_id IS NULL) AS rule FROM hits WHERE r = 1 GROUP BY ALL),
section_matrix AS (SELECT s.site, t.bot, token, coalesce(root, TRUE) AS site_allowed, coalesce(rule, '') AS rule, CASE WHEN s.site LIKE '%-1' THEN '' WHEN s.site LIKE '%-2' THEN '*' ELSE named END AS "group", coalesce(blocked, 0) AS blocked_count, category
  FROM (SELECT DISTINCT site FROM section) s CROSS JOIN tokens t LEFT JOIN counted c ON c.site = s.site AND c.who = CASE named WHEN '*' THEN '*' ELSE 'named' END)"""


@query("robots_sections", "SELECT * EXCLUDE (category) FROM section_matrix", SECTIONS)
def robots_sections(spark, d):
    """The access matrix of many sites, whose files name thousands of pages and do not all exist."""
    return robots.access_matrix(section_index(spark, d), section_pages(spark, d), C)


def blocked(spark, d, inventory=None):
    return robots.blocked_pages(policy(spark, C.priority_bots), site_pages(spark, d, inventory).filter("not deleted"))


PRIORITY = "(" + ", ".join(f"'{p}'" for p in C.priority_bots) + ")"


@query("pages_blocked_for_priority_crawlers", f"""SELECT page_id, string_agg(bot, ',' ORDER BY bot) AS bots FROM access
WHERE NOT allowed AND bot IN {PRIORITY} GROUP BY page_id""", ACCESS)
def pages_blocked_for_priority_crawlers(spark, d):
    return blocked(spark, d).filter(F.size("blocked") > 0).select(
        "page_id", F.array_join(F.array_sort("blocked.bot"), ",").alias("bots"))


@query("blocked_crawlers", f"""
SELECT m.bot, b.name, b.provider, b.category, site_allowed, blocked_count AS blocked_pages, m.bot IN {PRIORITY} AS priority,
  coalesce(attempts, 0) AS attempts, coalesce(rn.name, '') AS assistant, coalesce(visits, 0) AS visits
FROM matrix m JOIN bots b USING (bot) LEFT JOIN (SELECT * FROM (VALUES ('OpenAI', 'chatgpt'), ('Perplexity', 'perplexity'), ('Google', 'gemini'),
  ('Microsoft', 'copilot'), ('Anthropic', 'claude'), ('Meta', 'meta-ai'), ('Mistral AI', 'mistral')) v(provider, source)) s ON s.provider = b.provider
LEFT JOIN (SELECT source, CAST(sum(hits) AS BIGINT) AS visits FROM referrals WHERE day >= {b.since(30)} GROUP BY 1) r ON r.source = s.source
LEFT JOIN refnames rn ON rn.source = s.source
LEFT JOIN (SELECT bot, CAST(sum(hits) AS BIGINT) AS attempts FROM daily_bots WHERE day >= {b.since(30)} GROUP BY 1) a ON a.bot = m.bot
WHERE b.ai AND (NOT site_allowed OR blocked_count > 0) AND NOT (b.category IN ('ai_training', 'ai_other') AND visits IS NULL)
ORDER BY visits DESC, priority DESC, blocked_pages DESC, bot LIMIT 8""", ACCESS)
def blocked_crawlers(spark, d):
    return traffic.blocked_crawlers(robots_matrix(spark, d), b.referrals(spark, d), b.daily_bots(spark, d), R, C)


@query("access_changes", """
SELECT site, bot, 'blocked' AS change, rule, category FROM section_matrix WHERE site LIKE '%-3' AND "group" <> '*'
UNION ALL SELECT site, bot, 'allowed', rule, category FROM section_matrix WHERE site LIKE '%-4' AND "group" = '*'""", SECTIONS)
def access_changes(spark, d):
    """Two fetches of the sections' files: one section has closed itself to two crawlers, one has opened to the others."""
    old = robots.access_matrix(section_index(spark, d, old=True), section_pages(spark, d), C)
    return robots.access_changes(old, robots_sections(spark, d), R)


# importance, state -----------------------------------------------------------

def important_pages(spark, d, inventory=None):
    pid = F.col("page_id")
    rows = (b.inventory(spark, d) if inventory is None else inventory).withColumns({
        "in_menu": pid % 8 == 0, "cornerstone": pid % 19 == 0, "sales": F.when(pid % 10 == 6, pid * 3), "is_hub": pid % 43 == 0})
    sent = b.referrals(spark, d).filter(F.col("day") >= F.lit(C.back(30))).groupBy("url_hash").agg(F.sum("hits").alias("referrals"))
    return q.importance(rows.join(sent, "url_hash", "left"), C)


_POINTS = [
    ("object_type = 'home'", "60", "home"), ("object_type = 'post' AND page_id % 43 = 0", "30", "hub"), ("page_id % 8 = 0", "25", "menu"),
    ("object_type = 'post' AND page_id % 19 = 0", "30", "cornerstone"), ("object_type = 'post' AND subtype = 'product'", "10", "product"),
    ("object_type = 'post' AND subtype = 'product' AND page_id % 10 = 6 AND page_id > 0", "least(15, round(2 * log2(1 + page_id * 3)))", "sales"),
    ("object_type = 'post' AND subtype = 'page'", "10", "page"), ("inlinks > 0", "least(25, 3 * inlinks)", "inlinks"),
    ("coalesce(refs, 0) > 0", "least(20, 5 + refs)", "ai_referrals"), ("word_count >= 1000", "5", "in_depth"),
    (f"modified > {b.AS_OF - 90 * 86400}", "5", "fresh"),
]
IMPORTANT = f"""
weighed AS (SELECT i.* EXCLUDE (importance), CAST(CASE WHEN pinned < 0 THEN 0 WHEN pinned > 0 THEN 100 ELSE least(99, {' + '.join(f'CASE WHEN {cond} THEN {pts} ELSE 0 END' for cond, pts, _ in _POINTS)}) END AS BIGINT) AS importance,
    CASE WHEN pinned < 0 THEN 'excluded' WHEN pinned > 0 THEN 'pinned' ELSE concat_ws(',', {', '.join(f"CASE WHEN {cond} THEN '{why}' END" for cond, _, why in _POINTS)}) END AS reasons
  FROM inventory i LEFT JOIN (SELECT url_hash, CAST(sum(hits) AS BIGINT) AS refs FROM referrals WHERE day >= {b.day(30)} GROUP BY 1) r USING (url_hash))"""


@query("importance", "SELECT page_id, importance, reasons FROM weighed", IMPORTANT)
def importance(spark, d):
    return important_pages(spark, d).select("page_id", "importance", F.array_join("imp_reasons", ",").alias("reasons"))


STATE = f"""
state AS (SELECT url_hash, TRUE AS ai_any, bool_or(category IN ('ai_search', 'ai_user', 'ai_agent')) AS ai_search, bool_or(category = 'ai_training') AS training,
    max(last_seen) AS last_ai FROM page_bots JOIN bots USING (bot) WHERE ai GROUP BY 1),
per_bot AS (SELECT url_hash, bot, sum(hits) AS hits, sum(errors) AS errors, sum(ms_total) AS ms, max(last_status) AS status
  FROM daily WHERE day >= {b.day(14)} AND bot IN (SELECT bot FROM bots WHERE ai) GROUP BY 1, 2),
recent AS (SELECT url_hash, sum(hits) AS hits, sum(ms) AS ms FROM per_bot GROUP BY 1)"""


@query("crawl_state", "SELECT * FROM state", STATE)
def crawl_state(spark, d):
    return q.crawl_state(b.page_bots(spark, d), R)


@query("recent_crawl_errors", """SELECT url_hash, bot, CAST(errors AS BIGINT) AS errors, status FROM per_bot WHERE errors >= 2 OR (errors >= 1 AND status >= 500)""", STATE)
def recent_crawl_errors(spark, d):
    return q.recent_crawls(b.daily(spark, d), R, C).select("url_hash", F.explode("failing").alias("f")).select("url_hash", "f.*").select(
        "url_hash", "bot", "errors", "status")


def profile(spark, d, used=None):
    """From stored facts, inventory and folded requests: the events and the HTML are read once.

    `used` names the facts that are asked for, so that no others are worked out; all by default.
    """
    # nothing here asks for the last status ever or the title
    cube, inventory = b.written(spark, b.cube(spark, d).drop("seen", "status_by_seen"), "cube"), b.written(spark, b.inventory(spark, d).drop("title"), "inventory")
    known = facts(spark, d)
    stored = b.written(spark, known if used is None else known.select("page_id", *used), "facts")
    return q.page_profile(stored, important_pages(spark, d, inventory), q.crawl_state(rollups.genuine(cube), R),
                          q.recent_crawls(rollups.daily(cube), R, C), blocked(spark, d, inventory), C, q.is_learning(rollups.bots_seen(cube), C))


PROFILE = FACTS + "," + INTENT + "," + ACCESS + "," + IMPORTANT + "," + STATE + r""",
intent_of AS (SELECT page_id, """ + INTENT_CASE + r""" AS intent FROM intents),
profile AS (SELECT w.page_id, w.url_hash, w.subtype, w.pinned, w.inlinks, w.modified, w.importance, w.importance >= 40 AS important,
    w.object_type = 'home' OR contains(w.reasons, 'home') AS is_home, f.words, f.first_para_words, f.lists, i.intent, 'post' AS object_type,
    coalesce(ai_any, FALSE) AS ai_any, coalesce(ai_search, FALSE) AS ai_search, coalesce(training, FALSE) AS training, last_ai, r.hits AS rh, r.ms AS rms,
    (SELECT count(*) FROM access a WHERE a.page_id = w.page_id AND NOT allowed AND bot IN """ + PRIORITY + r""") AS nblocked
  FROM weighed w JOIN facts f USING (page_id) JOIN intent_of i USING (page_id) LEFT JOIN state s ON s.url_hash = w.url_hash LEFT JOIN recent r ON r.url_hash = w.url_hash
  WHERE NOT w.deleted)"""


@query("coverage_findings", f"""
SELECT page_id, 'robots_blocked' AS code, CASE WHEN important THEN 'critical' ELSE 'warning' END AS severity, bot, NULL AS n FROM profile JOIN access a USING (page_id) WHERE NOT allowed AND bot IN {PRIORITY}
UNION ALL SELECT page_id, 'bot_errors', CASE WHEN important THEN 'critical' ELSE 'warning' END, bot, CAST(errors AS BIGINT) FROM profile JOIN per_bot USING (url_hash) WHERE errors >= 2 OR (errors >= 1 AND status >= 500)
UNION ALL SELECT page_id, 'slow_for_bots', 'warning', '', CAST(round(rms / rh) AS BIGINT) FROM profile WHERE rh >= 3 AND rms / rh >= 3000
UNION ALL SELECT page_id, 'never_crawled', 'warning', '', NULL FROM profile WHERE important AND NOT ai_any AND nblocked = 0
UNION ALL SELECT page_id, 'stale_crawl', 'info', '', last_ai FROM profile WHERE important AND modified > last_ai AND modified < {b.AS_OF - 7 * 86400}
UNION ALL SELECT page_id, 'training_only', 'info', '', NULL FROM profile WHERE important AND training AND NOT ai_search""", PROFILE)
def coverage_findings(spark, d):
    return q.coverage_findings(profile(spark, d, ["noindex"]), C).select("page_id", "code", "severity", "bot", "n")


CONTENT_FINDINGS = f"""
SELECT page_id, 'orphan' AS code, CASE WHEN important THEN 'warning' ELSE 'info' END AS severity, NULL AS n FROM profile WHERE NOT is_home AND inlinks = 0
UNION ALL SELECT page_id, 'few_inlinks', 'info', inlinks FROM profile WHERE important AND NOT is_home AND inlinks BETWEEN 1 AND 2
UNION ALL SELECT page_id, 'thin_content', CASE WHEN important THEN 'warning' ELSE 'info' END, words FROM profile WHERE NOT is_home AND words < CASE subtype WHEN 'product' THEN 120 ELSE 300 END
UNION ALL SELECT page_id, 'no_subheadings', 'warning', NULL FROM profile WHERE NOT is_home AND words >= 400
UNION ALL SELECT page_id, 'no_question_headings', 'info', NULL FROM profile WHERE NOT is_home AND intent = 'informational' AND words >= 500
UNION ALL SELECT page_id, 'no_direct_answer', 'info', first_para_words FROM profile WHERE NOT is_home AND intent IN ('informational', 'commercial') AND words >= 300 AND (first_para_words > 80 OR first_para_words = 0)
UNION ALL SELECT page_id, 'no_faq', 'info', NULL FROM profile WHERE NOT is_home AND important AND intent IN ('informational', 'commercial', 'transactional') AND words >= 500
UNION ALL SELECT page_id, 'no_lists', 'info', NULL FROM profile WHERE NOT is_home AND words >= 800 AND lists = 0
UNION ALL SELECT page_id, 'no_structured_data', CASE WHEN important THEN 'warning' ELSE 'info' END, NULL FROM profile WHERE NOT is_home
UNION ALL SELECT page_id, 'outdated', 'info', page_id % 500 FROM profile WHERE NOT is_home AND subtype = 'post' AND intent = 'informational' AND page_id % 500 > 365
UNION ALL SELECT page_id, 'no_meta_description', 'info', NULL FROM profile WHERE NOT is_home"""


@query("content_findings", CONTENT_FINDINGS, PROFILE)
def content_findings(spark, d):
    return q.content_findings(profile(spark, d), C).select("page_id", "code", "severity", "n")


SCORES = """
scores AS (SELECT page_id, importance, pinned, access, discovery, structure, depth, trust, linking, access + discovery + structure + depth + trust + linking AS score FROM (
  SELECT page_id, importance, pinned, greatest(0, 30 - least(20, nblocked * 7)) AS access, CASE WHEN ai_search THEN 15 WHEN ai_any THEN 10 ELSE 0 END AS discovery,
    CASE WHEN words < 300 THEN 5 ELSE 0 END + CASE WHEN first_para_words BETWEEN 10 AND 80 THEN 4 ELSE 0 END + CASE WHEN lists > 0 THEN 3 ELSE 0 END AS structure,
    CASE WHEN subtype = 'product' THEN CASE WHEN words >= 400 THEN 15 WHEN words >= 250 THEN 12 WHEN words >= 150 THEN 9 WHEN words >= 80 THEN 5 ELSE 2 END
         ELSE CASE WHEN words >= 1200 THEN 15 WHEN words >= 800 THEN 12 WHEN words >= 500 THEN 9 WHEN words >= 300 THEN 5 ELSE 2 END END AS depth,
    3 + CASE WHEN page_id % 500 <= 365 THEN 4 WHEN page_id % 500 <= 730 THEN 2 ELSE 0 END AS trust,
    CASE WHEN is_home OR inlinks >= 3 THEN 8 WHEN inlinks >= 1 THEN 4 ELSE 0 END AS linking FROM profile))"""


@query("page_scores", "SELECT * FROM scores", PROFILE + "," + SCORES)
def page_scores(spark, d):
    return q.page_scores(profile(spark, d))


@query("site_score", f"""
SELECT CAST(greatest(0, round(sum((1 + importance) * score) / sum(1 + importance) - 0)) AS BIGINT) AS score,
  {', '.join(f'round(sum((1 + importance) * {p}) / sum(1 + importance), 1) AS {p}' for p in q.PARTS)}, count(*) AS pages, 0 AS penalty
FROM scores WHERE pinned >= 0""", PROFILE + "," + SCORES)
def site_score(spark, d):
    return q.site_score(q.page_scores(profile(spark, d)), robots_matrix(spark, d), R, C)


def probes(spark):
    return spark.createDataFrame([("claudebot", True), ("ccbot", False), ("bingbot", True)], "bot string, refused boolean")


def range_status(spark):
    return spark.createDataFrame([("a.json", False), ("b.json", True)], "file string, stale boolean")


def found_on_site(spark, d):
    return q.site_findings(spark, robots_matrix(spark, d), robots.sitemaps(sites(spark)), b.daily_bots(spark, d), range_status(spark),
                           probes(spark), R, C, proxy_seen_at=b.AS_OF - 86400)


@query("site_findings", f"""
SELECT 'robots_blocks_training' AS code, 'info' AS severity, 'gptbot' AS bot, NULL AS n
UNION ALL SELECT 'impersonation', 'info', bot, CAST(sum(spoofed) AS BIGINT) FROM daily_bots WHERE day >= {b.day(7)} GROUP BY bot HAVING sum(spoofed) >= 20
UNION ALL SELECT 'edge_blocks_bot', 'critical', p.bot, NULL FROM (VALUES ('claudebot'), ('bingbot')) p(bot)
  WHERE coalesce((SELECT sum(verified) - sum(errors) FROM daily_bots x WHERE x.bot = p.bot AND day >= {b.day(7)}), 0) <= 0
UNION ALL SELECT 'verification_stale', 'warning', '', NULL UNION ALL SELECT 'proxy_unconfigured', 'warning', '', NULL""")
def site_findings(spark, d):
    return found_on_site(spark, d).select("code", "severity", "bot", "n")


# lifecycle: the derived findings table is re-stated with some issues fixed and some new

def restated(spark, d):
    pid = F.col("page_id")
    kept = b.findings(spark, d).filter(pid % 5 != 0).select("page_id", "code", "bot", "severity", "kind", F.lit(None).cast("bigint").alias("n"))
    new = b.inventory(spark, d).filter(pid % 13 == 0).select(
        "page_id", F.lit("no_lists").alias("code"), F.lit("").alias("bot"), F.lit("info").alias("severity"), F.lit("observed").alias("kind"),
        F.lit(None).cast("bigint").alias("n"))
    return kept.unionByName(new)


def stored_findings(spark, d):
    return b.findings(spark, d).withColumn("n", F.lit(None).cast("bigint"))


@query("findings_lifecycle", f"""
SELECT page_id, code, bot, CASE WHEN status = 'ignored' THEN 'ignored' WHEN reported THEN 'open' WHEN status = 'open' THEN 'resolved' ELSE status END AS status,
  first_seen, CASE WHEN reported THEN {b.AS_OF} ELSE last_seen END AS last_seen,
  CASE WHEN status = 'ignored' THEN resolved_at WHEN reported THEN NULL WHEN status = 'open' THEN {b.AS_OF} ELSE resolved_at END AS resolved_at,
  CASE WHEN reported AND status = 'resolved' THEN 'opened' WHEN NOT reported AND status = 'open' THEN 'resolved' END AS event
FROM (SELECT *, page_id % 5 <> 0 AS reported FROM findings)
UNION ALL SELECT page_id, 'no_lists', '', 'open', {b.AS_OF}, {b.AS_OF}, NULL, 'opened' FROM inventory WHERE page_id % 13 = 0""")
def findings_lifecycle(spark, d):
    return q.sync_findings(stored_findings(spark, d), restated(spark, d), ("content", "coverage"), C).select(
        "page_id", "code", "bot", "status", "first_seen", "last_seen", "resolved_at", "event")


@query("finding_counts", f"""
SELECT {', '.join(f"count(*) FILTER (status = 'open' AND alive AND severity = '{s}') AS {s}" for s in q.SEVERITY)},
  count(*) FILTER (status = 'open' AND alive AND kind = 'observed') AS observed, count(*) FILTER (status = 'open' AND alive AND kind = 'inferred') AS inferred,
  count(*) FILTER (status = 'open' AND alive) AS total, count(*) FILTER (status = 'resolved' AND resolved_at > {C.from_ts(30)}) AS resolved_30d
FROM (SELECT f.*, page_id = 0 OR page_id IN (SELECT page_id FROM live) AS alive FROM findings f)""")
def finding_counts(spark, d):
    return q.finding_counts(b.findings(spark, d), b.inventory(spark, d), C)


GROUP_CASE = "CASE code " + " ".join(f"WHEN '{c}' THEN '{m[3]}'" for c, m in q.CATALOG.items()) + " END"


@query("technical_issues", f"""SELECT code, severity, count(*) AS n, {GROUP_CASE} AS "group" FROM findings
WHERE status = 'open' AND page_id IN (SELECT page_id FROM live) GROUP BY ALL""")
def technical_issues(spark, d):
    return q.technical_issues(b.findings(spark, d), b.inventory(spark, d))


REC = f"""
recs AS (SELECT page_id, code, bot, severity, kind, {GROUP_CASE} AS "group", path, title, importance,
  CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END * 1000 + CASE WHEN page_id = 0 THEN 150 ELSE coalesce(importance, 0) END AS priority
  FROM findings LEFT JOIN inventory USING (page_id) WHERE status = 'open' AND (page_id = 0 OR (NOT deleted AND pinned >= 0)))"""


@query("recommendations", "SELECT * FROM recs ORDER BY priority DESC, page_id, code, bot LIMIT 50 OFFSET 50", REC)
def recommendations(spark, d):
    return q.recommendations(b.findings(spark, d), b.inventory(spark, d), page=2)


@query("recommendations_in_group", """SELECT * FROM recs WHERE "group" = 'content' AND severity = 'warning'""", REC)
def recommendations_in_group(spark, d):
    return q.recommendations(b.findings(spark, d), b.inventory(spark, d), severity="warning", group="content", page=None)


@query("recently_resolved", "SELECT page_id, code, bot, resolved_at, path FROM findings JOIN inventory USING (page_id) WHERE status = 'resolved' ORDER BY resolved_at DESC, page_id, code, bot LIMIT 15")
def recently_resolved(spark, d):
    return q.recently_resolved(b.findings(spark, d), b.inventory(spark, d)).select("page_id", "code", "bot", "resolved_at", "path")


# readiness ---------------------------------------------------------------

def ready_checks(spark, d):
    pages = b.inventory(spark, d).withColumn("imp_reasons", F.when(F.col("page_id") == 0, F.array(F.lit("home"))).otherwise(F.array(F.lit("page"))))
    return readiness.checks(pages, b.findings(spark, d), robots_matrix(spark, d), robots.sitemaps(sites(spark)), probes(spark),
                            b.page_bots(spark, d), b.daily_bots(spark, d), R, C)


def _ready_sql():
    codes = {c: v[3] for c, v in readiness.CHECKS.items()}

    def page(check, cond="TRUE"):
        lst = ", ".join(f"'{x}'" for x in codes[check])
        return (f"SELECT '{check}' AS \"check\", count(*) FILTER (page_id IN (SELECT page_id FROM findings WHERE status = 'open' AND code IN ({lst}))) AS n, "
                f"count(*) AS total, NULL AS frac FROM scoped WHERE {cond}")
    content = "object_type = 'post' AND analyzed AND page_id <> 0"
    parts = [page("pages_accessible"), page("canonicals"), page("internal_links", "page_id <> 0"),
             page("authorship", content + " AND subtype = 'post'")]
    parts += [page(c, content) for c in readiness.CONTENT_CHECKS if c != "authorship"]
    share = lambda check, cond: (f"SELECT '{check}', count(*) FILTER (NOT site_allowed), count(*), NULL FROM matrix JOIN bots USING (bot) WHERE {cond}")
    parts += [
        "SELECT 'site_indexable', 0, 1, 1.0", share("ai_search_access", f"category = 'ai_search' OR (category = 'search' AND bot IN {PRIORITY})"),
        share("ai_user_access", "category IN ('ai_user', 'ai_agent')"), "SELECT 'edge_access', 0, 3, 1.0", "SELECT 'sitemap', 0, 1, 1.0",
        "SELECT 'llms_txt', 0, 1, 0.6",
        f"SELECT 'ai_crawl_coverage', count(*) - count(*) FILTER (last_ai >= {C.from_ts(30)}), count(*), count(*) FILTER (last_ai >= {C.from_ts(30)}) / count(*) FROM scoped LEFT JOIN state USING (url_hash)",
        f"""SELECT 'crawler_health', ill, total, CASE WHEN ill > 0 AND f > 0.5 THEN f - 0.2 ELSE f END FROM (SELECT
          (SELECT count(*) FROM scoped WHERE page_id IN (SELECT page_id FROM findings WHERE status = 'open' AND code IN ('bot_errors', 'slow_for_bots'))) AS ill,
          (SELECT count(*) FROM scoped) AS total,
          (SELECT CASE WHEN r <= 0.02 THEN 1.0 WHEN r <= 0.05 THEN 0.7 WHEN r <= 0.10 THEN 0.4 ELSE 0.0 END FROM (SELECT sum(errors) / sum(hits) AS r FROM daily_bots
            WHERE day >= {b.day(14)} AND bot IN (SELECT bot FROM bots WHERE ai))) AS f)""",
    ]
    weights = ", ".join(f"('{c}', '{v[0]}', {v[1]}, '{v[2]}', {i})" for i, (c, v) in enumerate(readiness.CHECKS.items()))
    return ACCESS + "," + STATE + f""",
scoped AS (SELECT * FROM live WHERE pinned >= 0 AND (pinned > 0 OR importance >= 40)),
raw_checks AS ({' UNION ALL '.join(parts)}),
ready AS (SELECT *, CASE WHEN frac >= 0.9 THEN 'pass' WHEN frac >= 0.6 THEN 'warn' ELSE 'fail' END AS status FROM (
  SELECT "check", grp AS "group", weight, effort, ord, n, total, CAST(coalesce(frac, 1 - n / total) AS DOUBLE) AS frac
  FROM raw_checks JOIN (VALUES {weights}) w(c, grp, weight, effort, ord) ON c = "check"))"""


READY = _ready_sql()


@query("readiness_checks", 'SELECT "check", "group", weight, effort, ord, n, total, round(frac, 6) AS frac, status FROM ready', READY)
def readiness_checks(spark, d):
    return ready_checks(spark, d).withColumn("frac", F.round("frac", 6))


@query("readiness_scores", """
SELECT coalesce("group", 'all') AS "group", CAST(sum(weight) AS BIGINT) AS max, CAST(sum(weight) AS BIGINT) AS weight, round(sum(weight * frac), 1) AS earned,
  CAST(round(100 * sum(weight * frac) / sum(weight)) AS BIGINT) AS score FROM ready GROUP BY ROLLUP ("group")""", READY)
def readiness_scores(spark, d):
    return readiness.scores(ready_checks(spark, d))


@query("readiness_queue", """
SELECT "check", "group", status, CASE WHEN status = 'fail' AND "group" = 'access' THEN 'critical' WHEN status = 'fail' THEN 'warning' WHEN gain >= 3 THEN 'warning' ELSE 'info' END AS severity,
  gain, effort, n, total FROM (SELECT *, round(100 * weight * (1 - frac) / (SELECT sum(weight) FROM ready), 1) AS gain FROM ready) WHERE status IN ('warn', 'fail')""", READY)
def readiness_queue(spark, d):
    return readiness.queue(ready_checks(spark, d)).drop("ord")


@query("readiness_state", f"""
SELECT "check", status, "check" = 'llms_txt' AS accepted, CASE WHEN status IN ('warn', 'fail') THEN CASE WHEN ord % 2 = 0 THEN {b.AS_OF - 864000} ELSE {b.AS_OF} END END AS since,
  CASE WHEN status = 'pass' AND ord % 2 = 0 THEN {b.AS_OF} END AS resolved_at FROM ready""", READY)
def readiness_state(spark, d):
    """Every second check already failed ten days ago; one is accepted."""
    rows = [(c, c == "llms_txt", b.AS_OF - 864000 if i % 2 == 0 else None) for i, c in enumerate(readiness.CHECKS)]
    state = spark.createDataFrame(rows, "check string, accepted boolean, since bigint")
    return readiness.with_state(ready_checks(spark, d), state, C).select("check", "status", "accepted", "since", "resolved_at")


@query("affected_pages", """SELECT page_id, path FROM live WHERE pinned >= 0 AND page_id IN (SELECT page_id FROM findings WHERE status = 'open' AND code IN ('robots_blocked', 'noindex', 'http_error'))
ORDER BY pinned DESC, importance DESC, page_id LIMIT 10""")
def affected_pages(spark, d):
    return readiness.affected_pages(b.inventory(spark, d), b.findings(spark, d), C, "pages_accessible").select("page_id", "path")


@query("page_crawlers", """
SELECT t.bot, b.name, b.category, b.robots_only, first_seen, last_seen, coalesce(hits, 0) AS hits, last_status AS status, coalesce(a.allowed, TRUE) AS allowed, coalesce(a.rule, '') AS rule
FROM (SELECT bot FROM bots WHERE ai OR category = 'search') t JOIN bots b USING (bot)
LEFT JOIN (SELECT * FROM page_bots WHERE url_hash = (SELECT url_hash FROM page_paths WHERE page_id = 1)) p ON p.bot = t.bot
LEFT JOIN (SELECT * FROM access WHERE page_id = 1) a ON a.bot = t.bot
WHERE last_seen IS NOT NULL OR t.bot IN """ + PRIORITY + " OR NOT coalesce(a.allowed, TRUE)", ACCESS)
def page_crawlers(spark, d):
    """Crawlers of one page: what each did, and what robots.txt says."""
    page = site_pages(spark, d).filter("page_id = 1")
    rules = robots.policies(robots.effective_body(sites(spark), robots.generated_body(C)), robots.robots_bots(R))
    verdicts = robots.check(rules, page.select("site", "path")).select("bot", "allowed", "rule")
    return traffic.page_crawlers(R.frame(spark), b.page_bots(spark, d), verdicts, C, page.select("url_hash").first()[0])
