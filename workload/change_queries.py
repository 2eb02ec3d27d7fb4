"""Snapshots, alerts, published lists, audits and exports."""

from pyspark.sql import functions as F

from trailmark.functions import html
from trailmark.operators import alerts as a, audit, content, quality as q, robots, rollups
from trailmark.plans import publish as p, readiness, traffic
from workload import bridge as b
from workload.content_queries import FACTS, facts
from workload.quality_queries import ACCESS, PRIORITY, blocked, policy, restated, robots_matrix, site_pages, stored_findings
from workload.rollup_queries import WEEK_AGO
from workload.traffic_queries import CRAWLERS_SQL, LIST

QUERIES, ORACLE = {}, {}
C, R = b.CONFIG, b.REGISTRY
D = 86400


def query(name, sql=None, extra="", recursive=False):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = b.sql(sql, extra, recursive)
        return fn
    return add


# trends ------------------------------------------------------------------

# as_of is moved back so that the four weeks before hold data; thresholds are the rule's own
MID = b.CONFIG.with_(as_of=b.AS_OF - 2 * D)


@query("activity_changes", f"""
SELECT bot, recent, weekly, CASE WHEN weekly >= 5 AND recent = 0 THEN 'bot_stopped' WHEN weekly >= 20 AND recent >= 2 * weekly AND recent >= 50 THEN 'activity_up'
  WHEN weekly >= 20 AND recent <= 0.4 * weekly THEN 'activity_down' END AS kind
FROM (SELECT bot, CAST(coalesce(sum(hits) FILTER (day >= DATE '2024-01-24'), 0) AS BIGINT) AS recent, coalesce(sum(hits) FILTER (day < DATE '2024-01-24'), 0) / 4 AS weekly
  FROM shaped WHERE day >= DATE '2023-12-27' GROUP BY bot) WHERE kind IS NOT NULL""", """
shaped AS (SELECT day, bot, CASE WHEN bot = 'ccbot' AND day >= DATE '2024-01-22' THEN 0 WHEN bot = 'claudebot' AND day >= DATE '2024-01-22' THEN hits // 5
  WHEN bot = 'gptbot' AND day >= DATE '2024-01-22' THEN hits * 4 ELSE hits END AS hits FROM daily_bots WHERE bot IN (SELECT bot FROM bots WHERE ai))""")
def activity_changes(spark, d):
    """One crawler stops, one fades and one grows in the last days."""
    late = F.col("day") >= F.lit("2024-01-22").cast("date")
    bot, hits = F.col("bot"), F.col("hits")
    shaped = b.daily_bots(spark, d).withColumn(
        "hits", F.when(late & (bot == "ccbot"), 0).when(late & (bot == "claudebot"), F.floor(hits / 5)).when(late & (bot == "gptbot"), hits * 4).otherwise(hits))
    return a.activity(shaped, R, C)


@query("hot_pages", f"""SELECT url_hash, page_id, hits FROM live JOIN (SELECT url_hash, CAST(sum(hits) AS BIGINT) AS hits FROM daily
WHERE day >= {b.day(29)} AND bot IN (SELECT bot FROM bots WHERE category = 'ai_user') GROUP BY 1 HAVING sum(hits) >= 10) USING (url_hash) ORDER BY hits DESC, url_hash LIMIT 10""")
def hot_pages(spark, d):
    return a.hot_pages(b.daily(spark, d), b.inventory(spark, d), R, C, days=29)


@query("dropped_pages", f"""SELECT page_id, path, importance, last_seen FROM live JOIN
  (SELECT url_hash, max(last_seen) AS last_seen FROM page_bots WHERE hits >= 3 GROUP BY 1) USING (url_hash)
WHERE (importance >= 40 OR pinned > 0) AND last_seen < {b.AS_OF} AND last_seen > {b.AS_OF - 90 * D} AND pinned >= 0""")
def dropped_pages(spark, d):
    """Seen from a month later."""
    return a.dropped_pages(b.inventory(spark, d), b.page_bots(spark, d), C.with_(as_of=b.AS_OF + 30 * D))


def snapshots(spark, d):
    """A snapshot per day: figures derived from the day's traffic."""
    per_day = b.daily_bots(spark, d).groupBy("day").agg(F.sum("hits").alias("h"), F.sum("errors").alias("e"))
    return per_day.select("day", (F.col("h") % 60 + 20).alias("score"), (F.col("h") % 50 + 30).alias("readiness"), (F.col("e") % 9).alias("critical"))


SNAPS = """snaps AS (SELECT day, CAST(sum(hits) % 60 + 20 AS BIGINT) AS score, CAST(sum(hits) % 50 + 30 AS BIGINT) AS readiness, CAST(sum(errors) % 9 AS BIGINT) AS critical
  FROM daily_bots GROUP BY day),
lagged AS (SELECT *, lag(score) OVER w - score AS sd, lag(readiness) OVER w - readiness AS rd, critical - lag(critical) OVER w AS cu FROM snaps WINDOW w AS (ORDER BY day)),
drops AS (SELECT 'score_drop' AS rule, strftime(day, '%Y') || '-' || strftime(day, '%V') AS key, 'warning' AS severity, epoch(day)::BIGINT AS at, 259200 AS cooldown, sd AS n FROM lagged WHERE sd >= 8
  UNION ALL SELECT 'readiness_drop', CAST(day AS VARCHAR), 'warning', epoch(day)::BIGINT, 86400, rd FROM lagged WHERE rd >= 10
  UNION ALL SELECT 'critical_up', CAST(day AS VARCHAR), 'critical', epoch(day)::BIGINT, 86400, cu FROM lagged WHERE cu >= 3)"""


@query("snapshot_alerts", "SELECT * FROM drops", SNAPS)
def snapshot_alerts(spark, d):
    return a.snapshot_alerts(snapshots(spark, d), C).drop("subject")


@query("snapshot_trend", "SELECT CAST(day AS VARCHAR) AS day, score AS value FROM snaps WHERE day >= " + b.since(20), SNAPS)
def snapshot_trend(spark, d):
    return a.trend(snapshots(spark, d), "score", C, 20).withColumn("day", b.iso("day"))


@query("snapshot", f"""
SELECT '2024-01-31' AS day, (SELECT CAST(sum(hits) AS BIGINT) FROM daily_bots WHERE day = {b.day(1)} AND bot IN (SELECT bot FROM ai)) AS ai_requests_1d,
  (SELECT CAST(sum(hits) AS BIGINT) FROM daily_bots WHERE day >= {b.since(7)} AND bot IN (SELECT bot FROM ai)) AS ai_requests_7d,
  (SELECT count(DISTINCT bot) FROM daily_bots WHERE day >= {b.since(7)} AND hits > 0 AND bot IN (SELECT bot FROM ai)) AS ai_bots_7d,
  count(*) AS pages, count(*) FILTER (last_ai >= {C.from_ts(30)}) AS pages_crawled_30d, count(*) FILTER (imp) AS important,
  count(*) FILTER (imp AND last_ai >= {C.from_ts(30)}) AS important_crawled_30d, round(100 * count(*) FILTER (imp AND last_ai >= {C.from_ts(30)}) / count(*) FILTER (imp), 1) AS coverage,
  (SELECT count(*) FROM findings WHERE status = 'open' AND severity = 'critical' AND page_id IN (SELECT page_id FROM live)) AS critical,
  (SELECT CAST(greatest(0, round(sum((importance + 1) * score) / sum(importance + 1))) AS INT) FROM live WHERE score IS NOT NULL AND pinned >= 0) AS score,
  (SELECT count(*) FROM findings WHERE status = 'open' AND severity = 'warning' AND page_id IN (SELECT page_id FROM live)) AS warning,
  (SELECT count(*) FROM findings WHERE status = 'open' AND page_id IN (SELECT page_id FROM live)) AS findings,
  (SELECT CAST(sum(hits) AS BIGINT) FROM referrals WHERE day >= {b.since(7)}) AS referrals_7d
FROM (SELECT p.*, importance >= 40 OR pinned > 0 AS imp, last_ai FROM live p
  LEFT JOIN (SELECT url_hash, max(last_seen) AS last_ai FROM page_bots WHERE bot IN (SELECT bot FROM ai) GROUP BY 1) USING (url_hash) WHERE pinned >= 0)""")
def snapshot(spark, d):
    from workload.quality_queries import ready_checks

    pages, found = b.inventory(spark, d), b.findings(spark, d)
    scored = pages.filter("not deleted and score is not null").select("importance", "pinned", "score", *[F.lit(0).alias(x) for x in q.PARTS])
    site = q.site_score(scored, robots_matrix(spark, d), R, C)
    row = a.snapshot(traffic.coverage(pages, b.page_bots(spark, d), R, C), b.daily_bots(spark, d), b.referrals(spark, d),
                     q.finding_counts(found, pages, C), site, readiness.scores(ready_checks(spark, d)), R, C)
    return row.withColumn("day", b.iso("day")).drop("readiness")


# alerts ------------------------------------------------------------------

@query("finding_alerts", f"""
SELECT 'page_' || code AS rule, page_id || ':' || bot AS key, 'critical' AS severity FROM findings
WHERE status = 'resolved' AND page_id % 5 <> 0 AND code IN ('robots_blocked', 'noindex', 'http_error', 'bot_errors')
  AND page_id IN (SELECT page_id FROM inventory WHERE importance >= 40)""")
def finding_alerts(spark, d):
    synced = q.sync_findings(stored_findings(spark, d), restated(spark, d), ("content", "coverage"), C)
    return a.findings_opened(synced, b.inventory(spark, d), C).select("rule", "key", "severity")


@query("first_crawl_pages", f"""
SELECT page_id, string_agg(DISTINCT r.bot, ',' ORDER BY r.bot) AS bots FROM requests r JOIN (SELECT url_hash, page_id FROM live WHERE (importance >= 40 OR pinned > 0) AND pinned >= 0) p USING (url_hash)
WHERE cls = 'ai' AND status < 400 AND NOT EXISTS (SELECT 1 FROM requests x WHERE x.bot = r.bot AND x.url_hash = r.url_hash AND x.cls IN ('ai', 'search') AND x.ts < {b.AS_OF - 29 * D})
GROUP BY p.page_id""".replace("SELECT page_id, string_agg", "SELECT p.page_id, string_agg"))
def first_crawl_pages(spark, d):
    first = rollups.first_crawls(b.requests(spark, d), b.page_bots(spark, d, b.AS_OF - 29 * D))
    return a.first_crawl_pages(first, b.inventory(spark, d), C).withColumn("bots", F.array_join("bots", ","))


def all_candidates(spark, d):
    pages, found, daily_bots = b.inventory(spark, d), b.findings(spark, d), b.daily_bots(spark, d)
    cube = b.cube(spark, d)
    fresh = rollups.new_bots(cube, rollups.bots_seen(b.cube(spark, d, b.AS_OF - 30 * D + 300)))
    return a.union_rules(
        a.new_bot(fresh, R, C), a.activity_alerts(daily_bots, R, C), a.hot_page_alerts(a.hot_pages(b.daily(spark, d), pages, R, C, days=29), C),
        a.never_crawled_alert(found, pages, C), a.dropped_alert(a.dropped_pages(pages, b.page_bots(spark, d), C.with_(as_of=b.AS_OF + 30 * D)), C),
        a.snapshot_alerts(snapshots(spark, d), C))


W = 7 * D
ALERT_SQL = f"""
hot AS (SELECT url_hash, page_id, hits FROM live JOIN (SELECT url_hash, CAST(sum(hits) AS BIGINT) AS hits FROM daily WHERE day >= {b.day(29)}
  AND bot IN (SELECT bot FROM bots WHERE category = 'ai_user') GROUP BY 1 HAVING sum(hits) >= 10) USING (url_hash) ORDER BY hits DESC, url_hash LIMIT 10),
dropped AS (SELECT page_id FROM live JOIN (SELECT url_hash, max(last_seen) AS last_seen FROM page_bots WHERE hits >= 3 GROUP BY 1) USING (url_hash)
  WHERE (importance >= 40 OR pinned > 0) AND last_seen < {b.AS_OF} AND last_seen > {b.AS_OF - 90 * D} AND pinned >= 0),
moves AS (SELECT bot, category, recent, CASE WHEN weekly >= 5 AND recent = 0 THEN 'bot_stopped' WHEN weekly >= 20 AND recent >= 2 * weekly AND recent >= 50 THEN 'activity_up'
    WHEN weekly >= 20 AND recent <= 0.4 * weekly THEN 'activity_down' END AS kind
  FROM (SELECT bot, CAST(coalesce(sum(hits) FILTER (day >= {b.day(7)}), 0) AS BIGINT) AS recent, coalesce(sum(hits) FILTER (day < {b.day(7)}), 0) / 4 AS weekly
    FROM daily_bots WHERE day >= {b.day(35)} GROUP BY bot) JOIN bots USING (bot) WHERE ai),
cand AS (
  SELECT 'new_bot' AS rule, bot AS key, 'info' AS severity, {b.AS_OF} AS t, {365 * D} AS cooldown, bot AS subject, CAST(NULL AS BIGINT) AS n
    FROM requests WHERE cls = 'ai' AND bot IN (SELECT bot FROM bots) GROUP BY bot HAVING bot NOT IN (SELECT bot FROM requests WHERE cls IN ('ai', 'search', 'potential') AND ts < {b.AS_OF - 30 * D + 300})
  UNION ALL SELECT kind, bot, CASE WHEN kind = 'activity_down' OR (kind = 'bot_stopped' AND category IN ('ai_search', 'ai_user')) THEN 'warning' ELSE 'info' END,
    {b.AS_OF}, CASE kind WHEN 'bot_stopped' THEN {2 * W} ELSE {W} END, bot, recent FROM moves WHERE kind IS NOT NULL
  UNION ALL SELECT 'hot_page', 'p' || page_id, 'info', {b.AS_OF}, {W}, CAST(page_id AS VARCHAR), hits FROM hot
  UNION ALL SELECT 'never_crawled', 'weekly', 'warning', {b.AS_OF}, {W}, '', count(*) FROM findings WHERE code = 'never_crawled' AND status = 'open' AND page_id IN (SELECT page_id FROM live) HAVING count(*) > 0
  UNION ALL SELECT 'page_dropped', md5(concat_ws(':', count(*), bit_xor(CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 15) AS BIGINT)), sum(page_id))), 'warning', {b.AS_OF}, {W}, '', count(*) FROM dropped HAVING count(*) > 0
  UNION ALL SELECT rule, key, severity, "at", cooldown, '', n FROM drops),
ordered AS (SELECT *, rule || ':' || key AS dedupe, row_number() OVER (PARTITION BY rule, key ORDER BY t) AS rn FROM cand),
walk AS (SELECT dedupe, t, rn, TRUE AS fired, t AS last FROM ordered WHERE rn = 1
  UNION ALL SELECT o.dedupe, o.t, o.rn, w.last <= o.t - o.cooldown, CASE WHEN w.last <= o.t - o.cooldown THEN o.t ELSE w.last END
  FROM walk w JOIN ordered o ON o.dedupe = w.dedupe AND o.rn = w.rn + 1)"""


@query("alerts", "SELECT rule, dedupe, severity, subject, n, 'unread' AS status, t AS created_at FROM walk JOIN ordered USING (dedupe, t) WHERE fired", SNAPS + "," + ALERT_SQL, True)
def all_alerts(spark, d):
    return a.raise_alerts(all_candidates(spark, d))


@query("alert_cooldown", """
SELECT dedupe, t AS created_at FROM walk WHERE fired""", """
cand AS (SELECT DISTINCT 'spoof:' || bot AS dedupe, ts AS t FROM requests WHERE cls = 'spoofed'),
ordered AS (SELECT *, row_number() OVER (PARTITION BY dedupe ORDER BY t) AS rn FROM cand),
walk AS (SELECT dedupe, t, rn, TRUE AS fired, t AS last FROM ordered WHERE rn = 1
  UNION ALL SELECT o.dedupe, o.t, o.rn, w.last <= o.t - 259200, CASE WHEN w.last <= o.t - 259200 THEN o.t ELSE w.last END
  FROM walk w JOIN ordered o ON o.dedupe = w.dedupe AND o.rn = w.rn + 1)""", True)
def alert_cooldown(spark, d):
    """Every impersonation is a candidate; each crawler's alert fires at most every three days."""
    rows = b.requests(spark, d).filter("cls = 'spoofed'").select(
        F.lit("spoof").alias("rule"), F.col("bot").alias("key"), F.lit("info").alias("severity"), F.col("ts").alias("at"),
        F.lit(3 * D).cast("bigint").alias("cooldown"), F.lit("").alias("subject"), F.lit(1).cast("bigint").alias("n"))
    return a.raise_alerts(rows).select("dedupe", "created_at")


def alert_table(spark, d):
    pid = F.col("page_id")
    return b.findings(spark, d).select(
        F.concat_ws(":", "code", pid.cast("string"), "bot").alias("dedupe"), "severity", (F.lit(b.AS_OF) - pid % 5 * D).alias("created_at"))


ALERTS = f"""alert_rows AS (SELECT code || ':' || page_id || ':' || bot AS dedupe, severity, {b.AS_OF} - page_id % 5 * 86400 AS created_at FROM findings)"""


@query("digest", f"""SELECT * FROM alert_rows WHERE created_at > {b.AS_OF - 2 * D}
ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, created_at DESC, dedupe LIMIT 30""", ALERTS)
def digest(spark, d):
    return a.digest(alert_table(spark, d), C)


@query("deliverable_alerts", "SELECT *, severity = 'critical' AS mail, severity <> 'info' AS webhook FROM alert_rows", ALERTS)
def deliverable_alerts(spark, d):
    return a.deliverable(alert_table(spark, d), C)


def agent_rows(spark, d):
    rows = b.requests(spark, d).withColumn("ua", F.when(F.col("cls") == "unknown", F.concat("ua", F.lit(" job-"), (F.col("id") % 40).cast("string"))).otherwise(F.col("ua")))
    return rollups.agents(rows, C).withColumn("shared_at", F.when(F.col("hits") % 2 == 0, F.col("last_seen")).otherwise(F.lit(0)))


AGENTS = """agent_rows AS (SELECT md5(ua) AS ua_hash, ua, cls, 'new' AS state, count(*) AS hits, min(ts) AS first_seen, max(ts) AS last_seen,
  CASE WHEN count(*) % 2 = 0 THEN max(ts) ELSE 0 END AS shared_at FROM (
  SELECT * REPLACE (ua || ' job-' || (id % 40) AS ua) FROM requests WHERE cls = 'unknown') GROUP BY ua, cls)"""


@query("agents", "SELECT ua_hash, ua, cls, state, hits, first_seen, last_seen, shared_at FROM agent_rows", AGENTS)
def agents(spark, d):
    return agent_rows(spark, d)


@query("unknown_agents", "SELECT ua_hash, hits, 'python-requests' AS token FROM agent_rows ORDER BY hits DESC, ua_hash LIMIT 25", AGENTS)
def unknown_agents(spark, d):
    return traffic.unknown_agents(agent_rows(spark, d), 25).select("ua_hash", "hits", "token")


@query("agents_of_batches", "SELECT ua_hash, ua, cls, state, hits, first_seen, last_seen FROM agent_rows", AGENTS)
def agents_of_batches(spark, d):
    """Agents of two batches, merged."""
    rows = b.requests(spark, d).withColumn("ua", F.when(F.col("cls") == "unknown", F.concat("ua", F.lit(" job-"), (F.col("id") % 40).cast("string"))).otherwise(F.col("ua")))
    part = lambda k: rollups.agents(rows.filter(F.col("id") % 2 == k), C).select("ua_hash", "ua", "cls", "state", "hits", "first_seen", "last_seen")
    return rollups.merge_agents(part(0).unionByName(part(1)))


@query("written_csv", "SELECT id, chr(39) || '=' || path || ', \"q\"' AS cell FROM requests")
def written_csv(spark, d):
    """An export as a spreadsheet would read it."""
    rows = b.requests(spark, d).select("id", F.concat(F.lit("="), "path", F.lit(', "q"')).alias("cell"))
    path = b.scratch_dir(spark, "csv")
    p.write_csv(p.csv_ready(rows), path)
    return spark.read.option("header", True).csv(path).select(F.col("id").cast("bigint").alias("id"), "cell")


@query("agents_to_share", "SELECT ua_hash, hits FROM agent_rows WHERE shared_at < last_seen ORDER BY hits DESC, ua_hash LIMIT 200", AGENTS)
def agents_to_share(spark, d):
    return a.agents_to_share(agent_rows(spark, d)).select("ua_hash", "hits")


@query("merged_agent_classes", "SELECT ua_hash, CASE WHEN hits % 3 = 0 THEN 'potential' ELSE 'unknown' END AS cls FROM agent_rows", AGENTS)
def merged_agent_classes(spark, d):
    rows = agent_rows(spark, d)
    return a.merge_classes(rows, rows.select("ua", (F.col("hits") % 3 == 0).alias("ai"))).select("ua_hash", "cls")


# published lists ----------------------------------------------------------

def guide_pages(spark, d):
    return site_pages(spark, d).withColumns({
        "url": F.concat(F.lit("https://example.com"), "path"), "description": F.concat(F.lit("Page "), F.col("page_id").cast("string")),
        "canonical_elsewhere": F.col("page_id") % 31 == 3})


def guide_sites(spark):
    return spark.createDataFrame([("main", "Example site", "All about crawlers", "no_media")], "site string, name string, summary string, policy string")


def listed(spark, d, limit):
    return p.candidates(guide_pages(spark, d), b.daily_pages(spark, d), blocked(spark, d), R, C, limit)


LISTED = ACCESS + f""",
listed AS (SELECT page_id, path, subtype, object_type, coalesce(ai_hits, 0) AS ai_hits, title,
    CASE WHEN length(squeezed) > 120 THEN rtrim(substr(squeezed, 1, 119)) || '…' WHEN title = '' THEN path ELSE squeezed END AS label,
    row_number() OVER (ORDER BY pinned DESC, object_type = 'home' DESC, coalesce(ai_hits, 0) DESC, importance DESC, page_id) AS rank
  FROM (SELECT *, trim(regexp_replace({b.unescape_sql("regexp_replace(title, '(?s)<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g')) AS squeezed FROM live)
  LEFT JOIN (SELECT url_hash, CAST(sum(hits) AS BIGINT) AS ai_hits FROM daily_pages WHERE day >= {b.day(89)} GROUP BY 1) USING (url_hash)
  WHERE pinned >= 0 AND NOT noindex AND http_status IN (0, 200) AND page_id % 31 <> 3
    AND page_id NOT IN (SELECT page_id FROM access WHERE NOT allowed AND bot IN ('oai-searchbot', 'claude-searchbot', 'perplexitybot')))"""


@query("guide_candidates", "SELECT rank, page_id, path, ai_hits, label, 'Page ' || page_id AS description FROM listed", LISTED)
def guide_candidates(spark, d):
    return listed(spark, d, None).select("rank", "page_id", "path", "ai_hits", "label", "description")


@query("guide_of_types", "SELECT row_number() OVER (ORDER BY rank) AS rank, page_id FROM listed WHERE subtype IN ('page', 'product') OR object_type = 'home'", LISTED)
def guide_of_types(spark, d):
    """Two kinds of content only, and the home page whatever it is."""
    chosen = C.with_(guide_types=("page", "product"))
    return p.candidates(guide_pages(spark, d), b.daily_pages(spark, d), blocked(spark, d), R, chosen, None).select("rank", "page_id")


@query("site_guide", r"""
SELECT 'main' AS site, count(*) AS links, '# Example site' || chr(10) || chr(10) || '> All about crawlers' || chr(10) || chr(10) ||
  (SELECT string_agg('## ' || section || chr(10) || chr(10) || lines, chr(10) || chr(10) ORDER BY CASE section WHEN 'Main pages' THEN 0 WHEN 'Optional' THEN 2 ELSE 1 END, n DESC, first) FROM (
    SELECT section, count(*) AS n, min(rank) AS first, string_agg('- [' || translate(label, '[]', '()') || '](https://example.com' || path || '): Page ' || page_id, chr(10) ORDER BY rank) AS lines FROM parts GROUP BY section)) || chr(10) AS text
FROM parts""", LISTED + """,
parts AS (SELECT *, CASE WHEN rank > 80 THEN 'Optional' WHEN object_type = 'home' OR subtype = 'page' THEN 'Main pages' WHEN subtype = 'product' THEN 'Products' ELSE 'Posts' END AS section
  FROM listed WHERE rank <= 120)""")
def site_guide(spark, d):
    return p.guide(listed(spark, d, 120), guide_sites(spark), C)


@query("site_full_text", f"""
SELECT 'main' AS site, count(*) AS links, '# Example site' || chr(10) || string_agg(
    chr(10) || '## ' || label || chr(10) || chr(10) || 'URL: https://example.com' || path || chr(10) || 'Updated: 2024-01-31' || chr(10) || chr(10) || f.text || chr(10), '' ORDER BY rank) AS text
FROM listed l JOIN facts f USING (page_id) WHERE object_type = 'post' AND words >= 50""", LISTED + "," + FACTS)
def site_full_text(spark, d):
    texts = facts(spark, d).select("page_id", "text", F.lit(C.local_date()).alias("updated"))
    return p.full_text(listed(spark, d, None), texts, guide_sites(spark)).select("site", "links", "text")


def choices(spark, d):
    """Owner choices per language section: crawlers that failed most there are blocked."""
    section = F.split_part("path", F.lit("/"), F.lit(2))
    bad = b.daily(spark, d).groupBy(section.alias("site"), "bot").agg(F.sum("errors").alias("e"))
    return bad.select("site", "bot", F.when(F.col("e") % 2 == 0, "block").otherwise("allow").alias("choice"))


_TOKENS = "string_agg('User-agent: ' || token || chr(10) || 'Disallow: /' || chr(10) || chr(10), '' ORDER BY ord)"


@query("crawler_rules", f"""
SELECT site, '{p.BEGIN}' || chr(10) || {_TOKENS} || '{p.END}' || chr(10) AS block FROM (
  SELECT split_part(path, '/', 2) AS site, bot FROM daily GROUP BY 1, 2 HAVING sum(errors) % 2 = 0) JOIN (SELECT bot, token, ord FROM bots WHERE ai AND token IS NOT NULL) USING (bot) GROUP BY site""")
def crawler_rules(spark, d):
    return p.crawler_rules(choices(spark, d), R)


@query("stripped_rules", f"SELECT DISTINCT split_part(path, '/', 2) AS site, 'User-agent: *' || chr(10) || 'Allow: /' || chr(10) AS body FROM page_paths")
def stripped_rules(spark, d):
    """A site's robots.txt with the managed block added and taken out again."""
    site = b.page_paths(spark, d).select(F.split_part("path", F.lit("/"), F.lit(2)).alias("site")).distinct()
    body = F.concat(F.lit("User-agent: *\nAllow: /\n\n" + p.BEGIN + "\nUser-agent: X\nDisallow: /\n" + p.END + "\n"))
    return site.select("site", p.strip_rules(body).alias("body"))


# The text of a policy file, as SQL.
_MEDIA_SQL = " || ".join(f"'Disallow: *.{x}' || chr(10)" for x in ("jpg", "jpeg", "png", "gif", "webp", "avif", "svg", "bmp", "tif", "tiff", "mp3", "wav", "ogg", "flac", "m4a", "mp4", "mov", "avi", "webm", "mkv"))


@query("training_policies", f"""SELECT site, '# ai.txt — ' || site || chr(10) || '# Policy for using this site''s content to train AI models.' || chr(10) || chr(10) || 'User-Agent: *' || chr(10) ||
  CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN {_MEDIA_SQL} ELSE 'Disallow: /' || chr(10) END || CASE n % 3 WHEN 2 THEN '' ELSE 'Allow: /' || chr(10) END AS text FROM (
  SELECT split_part(path, '/', 2) AS site, count(*) AS n FROM page_paths GROUP BY 1)""")
def training_policies(spark, d):
    sites = b.page_paths(spark, d).groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("site")).agg(F.count("*").alias("n")).select(
        "site", F.col("site").alias("name"), F.when(F.col("n") % 3 == 0, "allow").when(F.col("n") % 3 == 1, "no_media").otherwise("no_training").alias("policy"))
    return p.training_policy(sites).select("site", "text")


@query("access_view", f"""
SELECT m.bot, name, provider, category, coalesce(hits, 0) AS hits, CASE WHEN m.bot = 'ccbot' THEN 'block' ELSE '' END AS choice, NOT site_allowed AS blocked_elsewhere,
  CASE WHEN provider IN ('OpenAI', 'Anthropic', 'Google', 'Perplexity', 'Microsoft', 'Apple', 'Meta') THEN provider ELSE 'Others' END AS operator,
  CASE category WHEN 'ai_training' THEN CASE WHEN m.bot = 'google-extended' OR provider IN (SELECT provider FROM bots WHERE category IN ('ai_search', 'ai_user', 'search')) THEN 'training_only' ELSE 'no_visible_effect' END
    WHEN 'ai_search' THEN 'leaves_answers' WHEN 'ai_user' THEN 'links_fail' WHEN 'ai_agent' THEN 'links_fail' ELSE 'little_effect' END AS consequence
FROM matrix m JOIN bots b USING (bot) LEFT JOIN (SELECT bot, CAST(sum(hits) AS BIGINT) AS hits FROM daily_bots WHERE day >= {b.since(30)} GROUP BY 1) h ON h.bot = m.bot WHERE ai""", ACCESS)
def access_view(spark, d):
    mine = spark.createDataFrame([("ccbot", "block")], "bot string, choice string")
    return p.access_view(b.daily_bots(spark, d), mine, robots_matrix(spark, d), R, C).drop("purpose")


@query("file_fetches", f"""
SELECT path AS file, CAST(coalesce(sum(hits), 0) AS BIGINT) AS hits, CAST(max(day) AS VARCHAR) AS last, string_agg(bot, ',' ORDER BY hits DESC, bot) AS bots FROM (
  SELECT path, bot, CAST(sum(hits) AS BIGINT) AS hits, max(day) AS day FROM (SELECT DISTINCT path, url_hash FROM page_paths) LEFT JOIN (SELECT url_hash, bot, hits, day FROM daily WHERE day >= {b.day(30)}) USING (url_hash) GROUP BY ALL)
GROUP BY path""")
def file_fetches(spark, d):
    """Every page counts as a published file."""
    files = b.page_paths(spark, d).select(F.col("path").alias("file"))
    return p.file_fetches(b.daily(spark, d), C, files).withColumns({"bots": F.array_join("bots", ","), "last": b.iso("last")})


# exports -----------------------------------------------------------------

@query("export_events", f"""SELECT strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS time_utc, coalesce(name, bot) AS crawler, cls AS class, vstate AS verification, method, path,
  CAST(status AS VARCHAR) AS status, CAST(ms AS VARCHAR) AS ms, ip_net AS network, ua AS user_agent, 'live' AS source FROM requests LEFT JOIN (SELECT bot, name FROM bots) USING (bot) WHERE ts >= {C.from_ts(30)}""")
def export_events(spark, d):
    return p.export_events(b.requests(spark, d), R, C)


@query("export_referrals", f"SELECT max(path) AS landing_page, max(name) AS engine, CAST(sum(hits) AS VARCHAR) AS visits FROM referrals JOIN refnames USING (source) WHERE day >= {b.since(30)} GROUP BY url_hash, source")
def export_referrals(spark, d):
    return p.export_referrals(b.referrals(spark, d), R, C)


def _utc_sql(ts):
    return f"coalesce(strftime(to_timestamp({ts}) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'), '')"


@query("export_crawlers", f"""SELECT name AS crawler, provider AS company, category, {", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in ("requests", "verified", "impersonations", "errors", "avg_ms", "pages"))},
  {_utc_sql("first_seen")} AS first_seen_utc, {_utc_sql("last_seen")} AS last_seen_utc FROM ({CRAWLERS_SQL})""")
def export_crawlers(spark, d):
    return p.export_crawlers(traffic.crawlers(b.daily_bots(spark, d), b.page_bots(spark, d), b.bots_seen(spark, d), R, C))


@query("export_pages", f"""SELECT path, title, subtype AS type, {", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {a}" for c, a in (("importance", "importance"), ("score", "score"), ("word_count", "words"), ("inlinks", "internal_links_in")))},
  {_utc_sql("last_ai")} AS last_ai_crawl_utc, CAST(hits AS VARCHAR) AS hits, coalesce(replace(bots, ',', ' '), '') AS crawlers FROM page_rows""", LIST)
def export_pages(spark, d):
    return p.export_pages(traffic.page_list(b.inventory(spark, d), b.page_bots(spark, d), b.daily(spark, d), b.daily_pages(spark, d), b.findings(spark, d), R, C, page=None))


# audit and redirects ----------------------------------------------------------

def old_snapshot(spark, d):
    return b.inventory(spark, d).filter("page_id % 10 <> 9").select("page_id", "path", (F.col("page_id") % 900).alias("words"))


def new_snapshot(spark, d):
    pid = F.col("page_id")
    return b.inventory(spark, d).select(
        "page_id", F.when(pid % 6 == 1, F.concat("path", F.lit("-new"))).otherwise(F.col("path")).alias("path"), "noindex", "subtype", "importance", "pinned",
        F.when(pid % 14 == 0, "https://other.example/x").otherwise("").alias("canonical"), F.lit("example.com").alias("home_host"),
        F.floor(pid % 900 / (pid % 4 + 1)).alias("words"), (pid % 33 == 0).alias("builder"), F.when(pid > 0, F.array(F.floor(pid / 6) * 6 + 1)).otherwise(F.array(F.lit(-1).cast("bigint"))).alias("parents"))


SNAP2 = ACCESS + f""",
newer AS (SELECT i.*, CASE WHEN page_id % 6 = 1 THEN path || '-new' ELSE path END AS new_path, (page_id % 900) // (page_id % 4 + 1) AS new_words FROM inventory i),
history AS (SELECT url_hash FROM page_bots WHERE bot IN (SELECT bot FROM ai) UNION SELECT url_hash FROM referrals WHERE day >= {b.day(30)}),
audits AS (SELECT page_id, (importance >= 40 AND pinned >= 0) OR pinned > 0 AS important, page_id % 10 = 9 AS first_published,
    CASE WHEN noindex THEN 'fail' ELSE 'pass' END AS indexing,
    CASE WHEN nb = 0 THEN 'pass' WHEN hard > 0 THEN 'fail' ELSE 'warn' END AS robots, CASE WHEN page_id % 14 = 0 THEN 'warn' ELSE 'pass' END AS canonical,
    CASE WHEN page_id % 10 = 9 THEN 'na' WHEN new_path = path THEN 'pass' WHEN url_hash IN (SELECT url_hash FROM history) THEN 'fail' ELSE 'warn' END AS url_change,
    CASE WHEN page_id % 33 = 0 THEN 'na' WHEN page_id % 10 <> 9 AND page_id % 900 >= 300 AND new_words < (page_id % 900) / 2 THEN CASE WHEN (importance >= 40 AND pinned >= 0) OR pinned > 0 THEN 'fail' ELSE 'warn' END
      WHEN new_words < CASE subtype WHEN 'product' THEN 120 ELSE 300 END THEN 'warn' ELSE 'pass' END AS content
  FROM newer LEFT JOIN (SELECT page_id, count(*) AS nb, count(*) FILTER (bot IN ('oai-searchbot', 'claude-searchbot', 'perplexitybot', 'googlebot', 'bingbot')) AS hard
    FROM access WHERE NOT allowed AND bot IN {PRIORITY} GROUP BY 1) USING (page_id))"""


def audited(spark, d):
    history = traffic.crawl_history(b.page_bots(spark, d), b.referrals(spark, d), R, C)
    return audit.audit_changes(old_snapshot(spark, d), new_snapshot(spark, d), blocked(spark, d), history, R, C.with_(guard_redirects=False))


@query("publication_audit", """SELECT page_id, important, first_published, "check", status FROM (SELECT page_id, important, first_published, indexing, coalesce(robots, 'pass') AS robots, canonical, url_change, content FROM audits)
UNPIVOT (status FOR "check" IN (indexing, robots, canonical, url_change, content))""",
       SNAP2.replace("CASE WHEN nb = 0 THEN", "CASE WHEN coalesce(nb, 0) = 0 THEN"))
def publication_audit(spark, d):
    return audited(spark, d)


@query("publication_alerts", f"""SELECT 'publish_guard' AS rule, 'publish_guard:' || page_id || ':' || checks AS dedupe, CASE WHEN important THEN 'critical' ELSE 'warning' END AS severity,
  CAST(page_id AS VARCHAR) AS subject, n, 'unread' AS status, {b.AS_OF} AS created_at
FROM (SELECT page_id, important, first_published, string_agg("check", ',' ORDER BY "check") AS checks, count(*) AS n FROM (
  SELECT page_id, important, first_published, "check", status FROM (SELECT page_id, important, first_published, indexing, coalesce(robots, 'pass') AS robots, canonical, url_change, content FROM audits)
  UNPIVOT (status FOR "check" IN (indexing, robots, canonical, url_change, content))) WHERE status = 'fail' AND (important OR first_published) GROUP BY ALL)""",
       SNAP2.replace("CASE WHEN nb = 0 THEN", "CASE WHEN coalesce(nb, 0) = 0 THEN"))
def publication_alerts(spark, d):
    return a.raise_alerts(a.publish_guard(audited(spark, d), C))


REDIRECTS = """
olds AS (SELECT page_id, path FROM inventory WHERE page_id % 10 <> 9),
news AS (SELECT page_id, CASE WHEN page_id % 6 = 1 THEN path || '-new' ELSE path END AS path FROM inventory),
moved AS (SELECT n.page_id, o.path AS source, n.path FROM news n JOIN olds o USING (page_id) WHERE o.path <> n.path AND o.path <> '/' AND n.path <> '/'),
redirects AS (SELECT md5(lower(source)) AS source_hash, source, page_id, 'slug' AS reason FROM moved
  WHERE md5(lower(source)) NOT IN (SELECT md5(lower(path)) FROM news)
  QUALIFY row_number() OVER (PARTITION BY md5(lower(source)) ORDER BY page_id) = 1)"""


@query("redirect_candidates", f"SELECT *, {b.AS_OF} AS created_at FROM redirects", REDIRECTS)
def redirect_candidates(spark, d):
    return audit.redirect_candidates(old_snapshot(spark, d), new_snapshot(spark, d), C)


@query("moved_parents", f"""SELECT source_hash, source, page_id, reason, {b.AS_OF} AS created_at FROM (
  SELECT *, md5(lower(source)) AS source_hash FROM (
    SELECT n.page_id, o.path AS source, 'slug' AS reason, 0 AS prio FROM now_tree n JOIN old_tree o USING (page_id) WHERE o.path <> n.path
    UNION ALL SELECT c.page_id, o.path || substr(c.path, length(n.path) + 1), 'parent', 1 FROM now_tree c JOIN now_tree n ON n.page_id = c.page_id % 7 JOIN old_tree o ON o.page_id = n.page_id
      WHERE c.page_id >= 7 AND o.path <> n.path AND starts_with(c.path, n.path || '/')))
WHERE source_hash NOT IN (SELECT md5(lower(path)) FROM now_tree) QUALIFY row_number() OVER (PARTITION BY source_hash ORDER BY prio, page_id) = 1""", """
now_tree AS (SELECT page_id, CASE WHEN page_id < 7 THEN CASE WHEN page_id % 2 = 1 THEN '/t' ELSE '/s' END || page_id
  WHEN page_id % 11 = 0 THEN '/s' || (page_id % 7) || '/c' || (page_id - 7) ELSE CASE WHEN (page_id % 7) % 2 = 1 THEN '/t' ELSE '/s' END || (page_id % 7) || '/c' || page_id END AS path FROM page_paths),
old_tree AS (SELECT page_id, '/s' || CASE WHEN page_id < 7 THEN CAST(page_id AS VARCHAR) ELSE (page_id % 7) || '/c' || page_id END AS path FROM page_paths WHERE page_id < 7 OR page_id % 5 <> 2)""")
def moved_parents(spark, d):
    """Seven sections, of which three moved with all that is below them; some pages are new, some took an old path."""
    pid = F.col("page_id")
    top = (pid % 7).cast("string")
    letter = lambda n: F.when(n % 2 == 1, "/t").otherwise("/s")
    rows = b.table(spark, d, "pages").select("page_id")
    path = F.when(pid < 7, F.concat(letter(pid), pid.cast("string"))).when(
        pid % 11 == 0, F.concat(F.lit("/s"), top, F.lit("/c"), (pid - 7).cast("string"))).otherwise(F.concat(letter(pid % 7), top, F.lit("/c"), pid.cast("string")))
    new = rows.select("page_id", path.alias("path"), F.when(pid >= 7, F.array(pid % 7)).otherwise(F.array().cast("array<bigint>")).alias("parents"))
    was = F.concat(F.lit("/s"), F.when(pid < 7, pid.cast("string")).otherwise(F.concat(top, F.lit("/c"), pid.cast("string"))))
    old = rows.filter("page_id < 7 or page_id % 5 <> 2").select("page_id", was.alias("path"))
    return audit.redirect_candidates(old, new, C)


@query("resolved_redirects", """
SELECT source_hash, source, page_id, reason, coalesce(hits, 0) AS hits, coalesce(bot_hits, 0) AS bot_hits, last_hit FROM redirects
LEFT JOIN (SELECT url_hash, count(*) AS hits, count(*) FILTER (bot <> '' AND cls <> 'spoofed') AS bot_hits, max(ts) AS last_hit FROM requests WHERE status = 404 GROUP BY 1) ON url_hash = source_hash""", REDIRECTS)
def resolved_redirects(spark, d):
    return audit.resolve_redirects(b.requests(spark, d), audit.redirect_candidates(old_snapshot(spark, d), new_snapshot(spark, d), C))
