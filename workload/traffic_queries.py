"""Crawler, page and referral reports."""

from pyspark.sql import functions as F

from trailmark.operators import classify, page_sets, rollups, sessions, verify
from trailmark.plans import traffic as t
from workload import bridge as b
from workload.rollup_queries import SESSION_SQL

QUERIES, ORACLE = {}, {}
C, R = b.CONFIG, b.REGISTRY
FROM30 = C.from_ts(30)
IMP = "(importance >= 40 OR pinned > 0)"


def query(name, sql=None, extra="", recursive=False):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = b.sql(sql, extra, recursive)
        return fn
    return add


def text_days(df, *cols):
    return df.withColumns({c: b.iso(c) for c in (cols or ("day",))})


@query("overview", f"""
SELECT CAST(sum(hits) FILTER (day >= {b.since(30)}) AS BIGINT) AS ai_requests,
  CAST(coalesce(sum(hits) FILTER (day < {b.since(30)}), 0) AS BIGINT) AS ai_requests_prev,
  CAST(sum(verified) FILTER (day >= {b.since(30)}) AS BIGINT) AS verified,
  CAST(sum(spoofed) FILTER (day >= {b.since(30)}) AS BIGINT) AS impersonations,
  count(DISTINCT bot) FILTER (day >= {b.since(30)} AND hits > 0) AS ai_bots,
  CAST(sum(hits) FILTER (day >= {b.since(30)} AND bot IN (SELECT bot FROM bots WHERE category IN ('ai_user', 'ai_agent'))) AS BIGINT) AS user_fetches,
  (SELECT count(DISTINCT url_hash) FROM page_bots WHERE last_seen >= {FROM30} AND bot IN (SELECT bot FROM ai)) AS pages_crawled,
  (SELECT CAST(sum(hits) AS BIGINT) FROM referrals WHERE day >= {b.since(30)}) AS ai_referrals,
  (SELECT CAST(coalesce(sum(hits), 0) AS BIGINT) FROM referrals WHERE day < {b.since(30)} AND day >= {b.since(60)}) AS ai_referrals_prev
FROM daily_bots WHERE day >= {b.since(60)} AND bot IN (SELECT bot FROM ai)""")
def overview(spark, d):
    return t.overview(b.daily_bots(spark, d), b.page_bots(spark, d), b.referrals(spark, d), R, C)


def stored_sets(spark, d, rows, name):
    """Bitmaps of the pages per day and key, as an earlier job would have stored them: numbered in two steps."""
    rows = rows.select("day", "key", "url_hash")
    old = b.written(spark, page_sets.numbered(rows.filter(F.col("day") < F.lit(C.back(10)))), f"{name}-numbers")
    new = page_sets.numbered(rows, old)
    return b.written(spark, page_sets.page_sets(rows, old.unionByName(new)), f"{name}-sets")


@query("overview_year", f"""
SELECT CAST(sum(hits) AS BIGINT) AS ai_requests, count(DISTINCT bot) FILTER (hits > 0) AS ai_bots,
  (SELECT count(DISTINCT url_hash) FROM daily WHERE day >= {b.since(365)} AND bot IN (SELECT bot FROM ai)) AS pages_crawled,
  (SELECT CAST(sum(hits) AS BIGINT) FROM referrals WHERE day >= {b.since(365)}) AS ai_referrals
FROM daily_bots WHERE day >= {b.since(365)} AND bot IN (SELECT bot FROM ai)""")
def overview_year(spark, d):
    """A year's overview from stored rollups and page bitmaps alone."""
    crawled = stored_sets(spark, d, b.daily(spark, d).withColumnRenamed("bot", "key"), "crawled")
    bots, sent = b.written(spark, b.daily_bots(spark, d), "daily_bots"), b.written(spark, b.referrals(spark, d), "referrals")
    return t.overview(bots, None, sent, R, C, 365, crawled).select("ai_requests", "ai_bots", "pages_crawled", "ai_referrals")


@query("referral_sources_year", f"""SELECT source, CAST(sum(hits) AS BIGINT) AS visits, count(DISTINCT url_hash) AS pages, max(name) AS name
FROM referrals JOIN refnames USING (source) WHERE day >= {b.since(365)} GROUP BY source""")
def referral_sources_year(spark, d):
    sent = b.written(spark, b.referrals(spark, d), "referrals")
    return t.referral_sources(sent, R, C, 365, stored_sets(spark, d, sent.withColumnRenamed("source", "key"), "visited"))


@query("overview_week", f"""
SELECT CAST(sum(hits) FILTER (day >= {b.since(7)}) AS BIGINT) AS ai_requests,
  CAST(sum(hits) FILTER (day < {b.since(7)}) AS BIGINT) AS ai_requests_prev,
  CAST(sum(verified) FILTER (day >= {b.since(7)}) AS BIGINT) AS verified
FROM daily_bots WHERE day >= {b.since(14)} AND bot IN (SELECT bot FROM ai)""")
def overview_week(spark, d):
    return t.overview(b.daily_bots(spark, d), b.page_bots(spark, d), b.referrals(spark, d), R, C, 7).select(
        "ai_requests", "ai_requests_prev", "verified")


COVERAGE_SQL = f"""
SELECT count(*) AS pages, count(*) FILTER (last_ai >= {FROM30}) AS crawled, count(last_ai) AS crawled_ever,
  count(*) FILTER {IMP} AS important, count(*) FILTER ({IMP} AND last_ai >= {FROM30}) AS important_crawled,
  count(*) FILTER ({IMP} AND last_ai IS NULL) AS important_never,
  count(*) - count(*) FILTER (last_ai >= {FROM30}) AS not_crawled, FALSE AS learning
FROM live LEFT JOIN (SELECT url_hash, max(last_seen) AS last_ai FROM page_bots WHERE bot IN (SELECT bot FROM ai) GROUP BY 1)
USING (url_hash) WHERE pinned >= 0"""


@query("coverage", COVERAGE_SQL.replace(f"FILTER {IMP}", f"FILTER ({IMP})"))
def coverage(spark, d):
    return t.coverage(b.inventory(spark, d), b.page_bots(spark, d), R, C)


@query("timeline", f"""
SELECT CAST(s.day AS VARCHAR) AS day,
  {', '.join(f"CAST(coalesce(sum(hits) FILTER (cat = '{c}'), 0) AS BIGINT) AS {c}" for c in t.TIMELINE)},
  CAST(coalesce(sum(spoofed), 0) AS BIGINT) AS spoofed
FROM (SELECT CAST(range AS DATE) AS day FROM range({b.since(30)}, {b.day(-1)}, INTERVAL 1 DAY)) s
LEFT JOIN (SELECT d.*, CASE WHEN category = 'ai_agent' THEN 'ai_user'
             WHEN category IN ('ai_search','ai_user','ai_training','ai_other','search') THEN category ELSE 'other' END AS cat
           FROM daily_bots d LEFT JOIN bots USING (bot)) d ON d.day = s.day
GROUP BY s.day""")
def timeline(spark, d):
    return text_days(t.timeline(spark, b.daily_bots(spark, d), R, C))


CRAWLERS_SQL = f"""
SELECT d.bot, coalesce(max(b.name), CASE d.bot WHEN '_signed' THEN 'Signed agent (unknown operator)' ELSE 'Possible AI crawlers' END) AS name,
  max(provider) AS provider, max(category) AS category, bool_or(ai) AS ai,
  CAST(sum(d.hits) FILTER (day >= {b.since(30)}) AS BIGINT) AS requests,
  CAST(coalesce(sum(d.hits) FILTER (day < {b.since(30)}), 0) AS BIGINT) AS requests_prev,
  CAST(sum(d.verified) FILTER (day >= {b.since(30)}) AS BIGINT) AS verified,
  CAST(sum(d.spoofed) FILTER (day >= {b.since(30)}) AS BIGINT) AS impersonations,
  CAST(sum(d.errors) FILTER (day >= {b.since(30)}) AS BIGINT) AS errors,
  CAST(round(sum(d.ms_total) FILTER (day >= {b.since(30)}) / sum(d.hits) FILTER (day >= {b.since(30)})) AS BIGINT) AS avg_ms,
  max(p.pages) AS pages, max(s.first_seen) AS first_seen, max(s.last_seen) AS last_seen, bool_or(verifiable) AS verifiable,
  (SELECT string_agg(CAST(coalesce(x.hits, 0) AS VARCHAR), ',' ORDER BY g.range)
   FROM range({b.since(30)}, {b.day(-1)}, INTERVAL 1 DAY) g LEFT JOIN daily_bots x ON x.day = CAST(g.range AS DATE) AND x.bot = d.bot) AS spark,
  max(CASE category WHEN 'ai_training' THEN 'Model training' WHEN 'ai_search' THEN 'Search — powers answers'
      WHEN 'ai_user' THEN 'User-triggered fetch' WHEN 'ai_other' THEN 'Other AI use' WHEN 'search' THEN 'Search engine' END) AS purpose
FROM daily_bots d JOIN bots b ON b.bot = d.bot
LEFT JOIN (SELECT bot, count(*) AS pages FROM page_bots WHERE last_seen >= {FROM30} GROUP BY bot) p ON p.bot = d.bot
LEFT JOIN bots_seen s ON s.bot = d.bot
WHERE day >= {b.since(60)} GROUP BY d.bot"""


@query("crawlers", CRAWLERS_SQL)
def crawlers(spark, d):
    out = t.crawlers(b.daily_bots(spark, d), b.page_bots(spark, d), b.bots_seen(spark, d), R, C)
    return out.withColumn("spark", F.array_join(F.transform("spark", lambda x: x.cast("string")), ","))


SLOTS = """
slots AS (SELECT bot, row_number() OVER (ORDER BY hits DESC, bot) AS slot FROM bots_seen
  WHERE bot IN (SELECT bot FROM ai) ORDER BY hits DESC, bot LIMIT 4)"""


@query("chart_slots", "SELECT bot, slot FROM slots", SLOTS)
def chart_slots(spark, d):
    return t.slots(b.bots_seen(spark, d), R)


@query("crawler_series", f"""
SELECT x.series, x.slot, CAST(CAST(g.range AS DATE) AS VARCHAR) AS day, x.total, x.bots,
  coalesce((SELECT CAST(sum(hits) AS BIGINT) FROM ai_days y WHERE y.series = x.series AND y.day = CAST(g.range AS DATE)), 0) AS hits
FROM (SELECT series, slot, CAST(sum(hits) AS BIGINT) AS total, count(DISTINCT bot) AS bots FROM ai_days GROUP BY 1, 2) x,
  range({b.since(30)}, {b.day(-1)}, INTERVAL 1 DAY) g""", SLOTS + f""",
ai_days AS (SELECT coalesce(s.bot, 'other') AS series, coalesce(slot, 0) AS slot, d.bot, day, hits
  FROM daily_bots d LEFT JOIN slots s ON s.bot = d.bot
  WHERE day >= {b.since(30)} AND d.bot IN (SELECT bot FROM ai) AND hits > 0)""")
def crawler_series(spark, d):
    return text_days(t.crawler_series(spark, b.daily_bots(spark, d), b.bots_seen(spark, d), R, C))


@query("crawler_timeline", f"""
SELECT CAST(CAST(g.range AS DATE) AS VARCHAR) AS day, coalesce(hits, 0) AS requests, coalesce(verified, 0) AS verified,
  coalesce(spoofed, 0) AS spoofed, coalesce(errors, 0) AS errors
FROM range({b.since(30)}, {b.day(-1)}, INTERVAL 1 DAY) g
LEFT JOIN daily_bots d ON d.day = CAST(g.range AS DATE) AND bot = 'gptbot'""")
def crawler_timeline(spark, d):
    return text_days(t.crawler_timeline(spark, b.daily_bots(spark, d), C, "gptbot"))


@query("crawler_breakdowns", """
SELECT bot, kind, key, detail, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY bot, kind ORDER BY n DESC, key, detail) AS rank FROM (
    SELECT bot, kind, key, detail, count(*) AS n FROM facets WHERE NOT (kind = 'network' AND key = '') GROUP BY ALL))
WHERE rank <= CASE kind WHEN 'status' THEN 12 WHEN 'verification' THEN 1000000 WHEN 'network' THEN 15 ELSE 10 END""", f"""
latest AS (SELECT * FROM requests WHERE ts >= {FROM30} AND bot <> ''),
facets AS (SELECT bot, 'status' AS kind, CAST(status AS VARCHAR) AS key, '' AS detail FROM latest
  UNION ALL SELECT bot, 'verification', cls, vstate FROM latest
  UNION ALL SELECT bot, 'network', ip_net, vstate FROM latest UNION ALL SELECT bot, 'user_agent', ua, '' FROM latest)""")
def crawler_breakdowns(spark, d):
    return t.crawler_breakdowns(b.requests(spark, d), C)


ATTRS = "LEFT JOIN (SELECT url_hash, page_id, title, importance FROM live) USING (url_hash)"


@query("crawler_top_pages", f"""
SELECT x.*, page_id, title, importance FROM (
  SELECT url_hash, max(path) AS path, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(errors) AS BIGINT) AS errors, max(last_status) AS status
  FROM daily WHERE bot = 'gptbot' AND day >= {b.since(30)} GROUP BY url_hash ORDER BY hits DESC, path LIMIT 25) x {ATTRS}""")
def crawler_top_pages(spark, d):
    return t.crawler_top_pages(b.daily(spark, d), b.inventory(spark, d), C, "gptbot")


@query("latest_sessions", "SELECT * FROM sessions WHERE bot = 'claudebot' ORDER BY ended DESC, started DESC LIMIT 20",
       SESSION_SQL.format(gap=1800, cap=21600), True)
def latest_sessions(spark, d):
    return t.latest_sessions(sessions.sessions(b.requests(spark, d)), "claudebot")


CONF = """CASE WHEN vstate IN ('verified', 'failed') OR cls = 'spoofed' THEN 'high' WHEN cls IN ('potential', 'unknown') THEN 'low'
  WHEN confidence = 'high' THEN 'medium' ELSE 'low' END"""
EVENT_VIEW = f"""SELECT id, ts, bot, coalesce(name, bot) AS name, method, path, status, ms, cls, vstate, {CONF} AS conf,
  ip_net AS net, 'live' AS source FROM requests LEFT JOIN (SELECT bot, name, confidence FROM bots) USING (bot)"""


@query("crawler_latest_requests", f"{EVENT_VIEW} WHERE bot = 'googlebot' ORDER BY ts DESC, id DESC LIMIT 50")
def crawler_latest_requests(spark, d):
    return t.latest_requests(b.requests(spark, d), R, 50, bot="googlebot")


@query("event_view", EVENT_VIEW)
def event_view(spark, d):
    return classify.event_view(b.requests(spark, d), R)


@query("latest_per_page", f"""
SELECT * FROM (SELECT url_hash, row_number() OVER (PARTITION BY url_hash ORDER BY ts DESC, id DESC) AS rank, id, ts, bot, status, {CONF} AS conf
FROM requests LEFT JOIN (SELECT bot, confidence FROM bots) USING (bot) WHERE cls <> 'spoofed') WHERE rank <= 8""")
def latest_per_page(spark, d):
    return t.latest_per_page(b.requests(spark, d), R)


@query("top_pages", f"""
SELECT x.url_hash, x.hits, r.path, coalesce(r.bots, 0) AS bots, tb.bot AS top_bot, coalesce(v.visits, 0) AS visits, page_id, title, importance
FROM (SELECT url_hash, CAST(sum(hits) AS BIGINT) AS hits FROM daily_pages WHERE day >= {b.since(30)} GROUP BY 1 ORDER BY hits DESC, url_hash LIMIT 10) x
LEFT JOIN (SELECT url_hash, max(path) AS path, count(*) AS bots FROM page_bots WHERE bot IN (SELECT bot FROM ai) AND last_seen >= {FROM30} GROUP BY 1) r USING (url_hash)
LEFT JOIN (SELECT url_hash, bot FROM daily WHERE day >= {b.since(30)} AND bot IN (SELECT bot FROM ai) GROUP BY url_hash, bot
  QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY sum(hits) DESC, bot) = 1) tb USING (url_hash)
LEFT JOIN (SELECT url_hash, CAST(sum(hits) AS BIGINT) AS visits FROM referrals WHERE day >= {b.since(30)} GROUP BY 1) v USING (url_hash) {ATTRS}""")
def top_pages(spark, d):
    return t.top_pages(b.daily(spark, d), b.daily_pages(spark, d), b.page_bots(spark, d), b.referrals(spark, d),
                       b.inventory(spark, d), R, C)


LIST = f"""
page_rows AS (
  SELECT p.page_id, object_type, subtype, path, title, importance, {IMP} AND pinned >= 0 AS important, pinned, score, word_count, inlinks,
    last_ai, bots, coalesce(hits, 0) AS hits, coalesce(errors, 0) AS errors, coalesce(critical, 0) AS critical, coalesce(warnings, 0) AS warnings
  FROM live p LEFT JOIN (
    SELECT url_hash, max(last_seen) AS last_ai, array_to_string(list(bot ORDER BY last_seen DESC, bot), ',') AS bots
    FROM page_bots WHERE bot IN (SELECT bot FROM ai) GROUP BY 1) USING (url_hash)
  LEFT JOIN (SELECT url_hash, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(errors) AS BIGINT) AS errors FROM daily_pages
    WHERE day >= {b.since(30)} GROUP BY 1) USING (url_hash)
  LEFT JOIN (SELECT page_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warnings
    FROM findings WHERE status = 'open' GROUP BY 1) USING (page_id))"""


def _list(spark, d, **kw):
    out = t.page_list(b.inventory(spark, d), b.page_bots(spark, d), b.daily(spark, d), b.daily_pages(spark, d),
                      b.findings(spark, d), R, C, **kw)
    return out.withColumn("bots", F.array_join("bots", ","))


def _page_list_query(name, where, **kw):
    @query(name, f"SELECT * FROM page_rows WHERE {where}", LIST)
    def fn(spark, d):
        return _list(spark, d, page=None, **kw)


_page_list_query("pages_all", "TRUE")
_page_list_query("pages_important", "important", show="important")
_page_list_query("pages_crawled", "hits > 0", show="crawled")
_page_list_query("pages_uncrawled", "hits = 0", show="uncrawled")
_page_list_query("pages_never", "important AND last_ai IS NULL", show="never")
_page_list_query("pages_dropped", f"important AND last_ai < {FROM30}", show="dropped")
_page_list_query("pages_with_errors", "page_id IN (SELECT page_id FROM findings WHERE status = 'open' AND code IN ('bot_errors', 'http_error'))",
                 show="errors")
_page_list_query("pages_blocked", "page_id IN (SELECT page_id FROM findings WHERE status = 'open' AND code IN ('robots_blocked', 'noindex', 'canonical_elsewhere', 'noai'))",
                 show="blocked")
_page_list_query("pages_search", "(contains(lower(path), '/en') OR contains(lower(title), '/en')) AND subtype = 'post'",
                 search="/EN", subtype="post")


@query("pages_for_crawler", f"""
SELECT p.page_id, last_ai, coalesce(hits, 0) AS hits FROM live p
LEFT JOIN (SELECT url_hash, max(last_seen) AS last_ai FROM page_bots WHERE bot = 'gptbot' GROUP BY 1) USING (url_hash)
LEFT JOIN (SELECT url_hash, CAST(sum(hits) AS BIGINT) AS hits FROM daily WHERE bot = 'gptbot' AND day >= {b.since(30)} GROUP BY 1) USING (url_hash)""")
def pages_for_crawler(spark, d):
    return _list(spark, d, page=None, bot="gptbot").select("page_id", "last_ai", "hits")


for _sort, _order in {
    "importance": "importance DESC, page_id", "hits": "hits DESC, importance DESC, page_id",
    "last": "last_ai DESC NULLS LAST, page_id", "score": "score ASC NULLS FIRST, importance DESC, page_id",
    "title": "lower(title), page_id",
}.items():
    def _sorted(spark, d, sort=_sort):
        return _list(spark, d, page=2, per=20, sort=sort)

    QUERIES[f"pages_page_by_{_sort}"] = _sorted
    ORACLE[f"pages_page_by_{_sort}"] = b.sql(f"SELECT * FROM page_rows ORDER BY {_order} LIMIT 20 OFFSET 20", LIST)


@query("page_count", "SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 50)) AS BIGINT) AS pages FROM live")
def page_count(spark, d):
    return t.page_count(t.live_pages(b.inventory(spark, d)), 50)


@query("page_column", f"""
SELECT object_id, score, CAST(coalesce(sum(hits), 0) AS BIGINT) AS hits,
  CASE WHEN score IS NULL THEN 'none' WHEN score >= 70 THEN 'good' WHEN score >= 40 THEN 'warn' ELSE 'crit' END AS level
FROM live LEFT JOIN (SELECT * FROM daily_pages WHERE day >= {b.since(30)}) USING (url_hash) WHERE object_type = 'post' GROUP BY object_id, score""")
def page_column(spark, d):
    return t.page_column(b.inventory(spark, d), b.daily_pages(spark, d), C)


BUSIEST = "(SELECT url_hash FROM page_paths WHERE page_id = 1)"


def _one_hash(spark, d):
    """Hash of the page every scale has: page 1."""
    return b.page_paths(spark, d).filter("page_id = 1").select("url_hash").first()[0]


@query("page_timeline", f"""
SELECT CAST(CAST(g.range AS DATE) AS VARCHAR) AS day, CAST(coalesce(sum(hits) FILTER (ai), 0) AS BIGINT) AS ai,
  CAST(coalesce(sum(hits) FILTER (NOT ai), 0) AS BIGINT) AS search
FROM range({b.since(90)}, {b.day(-1)}, INTERVAL 1 DAY) g
LEFT JOIN (SELECT d.*, b.ai FROM daily d JOIN bots b USING (bot) WHERE url_hash = {BUSIEST}) d ON d.day = CAST(g.range AS DATE) GROUP BY g.range""")
def page_timeline(spark, d):
    return text_days(t.page_timeline(spark, b.daily(spark, d), R, C, _one_hash(spark, d)))


@query("url_detail", """
SELECT url_hash, max(path) AS path, CAST(sum(hits) AS BIGINT) AS total, min(first_seen) AS first_at,
  arg_min(name, CAST(first_seen AS VARCHAR) || bot) AS first_bot, max(last_seen) AS last_at,
  arg_max(last_status, CAST(last_seen AS VARCHAR) || bot) AS status, count(*) AS bots
FROM page_bots JOIN (SELECT bot, name FROM bots) USING (bot) WHERE bot IN (SELECT bot FROM ai) GROUP BY url_hash""")
def url_detail(spark, d):
    return t.url_detail(b.page_bots(spark, d), R)


TOP3 = f"""
top3 AS (SELECT bot, row_number() OVER (ORDER BY sum(hits) DESC, bot) AS k FROM daily_bots
  WHERE day >= {b.since(30)} AND bot IN (SELECT bot FROM ai) GROUP BY bot QUALIFY k <= 3),
last_answer AS (SELECT url_hash, arg_max(last_status, CAST(last_seen AS VARCHAR) || bot) AS status FROM page_bots
  WHERE bot IN (SELECT bot FROM ai) GROUP BY 1),
pivoted AS (
  SELECT d.url_hash, max(d.path) AS path, CAST(sum(d.hits) AS BIGINT) AS hits,
    CAST(coalesce(sum(d.hits) FILTER (k = 1), 0) AS BIGINT) AS top1, CAST(coalesce(sum(d.hits) FILTER (k = 2), 0) AS BIGINT) AS top2,
    CAST(coalesce(sum(d.hits) FILTER (k = 3), 0) AS BIGINT) AS top3, CAST(coalesce(sum(d.hits) FILTER (k IS NULL), 0) AS BIGINT) AS other,
    (SELECT string_agg(bot, ',' ORDER BY k) FROM top3) AS columns, max(l.status) AS status
  FROM daily d LEFT JOIN top3 USING (bot) LEFT JOIN last_answer l ON l.url_hash = d.url_hash
  WHERE day >= {b.since(30)} AND d.bot IN (SELECT bot FROM ai) GROUP BY d.url_hash)"""


def _pivot(spark, d, **kw):
    return t.crawler_pages(b.daily(spark, d), b.daily_bots(spark, d), b.page_bots(spark, d), b.inventory(spark, d), R, C, **kw)


@query("crawler_pages", """
SELECT x.*, page_id, title FROM (SELECT * FROM pivoted ORDER BY hits DESC, path LIMIT 20) x
LEFT JOIN (SELECT url_hash, page_id, title FROM live) USING (url_hash)""", TOP3)
def crawler_pages(spark, d):
    return _pivot(spark, d)


@query("crawler_pages_all", "SELECT * FROM pivoted", TOP3)
def crawler_pages_all(spark, d):
    return _pivot(spark, d, page=None)


@query("crawler_pages_errors", "SELECT * FROM pivoted WHERE status BETWEEN 400 AND 499", TOP3)
def crawler_pages_errors(spark, d):
    return _pivot(spark, d, page=None, status="4xx")


@query("crawler_pages_of_bot", f"""SELECT * FROM pivoted WHERE contains(lower(path), '/de/')
  AND url_hash IN (SELECT url_hash FROM daily WHERE bot = 'ccbot' AND day >= {b.since(30)})""", TOP3)
def crawler_pages_of_bot(spark, d):
    return _pivot(spark, d, page=None, bot="ccbot", search="/De/")


@query("url_crawlers", "SELECT url_hash, p.bot, name, hits, last_seen AS last FROM page_bots p JOIN bots b ON b.bot = p.bot WHERE ai")
def url_crawlers(spark, d):
    return t.url_crawlers(b.page_bots(spark, d), R)


VISITS = "SELECT url_hash, source, CAST(sum(hits) AS BIGINT) AS visits, max(name) AS name FROM referrals JOIN refnames USING (source) WHERE day >= {since} {own} GROUP BY url_hash, source"


@query("url_visits", VISITS.format(since=b.since(30), own=""))
def url_visits(spark, d):
    return t.url_visits(b.referrals(spark, d), R, C)


@query("page_visits", VISITS.format(since=b.since(90), own="AND url_hash = (SELECT max(url_hash) FROM referrals)"))
def page_visits(spark, d):
    """Visits by source of one page over 90 days: the page with the largest hash."""
    sent = b.written(spark, b.referrals(spark, d), "referrals")
    return t.url_visits(sent, R, C, 90, sent.agg(F.max("url_hash")).first()[0])


@query("referral_sources", f"""
SELECT source, CAST(sum(hits) AS BIGINT) AS visits, count(DISTINCT url_hash) AS pages, max(name) AS name
FROM referrals JOIN refnames USING (source) WHERE day >= {b.since(30)} GROUP BY source""")
def referral_sources(spark, d):
    return t.referral_sources(b.referrals(spark, d), R, C)


TOPREF = f"""
topref AS (SELECT source, row_number() OVER (ORDER BY sum(hits) DESC, source) AS k FROM referrals WHERE day >= {b.since(30)} GROUP BY source QUALIFY k <= 3),
refpages AS (SELECT url_hash, max(path) AS path, CAST(sum(hits) AS BIGINT) AS total,
    CAST(coalesce(sum(hits) FILTER (k = 1), 0) AS BIGINT) AS top1, CAST(coalesce(sum(hits) FILTER (k = 2), 0) AS BIGINT) AS top2,
    CAST(coalesce(sum(hits) FILTER (k = 3), 0) AS BIGINT) AS top3, CAST(coalesce(sum(hits) FILTER (k IS NULL), 0) AS BIGINT) AS other,
    (SELECT string_agg(source, ',' ORDER BY k) FROM topref) AS columns
  FROM referrals LEFT JOIN topref USING (source) WHERE day >= {b.since(30)} GROUP BY url_hash)"""


@query("referral_pages", f"""
SELECT x.*, coalesce(bot_hits, 0) AS bot_hits, page_id, title FROM (SELECT * FROM refpages ORDER BY total DESC, path LIMIT 20) x
LEFT JOIN (SELECT url_hash, CAST(sum(hits) AS BIGINT) AS bot_hits FROM daily_pages WHERE day >= {b.since(30)} GROUP BY 1) USING (url_hash)
LEFT JOIN (SELECT url_hash, page_id, title FROM live) USING (url_hash)""", TOPREF)
def referral_pages(spark, d):
    return t.referral_pages(b.referrals(spark, d), b.daily_pages(spark, d), b.inventory(spark, d), C)


@query("referral_pages_of_engine", f"""SELECT * FROM refpages
WHERE url_hash IN (SELECT url_hash FROM referrals WHERE source = 'gemini' AND day >= {b.since(30)})""", TOPREF)
def referral_pages_of_engine(spark, d):
    return t.referral_pages(b.referrals(spark, d), b.daily_pages(spark, d), b.inventory(spark, d), C, page=None, engine="gemini")


@query("crawled_and_cited", f"""
SELECT count(*) FILTER (n > 0 AND h > 0) AS cited, count(*) FILTER (n > 0 AND coalesce(h, 0) = 0) AS read_only,
  count(*) FILTER (e IS NULL) AS never
FROM live LEFT JOIN (SELECT url_hash, sum(hits) AS n FROM daily_pages WHERE day >= {b.since(30)} GROUP BY 1) USING (url_hash)
LEFT JOIN (SELECT url_hash, sum(hits) AS h FROM referrals WHERE day >= {b.since(30)} GROUP BY 1) USING (url_hash)
LEFT JOIN (SELECT url_hash, count(*) AS e FROM page_bots WHERE bot IN (SELECT bot FROM ai) GROUP BY 1) USING (url_hash) WHERE pinned >= 0""")
def crawled_and_cited(spark, d):
    return t.crawled_and_cited(b.inventory(spark, d), b.daily_pages(spark, d), b.referrals(spark, d), b.page_bots(spark, d), R, C)


AI_DAILY = "daily WHERE bot IN (SELECT bot FROM ai)"


@query("assistant_pages", f"""
SELECT x.*, page_id, title FROM (
  SELECT url_hash, max(path) AS path, CAST(sum(hits) AS BIGINT) AS fetches, string_agg(DISTINCT bot, ',' ORDER BY bot) AS bots FROM daily
  WHERE day >= {b.since(30)} AND bot IN (SELECT bot FROM bots WHERE category IN ('ai_user', 'ai_agent'))
  GROUP BY url_hash ORDER BY fetches DESC, path LIMIT 15) x LEFT JOIN (SELECT url_hash, page_id, title FROM live) USING (url_hash)""")
def assistant_pages(spark, d):
    return t.assistant_pages(b.daily(spark, d), b.inventory(spark, d), R, C).withColumn("bots", F.array_join("bots", ","))


@query("never_crawled", f"""SELECT page_id, path, title, importance FROM live WHERE {IMP}
AND url_hash NOT IN (SELECT url_hash FROM page_bots WHERE bot IN (SELECT bot FROM ai))""")
def never_crawled(spark, d):
    return t.never_crawled(b.inventory(spark, d), b.page_bots(spark, d), R, C)


@query("weak_but_popular", f"""
SELECT url_hash, page_id, p.path, title, score, CAST(sum(hits) AS BIGINT) AS hits, count(DISTINCT bot) AS bots
FROM live p JOIN (SELECT url_hash, hits, bot FROM {AI_DAILY} AND day >= {b.since(30)}) USING (url_hash) WHERE score < 60
GROUP BY ALL ORDER BY hits DESC, page_id LIMIT 10""")
def weak_but_popular(spark, d):
    return t.weak_but_popular(b.daily(spark, d), b.inventory(spark, d), R, C)


@query("erroring_pages", f"""
SELECT x.*, page_id, title FROM (SELECT url_hash, max(path) AS path, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(hits) AS BIGINT) AS hits,
  max(last_status) AS status FROM {AI_DAILY} AND day >= {b.since(14)} AND errors > 0 GROUP BY 1 ORDER BY errors DESC, path LIMIT 10) x
LEFT JOIN (SELECT url_hash, page_id, title FROM live) USING (url_hash)""")
def erroring_pages(spark, d):
    return t.erroring_pages(b.daily(spark, d), b.inventory(spark, d), R, C)


@query("slow_pages", f"""
SELECT x.*, page_id, title FROM (SELECT url_hash, max(path) AS path, CAST(sum(hits) AS BIGINT) AS hits,
  CAST(round(sum(ms_total) / greatest(sum(hits), 1)) AS BIGINT) AS avg_ms FROM {AI_DAILY} AND day >= {b.since(30)} GROUP BY 1
  HAVING sum(hits) >= 5 AND round(sum(ms_total) / greatest(sum(hits), 1)) >= 500 ORDER BY avg_ms DESC, path LIMIT 10) x
LEFT JOIN (SELECT url_hash, page_id, title FROM live) USING (url_hash)""")
def slow_pages(spark, d):
    return t.slow_pages(b.daily(spark, d), b.inventory(spark, d), R, C, min_ms=500)


HIST = """CASE WHEN category = 'ai_agent' THEN 'ai_user' ELSE coalesce(category, 'other') END"""
_PERIODS = {"day": "CAST(day AS VARCHAR)", "week": "strftime(day, '%G-W%V')", "month": "strftime(day, '%Y-%m')"}
for _g, _fmt in _PERIODS.items():
    def _history(spark, d, group=_g):
        return t.history(b.daily_bots(spark, d), R, C, 90, group)

    QUERIES[f"history_by_{_g}"] = _history
    ORACLE[f"history_by_{_g}"] = b.sql(f"""
SELECT {_fmt} AS period, {', '.join(f"CAST(coalesce(sum(hits) FILTER ({HIST} = '{c}'), 0) AS BIGINT) AS {c}" for c in t.HISTORY)},
  CAST(sum(spoofed) AS BIGINT) AS spoofed FROM daily_bots LEFT JOIN (SELECT bot, category FROM bots) USING (bot)
WHERE day >= {b.since(90)} GROUP BY 1""")


@query("history_of_crawlers", """
SELECT bot, period, hits, CAST(sum(hits) OVER (PARTITION BY bot) AS BIGINT) AS total FROM (
  SELECT bot, strftime(day, '%G-W%V') AS period, CAST(sum(hits) AS BIGINT) AS hits FROM daily_bots WHERE bot IN (SELECT bot FROM bots WHERE ai) GROUP BY 1, 2)""")
def history_of_crawlers(spark, d):
    return t.history_by_bot(b.daily_bots(spark, d), R, C, 90, "week")


@query("new_crawlers", f"SELECT bot, name, first_seen FROM bots_seen JOIN (SELECT bot, name FROM bots) USING (bot) WHERE first_seen >= {C.from_ts(30)}")
def new_crawlers(spark, d):
    return t.new_crawlers(b.bots_seen(spark, d), R, C, 30)


@query("issue_history", f"""
SELECT period, CAST(sum(o) AS BIGINT) AS opened, CAST(sum(r) AS BIGINT) AS resolved FROM (
  SELECT strftime(to_timestamp(first_seen) AT TIME ZONE 'UTC', '%G-W%V') AS period, 1 AS o, 0 AS r FROM findings WHERE first_seen >= {C.from_ts(90)}
  UNION ALL SELECT strftime(to_timestamp(resolved_at) AT TIME ZONE 'UTC', '%G-W%V'), 0, 1 FROM findings WHERE status = 'resolved' AND resolved_at >= {C.from_ts(90)})
GROUP BY period""")
def issue_history(spark, d):
    return t.issue_history(b.findings(spark, d), C, 90, "week")


@query("crawl_history", f"""
SELECT url_hash, coalesce(hits, 0) AS hits, coalesce(last, 0) AS last, bots, coalesce(referrals, 0) AS referrals FROM (
  SELECT url_hash, CAST(sum(hits) AS BIGINT) AS hits, max(last_seen) AS last, array_to_string(list(bot ORDER BY hits DESC, bot), ',') AS bots
  FROM page_bots WHERE bot IN (SELECT bot FROM ai) GROUP BY 1)
FULL JOIN (SELECT url_hash, CAST(sum(hits) AS BIGINT) AS referrals FROM referrals WHERE day >= {b.day(30)} GROUP BY 1) USING (url_hash)""")
def crawl_history(spark, d):
    return t.crawl_history(b.page_bots(spark, d), b.referrals(spark, d), R, C).withColumn("bots", F.array_join("bots", ","))
