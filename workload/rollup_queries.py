"""Rollups and sessions."""

from pyspark.sql import functions as F

from trailmark.operators import rollups, sessions
from workload import bridge as b

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@query("requests", b.sql("""
SELECT id, ts, CAST(day AS VARCHAR) AS day, bot, cls, vstate, path, url_hash, status, ms, ip_net, ip_hash, ua
FROM requests"""))
def requests(spark, d):
    return b.requests(spark, d).select(
        "id", "ts", b.iso("day").alias("day"), "bot", "cls", "vstate", "path", "url_hash",
        F.col("status").cast("int").alias("status"), "ms", "ip_net", "ip_hash", "ua")


@query("daily", b.sql("SELECT CAST(day AS VARCHAR) AS day, bot, url_hash, path, object_id, hits, errors, ms_total, ms_max, last_status FROM daily"))
def daily(spark, d):
    return b.daily(spark, d).drop("max_id").withColumn("day", b.iso("day"))


@query("daily_pages", b.sql("SELECT CAST(day AS VARCHAR) AS day, url_hash, hits, errors, ms_total FROM daily_pages"))
def daily_pages(spark, d):
    return b.daily_pages(spark, d).withColumn("day", b.iso("day"))


@query("daily_pages_backfill", b.sql("SELECT CAST(day AS VARCHAR) AS day, url_hash, hits, errors, ms_total FROM daily_pages"))
def daily_pages_backfill(spark, d):
    return rollups.daily_pages_from_daily(b.daily(spark, d), b.REGISTRY.ai_ids).withColumn("day", b.iso("day"))


@query("daily_bots", b.sql("SELECT CAST(day AS VARCHAR) AS day, bot, hits, verified, spoofed, errors, ms_total FROM daily_bots"))
def daily_bots(spark, d):
    return b.daily_bots(spark, d).withColumn("day", b.iso("day"))


@query("page_bots", b.sql("SELECT url_hash, bot, path, object_id, first_seen, last_seen, hits, last_status FROM page_bots"))
def page_bots(spark, d):
    return b.page_bots(spark, d).drop("seen")


@query("bots_seen", b.sql("SELECT * FROM bots_seen"))
def bots_seen(spark, d):
    return b.bots_seen(spark, d)


@query("referrals", b.sql("SELECT CAST(day AS VARCHAR) AS day, source, url_hash, path, hits FROM referrals"))
def referrals(spark, d):
    return b.referrals(spark, d).withColumn("day", b.iso("day"))


SESSION_SQL = """
ordered AS (
  SELECT bot, ts, row_number() OVER (PARTITION BY bot ORDER BY ts) AS rn
  FROM (SELECT DISTINCT bot, ts FROM requests WHERE cls IN ('ai', 'search'))),
walk AS (
  SELECT bot, ts, rn, ts AS started FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.bot, o.ts, o.rn,
         CASE WHEN o.ts - w.ts <= {gap} AND o.ts - w.started <= {cap} THEN w.started ELSE o.ts END
  FROM walk w JOIN ordered o ON o.bot = w.bot AND o.rn = w.rn + 1),
sessions AS (
  SELECT r.bot, w.started, max(r.ts) AS ended, count(*) AS hits, count(DISTINCT r.url_hash) AS pages,
         count(DISTINCT r.ip_hash) AS ips, count(*) FILTER (r.status >= 400) AS errors
  FROM requests r JOIN walk w ON w.bot = r.bot AND w.ts = r.ts
  WHERE r.cls IN ('ai', 'search') GROUP BY r.bot, w.started)"""


@query("sessions", b.sql("SELECT * FROM sessions", SESSION_SQL.format(gap=1800, cap=21600), recursive=True))
def crawl_sessions(spark, d):
    return sessions.sessions(b.requests(spark, d))


@query("sessions_capped", b.sql("SELECT * FROM sessions", SESSION_SQL.format(gap=14400, cap=21600), recursive=True))
def crawl_sessions_capped(spark, d):
    """A four-hour gap makes runs of days, so the six-hour cap decides most sessions."""
    return sessions.sessions(b.requests(spark, d), gap=14400)


WEEK_AGO = b.AS_OF - 7 * 86400


@query("new_bots", b.sql(f"""
SELECT bot, min(ts) AS first_seen FROM requests
WHERE cls = 'ai' AND bot NOT IN (SELECT bot FROM requests WHERE bot <> '' AND cls <> 'spoofed' AND ts < {b.AS_OF - 30 * 86400 + 300})
GROUP BY bot"""))
def new_bots(spark, d):
    cube = b.cube(spark, d)
    return rollups.new_bots(cube, rollups.bots_seen(b.cube(spark, d, b.AS_OF - 30 * 86400 + 300)))


@query("first_crawls", b.sql(f"""
SELECT bot, url_hash, min(ts) AS ts, max(path) AS path FROM requests r
WHERE cls = 'ai' AND status < 400 AND NOT EXISTS (
  SELECT 1 FROM requests q WHERE q.bot = r.bot AND q.url_hash = r.url_hash AND q.cls IN ('ai', 'search') AND q.ts < {WEEK_AGO})
GROUP BY bot, url_hash"""))
def first_crawls(spark, d):
    return rollups.first_crawls(b.requests(spark, d), b.page_bots(spark, d, WEEK_AGO))


@query("rollup_merge", b.sql("SELECT CAST(day AS VARCHAR) AS day, bot, url_hash, path, object_id, hits, errors, ms_total, ms_max, last_status FROM daily"))
def rollup_merge(spark, d):
    """Two batches folded apart and merged give the rollup of all events."""
    req = b.requests(spark, d)
    old = rollups.daily(rollups.fold(req.filter(F.col("ts") < WEEK_AGO)))
    new = rollups.daily(rollups.fold(req.filter(F.col("ts") >= WEEK_AGO)))
    return rollups.merge_daily(old.unionByName(new)).drop("max_id").withColumn("day", b.iso("day"))


@query("retained_events", b.sql(f"""
SELECT count(*) AS kept, min(ts) AS oldest FROM requests WHERE NOT (ts < {b.AS_OF - 20 * 86400} AND id <= 1000000000)"""))
def retained_events(spark, d):
    kept = rollups.prune("events", b.requests(spark, d), b.CONFIG.with_(retention_events=20), watermark=10**9)
    return kept.agg(F.count("*").alias("kept"), F.min("ts").alias("oldest"))


@query("flooding_addresses", b.sql("""
SELECT ip_hash, count(*) AS requests FROM requests WHERE vstate <> 'verified' AND ts > """ + str(b.AS_OF - 20 * 86400) + """ GROUP BY ip_hash HAVING count(*) > 15"""))
def flooding_addresses(spark, d):
    """The flood rule over the last twenty days with a threshold this data reaches."""
    return rollups.flooding(b.requests(spark, d), b.CONFIG, 20 * 86400, 15)
