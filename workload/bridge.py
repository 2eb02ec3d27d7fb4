"""Request, referral and inventory tables derived from the driver's `events` and `pages`.

Integer arithmetic only, so Spark and the SQL oracle derive the same rows.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trailmark.config import Config, DAY
from trailmark.functions import html, paths
from trailmark.operators import rollups
from trailmark.sources.pages import read_wide
from trailmark.sources.registry import Registry, lookup

AS_OF = 1706659200  # 2024-01-31 00:00:00 UTC
CONFIG = Config(as_of=AS_OF, monitoring_since=AS_OF - 60 * DAY)
REGISTRY = Registry.seed()

BOTS = ["gptbot", "oai-searchbot", "chatgpt-user", "claudebot", "perplexitybot", "perplexity-user",
        "meta-externalagent", "bytespider", "ccbot", "amazonbot", "googlebot", ""]
SOURCES = ["chatgpt", "perplexity", "gemini", "copilot"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def wide_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table with long text, spread over the cores when it is small."""
    return read_wide(spark, f"{d}/{name}.parquet")


def epoch():
    """Unix seconds of the UTC wall-clock column `ts`, whatever the session time zone is."""
    return F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")


def page_paths(spark: SparkSession, d: str) -> DataFrame:
    path = paths.normalize_path(F.col("url"))
    return table(spark, d, "pages").select("page_id", path.alias("path")).withColumn(
        "url_hash", paths.url_hash(F.col("path")))


def _page_count(spark: SparkSession, d: str):
    """Number of pages as a scalar subquery."""
    return table(spark, d, "pages").agg(F.count("*")).scalar()


def requests(spark: SparkSession, d: str, before: int | None = None) -> DataFrame:
    """The event table: classified, verified requests with their page."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id")
    n = _page_count(spark, d)
    k = F.col("user_id") % 12
    bot = F.get(F.array(*[F.lit(b) for b in BOTS]), k.cast("int"))
    spoofed = (F.col("event_id") % 20 == 0) & (k != 11)
    m = F.col("event_id") % n
    rows = e.select(
        F.col("event_id").alias("id"), epoch().alias("ts"), bot.alias("bot"),
        F.when(k == 11, "unknown").when(spoofed, "spoofed").when(k == 10, "search").otherwise("ai").alias("cls"),
        F.when(spoofed, "failed").when((F.col("event_id") % 3 == 0) | (k == 11), "none").otherwise("verified")
        .alias("vstate"),
        F.lit("GET").alias("method"),
        F.when(F.col("event_id") % 97 == 0, 503).when(F.col("event_id") % 31 == 0, 404).otherwise(200)
        .cast("int").alias("status"),
        (F.lit(50) + F.col("event_id") % 900).alias("ms"),
        (m * m % n).alias("page_id"),
        F.when(spoofed, F.concat(F.lit("198.51.100."), (F.col("event_id") % 250).cast("string")))
        .otherwise(F.concat(F.lit("203.0.113."), (F.col("user_id") % 250).cast("string"))).alias("ip"),
    )
    if before is not None:
        rows = rows.filter(F.col("ts") < before)
    names = {b: (REGISTRY.get(b) or {}).get("name", "") for b in BOTS if b}
    token = lookup(names, F.col("bot"))
    return rows.join(page_paths(spark, d), "page_id").withColumns({
        "day": F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts") / 86400).cast("int")),
        "ip_hash": F.substring(F.md5("ip"), 1, 16),
        "ip_net": F.concat(F.substring_index("ip", ".", 3), F.lit(".0/24")),
        "ua": F.when(F.col("bot") == "", "python-requests/2.32").otherwise(
            F.concat(F.lit("Mozilla/5.0 (compatible; "), token, F.lit("/1.0)"))),
        "kind": paths.path_kind(F.col("path")),
        "source": F.lit("live"),
        "object_id": F.col("page_id"),
    })


def visits(spark: SparkSession, d: str, before: int | None = None) -> DataFrame:
    """Human visits an assistant sent."""
    e = table(spark, d, "events").filter("event_type = 'click'").select("event_id", "ts", "user_id")
    rows = e.select(
        F.get(F.array(*[F.lit(s) for s in SOURCES]), (F.col("user_id") % 4).cast("int")).alias("referral"),
        epoch().alias("ts"),
        (F.col("event_id") * 7 % _page_count(spark, d)).alias("page_id"),
    )
    if before is not None:
        rows = rows.filter(F.col("ts") < before)
    return rows.join(page_paths(spark, d), "page_id").withColumn(
        "day", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts") / 86400).cast("int")))


def cube(spark, d, before=None):
    return rollups.fold(requests(spark, d, before))


def daily(spark, d, before=None):
    return rollups.daily(cube(spark, d, before))


def daily_pages(spark, d):
    return rollups.daily_pages(cube(spark, d))


def daily_bots(spark, d, before=None):
    return rollups.daily_bots(cube(spark, d, before))


def page_bots(spark, d, before=None):
    return rollups.page_bots(cube(spark, d, before))


def bots_seen(spark, d):
    return rollups.bots_seen(cube(spark, d))


def referrals(spark, d, before=None):
    return rollups.referrals(visits(spark, d, before))


def titles(spark: SparkSession, d: str) -> DataFrame:
    raw = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return table(spark, d, "pages").select("page_id", html.decode_entities(raw).alias("title"))


def inventory(spark: SparkSession, d: str) -> DataFrame:
    """One row per path (the lowest page id), with attributes derived from the page id."""
    pid = F.col("page_id")
    first = Window.partitionBy("url_hash").orderBy("page_id")
    # the projection to short columns happens before the shuffle, so no HTML travels
    rows = table(spark, d, "pages").select(
        "page_id", paths.normalize_path(F.col("url")).alias("path"),
        html.decode_entities(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
    ).withColumn("url_hash", paths.url_hash(F.col("path")))
    one = rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    return one.withColumns({
        "object_type": F.when(pid == 0, "home").otherwise("post"),
        "object_id": pid,
        "subtype": F.when(pid % 5 == 0, "page").when(pid % 5 == 1, "product").otherwise("post"),
        "importance": pid % 100,
        "pinned": F.when(pid % 50 == 0, 1).when(pid % 50 == 49, -1).otherwise(0),
        "score": F.when(pid % 29 != 0, pid * 37 % 101),
        "inlinks": pid % 7,
        "word_count": pid * 13 % 1500,
        "noindex": pid % 41 == 0,
        "http_status": F.when(pid % 37 == 0, 404).when(pid % 23 == 0, 0).otherwise(200),
        "modified": F.lit(AS_OF) - pid % 500 * DAY,
        "deleted": pid % 61 == 60,
        "analyzed": pid % 17 != 16,
    })


FINDING_RULES = [
    # code, severity, bot, rule over the inventory
    ("noindex", "critical", "", "noindex"),
    ("http_error", "critical", "", "http_status >= 400"),
    ("thin_content", "warning", "", "word_count < 300"),
    ("orphan", "warning", "", "inlinks = 0"),
    ("few_inlinks", "info", "", "inlinks between 1 and 2"),
    ("bot_errors", "critical", "gptbot", "page_id % 9 = 0"),
    ("never_crawled", "warning", "", "page_id % 11 = 0"),
]


def findings(spark: SparkSession, d: str) -> DataFrame:
    """A findings table with a mix of states."""
    each = F.array(*[
        F.when(F.expr(rule), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.lit(bot).alias("bot")))
        for code, sev, bot, rule in FINDING_RULES])
    pid = F.col("page_id")
    status = F.when(pid % 10 == 0, "ignored").when(pid % 7 == 0, "resolved").otherwise("open")
    return inventory(spark, d).select("page_id", F.explode(F.array_compact(each)).alias("f")).select(
        "page_id", "f.*", F.lit("observed").alias("kind"), status.alias("status"),
        (F.lit(AS_OF) - pid % 80 * DAY).alias("first_seen"), F.lit(AS_OF - DAY).cast("bigint").alias("last_seen"),
        F.when(status == "resolved", F.lit(AS_OF) - pid % 60 * DAY).alias("resolved_at"))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for files a query writes, in the cluster's shared folder; a temporary one on a local master only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return os.path.join(shared, f"trailmark-{name}-{uuid.uuid4().hex}")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"spark-{name}-")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """An input table as a job would find it: written once, read by whatever needs it."""
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


# ------------------------------------------------------------------ oracle

def _values(items) -> str:
    return ", ".join("(%s)" % ", ".join(_lit(x) for x in row) for row in items)


def _lit(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, int):
        return str(x)
    return "'" + str(x).replace("'", "''") + "'"


def _bot_rows():
    for i, b in enumerate(REGISTRY.bots):
        yield (b["id"], b["name"], b["provider"], b["category"], b["ai"], b["robots_only"],
               (b["robots_tokens"] or [None])[0], b["confidence"],
               bool(b["ranges"] or b["rdns"] or b["signature_hosts"]), i)


PATH_SQL = """CASE WHEN regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN '/'
    ELSE regexp_replace(regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') END"""

_BOT_CASE = "CASE user_id % 12 " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BOTS)) + " END"
_SOURCE_CASE = "CASE user_id % 4 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SOURCES)) + " END"

ENTITIES = [("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]


def unescape_sql(expr: str) -> str:
    """Decode the entities that occur in the driver's pages."""
    for had, want in ENTITIES:
        expr = f"replace({expr}, '{had}', '{want}')"
    return expr


TITLE_SQL = unescape_sql("regexp_extract(html, '<title>(.*?)</title>', 1)")
FINDING_SQL = " UNION ALL ".join(
    f"SELECT page_id, {_lit(c)} AS code, {_lit(sev)} AS severity, {_lit(bot)} AS bot FROM inventory WHERE {rule}"
    for c, sev, bot, rule in FINDING_RULES)

BASE = f"""
bots(bot, name, provider, category, ai, robots_only, token, confidence, verifiable, ord) AS
  (SELECT * FROM (VALUES {_values(_bot_rows())})),
refnames(source, name) AS (SELECT * FROM (VALUES {_values((r['id'], r['name']) for r in REGISTRY.referrers)})),
page_paths AS (
  SELECT page_id, path, md5(lower(path)) AS url_hash
  FROM (SELECT page_id, {PATH_SQL.format(u='url')} AS path FROM pages)),
page_total AS (SELECT count(*) AS n FROM pages),
raw_requests AS (
  SELECT event_id AS id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS ts, CAST(ts AS DATE) AS day,
         {_BOT_CASE} AS bot,
         CASE WHEN user_id % 12 = 11 THEN 'unknown' WHEN event_id % 20 = 0 THEN 'spoofed'
              WHEN user_id % 12 = 10 THEN 'search' ELSE 'ai' END AS cls,
         CASE WHEN event_id % 20 = 0 AND user_id % 12 <> 11 THEN 'failed'
              WHEN event_id % 3 = 0 OR user_id % 12 = 11 THEN 'none' ELSE 'verified' END AS vstate,
         'GET' AS method,
         CASE WHEN event_id % 97 = 0 THEN 503 WHEN event_id % 31 = 0 THEN 404 ELSE 200 END AS status,
         50 + event_id % 900 AS ms,
         ((event_id % n) * (event_id % n)) % n AS page_id,
         CASE WHEN event_id % 20 = 0 AND user_id % 12 <> 11 THEN '198.51.100.' || (event_id % 250)
              ELSE '203.0.113.' || (user_id % 250) END AS ip
  FROM events, page_total),
requests AS (
  SELECT r.*, p.path, p.url_hash, substr(md5(r.ip), 1, 16) AS ip_hash,
         regexp_replace(r.ip, '\\.[0-9]+$', '.0/24') AS ip_net,
         CASE WHEN r.bot = '' THEN 'python-requests/2.32'
              ELSE 'Mozilla/5.0 (compatible; ' || b.name || '/1.0)' END AS ua,
         r.page_id AS object_id
  FROM raw_requests r JOIN page_paths p USING (page_id) LEFT JOIN bots b ON b.bot = r.bot),
daily AS (
  SELECT day, bot, url_hash, max(path) AS path, max(object_id) AS object_id, count(*) AS hits,
         count(*) FILTER (status >= 400) AS errors, CAST(sum(ms) AS BIGINT) AS ms_total, max(ms) AS ms_max,
         arg_max(status, id) AS last_status
  FROM requests WHERE cls IN ('ai', 'search') GROUP BY day, bot, url_hash),
daily_pages AS (
  SELECT day, url_hash, count(*) AS hits, count(*) FILTER (status >= 400) AS errors,
         CAST(sum(ms) AS BIGINT) AS ms_total
  FROM requests WHERE cls = 'ai' GROUP BY day, url_hash),
daily_bots AS (
  SELECT day, CASE WHEN bot = '' THEN '_unknown' ELSE bot END AS bot,
         count(*) FILTER (cls <> 'spoofed') AS hits,
         count(*) FILTER (cls <> 'spoofed' AND vstate = 'verified') AS verified,
         count(*) FILTER (cls = 'spoofed') AS spoofed,
         count(*) FILTER (cls <> 'spoofed' AND status >= 400) AS errors,
         CAST(sum(CASE WHEN cls <> 'spoofed' THEN ms ELSE 0 END) AS BIGINT) AS ms_total
  FROM requests GROUP BY 1, 2),
page_bots AS (
  SELECT url_hash, bot, max(path) AS path, max(object_id) AS object_id, min(ts) AS first_seen,
         max(ts) AS last_seen, count(*) AS hits,
         arg_max(status, ts::HUGEINT * 1000000000000 + id) AS last_status
  FROM requests WHERE cls IN ('ai', 'search') GROUP BY url_hash, bot),
bots_seen AS (
  SELECT bot, min(ts) FILTER (cls <> 'spoofed') AS first_seen, max(ts) FILTER (cls <> 'spoofed') AS last_seen,
         count(*) FILTER (cls <> 'spoofed') AS hits,
         count(*) FILTER (cls <> 'spoofed' AND vstate = 'verified') AS verified,
         count(*) FILTER (cls = 'spoofed') AS spoofed
  FROM requests WHERE bot <> '' GROUP BY bot HAVING count(*) FILTER (cls <> 'spoofed') > 0),
visits AS (
  SELECT {_SOURCE_CASE} AS source, CAST(ts AS DATE) AS day, (event_id * 7) % n AS page_id
  FROM events, page_total WHERE event_type = 'click'),
referrals AS (
  SELECT day, source, url_hash, max(path) AS path, count(*) AS hits
  FROM visits JOIN page_paths USING (page_id) GROUP BY day, source, url_hash),
ai AS (SELECT bot FROM bots WHERE ai UNION ALL SELECT '_signed'),
inventory AS (
  SELECT page_id, path, url_hash, {TITLE_SQL} AS title,
         CASE WHEN page_id = 0 THEN 'home' ELSE 'post' END AS object_type, page_id AS object_id,
         CASE page_id % 5 WHEN 0 THEN 'page' WHEN 1 THEN 'product' ELSE 'post' END AS subtype,
         page_id % 100 AS importance,
         CASE WHEN page_id % 50 = 0 THEN 1 WHEN page_id % 50 = 49 THEN -1 ELSE 0 END AS pinned,
         CASE WHEN page_id % 29 <> 0 THEN page_id * 37 % 101 END AS score,
         page_id % 7 AS inlinks, page_id * 13 % 1500 AS word_count, page_id % 41 = 0 AS noindex,
         CASE WHEN page_id % 37 = 0 THEN 404 WHEN page_id % 23 = 0 THEN 0 ELSE 200 END AS http_status,
         {AS_OF} - page_id % 500 * 86400 AS modified, page_id % 61 = 60 AS deleted, page_id % 17 <> 16 AS analyzed
  FROM page_paths JOIN pages USING (page_id)
  QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY page_id) = 1),
live AS (SELECT * FROM inventory WHERE NOT deleted),
findings AS (
  SELECT page_id, code, severity, bot, 'observed' AS kind,
         CASE WHEN page_id % 10 = 0 THEN 'ignored' WHEN page_id % 7 = 0 THEN 'resolved' ELSE 'open' END AS status,
         {AS_OF} - page_id % 80 * 86400 AS first_seen, {AS_OF - 86400} AS last_seen,
         CASE WHEN page_id % 10 <> 0 AND page_id % 7 = 0 THEN {AS_OF} - page_id % 60 * 86400 END AS resolved_at
  FROM ({FINDING_SQL}))
"""


def sql(body: str, extra: str = "", recursive: bool = False) -> str:
    """A complete oracle statement: shared derived tables, extra ones, then the query."""
    more = f",\n{extra.strip()}" if extra.strip() else ""
    return f"WITH {'RECURSIVE ' if recursive else ''}{BASE.strip()}{more}\n{body.strip()}"


def day(offset: int) -> str:
    """DATE literal `offset` days before as_of."""
    return f"DATE '{CONFIG.back(offset).isoformat()}'"


def since(days: int) -> str:
    return f"DATE '{CONFIG.since(days).isoformat()}'"


def iso(col):
    """Days travel as text, so both engines compare the same value."""
    return F.date_format(col, "yyyy-MM-dd")
