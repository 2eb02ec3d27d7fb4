"""Access logs: combined text and JSON lines, one request per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailmark.config import Config, DAY
from trailmark.functions import agents, net, paths
from trailmark.sources.registry import Registry

# Names of each field in the JSON logs of CDN vendors, first non-empty wins.
JSON_FIELDS = {
    "uri": ["ClientRequestURI", "ClientRequestPath", "request_uri", "uri", "path", "url"],
    "ts": ["EdgeStartTimestamp", "timestamp", "time", "@timestamp", "time_local"],
    "ip": ["ClientIP", "client_ip", "remote_addr", "ip", "clientIp"],
    "method": ["ClientRequestMethod", "request_method", "method"],
    "status": ["EdgeResponseStatus", "OriginResponseStatus", "status", "response_status"],
    "ua": ["ClientRequestUserAgent", "http_user_agent", "user_agent", "userAgent", "ua"],
    "referer": ["ClientRequestReferer", "http_referer", "referer", "referrer"],
    "ms": ["OriginResponseDurationMs", "request_time_ms", "duration_ms"],
}

# Inside quoted parts an escaped quote and an escaped backslash are held as these two characters
# while the line is matched, so the pattern needs no alternation inside a repeat.
_QUOTE, _SLASH = "\x01", "\x02"
_COMBINED = (
    r'^(\S+) \S+ \S+ \[([^\]]+)\] "([^\s"]+) ([^\s"]+)[^"\x01]*" (\d{3}) \S+'
    r'(?: "([^"]*)" "([^"]*)")?(?: (\d+(?:\.\d+)?))?.*$'
)
# The eight groups of a matching line, one match for all of them.
_GROUPS, _MARK = "\x03".join(f"${i}" for i in range(1, 9)), "\x03"
_CLF = r"^\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}$"


def clf_time(text: Column) -> Column:
    """Unix seconds of `10/Oct/2026:13:55:36 +0000`; 0 when malformed. Plain arithmetic on fixed positions."""
    num = lambda at, n: F.substring(text, at, n).try_cast("int")
    month = (F.instr(F.lit("JanFebMarAprMayJunJulAugSepOctNovDec"), F.substring(text, 4, 3)) + 2) / 3
    whole = month == F.floor(month)
    first = F.make_date(num(8, 4), F.greatest(F.lit(1), F.least(F.lit(12), month.cast("int"))), F.lit(1))
    offset = num(23, 2) * 3600 + num(25, 2) * 60
    # a day past the end of its month runs on into the next one
    local = (F.unix_date(first).cast("bigint") + num(1, 2) - 1) * 86400 + num(13, 2) * 3600 + num(16, 2) * 60 + num(19, 2)
    ts = F.when(F.substring(text, 22, 1) == "+", local - offset).otherwise(local + offset)
    return F.coalesce(F.when(text.rlike(_CLF) & whole & (month >= 1), ts), F.lit(0).cast("bigint"))


def json_time(text: Column) -> Column:
    """Epoch numbers of any unit (told apart by size), common log time or ISO text."""
    def epoch(t: Column) -> Column:
        number = t.try_cast("decimal(38,6)")
        scaled = (
            F.when(number > F.lit(10**17), number / 10**9)
            .when(number > F.lit(10**14), number / 10**6)
            .when(number > F.lit(10**11), number / 1000)
            .otherwise(number)
        )
        return F.floor(scaled).cast("bigint")

    return net.let(text, lambda t: F.coalesce(
        F.when(t.rlike(r"^\d+(\.\d+)?$"), epoch(t)).when(t.rlike(r"^\d{2}/\w{3}/\d{4}:"), clf_time(t))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_seconds(t.try_cast("timestamp"))),
        F.lit(0).cast("bigint")))


_FIELDS = ("ts", "ip", "method", "path", "status", "ua", "referer", "ms")


def _request(ts, ip, method, path, status, ua, referer, ms) -> Column:
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(
        ts.alias("ts"), text(ip).alias("ip"), text(method).alias("method"), text(path).alias("path"),
        status.cast("int").alias("status"), text(ua).alias("ua"), text(referer).alias("referer"), ms.cast("bigint").alias("ms"))


def _pick(o: Column, field: str) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(o, F.lit(n)), F.lit("")) for n in JSON_FIELDS[field]])


def _json_path(o: Column) -> Column:
    return F.regexp_replace(_pick(o, "uri"), r"(?i)^https?://[^/]+", "")


def _json_request(o: Column) -> Column:
    ms = _pick(o, "ms")
    return _request(
        json_time(_pick(o, "ts")), _pick(o, "ip"), F.coalesce(_pick(o, "method"), F.lit("GET")), _json_path(o),
        F.coalesce(_pick(o, "status").try_cast("double"), F.lit(0.0)), _pick(o, "ua"), _pick(o, "referer"),
        F.when(ms.isNotNull(), F.coalesce(F.round(ms.try_cast("double")), F.lit(0.0))))


def _held(line: Column) -> Column:
    """The line with escaped quotes and backslashes held back; lines without a backslash as they are."""
    pairs = F.replace(F.translate(line, _QUOTE + _SLASH + _MARK, "   "), F.lit("\\\\"), F.lit(_SLASH))
    return F.when(line.contains("\\"), F.replace(pairs, F.lit('\\"'), F.lit(_QUOTE))).otherwise(line)


def _combined_request(m: Column, escaped: Column) -> Column:
    part = lambda i: F.get(m, F.lit(i - 1))
    restore = lambda c, quote: F.when(escaped, F.replace(F.replace(
        c, F.lit(_QUOTE), F.lit(quote)), F.lit(_SLASH), F.lit("\\\\"))).otherwise(c)
    referer, seconds = part(6), part(8)
    return _request(
        clf_time(part(2)), part(1), part(3), restore(part(4), '\\"'), part(5),
        restore(part(7), '"'), F.when(referer == "-", "").otherwise(restore(referer, '"')),
        F.when(seconds.contains("."), F.round(seconds.try_cast("double") * 1000)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines; the codec (gzip, zstd …) follows the file extension."""
    return spark.read.text(path)


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path)


def parse_combined(lines: DataFrame) -> DataFrame:
    """Requests of combined-format lines. A line is matched once, into an array of its parts."""
    parts = lines.select(
        F.col("line").contains("\\").alias("escaped"),
        F.split(F.regexp_replace(_held(F.col("line")), _COMBINED, _GROUPS), _MARK).alias("m"))
    found = F.when(F.size("m") == 8, F.array(_combined_request(F.col("m"), F.col("escaped"))))
    return parts.select(F.explode(found).alias("r")).select("r.*")


def parse_json(lines: DataFrame) -> DataFrame:
    """Requests of JSON lines; a record needs a time, an address and a path."""
    # a map keeps names apart that differ in case only
    parts = lines.select(F.from_json("line", "map<string, string>").alias("o"))
    found = F.when(F.col("o").isNotNull(), F.array(_json_request(F.col("o"))))
    return parts.select(F.explode(found).alias("r")).filter("r.ts > 0 and r.path <> '' and r.ip <> ''").select("r.*")


def parse_lines(lines: DataFrame, kind: str = "auto") -> DataFrame:
    """Parsed requests; rows without a request (blank, malformed) are dropped.

    `kind` is 'combined', 'json' or 'auto'. Auto reads the lines once per
    format and keeps each line for its own parser; name the format when a
    folder holds only one, as log folders do.
    """
    v = F.col("value")
    usable = lines.filter(F.length(v) > 0).select(
        F.when(v.endswith("\r"), F.substr(v, F.lit(1), F.length(v) - 1)).otherwise(v).alias("line"))
    is_json = F.col("line").startswith("{")
    parsers = {"combined": (parse_combined, ~is_json), "json": (parse_json, is_json)}
    wanted = parsers if kind == "auto" else {kind: parsers[kind]}
    frames = [parse(usable.filter(own)) for parse, own in wanted.values()]
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def worth_keeping(registry: Registry, ua: Column, referer: Column) -> Column:
    """Lines of automated clients, and visits an assistant sent."""
    tokens = agents.token_pattern(registry)
    named = ua.rlike("(?i)" + tokens) if tokens else F.lit(False)
    host = F.lower(F.regexp_extract(referer, r"(?i)^https?://([^/:?#]+)", 1))
    referred = host.isin(*registry.hosts) if registry.hosts else F.lit(False)
    return named | ua.rlike("(?i)" + registry.bot_pattern) | referred


def prefilter(requests: DataFrame, registry: Registry) -> DataFrame:
    ua, referer = F.col("ua"), F.col("referer")
    return requests.filter(((ua != "") | (referer != "")) & worth_keeping(registry, ua, referer))


def with_disposition(requests: DataFrame, config: Config) -> DataFrame:
    """Validate each request: `ok`, `invalid`, `too_old` or `no_user_agent`."""
    oldest = config.as_of - config.retention_history * DAY
    ua = F.coalesce("ua", F.lit(""))
    path = F.coalesce("path", F.lit(""))
    status = F.coalesce(F.col("status"), F.lit(0))
    ts = F.coalesce(F.col("ts"), F.lit(0))
    bad = (
        (ts <= 0) | (ts > config.as_of + 300) | (path == "") | ~status.between(100, 999)
        | (F.octet_length(ua) > 2000) | (F.octet_length(path) > 4000)
        | ~net.is_ip(F.coalesce("ip", F.lit("")))
    )
    letters = F.upper(F.substring(F.regexp_replace(F.coalesce("method", F.lit("GET")), "[^A-Za-z]", ""), 1, 7))
    return requests.select(
        "*",
        F.when(bad, "invalid").when(ts < oldest, "too_old").when(F.trim(ua) == "", "no_user_agent")
        .otherwise("ok").alias("disposition"),
    ).withColumns({
        "method": F.when(letters == "", "GET").otherwise(letters),
        "ms": F.least(F.greatest(F.coalesce(F.col("ms"), F.lit(0)), F.lit(0)), F.lit(600000)).cast("bigint"),
    })


def disposition_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("disposition").agg(F.count("*").alias("requests"))


def new_batches(requests: DataFrame, imported: DataFrame) -> DataFrame:
    """Idempotent import: batches whose (file_key, batch) is already recorded are left out."""
    return requests.join(imported.select("file_key", "batch").distinct(), ["file_key", "batch"], "left_anti")


def read_access_logs(spark: SparkSession, path: str, config: Config, kind: str = "auto") -> DataFrame:
    return with_disposition(parse_lines(read_lines(spark, path), kind), config)
