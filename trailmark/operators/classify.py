"""Requests + registry -> classified, routed, de-duplicated events and referrals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailmark.config import Config
from trailmark.functions import agents, net, paths
from trailmark.sources.registry import Registry


def classify_requests(requests: DataFrame, registry: Registry, config: Config,
                      address_bots: DataFrame | None = None) -> DataFrame:
    """Add bot, cls, path, url_hash, kind, day, ip_net, ip_hash and the referral source.

    `address_bots` (ip, address_bot) names the address-only agents found by
    `verify.address_only`.
    """
    req = requests
    if address_bots is not None:
        req = req.join(address_bots, "ip", "left")
    uri = F.col("path")
    req = req.filter(~paths.excluded(uri, config.exclude_paths))
    req = agents.with_agent(
        req, registry, "signature_agent" if "signature_agent" in req.columns else None,
        "address_bot" if address_bots is not None else None)
    visitor = F.lit(config.track_referrals) & (F.col("cls") == "human")
    referer = F.coalesce("referer", F.lit(""))
    req = req.withColumns({
        "_ref": F.when(visitor, F.when(F.col("source") == "log", paths.referral_source(registry, referer))
                       .otherwise(paths.referral_source(registry, referer, uri))),
        "path": paths.normalize_path(uri),
        "ua": paths.clean(F.col("ua")),
    })
    ip = F.coalesce("ip", F.lit(""))
    kind = paths.path_kind(F.col("path"))
    hit = (F.col("method") == "GET") & (F.col("status") < 400)
    # imported visits count on ordinary pages only, live ones on everything but assets
    counted = hit & F.when(F.col("source") == "log", kind == "").otherwise(kind != "asset")
    return req.withColumns({
        "url_hash": paths.url_hash(F.col("path")),
        "kind": kind,
        "day": local_day(F.col("ts"), config.tz),
        "ip_net": net.ip_network(ip) if config.ip_storage == "network" else F.lit(""),
        "ip_hash": net.ip_hash(ip, config.secret),
        "referral": F.when(F.col("_ref").isNotNull() & counted, F.col("_ref")),
    }).drop("_ref", *(["address_bot"] if address_bots is not None else []))


def local_day(ts: Column, tz: str) -> Column:
    """Site-local calendar day of unix seconds, whatever the session time zone is."""
    if tz.upper() == "UTC":
        return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts / 86400).cast("int"))
    ntz = F.convert_timezone(F.lit("UTC"), F.lit(tz), utc_ntz(ts))
    return F.to_date(ntz)


def utc_ntz(ts: Column) -> Column:
    """Unix seconds as a UTC wall-clock timestamp without time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=ts.cast("decimal(18,6)"))


def dedup_key() -> Column:
    """Same second, address, page, method and agent = the same request."""
    return F.md5(F.concat_ws("|", F.col("ts").cast("string"), "ip_hash", F.lower("path"), "method", "ua"))


def with_route(events: DataFrame, config: Config, throttled: DataFrame | None = None) -> DataFrame:
    """`event` rows are stored per page; `counter` rows only count per day and bot; `none` are not kept."""
    cls = F.col("cls")
    per_page = cls.isin("ai", "spoofed", "potential")
    if config.track_search_pages:
        per_page = per_page | (cls == "search")
    flooding = F.lit(False)
    if throttled is not None:
        # one row per flooding address: a small list by the rule that makes it
        mark = throttled.select("ip_hash").distinct().withColumn("flooding", F.lit(True))
        events = events.join(mark, "ip_hash", "left")
        flooding = F.coalesce("flooding", F.lit(False))
    route = (
        F.when(cls == "human", "none")
        .when(per_page & ~flooding, "event")
        .when(F.col("source") == "log", "none")  # counters cannot be de-duplicated
        .otherwise("counter")
    )
    out = events.withColumn("route", route)
    return out.drop("flooding") if throttled is not None else out


def deduplicate(events: DataFrame) -> DataFrame:
    """One row per request: the live row before the imported one, then the lowest id."""
    first = Window.partitionBy("dedup").orderBy(F.when(F.col("source") == "live", 0).otherwise(1), "id")
    return events.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def union_sources(live: DataFrame, imported: DataFrame) -> DataFrame:
    return live.withColumn("source", F.lit("live")).unionByName(
        imported.withColumn("source", F.lit("log")), allowMissingColumns=True
    )


def store_events(classified: DataFrame, config: Config, throttled: DataFrame | None = None) -> DataFrame:
    """The event table: routed per-page requests without duplicates."""
    routed = with_route(classified, config, throttled).filter("route = 'event'")
    return deduplicate(routed.withColumn("dedup", dedup_key()))


def event_view(events: DataFrame, registry: Registry) -> DataFrame:
    """Events as shown to a reader, with the confidence of the label."""
    return events.select(
        "id", "ts", "bot", registry.label(F.col("bot")).alias("name"), "method", "path", "status", "ms",
        "cls", "vstate",
        agents.confidence(registry, F.col("cls"), F.col("vstate"), F.col("bot")).alias("conf"),
        F.col("ip_net").alias("net"), "source",
    )
