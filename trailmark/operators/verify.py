"""Is a crawler who it claims to be? Address ranges, DNS tables, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from trailmark.config import Config, DAY
from trailmark.functions import net
from trailmark.sources import ranges as rng
from trailmark.sources.registry import Registry, lookup
from trailmark.storage import kept

VERDICT_TTL = {"verified": 7 * DAY, "failed": DAY}
GIVE_UP = 2 * DAY
MAX_RETRIES = 3
#: Merged intervals (some 100 bytes each) and verdict spans that every executor may hold.
IN_SCAN = 250_000


def range_verdicts(requests: DataFrame, bot_ranges: DataFrame, config: Config) -> DataFrame:
    """(bot, ip) -> `verified`, `failed` (a fresh file, address outside) or absent (no usable file).

    Works on the distinct (bot, ip) pairs, so a crawler with a third of the
    traffic costs one lookup per address. `bot_ranges`: bot, file, cidr, fetched_at.
    """
    pairs = requests.filter("bot <> '' and ip <> ''").select("bot", "ip").distinct()
    keyed = pairs.withColumn("key", net.ip_key(F.col("ip"))).filter("key is not null")
    probes = keyed.select("bot", "ip", "key", F.explode(rng.lookup_keys(F.col("key"))).alias("bucket"))
    table = rng.bucketed(bot_ranges).select("bot", "bucket", "lo", "hi")
    inside = (
        probes.join(table, ["bot", "bucket"])
        .filter(F.col("key").between(F.col("lo"), F.col("hi"))).select("bot", "ip").distinct()
        .withColumn("inside", F.lit(True))
    )
    fresh = bot_ranges.groupBy("bot").agg(
        F.max(F.col("fetched_at") > config.as_of - rng.FRESH_DAYS * DAY).alias("fresh")
    )
    return (
        pairs.join(inside, ["bot", "ip"], "left").join(fresh, "bot", "left")
        .select("bot", "ip",
                F.when(F.col("inside"), "verified").when(F.col("fresh"), "failed").alias("by_range"))
        .filter("by_range is not null")
    )


def merged_ranges(bot_ranges: DataFrame) -> DataFrame:
    """bot, lo, hi: each crawler's ranges as disjoint intervals of address keys."""
    r = bot_ranges.select("bot", net.cidr_bounds(F.col("cidr")).alias("b")).filter("b is not null").select("bot", "b.lo", "b.hi").distinct()
    order = Window.partitionBy("bot").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = r.withColumn("opens", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0))
    run = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("run", run).groupBy("bot", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


#: Characters of an address key (family and hex digits) under which an interval is filed: the longest that its ends share.
LEVELS = {"4": (7, 5, 3), "6": (13, 9, 3)}


def _filed(merged: DataFrame) -> list[DataFrame]:
    """The intervals by level, narrow to wide: bot, bucket, lo, hi. A wide one is filed under every first octet it covers."""
    family = F.substring("lo", 1, 1)
    part = lambda c, level: F.when(family == "4", F.substring(c, 1, LEVELS["4"][level])).otherwise(F.substring(c, 1, LEVELS["6"][level]))
    same = lambda level: part("lo", level) == part("hi", level)
    octet = lambda c: F.conv(F.substring(c, 2, 2), 16, 10).cast("int")
    octets = F.transform(F.sequence(octet("lo"), octet("hi")), lambda o: F.concat(family, F.lower(F.lpad(F.hex(o), 2, "0"))))
    return [
        merged.filter(same(0)).withColumn("bucket", part("lo", 0)),
        merged.filter(~same(0) & same(1)).withColumn("bucket", part("lo", 1)),
        merged.filter(~same(1)).withColumn("bucket", F.explode(octets)),
    ]


def in_scan_verdicts(requests: DataFrame, bot_ranges: DataFrame, config: Config) -> DataFrame | None:
    """`requests` with by_range, decided where the rows are read; None where the intervals are too many for that.

    Intervals of one crawler are disjoint, so whichever level they are filed under, a request meets at most one and
    stays one row: three broadcast joins on (crawler, leading digits) with the bounds as a residual, no exchange of
    requests. A bucket holds a few hundred intervals at most.
    """
    merged = kept(merged_ranges(bot_ranges))
    if merged.count() > IN_SCAN:
        return None
    out = requests.withColumn("_key", net.ip_key(F.col("ip")))
    for level, side in enumerate(_filed(merged)):
        names = [f"_{c}{level}" for c in ("bot", "lo", "hi", "bucket")]
        side = F.broadcast(side.select("bot", "lo", "hi", "bucket").toDF(*names))
        v4, v6 = LEVELS["4"][level], LEVELS["6"][level]
        bucket = F.when(F.col("_key").startswith("4"), F.substring("_key", 1, v4)).otherwise(F.substring("_key", 1, v6))
        on = (F.col("bot") == F.col(names[0])) & (bucket == F.col(names[3])) & F.col("_key").between(F.col(names[1]), F.col(names[2]))
        out = out.join(side, on, "left").drop(names[0], names[2], names[3])
    fresh = bot_ranges.groupBy("bot").agg(F.max(F.col("fetched_at") > config.as_of - rng.FRESH_DAYS * DAY).alias("_fresh")).withColumnRenamed("bot", "_file_bot")
    out = out.join(F.broadcast(fresh), F.col("bot") == F.col("_file_bot"), "left")  # a row per crawler
    inside = F.coalesce("_lo0", "_lo1", "_lo2").isNotNull()
    asked = (F.coalesce("bot", F.lit("")) != "") & (F.coalesce("ip", F.lit("")) != "")
    return out.withColumn("by_range", F.when(asked & inside, "verified").when(asked & F.col("_fresh"), "failed")).drop(
        "_key", "_lo0", "_lo1", "_lo2", "_fresh", "_file_bot")


def address_only(requests: DataFrame, bot_ranges: DataFrame) -> DataFrame:
    """(ip, address_bot): agents recognised by address alone, first in registry order.

    `bot_ranges` carries bot_order and ip_only. The bucket join serves lists of any length.
    """
    own = bot_ranges.filter("ip_only")
    keyed = (
        requests.filter("ip <> ''").select("ip").distinct()
        .withColumn("key", net.ip_key(F.col("ip"))).filter("key is not null")
    )
    probes = keyed.select("ip", "key", F.explode(rng.lookup_keys(F.col("key"))).alias("bucket"))
    table = rng.bucketed(own).select("bot", "bot_order", "bucket", "lo", "hi")
    return (
        probes.join(table, "bucket").filter(F.col("key").between(F.col("lo"), F.col("hi")))
        .groupBy("ip").agg(F.min_by("bot", "bot_order").alias("address_bot"))
    )


def valid_verdicts(verdicts: DataFrame, config: Config) -> DataFrame:
    """Cached verdicts still trusted: a pass for a week, a failure for a day."""
    ttl = lookup(VERDICT_TTL, F.col("verdict"))
    # of several, the newest; of those checked in the same second, the failure
    return verdicts.filter(F.col("checked_at") > F.lit(config.as_of) - ttl).groupBy("ip_hash", "bot").agg(
        F.max_by("verdict", F.struct("checked_at", F.col("verdict") == "failed")).alias("cached"))


def verdict_spans(verdicts: DataFrame) -> DataFrame:
    """ip_hash, bot, since, until, cached: when each verdict is the one to go by (`until` excluded).

    A newer verdict takes the place of an older one, whether it is still trusted or not; of those checked in the same
    second a failure counts.
    """
    one = verdicts.groupBy("ip_hash", "bot", "checked_at").agg(F.max_by("verdict", F.col("verdict") == "failed").alias("cached"))
    key = Window.partitionBy("ip_hash", "bot").orderBy("checked_at")
    trusted = F.col("checked_at") + lookup(VERDICT_TTL, F.col("cached"))
    until = F.least(trusted, F.lead("checked_at").over(key))
    return one.select("ip_hash", "bot", F.col("checked_at").alias("since"), until.alias("until"), "cached")


def _few(spans: DataFrame) -> bool:
    """Whether the spans fit every executor (those of a week have eight days at most)."""
    return len(spans.select("since").take(IN_SCAN + 1)) <= IN_SCAN


def as_of_verdicts(requests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """`requests` (ip_hash, bot, ts, ...) with `cached`: the verdict trusted at the time of each request, if any.

    Spans of one key never overlap and none is longer than a week, so each is entered under the days it touches and a
    request meets at most one: an equality on key and day, with the second as a residual. The span side has few rows
    per key and day; a hot address only makes its request side large, which is split freely.
    """
    day = lambda c: F.floor(c / DAY)
    spans = verdict_spans(verdicts).filter("since < until")
    days = spans.withColumn("_on", F.explode(F.sequence(day(F.col("since")), day(F.col("until") - 1))))
    days = (F.broadcast(days) if _few(spans) else days).withColumnsRenamed({"ip_hash": "_hash", "bot": "_bot"})
    keyed = requests.withColumn("_day", day(F.col("ts")))
    met = (F.col("ip_hash") == F.col("_hash")) & (F.col("bot") == F.col("_bot")) & (F.col("_day") == F.col("_on")) & (F.col("ts") >= F.col("since")) & (F.col("ts") < F.col("until"))
    return keyed.join(days, met, "left").drop("_hash", "_bot", "_on", "_day", "since", "until")


def decide(events: DataFrame, registry: Registry, config: Config) -> DataFrame:
    """vstate and the pending check, from by_range, cached and proxy_suspected columns."""
    has_rdns = lookup({b["id"]: True for b in registry.bots if b["rdns"]}, F.col("bot"))
    rdns = F.coalesce(has_rdns, F.lit(False)) & F.lit(config.verify_rdns)
    known = F.coalesce(registry.attr(F.col("bot"), "id").isNotNull(), F.lit(False))
    checked = F.col("cls").isin("ai", "search", "known")
    ask_rdns = rdns & F.col("cached").isNull()
    proxied = F.col("proxy_suspected") & (F.col("source") == "live")
    vstate = (
        F.when(~checked, "none")
        .when(F.col("by_address"), "verified")
        .when(F.col("sig"), "pending" if config.verify_signatures else "none")
        .when(~known | (F.coalesce("ip", F.lit("")) == ""), "none")
        .when(F.col("by_range") == "verified", "verified")
        .when(proxied, "none")
        .when(ask_rdns, "pending")
        .when(rdns, F.col("cached"))
        .when(F.col("by_range") == "failed", "failed")
        .otherwise("none")
    )
    needs = F.when(vstate == "pending", F.when(F.col("sig"), "sig").otherwise("rdns")).otherwise("")
    return events.withColumns({"vstate": vstate, "needs": needs}).withColumn(
        "cls", F.when(F.col("vstate") == "failed", "spoofed").otherwise(F.col("cls"))
    )


def verify_requests(classified: DataFrame, bot_ranges: DataFrame, verdicts: DataFrame,
                    registry: Registry, config: Config) -> DataFrame:
    """Verdict per request, by published ranges and the verdict known at its time.

    Ranges are met where the rows are read, as long as they fit every executor; longer lists are joined by bucket. Only requests of crawlers that answer by reverse DNS and that no range decides look for a cached verdict,
    so nothing is exchanged for the others: spans that fit every executor are broadcast, and beyond that the asking
    requests alone are shuffled.
    """
    out = in_scan_verdicts(classified, bot_ranges, config)
    if out is None:
        out = classified.join(range_verdicts(classified, bot_ranges, config), ["bot", "ip"], "left")
    if "proxy_suspected" not in out.columns:
        out = out.withColumn("proxy_suspected", F.lit(False))
    by_dns = lookup({b["id"]: True for b in registry.bots if b["rdns"]}, F.col("bot"))
    asks = F.coalesce(by_dns, F.lit(False)) & ~F.coalesce(F.col("by_range") == "verified", F.lit(False)) & (F.coalesce("ip_hash", F.lit("")) != "")
    if _few(verdict_spans(verdicts)):
        # one scan: rows that ask for nothing have no key and meet nothing
        keyed = out.withColumns({"_ask": F.when(asks, F.col("ip_hash"))})
        names = {"ip_hash": "_ip_hash", "_ask": "ip_hash"}
        found = as_of_verdicts(keyed.withColumnsRenamed(names), verdicts).drop("ip_hash").withColumnRenamed("_ip_hash", "ip_hash")
    else:
        found = as_of_verdicts(out.filter(asks), verdicts).unionByName(out.filter(~asks).withColumn("cached", F.lit(None).cast("string")))
    return decide(found, registry, config).drop("by_range", "cached")


def check_rdns(queue: DataFrame, ptr: DataFrame, fwd: DataFrame, registry: Registry) -> DataFrame:
    """Forward-confirmed reverse DNS from lookup tables.

    queue (bot, ip, …), ptr (ip, host), fwd (host, ips). An address absent from
    `ptr` was not looked up yet: `retry`.
    """
    suffixes = {b["id"]: [s.lower() for s in b["rdns"]] for b in registry.bots if b["rdns"]}
    allowed = F.lit(None).cast("array<string>")
    for bot, ends in suffixes.items():
        allowed = F.when(F.col("bot") == bot, F.array(*[F.lit(e) for e in ends])).otherwise(allowed)
    name = lambda c: F.lower(F.regexp_replace(c, r"\.+$", ""))
    names = ptr.select("ip", name(F.col("host")).alias("host")).distinct()
    forward = fwd.select(name(F.col("host")).alias("host"), F.explode("ips").alias("ip")).distinct().withColumn("confirmed", F.lit(True))
    # an address may have several names; any that leads back to it will do
    answers = names.join(forward, ["host", "ip"], "left").groupBy("ip").agg(
        F.collect_set("host").alias("hosts"), F.collect_set(F.when(F.col("confirmed"), F.col("host"))).alias("sure"))
    joined = queue.join(answers, "ip", "left").withColumn("ends", allowed)
    ours = lambda hosts: F.exists(hosts, lambda h: F.exists("ends", lambda s: h.endswith(s)))
    verdict = (
        F.when(F.col("ends").isNull() | ~net.is_ip(F.col("ip")), "failed")
        .when(F.col("hosts").isNull(), "retry")
        .when(ours("sure"), "verified")
        .otherwise("failed")
    )
    return joined.withColumn("verdict", verdict).drop("ends", "hosts", "sure")


def expire(queue: DataFrame, config: Config) -> DataFrame:
    """Checks given up: two days old, or retried too often without an answer -> `none`."""
    given_up = (F.col("created_at") < config.as_of - GIVE_UP) | (
        (F.col("verdict") == "retry") & (F.col("attempts") >= MAX_RETRIES)
    )
    return queue.withColumn("verdict", F.when(given_up, "none").otherwise(F.col("verdict")))


def settle(events: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Put decided verdicts on pending events.

    verdicts: kind ('rdns' by bot + ip_hash, 'sig' by event_id), bot, ip_hash,
    event_id, verdict and, if there is one, decided_at. `retry` leaves an event
    pending. Of several verdicts the newest counts, at equal times a failure.
    Only pending events are joined; all others pass as they are.
    """
    done = verdicts.filter("verdict <> 'retry'")
    when = F.col("decided_at") if "decided_at" in verdicts.columns else F.lit(0)
    newest = F.max_by("verdict", F.struct(when, F.col("verdict") == "failed"))
    dns = done.filter("kind = 'rdns'").groupBy("bot", "ip_hash").agg(newest.alias("_dns"))
    sig = done.filter("kind = 'sig'").groupBy(F.col("event_id").alias("id")).agg(newest.alias("_sig"))
    found = F.coalesce("_sig", "_dns")
    waiting, rest = _pending(events)
    settled = (
        waiting.join(dns, ["bot", "ip_hash"], "left").join(sig, "id", "left")
        .withColumn("cls", F.when(found == "failed", "spoofed").otherwise(F.col("cls")))
        .withColumn("vstate", F.coalesce(found, "vstate")).select(*events.columns)
    )
    return rest.unionByName(settled)


def _pending(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    waiting = F.coalesce(F.col("vstate") == "pending", F.lit(False))
    return events.filter(waiting), events.filter(~waiting)


def repair_orphans(events: DataFrame, queue: DataFrame) -> DataFrame:
    """A pending event whose check is no longer queued can never settle: `none`."""
    by_event = queue.filter("event_id > 0").select(F.col("event_id").alias("id")).distinct().withColumn(
        "_e", F.lit(True))
    by_address = queue.filter("kind = 'rdns'").select("bot", "ip_hash").distinct().withColumn("_a", F.lit(True))
    queued = F.coalesce("_e", F.lit(False)) | F.coalesce("_a", F.lit(False))
    waiting, rest = _pending(events)
    repaired = (
        waiting.join(by_event, "id", "left").join(by_address, ["bot", "ip_hash"], "left")
        .withColumn("vstate", F.when(queued, F.col("vstate")).otherwise("none")).select(*events.columns)
    )
    return rest.unionByName(repaired)


def backlog(queue: DataFrame, ranges: DataFrame, events: DataFrame, watermark: int, config: Config) -> DataFrame:
    """One row: range files, stale files, queued checks, pending and unfolded events."""
    files = rng.status(ranges, config).agg(
        F.count("*").alias("range_files"), F.count_if("stale").alias("stale_files"))
    todo = events.agg(F.struct(
        F.count_if(F.col("vstate") == "pending").alias("pending_events"),
        F.count_if(F.col("id") > watermark).alias("unfolded_events"),
    ).alias("t"))
    return files.withColumn("queued_checks", queue.agg(F.count("*")).scalar()).withColumn(
        "_t", todo.scalar()).select("*", "_t.*").drop("_t")


def latest_verdicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Verdict cache after a run: the newest row per (ip_hash, bot), of those of the same second a failure."""
    order = Window.partitionBy("ip_hash", "bot").orderBy(F.desc("checked_at"), F.desc(F.col("verdict") == "failed"))
    return (
        old.unionByName(new).filter(F.col("verdict").isin("verified", "failed"))
        .withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
    )


def prune_verdicts(verdicts: DataFrame, config: Config) -> DataFrame:
    return verdicts.filter(F.col("checked_at") >= config.as_of - 2 * VERDICT_TTL["verified"])
