import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from trailmark.config import Config, DAY
from trailmark.functions import agents, net, paths, text
from trailmark.operators import classify, verify
from trailmark.sources import registry as reg

NOW = 1_760_000_000
CFG = Config(as_of=NOW)
R = reg.Registry.seed()
CHROME = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/140.0.0.0 Safari/537.36"

AGENTS = {
    "Mozilla/5.0 AppleWebKit/537.36 (KHTML, like Gecko); compatible; GPTBot/1.4; +https://openai.com/gptbot": ("gptbot", "ai"),
    CHROME + "; compatible; OAI-SearchBot/1.4": ("oai-searchbot", "ai"),
    "mozilla/5.0 (compatible; gptbot/1.2)": ("gptbot", "ai"),
    "Claude-SearchBot/1.0": ("claude-searchbot", "ai"),
    "Mozilla/5.0 (compatible; Googlebot/2.1) GoogleOther": ("googleother", "ai"),
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)": ("googlebot", "search"),
    "Mozilla/5.0 (compatible; AhrefsBot/7.0; +http://ahrefs.com/robot/)": ("ahrefsbot", "known"),
    "facebookexternalhit/1.1": ("facebookexternalhit", "known"),
    CHROME: ("", "human"),
    "Mozilla/5.0 (Linux; Android 10; CUBOT X30) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/139.0.0.0 Mobile Safari/537.36": ("", "human"),
    "Mozilla/5.0 (X11; Linux x86_64; rv:142.0) Gecko/20100101 Firefox/142.0": ("", "human"),
    "python-requests/2.32.3": ("_unknown", "unknown"),
    "": ("_unknown", "unknown"),
    "Mozilla/5.0": ("_unknown", "unknown"),
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) HeadlessChrome/139.0.0.0 Safari/537.36": ("_unknown", "unknown"),
    "SuperNewAIBot/0.1 (+https://example.ai/bot)": ("_potential", "potential"),
    "Mozilla/5.0 (compatible; ExampleLLM-crawler/1.0)": ("_potential", "potential"),
    "my-rag-agent/2.0 python-httpx": ("_potential", "potential"),
}


def test_agents_are_classified(spark):
    rows = spark.createDataFrame([(u,) for u in AGENTS], "ua string")
    got = {r.ua: (r.bot, r.cls) for r in agents.with_agent(rows, R).collect()}
    assert got == AGENTS


def test_signed_and_address_only_agents(spark):
    rows = spark.createDataFrame([(CHROME, '"https://chatgpt.com"', None), (CHROME, "https://agents.example.net", None), (CHROME, "", "google-agent")],
                                 "ua string, s string, a string")
    got = [(r.bot, r.cls, r.sig, r.by_address) for r in agents.with_agent(rows, R, "s", "a").collect()]
    assert got == [("chatgpt-agent", "ai", True, False), ("_signed", "ai", True, False), ("google-agent", "ai", False, True)]


def test_registry_layers_and_validation(spark):
    bad = [reg._bot("Bad Id", "x", "", "seo", ["x"]), reg._bot("nopattern", "x", "", "seo"),
           reg._bot("x-bot", "X", "", "nope", ["evil\nline", "XBot"], ranges=["http://insecure.example/x.json", "https://ok.example/r.json"])]
    names = [f.split()[0] for f in reg.BOT_SCHEMA.replace("\n", " ").split(",")]
    frame = lambda rows: spark.createDataFrame([tuple(r[n] for n in names) for r in rows], reg.BOT_SCHEMA)
    kept = reg.validate_bots(frame(bad)).collect()
    assert [(k.id, k.patterns, k.category, k.ranges) for k in kept] == [("x-bot", ["XBot"], "other", ["https://ok.example/r.json"])]
    custom = frame([reg._bot("gptbot", "Mine", "", "other", ["GPTBot"])])
    merged = {r.id: r.name for r in reg.layer_bots(R.frame(spark), custom=custom).collect()}
    assert merged["gptbot"] == "Mine" and len(merged) == len(R.bots)
    with pytest.raises(ValueError):
        reg.promote_agent("some-agent/1", "other", "o-bot", "O", "ai_search")


def test_paths(spark):
    cases = {"/": "/", "/blog/post/?utm_source=x#frag": "/blog/post", "//blog///post//": "/blog/post", "/caf%C3%A9/": "/caf%C3%A9", "/café": "/caf%C3%A9",
             "https://a.example/x%7Ey?z": "/x~y", "": "/", "/a+b": "/a%2Bb", "/bad%zz": "/bad%25zz", "/a*b c": "/a%2Ab%20c"}
    rows = spark.createDataFrame([(k,) for k in cases], "u string").withColumn("p", paths.normalize_path(F.col("u")))
    again = rows.withColumn("q", paths.normalize_path(F.col("p"))).collect()
    assert {r.u: r.p for r in again} == cases
    assert all(r.p == r.q for r in again)
    one = spark.createDataFrame([("x\r\ny\x00", "=HYPERLINK(1)", "é" * 400)], "a string, b string, c string").select(
        paths.clean(F.col("a")).alias("a"), paths.csv_cell(F.col("b")).alias("b"), paths.clean(F.col("c"), 255).alias("c")).first()
    assert one.a == "x y" and one.b == "'=HYPERLINK(1)" and one.c == "é" * 127


def test_addresses_agree_with_the_standard_library(spark):
    rnd = random.Random(7)
    ips = [str(ipaddress.IPv4Address(rnd.getrandbits(32))) for _ in range(60)] + [str(ipaddress.IPv6Address(rnd.getrandbits(128))) for _ in range(60)]
    ips += ["::", "::1", "2001:db8::", "::ffff:1.2.3.4", "fe80::1:0:0:1", "256.1.1.1", "1.2.3", "1::2::3", ":::", "12345::", "not-an-ip", ""]
    nets = [f"{ip}/{rnd.randint(0, 32 if '.' in ip and ':' not in ip else 128)}" for ip in ips[:120]] + ["1.2.3.4", "10.0.0.0/33", "x/8", "::1/200"]

    def key(a):
        try:
            a = ipaddress.ip_address(a)
        except ValueError:
            return None
        return f"{a.version}{int(a):0{8 if a.version == 4 else 32}x}"

    got = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", net.ip_key(F.col("ip")).alias("k"), net.ip_network(F.col("ip")).alias("n")).collect()
    assert {r.ip: r.k for r in got} == {i: key(i) for i in ips}
    for r in got:
        if r.k:
            wide = ipaddress.ip_network(r.ip).supernet(new_prefix=24 if r.k[0] == "4" else 48)
            assert r.n == str(wide), r.ip
    bounds = spark.createDataFrame([(c,) for c in nets], "c string").select("c", net.cidr_bounds(F.col("c")).alias("b")).collect()
    for r in bounds:
        want = net.python_bounds(r.c)
        assert (None if r.b is None else (r.b.lo, r.b.hi)) == want, r.c


def test_ip_hash_is_keyed(spark):
    import hashlib
    import hmac

    got = spark.range(1).select(net.ip_hash(F.lit("203.0.113.9"), "s3cret").alias("h")).first().h
    assert got == hmac.new(b"s3cret", b"203.0.113.9", hashlib.sha256).hexdigest()[:16]


def test_range_join_equals_brute_force(spark):
    rnd = random.Random(11)
    cidrs = [f"{ipaddress.IPv4Address(rnd.getrandbits(32))}/{rnd.choice([1, 4, 7, 8, 12, 16, 20, 24, 32])}" for _ in range(40)]
    cidrs += [f"{ipaddress.IPv6Address(rnd.getrandbits(128))}/{rnd.choice([2, 5, 16, 31, 32, 48, 64, 128])}" for _ in range(40)]
    ips = [str(ipaddress.ip_network(c, strict=False)[0]) for c in cidrs] + [str(ipaddress.IPv4Address(rnd.getrandbits(32))) for _ in range(100)]
    requests = spark.createDataFrame([("gptbot", i) for i in ips], "bot string, ip string")
    ranges = spark.createDataFrame([("gptbot", "f", c, NOW) for c in cidrs], "bot string, file string, cidr string, fetched_at bigint")
    got = {r.ip: r.by_range for r in verify.range_verdicts(requests, ranges, CFG).collect()}
    nets = [ipaddress.ip_network(c, strict=False) for c in cidrs]
    assert got == {i: "verified" if any(ipaddress.ip_address(i) in n for n in nets if n.version == ipaddress.ip_address(i).version) else "failed" for i in ips}


def _verify(spark, cases, ranges, cached=()):
    rows = spark.createDataFrame([(i, NOW, ip, "GET", "/a/", 200, ua, 1, "", src) for i, (ua, ip, src) in enumerate(cases)],
                                 "id bigint, ts bigint, ip string, method string, path string, status int, ua string, ms bigint, referer string, source string")
    r = spark.createDataFrame(ranges, "bot string, file string, cidr string, fetched_at bigint")
    v = spark.createDataFrame(list(cached), "ip_hash string, bot string, verdict string, checked_at bigint")
    out = verify.verify_requests(classify.classify_requests(rows, R, CFG), r, v, R, CFG)
    return [(x.cls, x.vstate, x.needs) for x in out.orderBy("id").collect()]


def test_verification_rules(spark):
    ranges = [("gptbot", "g", "20.171.206.0/24", NOW), ("gptbot", "g", "2a01:111:f402::/48", NOW), ("perplexitybot", "p", "18.97.9.0/24", NOW - 30 * DAY),
              ("googlebot", "b", "66.249.64.0/27", NOW)]
    got = _verify(spark, [
        ("GPTBot/1.4", "20.171.206.9", "live"), ("GPTBot/1.4", "2a01:111:f402:12::1", "live"), ("GPTBot/1.4", "198.51.100.7", "live"),
        ("PerplexityBot/1.0", "198.51.100.7", "live"), ("meta-externalagent/1.1", "198.51.100.7", "live"),
        ("Googlebot/2.1", "66.249.64.5", "live"), ("Googlebot/2.1", "66.249.90.1", "live")], ranges)
    assert got == [("ai", "verified", ""), ("ai", "verified", ""), ("spoofed", "failed", ""), ("ai", "none", ""), ("ai", "none", ""),
                   ("search", "verified", ""), ("search", "pending", "rdns")]


def test_reverse_dns(spark):
    host = "crawl-66-249-90-%d.googlebot.com"
    queue = spark.createDataFrame([("googlebot", f"66.249.90.{i}") for i in range(1, 6)], "bot string, ip string")
    ptr = spark.createDataFrame([("66.249.90.1", host % 1), ("66.249.90.2", "evil.example.com"), ("66.249.90.3", host % 3), ("66.249.90.4", "")], "ip string, host string")
    fwd = spark.createDataFrame([(host % 1, ["66.249.90.1"]), ("evil.example.com", ["66.249.90.2"]), (host % 3, ["10.0.0.1"])], "host string, ips array<string>")
    got = [r.verdict for r in verify.check_rdns(queue, ptr, fwd, R).orderBy("ip").collect()]
    assert got == ["verified", "failed", "failed", "failed", "retry"]


def test_long_lists_paths_and_agents_are_used_whole(spark):
    ranges = spark.range(3500).select(
        F.lit("gptbot").alias("bot"), F.lit(0).alias("bot_order"), F.lit(True).alias("ip_only"), F.lit("f").alias("file"),
        F.format_string("10.%d.%d.0/24", F.floor(F.col("id") / 250), F.col("id") % 250).alias("cidr"), F.lit(0).cast("bigint").alias("fetched_at"))
    asked = spark.createDataFrame([("10.13.249.7",), ("10.200.0.1",)], "ip string")
    assert [(r.ip, r.address_bot) for r in verify.address_only(asked, ranges).collect()] == [("10.13.249.7", "gptbot")]
    urls = spark.createDataFrame([("/" + "a" * 600 + "x",), ("/" + "a" * 600 + "y",)], "u string")
    assert urls.select(paths.normalize_path(F.col("u")).alias("p")).distinct().count() == 2
    agents_ = spark.createDataFrame([("b" * 300 + "1",), ("b" * 300 + "2",)], "ua string")
    assert agents_.select(paths.clean(F.col("ua")).alias("c")).distinct().count() == 2
    body = spark.createDataFrame([("Our place", "word " * 2000 + "opening hours and address")], "title string, body string")
    none = F.array().cast("array<string>")
    assert body.select(text.intent(F.col("title"), none, F.col("body"), F.lit(""), none)["intent"].alias("i")).first().i == "local"


def test_ranges_are_searched_in_the_scan_as_by_bucket(spark, monkeypatch):
    cfg = Config(as_of=1_700_000_000)
    lists = [("gptbot", "10.0.0.0/8"), ("gptbot", "10.1.0.0/16"), ("gptbot", "9.255.255.0/24"), ("gptbot", "2001:db8::/32"), ("gptbot", "nonsense"), ("ccbot", "192.0.2.7"), ("ccbot", "192.0.2.9/32"), ("ccbot", "2600::/12"), ("ccbot", "198.18.0.0/15"), ("ccbot", "203.0.112.0/22"), ("ccbot", "2001:db8:7::/48")]
    ranges = spark.createDataFrame([(bot, bot, c, 1_700_000_000 - (40 * 86400 if bot == "ccbot" else 60)) for bot, c in lists], "bot string, file string, cidr string, fetched_at long")
    ips = ["10.1.2.3", "10.255.255.255", "9.255.255.9", "9.255.254.9", "11.0.0.0", "192.0.2.7", "192.0.2.8", "192.0.2.9", "2001:db8::1", "2001:db9::1", "260f::", "2610::", "198.19.9.9", "198.20.0.0", "203.0.115.255", "203.0.116.0", "2001:db8:7:1::", "2001:db8:8::", "bad", "", None]
    rows = spark.createDataFrame([(bot, ip) for bot in ("gptbot", "ccbot", "other", "", None) for ip in ips], "bot string, ip string")
    found = {(r.bot, r.ip): r.by_range for r in verify.in_scan_verdicts(rows, ranges, cfg).collect()}
    by_bucket = {(r.bot, r.ip): r.by_range for r in verify.range_verdicts(rows, ranges, cfg).collect()}
    assert {k: v for k, v in found.items() if v} == by_bucket and "failed" in by_bucket.values()
    monkeypatch.setattr(verify, "IN_SCAN", 2)
    assert verify.in_scan_verdicts(rows, ranges, cfg) is None


@pytest.mark.parametrize("few", [0, 10**6])
def test_verdicts_are_those_known_at_the_time(spark, monkeypatch, few):
    monkeypatch.setattr(verify, "IN_SCAN", few)
    day = 86400
    checks = [("h", "b", "verified", 0), ("h", "b", "failed", 3 * day), ("h", "b", "verified", 20 * day), ("h", "b", "failed", 20 * day), ("g", "b", "verified", 5)]
    verdicts = spark.createDataFrame(checks, "ip_hash string, bot string, verdict string, checked_at long")
    at = [-1, 0, 3 * day - 1, 3 * day, 4 * day - 1, 4 * day, 6 * day, 20 * day, 21 * day]
    rows = spark.createDataFrame([("h", "b", t) for t in at] * 3 + [("h", "c", 1), (None, "b", 1), ("g", "b", 7 * day + 4), ("g", "b", 7 * day + 5)], "ip_hash string, bot string, ts long")
    got = sorted((r.ip_hash or "", r.bot, r.ts, r.cached) for r in verify.as_of_verdicts(rows, verdicts).collect())
    want = [None, "verified", "verified", "failed", "failed", None, None, "failed", None]
    assert got == sorted([("h", "b", t, w) for t, w in zip(at, want)] * 3 + [("h", "c", 1, None), ("", "b", 1, None), ("g", "b", 7 * day + 4, "verified"), ("g", "b", 7 * day + 5, None)], key=lambda r: r[:3])
