import random

from pyspark.sql import functions as F

from trailmark.config import Config, DAY
from trailmark.functions import net
from trailmark.operators import classify, page_sets, rollups, sessions, verify
from trailmark.sources import logs
from trailmark.sources.registry import Registry
from trailmark.streaming import rollup_stream as st, term_frequencies as tf

NOW = 1_760_000_000
CFG = Config(as_of=NOW)
R = Registry.seed()
SCHEMA = "id bigint, ts bigint, day date, bot string, cls string, vstate string, path string, url_hash string, status int, ms bigint, ip_hash string"


def events(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, ts bigint, bot string, cls string, vstate string, path string, status int, ms bigint, ip_hash string")
    return df.withColumn("day", classify.local_day(F.col("ts"), "UTC")).withColumn("url_hash", F.md5("path"))


def golden(spark):
    day = (NOW // DAY - 2) * DAY + 3600
    rows = [(i, day + i * 60, "gptbot", "ai", "verified", f"/p{i % 3}", 503 if i % 10 == 0 else 200, 120, f"ip{i % 5}") for i in range(30)]
    rows += [(30 + i, day + i, "gptbot", "spoofed", "failed", "/p0", 200, 120, f"bad{i}") for i in range(4)]
    rows += [(34, day + 5000, "claudebot", "ai", "none", "/p1", 200, 120, "c")]
    return events(spark, rows)


def total(df, col):
    return df.agg(F.sum(col)).first()[0]


def test_rollups_are_exact(spark):
    cube = rollups.fold(golden(spark))
    daily, bots, seen = rollups.daily(cube), rollups.daily_bots(cube), rollups.bots_seen(cube)
    assert (total(daily, "hits"), total(daily, "errors")) == (31, 3)
    assert (total(bots, "hits"), total(bots, "spoofed"), total(bots, "verified")) == (31, 4, 30)
    assert rollups.page_bots(cube).count() == 4
    assert (seen.count(), total(seen, "spoofed")) == (2, 4)
    got = {r.bot: r for r in sessions.sessions(golden(spark)).collect()}
    g = got["gptbot"]
    assert len(got) == 2 and (g.hits, g.pages, g.ips, g.errors, g.ended - g.started) == (30, 3, 5, 3, 29 * 60)


def test_fold_needs_no_sort(spark):
    plan = rollups.fold(golden(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_sessions_equal_a_sequential_walk(spark):
    rnd = random.Random(3)
    rows, want, i = [], {}, 0
    for bot in ("a", "b", "c"):
        t = NOW - 10 * DAY
        times = []
        for _ in range(700):
            t += rnd.choice([0, 5, 300, 1500, 1800, 1801, 1799, 4000])
            times.append(t)
        start = prev = None
        for t in times:
            if prev is None or t - prev > 1800 or t - start > 21600:
                start = t
            prev = t
            want[(bot, start)] = want.get((bot, start), 0) + 1
            rows.append((i, t, bot, "ai", "none", "/x", 200, 1, "i"))
            i += 1
    got = {(r.bot, r.started): r.hits for r in sessions.sessions(events(spark, rows)).collect()}
    assert got == want


def test_new_bots_first_crawls_and_merge(spark):
    e = golden(spark)
    old, new = e.filter("id < 10"), e.filter("id >= 10")
    known = rollups.page_bots(rollups.fold(old))
    assert [r.bot for r in rollups.new_bots(rollups.fold(e), rollups.bots_seen(rollups.fold(old))).collect()] == ["claudebot"]
    assert {(r.bot, r.path) for r in rollups.first_crawls(new, known).collect()} == {("claudebot", "/p1")}
    merged = rollups.merge_page_bots(known.unionByName(rollups.page_bots(rollups.fold(new)))).orderBy("bot", "path").collect()
    assert merged == rollups.page_bots(rollups.fold(e)).orderBy("bot", "path").collect()


def test_flood(spark):
    rows = [(i, NOW - i % 500, "gptbot", "spoofed", "failed", f"/f{i}", 200, 1, "flooder") for i in range(650)]
    assert [r.ip_hash for r in rollups.flooding(events(spark, rows), CFG).collect()] == ["flooder"]


def test_retention(spark):
    cfg = CFG.with_(retention_events=7, retention_history=30)
    e = events(spark, [(1, NOW - 10 * DAY, "gptbot", "ai", "none", "/old", 200, 1, "i"), (2, NOW - DAY, "gptbot", "ai", "none", "/new", 200, 1, "i")])
    assert [r.id for r in rollups.prune("events", e, cfg, watermark=2).collect()] == [2]
    assert rollups.prune("events", e, cfg, watermark=0).count() == 2
    assert rollups.prune("daily", rollups.daily(rollups.fold(e)), cfg).count() == 2


def test_log_lines(spark, tmp_path):
    ua = "GPTBot/1.4"
    text = "\n".join([
        f'20.171.206.5 - - [10/Oct/2025:13:55:36 +0200] "GET /a/?x=1 HTTP/1.1" 200 12 "-" "{ua}" 0.250',
        r'20.171.206.5 - - [10/Oct/2025:13:55:36 +0000] "GET /b HTTP/1.1" 404 12 "https://chatgpt.com/" "say \"hi\" C:\\x" 7',
        '1.2.3.4 - - [31/Feb/2025:00:00:00 +0000] "GET /c HTTP/1.1" 200 1', "garbage", "",
        '{"EdgeStartTimestamp": 1760000000123456789, "ClientIP": "2001:db8::1", "ClientRequestURI": "https://x.example/d?e", "EdgeResponseStatus": 200, "ClientRequestUserAgent": "curl/8"}',
        '{"time": "nothing"}'])
    import gzip

    with gzip.open(tmp_path / "a.log.gz", "wt") as f:
        f.write(text)
    got = {r.path: r for r in logs.parse_lines(logs.read_lines(spark, str(tmp_path / "a.log.gz"))).collect()}
    assert set(got) == {"/a/?x=1", "/b", "/c", "/d?e"}
    assert (got["/a/?x=1"].ts, got["/a/?x=1"].ms, got["/a/?x=1"].referer) == (1760097336, 250, "")
    assert (got["/b"].ua, got["/b"].ms, got["/b"].referer) == ('say "hi" C:\\\\x', None, "https://chatgpt.com/")
    assert got["/c"].ts == 1740960000  # a day past the month's end runs on, as 3 March
    assert (got["/d?e"].ts, got["/d?e"].ip, got["/d?e"].method) == (1760000000, "2001:db8::1", "GET")


def test_import_is_validated_and_stored_once(spark):
    ok, late = NOW - 3600, NOW - 900 * DAY
    rows = [(ok, "20.171.206.5", "GET", "/a/?x=1", 200, "GPTBot/1.4"), (ok, "20.171.206.5", "GET", "/a/?x=1", 200, "GPTBot/1.4"), (ok, "198.51.100.1", "GET", "/b/", 200, "GPTBot/1.4"),
            (ok, "not-an-ip", None, "/c/", 200, "GPTBot/1.4"), (NOW + 86400, "20.171.206.5", None, "/c/", 200, "GPTBot/1.4"), (late, "20.171.206.5", None, "/c/", 200, "GPTBot/1.4")]
    df = spark.createDataFrame(rows, "ts bigint, ip string, method string, path string, status int, ua string").withColumns(
        {"ms": F.lit(None).cast("bigint"), "referer": F.lit(""), "source": F.lit("log"), "id": F.monotonically_increasing_id()})
    judged = logs.with_disposition(df, CFG)
    assert {r.disposition: r.requests for r in logs.disposition_counts(judged).collect()} == {"ok": 3, "invalid": 2, "too_old": 1}
    events_ = classify.store_events(classify.classify_requests(judged.filter("disposition = 'ok'"), R, CFG), CFG)
    assert sorted(r.path for r in events_.collect()) == ["/a", "/b"]


def test_trusted_proxies(spark):
    cfg = CFG.with_(proxy_header="x-forwarded-for", trusted_proxies=("10.0.0.0/8", "203.0.113.0/24"))
    rows = [("203.0.113.9", "20.171.206.9"), ("203.0.113.9", "1.2.3.4, 20.171.206.9, 10.1.1.1"), ("198.51.100.1", "20.171.206.9")]
    df = spark.createDataFrame(rows, "r string, x string").select(net.client_ip(F.col("r"), F.col("x"), F.lit(""), cfg).alias("c"))
    assert [r.c.ip for r in df.collect()] == ["20.171.206.9", "20.171.206.9", "198.51.100.1"]


def test_stream_equals_batch_and_survives_a_retry(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    golden(spark).repartition(3).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = st.start_rollups(stream, root, str(tmp_path / "cp"), {"availableNow": True})
    q.awaitTermination()
    st.fold_batch(root)(spark.read.parquet(src).limit(0).unionByName(spark.read.parquet(src).limit(0)), 99)  # an empty batch
    st.backfill(golden(spark).limit(0), root, 99)  # the same batch again
    cube = rollups.fold(golden(spark))
    for name in ("daily", "daily_bots", "daily_pages", "page_bots", "bots_seen"):
        want = getattr(rollups, name)(cube)
        got = st.read_rollup(spark, root, name).select(*want.columns)
        key = want.columns[:3]
        assert got.orderBy(*key).collect() == want.orderBy(*key).collect(), name
    assert st.read_sessions(spark, root).count() == 2
    st.compact(spark, root, str(tmp_path / "compact"))
    assert total(st.read_rollup(spark, str(tmp_path / "compact"), "daily"), "hits") == 31


def test_late_batches_and_compacted_history_do_not_replace_live_ones(spark, tmp_path):
    root, base = str(tmp_path / "live"), str(tmp_path / "base")
    st.fold_batch(root)(golden(spark), 0)
    st.backfill(golden(spark), root, 0)
    assert total(st.read_rollup(spark, root, "daily"), "hits") == 62
    st.compact(spark, root, base)
    st.fold_batch(base)(golden(spark), 0)
    assert total(st.read_rollup(spark, base, "daily"), "hits") == 93


def test_newest_verdict_settles_pending_events_only(spark):
    events = spark.createDataFrame(
        [(1, "a", "h", "pending", "ai"), (2, "a", "h", "none", "ai"), (3, "a", "g", "pending", "ai"), (4, "b", "h", "pending", "ai")],
        "id bigint, bot string, ip_hash string, vstate string, cls string")
    rows = [("rdns", "a", "h", 0, "verified", 5), ("rdns", "a", "h", 0, "failed", 9), ("rdns", "a", "g", 0, "retry", 9), ("sig", "b", "", 4, "verified", 1)]
    verdicts = spark.createDataFrame(rows, "kind string, bot string, ip_hash string, event_id bigint, verdict string, decided_at bigint")
    got = {r.id: (r.vstate, r.cls) for r in verify.settle(events, verdicts).collect()}
    assert got == {1: ("failed", "spoofed"), 2: ("none", "ai"), 3: ("pending", "ai"), 4: ("verified", "ai")}


def test_any_name_of_an_address_may_confirm_it(spark):
    queue = spark.createDataFrame([("googlebot", "66.249.66.1"), ("googlebot", "66.249.66.2"), ("googlebot", "66.249.66.3")], "bot string, ip string")
    ptr = spark.createDataFrame([("66.249.66.1", "x.example"), ("66.249.66.1", "crawl-1.googlebot.com."), ("66.249.66.2", "evil.example")], "ip string, host string")
    fwd = spark.createDataFrame([("crawl-1.googlebot.com", ["66.249.66.1"]), ("evil.example", ["66.249.66.2"])], "host string, ips array<string>")
    got = {r.ip: r.verdict for r in verify.check_rdns(queue, ptr, fwd, R).collect()}
    assert got == {"66.249.66.1": "verified", "66.249.66.2": "failed", "66.249.66.3": "retry"}


def test_stored_rollups_are_read_by_day(spark, tmp_path):
    root = str(tmp_path)
    rollups.build_rollups(golden(spark), root)
    daily = spark.read.parquet(f"{root}/daily")
    day = daily.agg(F.max("day")).first()[0]
    plan = daily.filter(F.col("day") == day)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    want = rollups.daily(rollups.fold(golden(spark)))
    assert sorted(daily.select(*want.columns).collect()) == sorted(want.collect())
    n = daily.count()
    rollups.write_partitioned(want.filter(F.col("day") == day).withColumn("hits", F.lit(0).cast("bigint")), f"{root}/daily")
    again = spark.read.parquet(f"{root}/daily")
    assert again.filter(F.col("day") == day).agg(F.sum("hits")).first()[0] == 0 and again.count() == n


def test_late_rows_merge_stored_sessions_and_a_retry_changes_nothing(spark, tmp_path):
    import random

    rng, root = random.Random(4), str(tmp_path)
    times = [(rng.choice("ab"), NOW + rng.randrange(5 * DAY) // 600 * 600) for _ in range(900)]
    rows = [(bot, ts, rng.choice("xyz"), rng.choice("pq"), 1, ts % 2) for bot, ts in times]
    rows += [("c", NOW, "x", "p", 1, 0), ("c", NOW + 3000, "y", "p", 1, 0), ("c", NOW + 1500, "z", "q", 1, 0)]  # the last joins the other two
    schema = "bot string, ts long, url_hash string, ip_hash string, hits long, errors long"
    rng.shuffle(rows[:900])
    batches = [spark.createDataFrame(rows[k::3], schema).groupBy("bot", "ts", "url_hash", "ip_hash").agg(F.sum("hits").alias("hits"), F.sum("errors").alias("errors")) for k in range(3)]
    for k, batch in enumerate(batches):
        st.merge_sessions(spark, root, batch, f"live-{k}")
    st.merge_sessions(spark, root, batches[2], "live-2")
    want = sessions.sessions_from_grain(spark.createDataFrame(rows, schema))
    got = st.read_sessions(spark, root).select(*want.columns)
    assert sorted(got.collect()) == sorted(want.collect())
    assert [(r.started, r.pages) for r in got.filter("bot = 'c'").collect()] == [(NOW, 3)]


def test_a_batch_cuts_only_the_runs_it_touches(spark):
    runs = spark.createDataFrame([("a", 0, 100), ("a", 5000, 6000), ("a", 90000, 200000), ("b", 0, 100)], "bot string, run long, run_end long")
    new = spark.createDataFrame([("a", 1900), ("a", 3200), ("a", 198000)], "bot string, ts long")
    assert sorted(tuple(r) for r in sessions.touched_runs(new, runs).collect()) == [("a", 0, 100), ("a", 5000, 6000), ("a", 90000, 200000)]
    assert sessions.touched_runs(new.filter("ts = 3200"), runs).collect()[0].run == 5000
    assert sessions.touched_runs(new.filter("ts = 1900"), runs).collect()[0].run_end == 100


def test_page_numbers_are_unique_and_stay(spark):
    first = page_sets.numbered(spark.range(40_000).select(F.col("id").cast("string").alias("url_hash")), buckets=1).cache()
    more = page_sets.numbered(spark.range(39_000, 75_000).select(F.col("id").cast("string").alias("url_hash")), first).cache()
    both = first.unionByName(more)
    assert more.count() == 35_000 and both.select("bucket", "pos").distinct().count() == 75_000
    assert {r.bucket for r in both.select("bucket").distinct().collect()} == {0, 1, 2} and both.agg(F.max("pos")).first()[0] == page_sets.WIDTH - 1
    rows = spark.range(75_000).select(F.lit("d1").alias("day"), F.lit("k").alias("key"), F.col("id").cast("string").alias("url_hash"))
    sets = page_sets.page_sets(rows.unionByName(rows.limit(500).withColumn("day", F.lit("d2"))), both)
    assert page_sets.distinct_pages(sets).first().n == 75_000 and page_sets.distinct_pages(sets.filter("day = 'd2'"), "key").first().n == 500


def test_compacted_frequencies_are_the_same(spark, tmp_path):
    root, base = str(tmp_path / "a"), str(tmp_path / "b")
    pages = lambda *rows: spark.createDataFrame(list(rows), "page_id long, terms array<string>")
    tf.merge_terms(spark, root, pages((1, ["x", "y"]), (2, ["x"])), "live-0")
    tf.merge_terms(spark, root, pages((1, ["y"]), (3, ["z"])), "live-1")
    tf.compact(spark, root, base)
    tf.merge_terms(spark, base, pages((2, []), (3, ["x", "z"])), "live-0")
    assert sorted(tuple(r) for r in tf.frequencies(spark, root).collect()) == [("x", 1), ("y", 1), ("z", 1)]
    assert sorted(tuple(r) for r in tf.frequencies(spark, base).collect()) == [("x", 1), ("y", 1), ("z", 1)]


def test_throttled_requests_meet_the_windows_of_their_hour(spark):
    rows = spark.readStream.format("rate").load().selectExpr("value as id", "'a' as ip_hash", "value as ts", "'none' as vstate")
    assert "flood_hour" in st.throttled(rows)._jdf.queryExecution().analyzed().toString()


def test_batches_of_one_run_are_cut_once_when_sessions_are_read(spark, tmp_path, monkeypatch):
    root, base = str(tmp_path / "a"), str(tmp_path / "b")
    schema = "bot string, ts long, url_hash string, ip_hash string, hits long, errors long"
    rows = [("a", NOW + 600 * k, f"p{k % 7}", "x", 1, k % 2) for k in range(400) if k % 100 < 90] + [("b", NOW, "p", "x", 2, 0)]
    cuts, cut = [], sessions.sessions_of_runs
    monkeypatch.setattr(sessions, "sessions_of_runs", lambda *a: cuts.append(1) or cut(*a))
    for k in range(4):
        st.merge_sessions(spark, root, spark.createDataFrame(rows[k::4], schema), f"live-{k}")
    assert not cuts
    want = cut(spark.createDataFrame(rows, schema))
    st.compact_sessions(spark, root, base)
    assert len(cuts) == 1 and sorted(cut_.started for cut_ in st.read_sessions(spark, base).collect()) == sorted(r.started for r in want.collect())
    late = [("a", NOW + 600 * 95 + 5, "q", "y", 1, 0), ("a", NOW + 600 * 92, "q", "y", 1, 0), ("a", NOW + 600 * 97 + 1200, "q", "y", 1, 0)]
    st.merge_sessions(spark, base, spark.createDataFrame(late, schema), "live-4")
    want = sessions.sessions_from_grain(spark.createDataFrame(rows + late, schema))
    assert sorted(st.read_sessions(spark, base).select(*want.columns).collect()) == sorted(want.collect())


def test_a_stream_keeps_the_tables_it_is_asked_for(spark, tmp_path):
    root = str(tmp_path)
    st.fold_batch(root, tables=["sessions"])(golden(spark), 0)
    assert [p.name for p in tmp_path.iterdir()] == ["session_grain"] and st.read_sessions(spark, root).count() == 2


def test_a_held_key_calls_its_state_three_times_a_batch(spark):
    from types import SimpleNamespace

    import pandas as pd

    calls, lists, timers = [], {}, set()

    def state(name, schema):
        rows = lists.setdefault(name, [])
        return SimpleNamespace(appendList=lambda new: (calls.append(name), rows.extend(new)), get=lambda: iter(list(rows)), clear=rows.clear)

    held = st.HoldBack()
    held.init(SimpleNamespace(getListState=state, registerTimer=lambda ms: (calls.append("timer"), timers.add(ms)), listTimers=lambda: iter(timers)))
    key, clock = ("b", "h", 100, 0), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    at = 100 * DAY
    frame = pd.DataFrame([(at, None, "e1"), (at + 9, None, "e2"), (at + 5, "verified", None), (at + 5, "failed", None), (at + 5, "verified", None),
                          (at + 2 * DAY + 5, "verified", None), (at - 8 * DAY, "failed", None)], columns=["at", "verdict", "event"])
    for _ in range(2):
        assert not list(held.handleInputRows(key, iter([frame]), clock))
    assert len(calls) == 6 and timers == {(101 * DAY + st.HOLD) * 1000}
    out = [tuple(r) for f in held.handleExpiredTimer(key, clock, None) for r in f.itertuples(index=False)]
    assert sorted(out) == [("e1", "failed")] * 2 + [("e2", "verified")] * 2
    assert not list(held.handleExpiredTimer(key, clock, None))
