"""Headline timings on one machine; prints one JSON line.

The rollups are folded and written once, as they are in use; the reports then
read the stored tables. BENCH_SF_DIR and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession, functions as F  # noqa: E402

from trailmark.operators import quality, rollups, sessions  # noqa: E402
from trailmark.plans import traffic as t  # noqa: E402
from trailmark.sources import logs  # noqa: E402
from workload import bridge as b, content_queries as cq, ingest_queries as iq, quality_queries as qq  # noqa: E402


#: Requests that the fold and the reports run on, at least.
EVENTS = 1_000_000


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="spark-bench-")
    C, R = b.CONFIG, b.REGISTRY

    # inputs as they arrive in use: stored requests, log lines, an inventory
    # the given requests, repeated some seconds apart until there are at least a million
    given = b.requests(spark, d)
    copies = -(-EVENTS // given.count())
    k = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("k")
    many = given.select("*", k).withColumns({"id": F.col("id") * copies + F.col("k"), "ts": F.col("ts") + F.col("k") * 7}).drop("k")
    many.repartition(int(cpus)).write.parquet(f"{root}/requests")
    b.visits(spark, d).write.parquet(f"{root}/visits")
    b.inventory(spark, d).write.parquet(f"{root}/pages")
    b.findings(spark, d).write.parquet(f"{root}/findings")
    lines = iq.combined_lines(spark, d)
    lines = lines.select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("k")).drop("k")
    lines.repartition(int(cpus)).write.text(f"{root}/log")
    log_mb = sum(os.path.getsize(os.path.join(f"{root}/log", x)) for x in os.listdir(f"{root}/log") if x.startswith("part-")) / 1e6
    stored = lambda name: spark.read.parquet(f"{root}/{name}")

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def fold() -> None:
        rollups.build_rollups(stored("requests"), root)
        rollups.referrals(stored("visits")).write.mode("overwrite").parquet(f"{root}/referrals")
        sessions.sessions(stored("requests")).write.mode("overwrite").parquet(f"{root}/sessions")

    def detail() -> None:
        """All that a crawler's page shows."""
        bot = "googlebot"
        run(t.crawlers(stored("daily_bots"), stored("page_bots"), stored("bots_seen"), R, C).filter(F.col("bot") == bot))
        run(t.crawler_timeline(spark, stored("daily_bots"), C, bot))
        run(t.crawler_top_pages(stored("daily"), stored("pages"), C, bot))
        run(t.latest_sessions(stored("sessions"), bot))
        run(t.latest_requests(stored("requests"), R, 50, bot))
        run(t.crawler_breakdowns(stored("requests").filter(F.col("bot") == bot), C))

    def terms():
        return cq.page_terms(spark, d)

    queries = {
        "rollup_fold": fold,
        "crawler_detail": detail,
        "log_parse": lambda: run(logs.parse_lines(logs.read_lines(spark, f"{root}/log"), "combined")),
        "classify": lambda: run(iq.classify.classify_requests(
            stored("requests").select("id", "ts", "ip", "method", "path", "status", "ua", "ms", "source", F.lit("").alias("referer")), R, C)),
        "overview": lambda: run(t.overview(stored("daily_bots"), stored("page_bots"), stored("referrals"), R, C)),
        "coverage": lambda: run(t.coverage(stored("pages"), stored("page_bots"), R, C)),
        "crawlers": lambda: run(t.crawlers(stored("daily_bots"), stored("page_bots"), stored("bots_seen"), R, C)),
        "crawler_breakdowns": lambda: run(t.crawler_breakdowns(stored("requests"), C)),
        "top_pages": lambda: run(t.top_pages(stored("daily"), stored("daily_pages"), stored("page_bots"), stored("referrals"), stored("pages"), R, C)),
        "page_list": lambda: run(t.page_list(stored("pages"), stored("page_bots"), stored("daily"), stored("daily_pages"), stored("findings"), R, C)),
        "crawler_pages": lambda: run(t.crawler_pages(stored("daily"), stored("daily_bots"), stored("page_bots"), stored("pages"), R, C)),
        "referral_pages": lambda: run(t.referral_pages(stored("referrals"), stored("daily_pages"), stored("pages"), C)),
        "history_weekly": lambda: run(t.history(stored("daily_bots"), R, C, 365, "week")),
        "recommendations": lambda: run(quality.recommendations(stored("findings"), stored("pages"))),
        "page_facts": lambda: run(cq.facts(spark, d)),
        "page_terms": lambda: run(terms()),
        "key_terms": lambda: run(cq.key_terms(spark, d)),
        "robots_matrix": lambda: run(qq.robots_matrix(spark, d)),
        "page_scores": lambda: run(qq.page_scores(spark, d)),
    }
    run(stored("requests").groupBy("bot").count())  # start the executors
    seconds = {}
    for name, fn in queries.items():
        t0 = time.perf_counter()
        fn()
        seconds[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(d).removeprefix("sf"), "events": stored("requests").count(), "cpus": int(cpus),
                      "fold_events_per_sec": round(stored("requests").count() / seconds["rollup_fold"]), "log_mb_per_sec": round(log_mb / seconds["log_parse"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
