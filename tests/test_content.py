import pytest
from pyspark.sql import functions as F

from trailmark.config import Config, DAY
from trailmark.functions import html, text
from trailmark.operators import alerts, content, quality, robots
from trailmark.plans import publish
from trailmark.sources.registry import Registry

NOW = 1_760_000_000
CFG = Config(as_of=NOW)
R = Registry.seed()

PAGE = """<!doctype html><html lang="en"><head><title>How to brew &amp; pour</title><!-- <title>no</title> -->
<meta name="description" content="All about &quot;coffee&quot;"><meta content="noindex, follow" name=robots>
<link rel="canonical" href="https://www.example.com/brew/"><script type="application/ld+json">{"@context":"https://schema.org","@type":["Article","WebPage"],"author":{"@type":"Person"}}</script>
</head><body><header><nav><a href="/menu">Menu</a><h2>Not content</h2></nav></header><main><h1>Brew</h1><h2>What is brewing?</h2><p>Hi.</p>
<p>Brewing is the art of making coffee with hot water.<p>Second &#233; one &eacute; more words here.</p><h3>Steps</h3><ol><li>Grind</li><li>Pour</li></ol>
<table><tr><td>a</td></tr></table><img src=a.png><img src="b.png" alt="ok"><img role="presentation" src=c.png>
<a href="/shop/?x=1">shop</a><a href="https://www.example.com/shop">again</a><a href="https://other.example/">out</a><a href="#top">t</a><a href="/pic.png">p</a><a href="mailto:x@y">m</a>
<style>p{}</style><script>var a="<p>no</p>";</script><div class="faq-block">Is it good? Yes.</div></main><footer>foot</footer></body></html>"""


def test_page_facts(spark):
    rows = spark.createDataFrame([(1, "https://example.com/brew/", PAGE)], "page_id bigint, url string, html string")
    f = content.analyze_pages(rows, CFG).first()
    assert (f.title, f.description, f.lang, f.h1) == ("How to brew & pour", 'All about "coffee"', "en", "Brew")
    assert (f.canonical, f.canonical_elsewhere, f.noindex, f.noai) == ("https://www.example.com/brew/", False, True, False)
    assert set(f.schema) == {"Article", "WebPage", "Person"}
    assert (f.h2, f.h3, f.headings, f.question_headings) == (1, 1, ["What is brewing?", "Steps"], ["What is brewing?"])
    assert (f.lists, f.tables, f.images, f.images_no_alt, f.external_links, f.links) == (1, 1, 3, 1, 1, ["/shop"])
    assert f.first_para_words == 10 and f.faq and "Second é one é more" in f.text and "foot" not in f.text and "var a" not in f.text
    assert f.intent.intent == "informational"


def test_text_helpers(spark):
    df = spark.createDataFrame([("Don't stop. It’s état-major 42! 2 more? \"Yes\"",)], "t string")
    r = df.select(text.words(F.col("t")).alias("w"), text.sentences(F.col("t")).alias("s"), text.is_question(F.lit("Where is it")).alias("q"),
                  text.subject(F.lit("The ultimate guide to cold brew — part 3")).alias("j")).first()
    assert r.w == ["don't", "stop", "it’s", "état-major", "42", "2", "more", "yes"]
    assert r.s == ["Don't stop.", "It’s état-major 42!", "2 more?", '"Yes"'] and r.q and r.j == "cold brew"
    e = spark.range(1).select(html.decode_entities(F.lit("a &amp;lt; &#x1F600; &copy; &bogus; & b")).alias("x")).first().x
    assert e == "a &lt; \U0001F600 © &bogus; & b"


def test_term_counts_weigh_emphasis_and_phrases(spark):
    rows = spark.createDataFrame([(1, "Cold brew coffee. Cold brew is the best, 123 times", "Cold brew")], "page_id bigint, text string, emphasis string")
    got = {r.term: r.weight for r in content.term_counts(rows, text.STOP_WORDS).collect()}
    assert got == {"cold": 5, "brew": 5, "cold brew": 5, "coffee": 1, "times": 1}


ROBOTS_A = "User-agent: *\nDisallow: /private/\n\nUser-agent: GPTBot\nDisallow: /\n\nUser-agent: Googlebot\nUser-agent: Bingbot\nDisallow: /search\n"
ROBOTS_B = ("User-agent: *\nDisallow: /shop/\nAllow: /shop/products/\nDisallow: /*.pdf$\nDisallow: /tmp*\nAllow: /page\nDisallow: /page\n"
            "# comment\nDisallow: /x # trailing comment\n")
TRUTH = [("a", "GPTBot", "/blog/", False), ("a", "ClaudeBot", "/blog/", True), ("a", "ClaudeBot", "/private/x", False), ("a", "Googlebot", "/private/x", True),
         ("a", "bingbot", "/search?q=1", False), ("a", "Googlebot-News", "/search", False), ("b", "GPTBot", "/shop/products/mug", True), ("b", "GPTBot", "/shop/cart", False),
         ("b", "GPTBot", "/files/guide.pdf", False), ("b", "GPTBot", "/files/guide.pdf?download=1", True), ("b", "GPTBot", "/tmpfile", False), ("b", "GPTBot", "/page", True),
         ("b", "GPTBot", "/x/y", False), ("c", "GPTBot", "/", True), ("d", "GPTBot", "/", True)]


def test_robots_truth_table(spark):
    sites = spark.createDataFrame([("a", ROBOTS_A), ("b", ROBOTS_B), ("c", "User-agent: *\nDisallow:\n"), ("d", "")], "site string, body string")
    tokens = sorted({t for _, t, _, _ in TRUTH})
    policy = robots.policies(sites, [(t, t) for t in tokens])
    asked = spark.createDataFrame([(s, p) for s, _, p, _ in TRUTH], "site string, path string").distinct()
    got = {(r.site, r.token, r.path): (r.allowed, r.rule) for r in robots.check(policy, asked).collect()}
    for site, token, path, want in TRUTH:
        assert got[(site, token, path)][0] == want, (site, token, path)
    assert got[("b", "GPTBot", "/shop/cart")][1] == "Disallow: /shop/"


def test_rule_index_decides_as_all_rules_tried_one_by_one(spark):
    import random

    rng = random.Random(7)
    parts = ["/a", "/b", "/shop", ".pdf", "?q=1", "x", "é", "/"]
    text = lambda n: "".join(rng.choice(parts) for _ in range(rng.randint(1, n)))
    rule = lambda: rng.choice(["Allow: ", "Disallow: "]) + rng.choice(["", "*", "/"]) + text(3) + rng.choice(["", "", "*", "*" + text(1), "*" + text(2) + "$", "$"])
    body = lambda: "\n".join(f"User-agent: {a}\n" + "\n".join(rule() for _ in range(40)) for a in ("*", "GPTBot", "CCBot"))
    sites = spark.createDataFrame([("a", ROBOTS_A), ("b", ROBOTS_B), ("c", ""), *[(f"s{i}", body()) for i in range(4)]], "site string, body string")
    bots = [(t, t) for t in ("GPTBot", "CCBot", "ClaudeBot", "Googlebot-News")]
    asked = sites.select("site").crossJoin(spark.createDataFrame([(i, "/" + text(4)) for i in range(120)] + [(500, "/"), (501, "/tmp%C3%A9")], "page_id long, path string"))
    want = {(r.site, r.page_id, r.bot): (r.allowed, r.rule) for r in robots.check(robots.policies(sites, bots), asked).collect() if r.rule}
    index = robots.index(sites, bots)
    got = {(r.site, r.page_id, r.bot): (r.allowed, r.rule) for r in robots.page_verdicts(index, asked).join(index.groups, ["site", "agent"]).collect()}
    assert got == want and len({v[0] for v in want.values()}) == 2


def test_findings_lifecycle(spark):
    schema = "page_id bigint, code string, bot string, severity string, kind string, status string, n bigint, first_seen bigint, last_seen bigint, resolved_at bigint"
    stored = spark.createDataFrame([(1, "noindex", "", "critical", "observed", "open", None, 5, 5, None), (1, "no_faq", "", "info", "observed", "ignored", None, 5, 5, None),
                                    (2, "orphan", "", "warning", "observed", "resolved", None, 5, 5, 6), (2, "site_noindex", "", "critical", "observed", "open", None, 5, 5, None)], schema)
    now = spark.createDataFrame([(1, "no_faq", "", "info", "observed", None), (2, "orphan", "", "info", "observed", None), (3, "noai", "", "info", "observed", None)],
                                "page_id bigint, code string, bot string, severity string, kind string, n bigint")
    got = {(r.page_id, r.code): (r.status, r.event, r.resolved_at) for r in quality.sync_findings(stored, now, ("content",), CFG).collect()}
    assert got == {(1, "noindex"): ("resolved", "resolved", NOW), (1, "no_faq"): ("ignored", None, None), (2, "orphan"): ("open", "opened", None),
                   (2, "site_noindex"): ("open", None, None), (3, "noai"): ("open", "opened", None)}


def test_alert_cooldown_and_activity(spark):
    rows = [("r", "k", "info", t * DAY, 3 * DAY, "", 1) for t in (0, 1, 2, 3, 4, 7, 7)]
    df = spark.createDataFrame(rows, "rule string, key string, severity string, at bigint, cooldown bigint, subject string, n bigint")
    assert sorted(r.created_at // DAY for r in alerts.raise_alerts(df).collect()) == [0, 3, 7]
    stored = spark.createDataFrame([("r:k", 2 * DAY)], "dedupe string, created_at bigint")
    assert sorted(r.created_at // DAY for r in alerts.raise_alerts(df, stored).collect()) == [7]
    days = [(CFG.back(i), "gptbot", 0 if i < 9 else 10) for i in range(35)] + [(CFG.back(i), "claudebot", 40 if i < 8 else 5) for i in range(35)]
    bots = spark.createDataFrame(days, "day date, bot string, hits bigint")
    cfg = CFG.with_(monitoring_since=NOW - 60 * DAY)
    assert {(r.bot, r.kind) for r in alerts.activity(bots, R, cfg).collect()} == {("gptbot", "bot_stopped"), ("claudebot", "activity_up")}
    assert alerts.activity(bots, R, CFG.with_(monitoring_since=NOW - 5 * DAY)).count() == 0


def test_managed_robots_block(spark):
    choices = spark.createDataFrame([("s", "gptbot", "block"), ("s", "ccbot", "allow"), ("s", "googlebot", "block")], "site string, bot string, choice string")
    block = publish.crawler_rules(choices, R).first().block
    assert block == f"{publish.BEGIN}\nUser-agent: GPTBot\nDisallow: /\n\n{publish.END}\n"
    got = spark.range(1).select(publish.strip_rules(F.lit("User-agent: *\n\n" + block)).alias("x")).first().x
    assert got == "User-agent: *\n"


def test_importance(spark):
    rows = [("home", 0, "home", 0, 0, NOW, 0), ("post", 1, "product", 0, 4, NOW - 365 * DAY, 1200), ("post", 2, "post", -1, 9, NOW, 0), ("post", 3, "post", 1, 0, NOW, 0)]
    df = spark.createDataFrame(rows, "object_type string, object_id bigint, subtype string, pinned int, inlinks bigint, modified bigint, word_count bigint")
    got = [(r.importance, r.imp_reasons) for r in quality.importance(df, CFG).orderBy("object_id").collect()]
    assert got == [(65, ["home", "fresh"]), (27, ["product", "inlinks", "in_depth"]), (0, ["excluded"]), (100, ["pinned"])]


def planted_terms(spark, n, seed):
    """n pages: a term on three tenths of them, two on a fifth, and a long tail of rare ones."""
    import random

    rng = random.Random(seed)
    rows = []
    for page in range(n):
        own = {f"rare{rng.randrange(n // 2)}" for _ in range(3)}
        own |= {t for t, share in (("hot", 0.28), ("warm a", 0.2), ("warmb", 0.2)) if rng.random() < share}
        rows += [(page, t, rng.randrange(1, 5)) for t in sorted(own)]
    terms = spark.createDataFrame(rows, "page_id long, term string, weight long")
    pages = spark.createDataFrame(
        [(p, p % 60, 0, p % 7, "post", p % 31 == 30, True) for p in range(n)],
        "page_id long, importance long, pinned int, inlinks long, object_type string, deleted boolean, analyzed boolean")
    links = spark.createDataFrame([(rng.randrange(n), rng.randrange(n)) for _ in range(n)] + [(p, 45) for p in range(0, n, 2)], "from_id long, to_id long")
    return terms, pages, links


@pytest.mark.parametrize("light", [3, 30, 10_000])
def test_link_suggestions_are_the_best_of_all_pairs(spark, light):
    from collections import defaultdict

    terms, pages, links = planted_terms(spark, 240, 1)
    ranked = content.key_terms(terms, content.document_frequency(terms), F.lit(240))
    got = {(r.target_id, r["rank"]): (r.from_id, r.shared_terms, r.weight) for r in content.suggest_links(terms, ranked, links, pages, F.lit(240), CFG, light=light).collect()}
    weights, live = {(r.page_id, r.term): r.weight for r in terms.collect()}, {r.page_id for r in pages.collect() if not r.deleted}
    own = defaultdict(list)
    for r in sorted(ranked.collect(), key=lambda r: r["rank"]):
        if 2 <= r.pages <= 72 and len(own[r.page_id]) < 6:
            own[r.page_id].append(r.term)
    linked = {(r.from_id, r.to_id) for r in links.collect()}
    want = {}
    for p in pages.collect():
        if p.page_id in live and p.importance >= CFG.importance_min and p.inlinks < 5:
            found = [(-len(s), -sum(s), q) for q in live - {p.page_id} if (q, p.page_id) not in linked and (s := [weights[q, t] for t in own[p.page_id] if (q, t) in weights])]
            for k, (n, w, q) in enumerate(sorted(found)[:3]):
                want[p.page_id, k + 1] = (q, -n, -w)
    assert got == want and len(want) > 100


def test_link_candidates_grow_with_the_pages(spark):
    def pairs(n):
        terms, pages, links = planted_terms(spark, n, 2)
        ranked = content.key_terms(terms, content.document_frequency(terms), F.lit(n))
        own = content._wanted(ranked, pages, F.lit(n), CFG, None).join(terms.groupBy("term").agg(F.count("*").alias("df")), "term").withColumn("heavy", F.col("df") > 20)
        closed = own.select("target_id", F.col("target_id").alias("from_id")).distinct()
        return content.link_candidates(own, terms.withColumnRenamed("page_id", "from_id"), closed, 3).count()

    assert pairs(1200) < 3 * pairs(600)


def test_ranks_of_a_hot_group_span_tasks(spark):
    from trailmark.operators.ranks import with_rank

    rows = spark.range(0, 900, 1, 6).select("id", F.when(F.col("id") % 9 == 0, F.lit(None)).when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("site"), (F.col("id") * 7 % 50).alias("w"))
    got = {r.id: r["rank"] for r in with_rank(rows, "site", [F.desc("w"), F.asc("id")]).collect()}
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.site, []).append((-r.w, r.id))
    assert got == {i: k + 1 for g in groups.values() for k, (_, i) in enumerate(sorted(g))}


def test_whole_titles_name_topics(spark):
    title = "The state-of-the-art coffee " + " ".join(f"w{i}" for i in range(60)) + " grinder"
    pages = spark.createDataFrame([(1, title, False), (2, "Other", False), (3, "Tea pot", True)], "page_id long, title string, deleted boolean")
    terms = spark.createDataFrame([(p, t, 2) for p in (1, 2) for t in ("state-of-the-art coffee", "w59 grinder", "art", "tea pot", "w1 w3")], "page_id long, term string, weight long")
    assert {r.term for r in content.topics(terms, pages).collect()} == {"state-of-the-art coffee", "w59 grinder", "art"}


def test_frequent_terms_meet_in_blocks(spark, monkeypatch):
    terms, pages, links = planted_terms(spark, 240, 4)
    ranked = content.key_terms(terms, content.document_frequency(terms), F.lit(240))
    found = lambda: sorted(tuple(r) for r in content.suggest_links(terms, ranked, links, pages, F.lit(240), CFG, light=3).select("target_id", "rank", "from_id", "weight").collect())
    whole = found()
    monkeypatch.setattr(content, "BLOCK", 60)  # several blocks of pages and groups of targets
    assert found() == whole and len(whole) > 100


def test_a_block_of_links_fits_in_a_task():
    """A full task's arrays, from one of a fiftieth of its postings and asked terms."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng, n = np.random.default_rng(1), content.BLOCK // 50
    pages, targets = n // 100, n // 6
    ends = lambda rows, each: pa.array(np.arange(rows + 1) * each, pa.int32())
    item = pa.StructArray.from_arrays([rng.integers(0, 5000, pages * 100), np.ones(pages * 100, np.int64)], ["t", "weight"])
    postings = pa.table({"from_id": rng.permutation(pages), "terms": pa.ListArray.from_arrays(ends(pages, 100), item)})
    asked = pa.table({"target_id": np.arange(targets), "keep": np.full(targets, 5), "need": np.ones(targets, np.int64), "terms": pa.ListArray.from_arrays(ends(targets, 6), pa.array(rng.integers(0, 5000, targets * 6)))})
    tracemalloc.start()
    try:
        found = content._best_of_block()(asked, postings)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.num_rows > 4 * targets and most * 50 < 400e6


def test_every_page_meets_every_crawler(spark):
    bots = robots.robots_bots(R)
    sites = spark.createDataFrame([("a", ROBOTS_A), ("b", ROBOTS_B)], "site string, body string")
    pages = spark.createDataFrame([("a", 1, "/private/x"), ("a", 2, "/open"), ("b", 3, "/shop/cart"), ("b", 4, "/")], "site string, page_id long, path string")
    cols = ["page_id", "bot", "allowed", "rule"]
    got = sorted(tuple(r) for r in robots.page_access(robots.index(sites, bots), pages).select(*cols).collect())
    assert got == sorted(tuple(r) for r in robots.check(robots.policies(sites, bots), pages).select(*cols).collect())
    assert len(got) == 4 * len(bots) and (4, "gptbot", True, "") in got


def test_terms_are_counted_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, "Cold brew, cold brew -- coffee’s", None), (2, None, ""), (3, "", "Tea")], "page_id bigint, text string, emphasis string")
    lists = content.term_lists(rows, text.STOP_WORDS, keep=("emphasis",))
    assert {r.page_id: (r.total, len(r.terms)) for r in lists.collect()} == {1: (7, 4), 2: (0, 0), 3: (3, 1)}
    counts = content.term_counts(rows, text.STOP_WORDS)
    assert sorted(tuple(r) for r in counts.collect()) == [(1, "brew", 2), (1, "coffee’s", 1), (1, "cold", 2), (1, "cold brew", 2), (3, "tea", 3)]
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
