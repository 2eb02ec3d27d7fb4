"""What pages contain: facts, key terms, links, suggestions, topics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trailmark.config import Config, DAY
from trailmark.functions import html as h, paths, text as txt
from trailmark.storage import kept

MIN_LOCAL_WORDS = 80


def analyze_pages(pages: DataFrame, config: Config) -> DataFrame:
    """Facts of every page in one scan; the HTML never leaves the scan stage.

    Needs page_id, url, html. Optional columns: local_html (stored content,
    used when it has 80 words), home_host, status, x_robots, location, subtype,
    object_type, modified, author_known, author_bio.
    """
    given = set(pages.columns)
    opt = lambda name, default: F.col(name) if name in given else default
    null = lambda kind: F.lit(None).cast(kind)
    local = opt("local_html", F.lit(""))
    base = pages.select(
        "page_id", "url", "html",
        paths.normalize_path(F.col("url")).alias("path"),
        opt("home_host", paths.url_host(F.col("url"))).alias("home_host"),
        F.coalesce(opt("status", F.lit(200)), F.lit(0)).cast("int").alias("status"),
        F.coalesce(opt("x_robots", F.lit("")), F.lit("")).alias("x_robots"),
        F.coalesce(opt("location", F.lit("")), F.lit("")).alias("location"),
        opt("subtype", F.lit("post")).alias("subtype"),
        opt("object_type", F.lit("post")).alias("object_type"),
        opt("modified", null("bigint")).alias("modified"),
        opt("author_known", F.lit(False)).alias("author_known"),
        opt("author_bio", F.lit(False)).alias("author_bio"),
        local.alias("local"),
    )
    enough = txt.word_count(h.strip_tags(F.col("local"))) >= MIN_LOCAL_WORDS
    # Each step reads the one before it as a column, so no step is evaluated twice.
    body = h.with_main_region(base.withColumn("src", h.drop_comments(F.col("html"))), "src", "body")
    if "local_html" in given:
        body = body.withColumn("body", F.when(enough, h.content(F.col("local"))).otherwise(F.col("body")))
    body = body.withColumn("text", h.plain_body(F.col("body")))
    body = body.withColumns(h.body_parts(F.col("body"), F.col("text")))
    facts = h.body_facts(F.col("body"), F.col("url"), F.col("home_host"))
    out = body.select(
        "page_id", "url", "path", paths.url_hash(F.col("path")).alias("url_hash"), "home_host", "status", "x_robots",
        "location", "subtype", "object_type", "modified", "author_known", "author_bio", "text", "words",
        F.md5("body").alias("content_hash"),
        *[c.alias(n) for n, c in h.head_facts(F.col("src")).items()],
        *[c.alias(n) for n, c in facts.items()],
    )
    return out.withColumns({
        "fetched": F.lit(True),
        "noindex": h.noindex(F.col("robots_meta"), F.col("x_robots")),
        "noai": h.noai(F.col("robots_meta"), F.col("x_robots")),
        "canonical_elsewhere": h.canonical_elsewhere(F.col("canonical"), F.col("path"), F.col("home_host")),
        "modified_days": F.floor((F.lit(config.as_of) - F.col("modified")) / DAY).cast("int"),
        "intent": txt.intent(F.col("title"), F.col("headings"), F.col("text"), F.col("subtype"), F.col("schema")),
    })


def merge_inventory(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert an inventory snapshot: changed pages become dirty, unseen ones deleted.

    old: page_id, object_type, object_id, path, title, modified, dirty, deleted …
    new: object_type, object_id, path, title, modified. Rows match by object,
    else by path.
    """
    o = old.select(F.struct(*old.columns).alias("o"), "object_type", "object_id", paths.url_hash(F.col("path")).alias("url_hash"))
    n = new.withColumn("url_hash", paths.url_hash(F.col("path")))
    by_object = n.join(
        o.filter("object_type <> 'home'").select("object_type", "object_id", "o"), ["object_type", "object_id"], "left")
    matched = by_object.filter("o is not null")
    by_path = by_object.filter("o is null").drop("o").join(
        o.select("url_hash", "o").join(matched.select(F.col("o.page_id").alias("_m")), F.col("o.page_id") == F.col("_m"), "left_anti"),
        "url_hash", "left")
    seen = matched.unionByName(by_path)
    moved = F.coalesce(F.lower(F.col("o.path")) != F.lower(F.col("path")), F.lit(False))
    changed = F.col("o").isNull() | moved | F.col("o.deleted") | ~F.col("o.modified").eqNullSafe(F.col("modified"))
    live = seen.select(
        F.col("o.page_id").alias("page_id"), "object_type", "object_id", "path", "title", "modified",
        (changed | F.coalesce(F.col("o.dirty"), F.lit(False))).alias("dirty"), F.lit(False).alias("deleted"))
    gone = old.join(live.select("page_id"), "page_id", "left_anti")
    # a stale row that still holds the path of a live page gives it up
    gone = gone.join(live.select(F.lower("path").alias("_p")).distinct(), F.lower(F.col("path")) == F.col("_p"), "left_anti")
    return live.unionByName(gone.withColumn("deleted", F.lit(True)).select(*live.columns))


# terms -------------------------------------------------------------------

def _tokens(text: Column, stop: list[str]) -> Column:
    """Words without the marks at their end; words that name nothing are null so they break phrases."""
    # A word that ends in a letter or number.
    trimmed = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}](?:[\p{L}\p{N}'’-]*[\p{L}\p{N}])?"), 0)
    return F.transform(trimmed, lambda w: F.when(txt.usable(w, stop), w))


def _mentions(tokens: Column) -> Column:
    """Each word and each pair of neighbours."""
    rest = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(tokens, 1, rest), F.slice(tokens, 2, rest), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_compact(F.concat(tokens, pairs))


def term_lists(documents: DataFrame, stop: list[str], key: str = "page_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, text, emphasis), one row per document -> its terms as an array of (term, weight), and the total weight: body ×1, emphasis ×3.

    Counted inside the row: the sorted mentions of a document, and how far it is from one term to the next. Nothing
    is shuffled. Columns in `keep` stay.
    """
    own = [key, *keep]
    body = _tokens(F.coalesce("text", F.lit("")), stop)
    strong = _tokens(F.coalesce("emphasis", F.lit("")), stop)
    rows = documents.select(*own, body.alias("b"), strong.alias("e")).select(*own, _mentions(F.col("b")).alias("b"), _mentions(F.col("e")).alias("e"))
    rows = rows.select(*own, F.sort_array(F.concat("b", "e", "e", "e")).alias("m"))
    first = F.transform("m", lambda x, i: F.when((i == 0) | (x != F.get(F.col("m"), i - 1)), i))
    rows = rows.select(*own, "m", F.array_compact(first).alias("at"))
    ends = F.concat(F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), F.array(F.size("m")))
    # without mentions there is an end but no start
    runs = F.zip_with("at", F.slice(ends, 1, F.size("at")), lambda a, z: F.struct(F.get(F.col("m"), a).alias("term"), (z - a).cast("long").alias("weight")))
    counted = rows.select(*own, F.filter(runs, lambda t: ~t["term"].contains(" ") | (t["weight"] >= 2)).alias("terms"))
    return counted.withColumn("total", F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + t["weight"]))


def term_rows(lists: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per document and term; `total` is the weight of all terms of the document."""
    # a plain explode adds a filter on the list, which would be counted once more for it, in one nested expression
    return lists.select(key, "total", F.explode_outer("terms").alias("t")).filter("t is not null").select(key, "t.term", "t.weight", "total")


def term_counts(documents: DataFrame, stop: list[str], key: str = "page_id") -> DataFrame:
    """key, term, weight of documents (see `term_lists`)."""
    return term_rows(term_lists(documents, stop, key), key).drop("total")


def document_frequency(terms: DataFrame, key: str = "page_id") -> DataFrame:
    return terms.groupBy("term").agg(F.count(key).alias("df"))


def term_changes(old: DataFrame, new: DataFrame, key: str = "page_id") -> DataFrame:
    """+1 / -1 per term: how re-analysed pages move the document frequencies."""
    added = new.select(key, "term").join(old.select(key, "term"), [key, "term"], "left_anti").select("term", F.lit(1).alias("d"))
    gone = old.select(key, "term").join(new.select(key, "term"), [key, "term"], "left_anti").select("term", F.lit(-1).alias("d"))
    return added.unionByName(gone).groupBy("term").agg(F.sum("d").alias("delta"))


def key_terms(terms: DataFrame, df: DataFrame, n_documents: Column, key: str = "page_id", limit: int = 12) -> DataFrame:
    """Terms ranked by TF-IDF; phrases weigh 1.3. The weight of all terms of a document comes with them (`total`) or is summed here."""
    total = F.col("total") if "total" in terms.columns else F.sum("weight").over(Window.partitionBy(key))  # the distinct terms of one document
    idf = F.log((n_documents + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    score = F.col("weight") / F.greatest(F.col("total"), F.lit(1)) * idf * F.when(F.col("term").contains(" "), 1.3).otherwise(1.0)
    scored = terms.withColumn("total", total).join(df, "term", "left").withColumn("score", score)
    order = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "term")
    return (
        scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
        .select(key, "rank", "term", F.col("weight").alias("count"), F.coalesce("df", F.lit(0)).alias("pages"),
                F.round("score", 4).alias("score"))
    )


def topics(terms: DataFrame, pages: DataFrame, k: int = 30) -> DataFrame:
    """Heaviest terms on two or more pages that also occur as whole words in a title."""
    per_term = terms.join(pages.filter(~F.col("deleted")).select("page_id"), "page_id", "left_semi").groupBy("term").agg(
        F.count("*").alias("pages"), F.sum("weight").alias("weight"))
    top = per_term.filter("pages >= 2")
    # The terms of a title are its word runs of one and two words, so whole-word
    # containment is an equality on those and the titles are never multiplied by the terms.
    # Runs are cut at every character a term cannot hold.
    w = F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}\p{N}]+"), 0)
    gaps = F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}\p{N}]+([^\p{L}\p{N}]*)"), 1)
    span = lambda i, n: F.array_join(F.transform(
        F.slice(F.arrays_zip(w.alias("w"), gaps.alias("g")), i + 1, n),
        lambda x, j: F.when(j == n - 1, x["w"]).otherwise(F.concat(x["w"], x["g"]))), "")
    # A term is two words at most, of 40 characters each; what joins runs within a word makes more of them, but 40 in
    # all. So a title has that many spans per run, however long it is.
    spans = F.flatten(F.transform(
        F.sequence(F.lit(0), F.size(w) - 1),
        lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(40), F.size(w) - i)), lambda n: span(i, n))))
    in_titles = pages.filter(~F.col("deleted")).filter(F.size(w) > 0).select(
        F.explode(F.array_distinct(spans)).alias("term"))
    return top.join(in_titles.distinct(), "term", "left_semi").orderBy(F.desc("weight"), "term").limit(k)


def entities(documents: DataFrame, stop: list[str], key: str = "page_id", limit: int | None = None) -> DataFrame:
    """Names a text mentions: capitalised phrases that repeat or have several words; the first `limit` if given."""
    # What a name looks like.
    phrase = (r"(?<=\s)(\p{Lu}[\p{L}\p{N}&\.'’-]+(?:\s+(?:of|the|de|la|and|&)?\s*\p{Lu}[\p{L}\p{N}&\.'’-]+){0,3})")
    named = documents.select(key, F.posexplode(txt.sentences(F.col("text"))).alias("s", "sentence")).select(
        key, "s", "sentence",
        F.posexplode(F.regexp_extract_all(F.concat(F.lit(" "), "sentence"), F.lit(phrase), 1)).alias("i", "raw"))
    trimmed = F.regexp_replace("raw", r"^[ .'’-]+|[ .'’-]+$", "")
    rows = named.withColumn("phrase", trimmed).filter(
        ~(F.ltrim("sentence").startswith(F.col("phrase")) & ~F.col("phrase").contains(" "))
        & ~F.lower("phrase").isin(*stop) & (F.length("phrase") >= 3))
    counts = rows.groupBy(key, "phrase").agg(
        F.count("*").alias("mentions"), F.min(F.col("s") * 100000 + F.col("i")).alias("pos"))
    counts = counts.filter((F.col("mentions") >= 2) | F.col("phrase").contains(" "))
    order = Window.partitionBy(key).orderBy(F.desc("mentions"), "pos")
    ranked = counts.withColumn("rank", F.row_number().over(order)).drop("pos")
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


# links -------------------------------------------------------------------

def resolve_links(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """Extracted paths -> edges between pages of the inventory."""
    out = facts.select(F.col("page_id").alias("from_id"), F.explode("links").alias("path")).select(
        "from_id", paths.url_hash(F.col("path")).alias("url_hash"))
    targets = pages.filter(~F.col("deleted")).select("url_hash", F.col("page_id").alias("to_id"))
    return out.join(targets, "url_hash").filter("from_id <> to_id").select("from_id", "to_id").distinct()


def link_counts(links: DataFrame) -> DataFrame:
    """Inlinks and outlinks per page in one pass."""
    ends = links.select(F.explode(F.array(
        F.struct(F.col("to_id").alias("page_id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        F.struct(F.col("from_id").alias("page_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("page_id").agg(F.sum("i").alias("inlinks"), F.sum("o").alias("outlinks"))


#: Terms on more live pages than this have no postings of their own joined to targets.
LIGHT = 256


def _wanted(ranked: DataFrame, pages: DataFrame, n_documents: Column, config: Config, targets: int | None) -> DataFrame:
    """target_id, term, target_score: the six best usable terms of every page that should get links."""
    wanted = pages.filter(
        ~F.col("deleted") & F.col("analyzed") & ((F.col("importance") >= config.importance_min) | (F.col("pinned") > 0))
        & (F.col("inlinks") < 5) & (F.col("object_type") == "post")
    )
    if targets is not None:
        wanted = wanted.orderBy(F.desc("importance"), "inlinks", "page_id").limit(targets)
    usable = ranked.filter((F.col("pages") >= 2) & (F.col("pages") <= F.greatest(F.lit(3.0), n_documents * 0.3)))
    six = Window.partitionBy("page_id").orderBy("rank")
    return (
        usable.join(wanted.select("page_id"), "page_id", "left_semi")
        .withColumn("_r", F.row_number().over(six)).filter("_r <= 6")
        .select(F.col("page_id").alias("target_id"), "term", F.col("score").alias("target_score"))
    )


def _light_candidates(own: DataFrame, postings: DataFrame, closed: DataFrame, per_target: int) -> DataFrame:
    """target_id, from_id, bar: pages that share a light term with a target and may be among its best.

    `bar` is how many light terms the last of the target's `per_target` best shares (null: there are fewer). A page
    may still share all heavy terms, so those go that would stay under the bar even then.
    """
    shared = own.filter("not heavy").join(postings, "term").groupBy("target_id", "from_id").agg(F.count("*").alias("n"))
    shared = shared.join(closed, ["target_id", "from_id"], "left_anti")
    order = Window.partitionBy("target_id").orderBy(F.desc("n"), "from_id")
    ranked = shared.withColumn("_r", F.row_number().over(order))
    bars = ranked.filter(F.col("_r") == per_target).select("target_id", F.col("n").alias("bar"))
    heavies = own.groupBy("target_id").agg(F.count_if("heavy").alias("h"))
    open_ = shared.join(bars, "target_id", "left").join(heavies, "target_id")
    return open_.filter(F.col("bar").isNull() | (F.col("n") + F.col("h") >= F.col("bar"))).select("target_id", "from_id", "bar")


#: Postings that meet in one task, and asked terms.
BLOCK = 2_000_000
#: Above any sum of weights; six of it and the weights are whole numbers of 53 bits.
SHARED = float(1 << 40)
#: Targets whose best pages are put into one array at a time.
_TARGETS = 4096


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Ends of the lists, and their items one after another."""
    whole = lists.combine_chunks()
    return np.cumsum(whole.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64), whole.flatten()


def _best_of_block(shared: float = SHARED):
    def best(asked: pa.Table, postings: pa.Table) -> pa.Table:
        """target_id, from_id, score: of one block's pages the `keep` best of each target, those first that share the most terms."""
        # posting lists: places of pages in order of their ids, and what a shared term is worth there
        pages = postings["from_id"].to_numpy()
        by_id = np.argsort(pages)
        ends, items = _flat(postings["terms"])
        t = items.field("t").to_numpy()
        by = np.argsort(t, kind="stable")
        place = np.repeat(np.argsort(by_id), np.diff(ends, prepend=0))[by]
        worth = items.field("weight").to_numpy()[by] + shared
        t, pages = t[by], pages[by_id]
        del by
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1])[: len(t)])
        terms, last = t[first], np.append(first[1:], len(t))
        # the terms of each target that are in the block
        ends, items = _flat(asked["terms"])
        want = items.to_numpy()
        at = np.searchsorted(terms, want)
        known = terms[np.minimum(at, len(terms) - 1)] == want if len(terms) else np.zeros(len(want), bool)
        at, ends = at[known], np.append(0, np.cumsum(known))[ends]
        first, last = first[at], last[at]
        targets, keep, need = (asked[c].to_numpy() for c in ("target_id", "keep", "need"))
        starts = np.append(0, ends[:-1])
        able = np.flatnonzero((ends > starts) & (ends - starts >= need))
        out = [pa.table({"target_id": pa.array([], pa.int64()), "from_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        for some in np.split(able, range(_TARGETS, len(able), _TARGETS)):
            places, scores = [], []
            for k in some:
                spans = [slice(a, z) for a, z in zip(first[starts[k] : ends[k]], last[starts[k] : ends[k]], strict=True)]
                score = np.bincount(np.concatenate([place[s] for s in spans]), np.concatenate([worth[s] for s in spans]))
                found = np.zeros(0, np.int64)
                for n in range(int(score.max() // shared), need[k] - 1, -1):  # those that share the most terms first
                    found = np.flatnonzero(score >= n * shared)
                    if len(found) >= keep[k]:
                        break
                if len(found) > keep[k]:
                    found = found[score[found] >= np.partition(score[found], len(found) - keep[k])[len(found) - keep[k]]]
                found = found[np.argsort(-score[found], kind="stable")][: keep[k]]  # pages are in order of their ids
                places.append(found)
                scores.append(score[found])
            if places:
                target = np.repeat(targets[some], [len(x) for x in places])
                out.append(pa.table({"target_id": target, "from_id": pages[np.concatenate(places)], "score": np.concatenate(scores)}))
        return pa.concat_tables(out)

    return best


def _heavy_candidates(own: DataFrame, postings: DataFrame, closed: DataFrame, bars: DataFrame, per_target: int) -> DataFrame:
    """target_id, from_id: pages that share no light term but may be among the best by heavy ones.

    A page that shares just heavy terms scores by them alone, so it is among a target's best only if it is among the
    `per_target` best by heavy terms, after those that don't count. Pages are dealt out in blocks and targets in
    groups, both of bounded size; each task sums a target's posting lists within its block and gives back the best
    few. So no pair but those is written or shuffled. Targets whose bar is above their number of heavy terms ask for
    nothing. Targets and pages travel in one row each, with a list of their terms, and stay flat arrays in a task.
    """
    heavy = own.filter("heavy").select("target_id", "term")
    numbers = kept(heavy.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
    skipped = closed.groupBy("target_id").agg(F.count("*").alias("skipped"))
    many = heavy.groupBy("target_id").agg(F.count("*").alias("terms")).join(bars, "target_id", "left").filter(F.col("bar").isNull() | (F.col("bar") <= F.col("terms")))
    limits = many.join(skipped, "target_id", "left").select(
        "target_id", (F.coalesce("skipped", F.lit(0)) + per_target).alias("keep"), F.coalesce("bar", F.lit(1)).alias("need"))
    asked = kept(heavy.join(limits, "target_id").join(numbers, "term").groupBy("target_id", "keep", "need").agg(F.collect_list("t").alias("terms")))
    item = F.struct("t", F.col("weight").cast("long").alias("weight"))
    listed = kept(postings.join(numbers, "term").groupBy("from_id").agg(F.collect_list(item).alias("terms")))
    tasks = lambda rows: 1 + (rows.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK
    blocks, groups = tasks(listed), tasks(asked)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("group", part("target_id", groups)).withColumn("block", every(blocks))
    right = listed.withColumn("block", part("from_id", blocks)).withColumn("group", every(groups))
    best = left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInArrow(
        _best_of_block(), "target_id long, from_id long, score double")
    order = Window.partitionBy("target_id").orderBy(F.desc("score"), "from_id")
    ranked = best.withColumn("_r", F.row_number().over(order)).join(limits.select("target_id", "keep"), "target_id").filter("_r <= keep")
    return ranked.select("target_id", "from_id").join(closed, ["target_id", "from_id"], "left_anti")


def link_candidates(own: DataFrame, postings: DataFrame, closed: DataFrame, per_target: int) -> DataFrame:
    """target_id, from_id: few pages per target, with all of its `per_target` best among them.

    own: target_id, term, df, heavy; postings: term, from_id, weight of those terms; closed: pairs that don't count.
    """
    light = kept(_light_candidates(own, postings, closed, per_target))
    bars = light.groupBy("target_id").agg(F.max("bar").alias("bar"))
    heavy = _heavy_candidates(own, postings, closed, bars, per_target)
    return light.select("target_id", "from_id").unionByName(heavy).distinct()


def suggest_links(terms: DataFrame, ranked: DataFrame, links: DataFrame, pages: DataFrame, n_documents: Column,
                  config: Config, targets: int | None = None, per_target: int = 3, light: int = LIGHT) -> DataFrame:
    """Pages that share a target's terms but do not link to it yet.

    Targets are the important pages with fewer than five links, or the first `targets` of them, each with its six
    best terms. Pages rank by the number of shared terms, then by their weight. Terms on at most `light` pages
    are looked up in the term index; a term on more is never multiplied by its targets (see `_heavy_candidates`).
    Candidates, a bounded number per target, are then scored exactly.
    """
    own = kept(_wanted(ranked, pages, n_documents, config, targets))
    live = pages.filter(~F.col("deleted")).select("page_id")
    used = own.select("term").distinct()
    postings = kept(terms.join(used, "term", "left_semi").join(live, "page_id", "left_semi").select("term", F.col("page_id").alias("from_id"), "weight"))
    counts = postings.groupBy("term").agg(F.count("*").alias("df"))
    own = kept(own.join(counts, "term", "left").withColumn("heavy", F.coalesce(F.col("df") > light, F.lit(False))))
    goals = own.select("target_id").distinct()
    closed = kept(
        links.select(F.col("to_id").alias("target_id"), "from_id").join(goals, "target_id", "left_semi")
        .unionByName(goals.withColumn("from_id", F.col("target_id"))).distinct())
    pairs = link_candidates(own, postings, closed, per_target)
    shared = pairs.join(own, "target_id").join(postings, ["from_id", "term"])
    anchor = F.max_by("term", F.struct(
        F.when(F.col("term").contains(" "), 1).otherwise(0).alias("phrase"), F.col("target_score"), F.col("term")))
    found = shared.groupBy("target_id", "from_id").agg(
        F.count("*").alias("shared_terms"), F.sum("weight").alias("weight"), anchor.alias("anchor"))
    best = Window.partitionBy("target_id").orderBy(F.desc("shared_terms"), F.desc("weight"), "from_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= per_target)


# stored AI analyses (inputs, never produced here) -----------------------------

ASSIST_SCHEMA = """
    summary string, primary_keyword struct<keyword: string, why: string, volume: bigint, competition: string, used: boolean, measured: boolean>,
    secondary_keywords array<struct<keyword: string, why: string, volume: bigint, competition: string, used: boolean, measured: boolean>>,
    semantic_terms array<struct<term: string, used: boolean>>,
    entities array<struct<term: string, kind: string, used: boolean>>,
    faqs array<struct<question: string, answer: string, from_search: boolean>>,
    gaps array<string>, add array<struct<topic: string, why: string, heading: string>>
"""


def present_assist(pages: DataFrame) -> DataFrame:
    """Parse stored analyses (page_id, assist JSON) and label each item by where it comes from."""
    a = F.from_json("assist", ASSIST_SCHEMA)
    src = lambda flag, yes: F.when(F.coalesce(flag, F.lit(False)), yes).otherwise("suggested")
    kw = lambda k: F.struct(
        F.coalesce(k["keyword"], F.lit("")).alias("keyword"), k["volume"].alias("volume"),
        F.coalesce(k["used"], F.lit(False)).alias("used"), src(k["measured"], "measured").alias("source"))
    arr = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    keyword_t = "struct<keyword: string, why: string, volume: bigint, competition: string, used: boolean, measured: boolean>"
    keywords = F.concat(F.array_compact(F.array(F.col("a.primary_keyword"))), arr(F.col("a.secondary_keywords"), keyword_t))
    additions = F.transform(arr(F.col("a.add"), "struct<topic: string, why: string, heading: string>"), lambda x: x["topic"])
    return pages.withColumn("a", a).filter("a is not null").select(
        *[c for c in pages.columns if c != "assist"],
        F.coalesce(F.col("a.summary"), F.lit("")).alias("summary"),
        F.transform(keywords, kw).alias("keywords"),
        F.transform(arr(F.col("a.faqs"), "struct<question: string, answer: string, from_search: boolean>"), lambda q: F.struct(
            F.coalesce(q["question"], F.lit("")).alias("question"), src(q["from_search"], "search_results").alias("source"))).alias("questions"),
        F.filter(F.concat(arr(F.col("a.gaps"), "string"), additions), lambda g: g.isNotNull() & (g != "")).alias("gaps"),
        F.concat(
            F.transform(arr(F.col("a.semantic_terms"), "struct<term: string, used: boolean>"), lambda x: F.struct(x["term"].alias("term"), x["used"].alias("used"))),
            F.transform(arr(F.col("a.entities"), "struct<term: string, kind: string, used: boolean>"), lambda x: F.struct(x["term"].alias("term"), x["used"].alias("used"))),
        ).alias("terms"),
    )


def keyword_rollup(assists: DataFrame, k: int = 40) -> DataFrame:
    """Per keyword the page with the highest volume; measured ones first."""
    each = assists.select("page_id", "importance", F.explode("keywords").alias("k")).filter("k.keyword <> ''").select(
        "page_id", "importance", F.lower("k.keyword").alias("keyword"), F.coalesce("k.volume", F.lit(0)).alias("volume"), F.col("k.source").alias("source"))
    order = Window.partitionBy("keyword").orderBy(F.desc("volume"), F.desc("importance"), "page_id")
    best = each.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r", "importance")
    return best.orderBy(F.when(F.col("source") == "measured", 0).otherwise(1), F.desc("volume"), "keyword").limit(k)


def question_rollup(assists: DataFrame, k: int = 40) -> DataFrame:
    return assists.select("page_id", "importance", F.posexplode("questions").alias("pos", "q")).orderBy(
        F.desc("importance"), "page_id", "pos").limit(k).select("page_id", "q.*")


def gap_rollup(assists: DataFrame, k: int = 40) -> DataFrame:
    return assists.select("page_id", "importance", F.posexplode("gaps").alias("pos", "topic")).orderBy(
        F.desc("importance"), "page_id", "pos").limit(k).select("page_id", "topic")


def inferred_findings(assists: DataFrame, facts: DataFrame) -> DataFrame:
    """Gaps, missing terms and unanswered questions of stored analyses; one row per page × code."""
    have = facts.select("page_id", F.transform(F.concat("question_headings", "questions"), F.lower).alias("have"))
    rows = assists.join(have, "page_id", "left").withColumns({
        "have": F.coalesce("have", F.array().cast("array<string>")),
        "gap_items": F.array_distinct("gaps"),
        "missing": F.transform(F.filter("terms", lambda x: ~F.coalesce(x["used"], F.lit(False)) & (F.coalesce(x["term"], F.lit("")) != "")),
                               lambda x: x["term"]),
    }).withColumn("open_questions", F.filter(
        F.transform("questions", lambda q: q["question"]),
        lambda q: (q != "") & ~F.array_contains("have", F.lower(q))))
    item = lambda code, sev, col: F.when(F.size(col) > 0, F.struct(
        F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.size(col).alias("n"), F.col(col).alias("items")))
    return rows.select("page_id", F.explode(F.array_compact(F.array(
        item("content_gaps", "warning", "gap_items"),
        item("keyword_gaps", "info", "missing"),
        item("faq_opportunities", "info", "open_questions")))).alias("f")).select("page_id", "f.*", F.lit("inferred").alias("kind"))
