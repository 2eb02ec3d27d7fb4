"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item is cut into windows of 13 words (a shorter item is one window), a window into its set of five-word
shingles (fewer words: the whole window). Containment must be complete, so of a window's shingles, ordered by
rarity over all documents, the prefix that has to be joined is the rarest one alone; a window of which some
shingle never occurs is left out at once. The joined place gives the only possible start (positional bound),
which must leave room for the window in the document (length bound). Then every shingle of the window is
verified at its own place: consecutive five-word shingles that all agree are the window's words in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.llm.shared import ascii_lower, cut, documents

WINDOW, SHINGLE = 13, 5
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: The benchmark's shingles are broadcast up to so many rows of about 24 bytes; beyond that they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def _hashes(w: Column, size: int) -> Column:
    """The hash of each run of `size` words, in order."""
    one = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])
    return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), one)).otherwise(F.array().cast("array<bigint>"))


def _windows(benchmark: DataFrame) -> DataFrame:
    """item_id, win (a number of the window), len, size of its shingles, hashes: one row per window of an item with words."""
    items = cut(benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter("size(w) > 0"))
    length = F.least(F.size("w"), F.lit(WINDOW))
    starts = items.select("item_id", "w", length.alias("len"), F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("at"))
    each = starts.select("item_id", "len", F.least("len", F.lit(SHINGLE)).alias("size"), F.slice("w", F.col("at") + 1, F.col("len")).alias("w"))
    by_size = F.coalesce(*[F.when(F.col("size") == s, _hashes(F.col("w"), s)) for s in range(1, SHINGLE + 1)])
    return each.select("item_id", "len", "size", by_size.alias("hashes")).distinct()


def occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, version (a hash of the text), at, len, item_id: each place where a window of an item stands in a document."""
    windows = cut(_windows(benchmark))
    wanted = windows.select("size", F.explode("hashes").alias("h")).distinct()
    facts = wanted.groupBy("size").count().collect()  # at most five rows
    sizes = sorted(r["size"] for r in facts)
    if sum(r["count"] for r in facts) <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    held = docs.select("doc_id", F.xxhash64("text").alias("version"), words(F.col("text")).alias("w"))
    found = None
    for s in sizes or [SHINGLE]:
        places = held.select("doc_id", "version", F.size("w").alias("n"), F.lit(s).alias("size"), F.posexplode(_hashes(F.col("w"), s)).alias("at", "h"))
        some = places.join(wanted, ["size", "h"]).select("doc_id", "version", "n", "size", "at", "h").distinct()
        found = some if found is None else found.unionByName(some)
    found = cut(found)

    rarity = found.groupBy("size", "h").count()
    tokens = windows.select("*", F.posexplode("hashes").alias("k", "h")).join(rarity, ["size", "h"])
    whole = tokens.groupBy("item_id", "len", "size", "hashes").agg(F.count("*").alias("met"), F.min(F.struct("count", "k", "h")).alias("rare"))
    prefix = cut(whole.filter("met = size(hashes)").select("item_id", "len", "size", "hashes", F.col("rare.k").alias("k"), F.col("rare.h").alias("h")))
    if prefix.count() <= BROADCAST_ROWS // SHINGLE:
        prefix = F.broadcast(prefix)

    # the hashes at the places around each one, as far as they follow without a gap: what a window there has to agree with
    most = WINDOW - SHINGLE
    order = Window.partitionBy("doc_id", "version", "size").orderBy("at")
    near = [F.when(F.lead("at", i).over(order) == F.col("at") + i, F.lead("h", i).over(order)) for i in range(-most, most + 1)]
    run = found.select("doc_id", "version", "n", "size", "at", "h", F.array(*near).alias("near"))
    room = (run["at"] >= prefix["k"]) & (run["at"] - prefix["k"] + prefix["len"] <= run["n"])
    same = F.slice(run["near"], most + 1 - prefix["k"], F.size(prefix["hashes"])) == prefix["hashes"]
    kept = run.join(prefix, (run["size"] == prefix["size"]) & (run["h"] == prefix["h"]) & room & same)
    return kept.select("doc_id", "version", (run["at"] - prefix["k"]).alias("at"), "len", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted strings), contaminated, version: one row per row of docs.

    A null text or item has no words and hits nothing. Rows are told apart by doc_id and text, so repeated rows get
    equal results and a null doc_id is an id like any other; items with equal windows are all reported; an empty
    benchmark hits nothing. Other columns are ignored.
    """
    spans = occurrences(docs, benchmark).groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(F.struct("at", "len"))).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))

    def add(acc: Column, x: Column) -> Column:
        end = x["at"] + x["len"]
        return F.struct((acc["hit"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["at"]))).alias("hit"), F.greatest(acc["end"], end).alias("end"))

    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
    hits = spans.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), F.aggregate("spans", start, add)["hit"].cast("long").alias("n_hit"), "items")
    counted = docs.select("doc_id", F.xxhash64("text").alias("version"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(hits, counted.doc_id.eqNullSafe(hits.d) & (counted.version == hits.v), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"), "version")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    bad = cut(contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("d"), F.col("version").alias("v")).distinct())
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.d) & (F.xxhash64(docs.text) == bad.v), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH items AS (SELECT *, least(len(w), 13) AS l FROM (SELECT CAST(item_id AS VARCHAR) AS item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, l, list_slice(w, i, i + l - 1) AS g FROM (SELECT *, unnest(generate_series(1, len(w) - l + 1)) AS i FROM items)),
docs AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
grams AS (SELECT doc_id, l, i, list_slice(w, i, i + l - 1) AS g FROM (
    SELECT doc_id, w, l, unnest(generate_series(1, len(w) - l + 1)) AS i FROM docs, (SELECT DISTINCT l FROM windows))),
found AS (SELECT doc_id, l, i, item_id FROM grams JOIN windows USING (l, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + l - 1)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
