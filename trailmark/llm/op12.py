"""A Merkle manifest of a dataset, with an inclusion proof for every row, by exchange of subtrees.

Each source is a tree of threes over its leaves in order of doc_id; the subroots, in order of source, are the leaves
of one tree more. A tree is cut into superblocks of 3 ** LEVELS leaves, so no source is ever gathered: superblocks reduce to
one node each, those nodes form superblocks again, until a tree has one node. On the way back each superblock gets
the few nodes that it needs from outside (its siblings on all levels above), and `exchange` cogroups them with the
superblock's own nodes: local reduction, joining the proof and folding happen together there. Small trees share a
group. Texts stay in the scan: only doc_ids and digests travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.llm.shared import cut, documents

#: Children of a node, and levels of a superblock, which has up to FAN ** LEVELS leaves.
FAN, LEVELS = 3, 7
NODE = "tree string, idx long, n long, digest string"
PATH = "tree string, idx long, path array<string>, subroot string, root string"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof array<string>"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(docs: DataFrame, text: Column | None = None) -> Column:
    """The digest of a row of documents, with another text in place of its own if one is given."""
    parts = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), F.col("text") if text is None else text]
    return F.sha2(F.concat(*[_field(p) for p in parts]).cast("binary"), 256)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` (tree, ...) with idx, the place of a row in its tree by `order`, and n, the rows of the tree.

    Rows are dealt out by ranges and counted in their partition; the trees of a partition begin after those before it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, nth = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            numbers = []
            for tree in batch.column("tree").to_pylist():
                nth = nth + 1 if tree == last else 0
                last = tree
                numbers.append(nth)
            yield batch.append_column("part", pa.array([part] * len(numbers), pa.int64())).append_column("nth", pa.array(numbers, pa.int64()))

    schema = f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, part long, nth long"
    dealt = cut(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).mapInArrow(count, schema))
    own = dealt.groupBy("part", "tree").agg((F.max("nth") + 1).alias("own"))
    tree = Window.partitionBy("tree")
    starts = own.select("part", "tree", (F.sum("own").over(tree.orderBy("part")) - F.col("own")).alias("before"), F.sum("own").over(tree).alias("n"))
    return dealt.join(starts, ["part", "tree"]).withColumn("idx", F.col("before") + F.col("nth")).drop("part", "nth", "before")


def _reduced(digests: list[str], n: int, levels: int) -> list[list[str]]:
    """A superblock's nodes level by level: up to one node in a tree of one superblock, all levels in a larger one."""
    nodes = [digests]
    while len(nodes[-1]) > 1 if n <= FAN**levels else len(nodes) <= levels:
        below = nodes[-1]
        nodes.append([_hash("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return nodes


def _siblings(nodes: list[list[str]], i: int) -> list[str]:
    """Level by level what stands left and right of node i in its run, as `left|right`."""
    out = []
    for level in nodes[:-1]:
        run = i - i % FAN
        out.append(f"{''.join(level[run:i])}|{''.join(level[i + 1 : run + FAN])}")
        i //= FAN
    return out


def _superblocks(frame: pd.DataFrame, levels: int) -> Iterator[tuple[tuple[str, int], pd.DataFrame, list[list[str]]]]:
    """Key, nodes in order and reduced levels of each superblock of a group."""
    ordered = frame.assign(block=frame["idx"] // FAN**levels).sort_values(["tree", "idx"])
    for key, own in ordered.groupby(["tree", "block"], sort=False):
        yield key, own, _reduced(own["digest"].tolist(), int(own["n"].iloc[0]), levels)


def _slot(nodes: DataFrame, small: int, levels: int) -> DataFrame:
    """The group in which a node is reduced: its superblock, or a bucket of whole small trees, which have `small` nodes in all."""
    span = FAN**levels
    bucket = F.pmod(F.xxhash64("tree"), F.lit(max(1, -(-small // span))))
    return nodes.withColumn("block", F.expr(f"idx div {span}")).withColumn("slot", F.when(F.col("n") > span, F.xxhash64("tree", "block")).otherwise(bucket))


def reduced(nodes: DataFrame, levels: int) -> DataFrame:
    """One node (NODE) for each superblock of slotted nodes."""

    def up(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(tree, block, -(-int(own["n"].iloc[0]) // FAN**levels), found[-1][0]) for (tree, block), own, found in _superblocks(frame, levels)]
        return pd.DataFrame(rows, columns=["tree", "idx", "n", "digest"])

    return nodes.select("slot", "tree", "idx", "n", "digest").groupBy("slot").applyInPandas(up, NODE)


def exchange(nodes: DataFrame, outer: DataFrame, levels: int, proofs: bool = False, with_proof: bool = False) -> DataFrame:
    """Cogroups superblocks with what they need from outside. `outer` (PATH) has a row for each superblock: idx is its number.

    Gives the PATH of each node, or for `proofs` of leaves (doc_id, now) the rows of PROOF.
    """
    needed = nodes.select("slot", "tree", F.col("block").alias("idx")).distinct().join(outer, ["tree", "idx"])
    needed = needed.toDF(*(f"_{c}" for c in needed.columns))  # both sides come from the same nodes

    schema = PROOF.replace("doc_id long", "doc_id string") if proofs else PATH

    def meet(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        known = {(tree, idx): (list(path), subroot, root) for tree, idx, _, path, subroot, root in above.itertuples(index=False)}
        rows: list[tuple] = []
        for key, block, found in _superblocks(own, levels):
            path, subroot, root = known[key]
            if proofs:
                for i, (doc, digest, now) in enumerate(zip(block["doc_id"], block["digest"], block["now"], strict=True)):
                    proof = _siblings(found, i) + path
                    folded = now
                    for step in proof:
                        left, right = step.split("|")
                        folded = _hash(left + folded + right)
                    rows.append((doc, digest, subroot, root, _hash("".join(proof).replace("|", "")), folded, folded == root, proof if with_proof else None))
            else:
                rows += [(key[0], idx, _siblings(found, i) + path, subroot, root) for i, idx in enumerate(block["idx"])]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    # ids travel as text: pandas would turn a column of integers with nulls into floats
    columns = ["slot", "tree", "idx", "n", "digest", *([F.col("doc_id").cast("string"), "now"] if proofs else [])]
    return nodes.select(columns).groupBy("slot").cogroup(needed.groupBy("_slot")).applyInPandas(meet, schema)


def _climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The slotted nodes, then those of their superblocks, and so on; the last has one row for each tree."""
    span, tiers = FAN**levels, []
    while True:
        most, small = nodes.agg(F.coalesce(F.max("n"), F.lit(0)), F.count_if(F.col("n") <= span)).first()
        tiers.append(_slot(nodes, small, levels))
        if tiers[1:] and most <= 1:
            return tiers
        nodes = cut(reduced(tiers[-1], levels))


def manifest(docs: DataFrame, text_now: Column | None = None, with_proof: bool = False, levels: int = LEVELS) -> DataFrame:
    """One row of PROOF per row of docs: its leaf, the subroot of its source, the root, and its proof.

    `text_now` is the text as it is found now (an expression over docs): folded_root is computed from the leaf of that
    text and the proof, verified says whether it is the root. Nulls in any column have leaves of their own; null
    sources are one source, which comes first; null doc_ids come first in it; rows of equal doc_id follow each other
    by leaf, and equal rows are leaves each. Other columns are ignored. No rows give no manifest.
    """
    own = leaf(docs)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"), own.alias("digest"), (own if text_now is None else leaf(docs, text_now)).alias("now")
    )
    leaves = cut(numbered(rows, "doc_id", "digest", "now"))
    tiers = _climb(leaves, levels)
    subroots = tiers[-1].select("tree", "digest")
    # the tree over all sources: its leaves are the subroots, which keep their tree as `name`
    tops = cut(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name"))
    above = _climb(tops, levels)
    outer = above[-1].select("tree", "idx", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for tier in reversed(above[:-1]):
        outer = exchange(tier, outer, levels)
    named = tops.select("name", "idx", "digest").join(outer.select("idx", "path", "root"), "idx")
    outer = named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("idx"), "path", F.col("digest").alias("subroot"), "root")
    for tier in reversed(tiers[1:-1]):
        outer = exchange(tier, outer, levels)
    found = exchange(tiers[0], outer, levels, proofs=True, with_proof=with_proof).withColumn("doc_id", F.col("doc_id").cast("long"))
    return found if with_proof else found.drop("proof")


def tampered(docs: DataFrame) -> Column:
    """The text without its line feeds where 2 divides the CRC-32 of the decimal doc_id, else the text."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return manifest(docs, tampered(docs))


def oracle(levels: int = 12, top: int = 9) -> str:
    """The same in SQL, level by level, for sources of up to 3 ** levels rows and up to 3 ** top sources."""
    field = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
    row = lambda text: "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)), lambda c, b: {bits}), 4294967295)"
    ctes = [
        f"""d AS (SELECT doc_id, source, {row("text")} AS leaf, {row("now")} AS now FROM
            (SELECT *, CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now FROM documents))""",
        """a0 AS (SELECT source AS tree, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, now) - 1 AS i,
            count(*) OVER (PARTITION BY source) AS n, doc_id, now FROM d)""",
    ]
    run = "OVER (PARTITION BY tree, i // 3 ORDER BY i)"

    def level(name: str, k: int) -> None:
        ctes.append(f"""{name}s{k} AS (SELECT tree, i, n, coalesce(lag(h, 2) {run}, '') || coalesce(lag(h) {run}, '') AS l,
            coalesce(lead(h) {run}, '') || coalesce(lead(h, 2) {run}, '') AS r FROM {name}{k})""")
        ctes.append(f"""{name}{k + 1} AS (SELECT tree, i // 3 AS i, (min(n) + 2) // 3 AS n,
            CASE WHEN min(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h FROM {name}{k} GROUP BY tree, i // 3)""")

    for k in range(levels):
        level("a", k)
    ctes.append(f"b0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS i, count(*) OVER () AS n, tree AS source, h FROM a{levels})")
    for k in range(top):
        level("b", k)
    steps = [("a", k) for k in range(levels)] + [("b", k) for k in range(top)]
    ctes.append(f"f0 AS (SELECT x.doc_id, x.tree, x.h AS leaf, x.i, y.i AS j, y.h AS subroot, x.now AS fold, '' AS proof FROM a0 x JOIN b0 y ON x.tree IS NOT DISTINCT FROM y.source)")
    for m, (name, k) in enumerate(steps):
        on = f"s.tree IS NOT DISTINCT FROM f.tree AND s.i = f.i // {3**k}" if name == "a" else f"s.i = f.j // {3**k}"
        ctes.append(f"""f{m + 1} AS (SELECT f.doc_id, f.tree, f.leaf, f.i, f.j, f.subroot, proof || s.l || s.r AS proof,
            CASE WHEN s.n > 1 THEN sha256(s.l || fold || s.r) ELSE fold END AS fold FROM f{m} f JOIN {name}s{k} s ON {on})""")
    # every level is read by two others: without MATERIALIZED each would be computed anew for each of them
    made = ", ".join(c.replace(" AS (", " AS MATERIALIZED (", 1) for c in ctes)
    return f"""WITH {made} SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t.h AS verified
        FROM f{len(steps)} CROSS JOIN b{top} t"""


ORACLE_SQL = oracle()
