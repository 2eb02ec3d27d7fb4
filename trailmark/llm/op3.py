"""SimHash near-duplicates, found by multi-index hashing.

Documents meet as distinct 64-bit fingerprints. A fingerprint is cut into three segments; two that differ in
at most four bits differ in at most one bit within some segment. So every fingerprint looks up each segment's
Hamming ball of radius one among the stored segments, and full distances are verified in that same join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.components import components
from trailmark.llm.shared import cut, documents

SHINGLE, DISTANCE = 4, 4
#: (first bit, bits) of each segment; with three of them a ball of radius one reaches distances up to five.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
CHUNK = 1 << 15


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The SimHash of one text as a signed 64-bit number; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    h, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([h(joined[s:e], 42) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: one row per row of docs, in no other order. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _segment(fp: Column, j: int) -> Column:
    first, bits = SEGMENTS[j]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct values `fp` at the given distance (5 at most) or nearer, once each."""
    stored = fps.select(F.explode(F.array(*[F.struct(F.lit(j).alias("j"), _segment(F.col("fp"), j).alias("v")) for j in range(len(SEGMENTS))])).alias("k"), F.col("fp").alias("b"))
    balls = F.concat(*[
        F.array(*[F.struct(F.lit(j).alias("j"), _segment(F.col("fp"), j).bitwiseXOR(F.lit(m)).alias("v")) for m in [0, *(1 << i for i in range(bits))]])
        for j, (_, bits) in enumerate(SEGMENTS)
    ])
    probes = fps.select(F.explode(balls).alias("k"), F.col("fp").alias("a"))
    flat = lambda df, x: df.select(F.col("k.j").alias("j"), F.col("k.v").alias("v"), x)
    p, s = flat(probes, "a"), flat(stored, "b")
    near = (p.a < s.b) & (F.bit_count(p.a.bitwiseXOR(s.b)) <= distance)
    return p.join(s, (p.j == s.j) & (p.v == s.v) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links) for each row of docs.

    Rows without a doc_id get their fingerprint and take part in links; a component of such rows alone has a null
    id. Repeated rows and texts share a fingerprint, texts without words share fingerprint zero, other columns of
    docs are ignored, and no rows give no rows.
    """
    each = cut(fingerprints(docs))
    fps = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = fps.join(components(links(fps.select("fp"), distance)).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # both are written first: a group with many fingerprints is then a skewed join that adaptive execution can split
    roots = cut(roots)
    least = cut(roots.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(roots.select("fp", "root").join(least, "root").select("fp", "component_id"))
    return each.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs that stand for their group: those with its smallest doc_id, one row of each; all columns stay.

    A group whose rows all lack a doc_id is kept whole.
    """
    found = near_duplicates(docs, distance).filter("component_id = doc_id").select("doc_id").distinct()
    with_id = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).join(found, "doc_id", "left_semi")
    return with_id.unionByName(docs.filter("doc_id is null"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
