"""Near-duplicate vectors by NN-descent.

Equal vectors of one label are one class. A forest of random hyperplanes deals the classes of a label to small
leaves; the nearest in its leaf are a class's first neighbours. The planes go through the mean of the label. NN-descent
then lets all neighbours of a class meet (neighbours of neighbours, reverse ones included) and keeps the nearest, until
hardly any list changes. Threshold edges make components. Where a list may be saturated, it is enlarged to its whole
component: members meet in bounded square blocks, of which only each member's number of links leaves the task. A
brute-force audit over a sample then measures the share of classes that have all their links, and another forest
follows while it is below the target. Where FORESTS forests don't reach it, or too few classes have links for an audit,
all classes of each label meet in square blocks: that is exact, and its cost grows with the square of a label.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.llm.components import components
from trailmark.llm.shared import cut

THRESHOLD = 0.98
#: Neighbours kept, trees of a forest, classes in a leaf, members of a block and of a meeting, all at most.
LIST, TREES, LEAF, BLOCK, MEETING = 8, 6, 256, 1024, 96
#: Rows that a call in Python takes, about; groups are never split for it.
BATCH = 10_000
#: Planes of a tree, and times that overfull leaves are split further.
PLANES, DEEPER = 62, 3
#: Lists have settled when no more than this share of their places changes.
SETTLED = 0.001
#: The audit compares about so many classes with all others, and more (MOST at most) until ENOUGH of them have links;
#: forests are added until the share RECALL of those has all its links, and from FORESTS on the rest is done exactly.
AUDIT, ENOUGH, MOST, RECALL, FORESTS = 400, 200, 32_000, 0.995, 4
#: Classes of a block where all of a label meet, and of the audit's sample that meet others at once.
WIDE, AT_ONCE = 4096, 512
_PAIRS = "a long, b long, sim double"


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of unit length, in double precision. Huge and tiny components are scaled first, so that squares stay finite."""
    x = np.array(vectors.tolist(), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _in_groups(df: DataFrame, keys: list[str], rows: int, work: Callable[[pd.DataFrame, np.ndarray], list[np.ndarray]], schema: str) -> DataFrame:
    """work(group, unit vectors) for each group by `keys`; returned are the columns of `schema`.

    Groups are bounded by whoever calls; a task call holds many of them, about BATCH of the `rows` expected, so that
    small groups cost no call of their own.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        vectors, frame = frame["vec"], frame.drop(columns="vec")
        whole = _matrix(vectors) if vectors.map(len).nunique() == 1 else None  # a group's vectors are of one length
        groups = frame.groupby(keys, sort=False).indices.values()
        parts = [work(frame.iloc[at], _matrix(vectors.iloc[at]) if whole is None else whole[at]) for at in groups]
        return pd.DataFrame({n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(names)})

    return df.withColumn("batch", F.pmod(F.xxhash64(*keys), F.lit(max(1, rows // BATCH)))).groupBy("batch").applyInPandas(run, schema)


def _nearest(ids: np.ndarray, x: np.ndarray, k: int, threshold: float) -> list[np.ndarray]:
    """Each row's k nearest others, and a spanning forest of the threshold links, which keeps components that k neighbours may miss."""
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    k = min(k, len(ids) - 1)
    if k < 1:
        return [ids[:0], ids[:0], np.zeros(0)]
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    a, b = np.repeat(np.arange(len(ids)), k), near.ravel()
    linked = sim >= threshold
    full = np.flatnonzero(linked.sum(axis=1) >= k)
    if len(full):
        seen, tree = np.zeros(len(ids), bool), []
        for root in full.tolist():
            stack = [] if seen[root] else [root]
            seen[root] = True
            while stack:
                at = stack.pop()
                new = np.flatnonzero(linked[at] & ~seen)
                seen[new] = True
                tree += [(at, n) for n in new.tolist()]
                stack += new.tolist()
        if tree:
            ta, tb = np.array(tree).T
            a, b = np.concatenate([a, ta, tb]), np.concatenate([b, tb, ta])
    return [ids[a], ids[b], sim[a, b]]


def _means(classes: DataFrame) -> DataFrame:
    """label, dim, mean: the mean of the unit vectors of each label and length."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (label, dim), part in frame.groupby(["label", "dim"]):
                yield pd.DataFrame({"label": label, "dim": dim, "place": np.arange(dim), "sum": _matrix(part["vec"]).sum(axis=0), "rows": len(part)})

    parts = classes.select("label", "dim", "vec").mapInPandas(sums, "label string, dim int, place int, sum double, rows long")
    each = parts.groupBy("label", "dim", "place").agg((F.sum("sum") / F.sum("rows")).alias("mean"))
    return each.groupBy("label", "dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "mean"))), lambda x: x["mean"]).alias("mean"))


def _forest(classes: DataFrame, means: DataFrame, n: int, forest: int, threshold: float) -> DataFrame:
    """a, b, sim: nearest others within the leaves of one forest. classes: id, label, dim, size of its label and dim, vec."""

    def codes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (label, dim, n), part in frame.groupby(["label", "dim", "n"]):
                x = _matrix(part["vec"]) - np.array(part["mean"].iloc[0])
                for tree in range(TREES):
                    planes = np.random.default_rng([forest, tree, dim]).standard_normal((dim, PLANES))
                    code = ((x @ planes > 0).astype(np.int64) << np.arange(PLANES)).sum(axis=1)
                    yield pd.DataFrame({"id": part["id"], "label": label, "dim": dim, "tree": tree, "code": code, "depth": max(0, math.ceil(math.log2(max(1, n) / LEAF * 2)))})

    coded = cut(classes.join(means, ["label", "dim"]).select("id", "label", "dim", "n", "mean", "vec").mapInPandas(codes, "id long, label string, dim int, tree int, code long, depth int"))
    leaf = ["label", "dim", "tree", "depth", "leaf"]
    for more in range(DEEPER + 1):
        coded = coded.withColumn("leaf", F.expr(f"code & (shiftleft(1L, least(depth, {PLANES})) - 1)"))
        counts = coded.groupBy(*leaf).count()
        full = F.col("count") > 2 * LEAF
        if more == DEEPER or not counts.filter(full & (F.col("depth") < PLANES)).limit(1).count():
            break
        # a leaf that holds too many is split by more planes
        deeper = F.when(full, F.col("depth") + F.ceil(F.log2(F.col("count") / LEAF)).cast("int")).otherwise(F.col("depth"))
        coded = cut(coded.join(counts, leaf).withColumn("depth", F.least(deeper, F.lit(PLANES))).drop("count", "leaf"))
    # what is too large even then is dealt out by hash; the audit tells whether that parts links that the descent misses
    dealt = coded.join(counts, leaf).withColumn("share", F.pmod(F.xxhash64("id", F.lit(forest), "tree"), F.ceil(F.col("count") / (2 * LEAF))))

    met = dealt.join(classes.select("id", "vec"), "id")
    return _in_groups(met, [*leaf, "share"], TREES * n, lambda g, x: _nearest(g["id"].to_numpy(), x, LIST, threshold), _PAIRS)


def _best(pairs: DataFrame, threshold: float) -> DataFrame:
    """Of each a the LIST nearest b, and all links of the threshold."""
    once = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return once.withColumn("place", place).filter((F.col("place") <= LIST) | (F.col("sim") >= threshold)).drop("place")


def _lists(graph: DataFrame) -> DataFrame:
    """a, b: of each a the LIST nearest b."""
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return graph.withColumn("place", place).filter(F.col("place") <= LIST).select("a", "b")


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _descend(nearest: DataFrame, new: DataFrame, classes: DataFrame, n: int, turn: int, threshold: float) -> DataFrame:
    """a, b, sim: what comes of all neighbours of each class meeting, where one of them is new. A class with many reverse neighbours holds several meetings."""
    both = _both(nearest).join(_both(new).select("a").distinct(), "a", "left_semi")
    sizes = both.groupBy("a").agg(F.ceil(F.count("*") / MEETING).alias("tables"))
    seated = both.join(sizes, "a").select("a", F.pmod(F.xxhash64("b", F.lit(turn)), F.col("tables")).alias("seat"), F.col("b").alias("id"))
    hosts = sizes.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tables") - 1)).alias("seat"), F.col("a").alias("id"))

    met = seated.unionByName(hosts).join(classes.select("id", "vec"), "id")
    return _in_groups(met, ["a", "seat"], 2 * LIST * n, lambda g, x: _nearest(g["id"].to_numpy(), x, LIST, threshold), _PAIRS)


def _degrees(classes: DataFrame, n: int, members: DataFrame, threshold: float) -> DataFrame:
    """id, others (rows linked beyond its own class), found (classes linked): exact within each component, in square blocks."""
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = members.join(sizes, "root").select("id", "root", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("mine"))
    rows = placed.select("id", "root", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    pairs = rows.select("id", "root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("left"))

    def count(frame: pd.DataFrame, x: np.ndarray) -> list[np.ndarray]:
        ids, copies, left = frame["id"].to_numpy(), frame["copies"].to_numpy(), frame["left"].to_numpy()
        if frame["i"].iloc[0] == frame["j"].iloc[0]:
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            return [ids, linked @ copies, linked.sum(axis=1)]
        linked = x[left] @ x[~left].T >= threshold
        return [np.concatenate(p) for p in ((ids[left], ids[~left]), (linked @ copies[~left], linked.T @ copies[left]), (linked.sum(axis=1), linked.sum(axis=0)))]

    met = pairs.join(classes.select("id", "vec", "copies"), "id")
    met = _in_groups(met, ["root", "i", "j"], n, count, "id long, others long, found long")
    return met.groupBy("id").agg(F.sum("others").alias("others"), F.sum("found").alias("found"))


def _audit(classes: DataFrame, n: int, degrees: DataFrame, threshold: float) -> float | None:
    """Of the classes with links in a sample, the share that has all of them; None if too few of MOST have any."""
    samples = max(1, -(-n // AUDIT))
    sampled = cut(classes.withColumn("sample", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(samples))).filter(F.col("sample") < max(1, MOST // AUDIT)).join(degrees, "id", "left").select("sample", "id", "label", "dim", "vec", F.coalesce("found", F.lit(0)).alias("found")))
    linked = whole = upto = 0
    while linked < ENOUGH and upto < min(samples, max(1, MOST // AUDIT)):
        first, upto = upto, min(upto + min(max(1, 3 * upto), 10), max(1, MOST // AUDIT))
        sample = sampled.filter((F.col("sample") >= first) & (F.col("sample") < upto)).toPandas()
        if not len(sample):
            continue
        asked = [(label, dim, part["id"].to_numpy(), _matrix(part["vec"])) for (label, dim), part in sample.groupby(["label", "dim"])]

        def count(frames: Iterator[pd.DataFrame], asked: list = asked) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for label, dim, ids, x in asked:
                    part = frame[(frame["label"] == label) & (frame["dim"] == dim)]
                    others, y = part["id"].to_numpy(), _matrix(part["vec"]) if len(part) else None
                    for at in range(0, len(ids) if len(part) else 0, AT_ONCE):
                        some = ids[at : at + AT_ONCE]
                        links = ((x[at : at + AT_ONCE] @ y.T >= threshold) & (some[:, None] != others[None, :])).sum(axis=1)
                        yield pd.DataFrame({"id": some[links > 0], "links": links[links > 0]})

        true = classes.select("id", "label", "dim", "vec").mapInPandas(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links")).toPandas()
        linked += len(true)
        whole += int((true.merge(sample[["id", "found"]], on="id").eval("links == found")).sum())
    if linked < ENOUGH and upto < samples:
        return None
    return whole / linked if linked else 1.0


def _missed(classes: DataFrame, n: int, members: DataFrame, threshold: float) -> DataFrame:
    """a, b: links between the components of members (id, root), enough to join all that belong together; exact, in square blocks of each label."""
    placed = classes.select("id", "label", "dim", F.ceil(F.col("n") / WIDE).alias("blocks")).withColumn("mine", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")))
    rows = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = rows.select("id", "label", "dim", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("left"))

    def link(frame: pd.DataFrame, x: np.ndarray) -> list[np.ndarray]:
        roots, left, out = frame["root"].to_numpy(), frame["left"].to_numpy(), [np.zeros((0, 2), np.int64)]
        one = frame["i"].iloc[0] == frame["j"].iloc[0]
        rows, cols = (np.arange(len(x)),) * 2 if one else (np.flatnonzero(left), np.flatnonzero(~left))
        for at in range(0, len(rows), AT_ONCE):
            some = rows[at : at + AT_ONCE]
            a, b = np.nonzero((x[some] @ x[cols].T >= threshold) & (roots[some][:, None] != roots[cols][None, :]))
            out.append(np.unique(np.stack([roots[some][a], roots[cols][b]], axis=1), axis=0))
        a, b = np.unique(np.concatenate(out), axis=0).T
        return [a, b]

    met = pairs.join(classes.select("id", "vec"), "id").join(members, "id", "left").withColumn("root", F.coalesce("root", "id"))
    copies = placed.agg(F.sum("blocks")).first()[0] or 0
    return _in_groups(met, ["label", "dim", "i", "j"], copies, link, "a long, b long").distinct()


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors; see the contract of op1 for the columns.

    Rows link only under equal labels that aren't null, and vectors of equal length. A vector that is null, empty,
    zero or has a null or non-finite component, and a row without an id, link with nothing: n_links 0, component_id
    its own id. Repeated rows count as rows of their own, so copies of one id link. Other columns are ignored. Of the
    classes with links, about the share RECALL or more have all of them; all do where the exact way was needed.
    """
    kind = dict(vectors.dtypes)[embedding]
    given = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>" if kind != "array<float>" else kind).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    rows = given.withColumn("usable", usable)
    good = rows.filter("usable")
    grouped = good.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    counts = grouped.groupBy("label", F.size("vec").alias("dim")).agg(F.count("*").alias("n"))
    classes = cut(grouped.withColumn("dim", F.size("vec")).join(counts, ["label", "dim"]))
    means = cut(_means(classes))
    # one id may stand for two classes if an id is repeated with unequal vectors: they get numbers of their own
    numbered = classes.groupBy("id").count().filter("count > 1").limit(1).count()
    if numbered:
        classes = cut(classes.withColumn("least", F.col("id")).withColumn("id", F.xxhash64("label", "vec")))
    else:
        classes = classes.withColumn("least", F.col("id"))

    def joined(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        members = cut(components(links).select(F.col("node").alias("id"), "root"))
        return members, cut(_degrees(classes, n, members, threshold))

    n, graph, forest, turn, before = classes.count(), None, 0, 0, None
    while True:
        fresh = _forest(classes, means, n, forest, threshold)
        graph = cut(_best(fresh if graph is None else graph.unionByName(fresh), threshold))
        while True:
            nearest = cut(_lists(graph))
            new = nearest if before is None else cut(nearest.join(before, ["a", "b"], "left_anti"))
            before = nearest
            if new.count() <= SETTLED * LIST * n:
                break
            graph = cut(_best(graph.unionByName(_descend(nearest, new, classes, n, turn, threshold)), threshold))
            turn += 1
        forest += 1
        links = graph.filter(F.col("sim") >= threshold).select("a", "b")
        members, degrees = joined(links)
        recall = _audit(classes, n, degrees, threshold)
        if recall is not None and recall >= RECALL:
            break
        if recall is None or forest >= FORESTS:
            members, degrees = joined(links.unionByName(_missed(classes, n, members, threshold)))
            break
    known = classes.select("id", "label", "vec", "copies", "least").join(members, "id", "left").join(degrees, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(least, "root").select("label", "vec", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = good.join(named, ["label", "vec"]).select("id", "n_links", "component_id")
    out = out.unionByName(rows.filter("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE good AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reached AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT vec_id, b FROM reached JOIN links ON other = a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""
