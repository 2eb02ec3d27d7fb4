"""Document quality by regularised quadratic discriminant analysis over transformed document statistics.

The statistics describe letters, words and lines of a whole text; language, source, id and labels are no inputs.
The model is fitted on a bounded sample of labelled documents (SAMPLE rows, those with the smallest hash of
doc_id). Each class covariance is shrunk towards the pooled one and towards its diagonal; how far is chosen on a
fifth of the sample. Scores are differences of Mahalanobis log-densities, by Cholesky factors that are computed
once, and a temperature chosen on that fifth too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.shared import documents

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
THRESHOLD = 0.7
NAMES = (
    "bytes", "words", "word_bytes", "capitals", "digits", "wide", "exclamations", "bars", "symbols", "stops", "lines",
    "line_copies", "distinct", "most_frequent", "runs", "pair_copies", "longest", "entropy",
)
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b"!", b"|", b"#$%&*+/<=>@\\^_`{}~", b".,;:?")):
    _CLASS[list(_chars)] = _k + 1


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, already transformed (logarithms of sizes, square roots of shares); all zero if it is empty."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [float(np.log1p(len(data)))] + [0.0] * (len(NAMES) - 1)
    n = len(words)
    each = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = np.bincount(_CLASS, weights=each, minlength=8)[1:] / len(data)
    p = each[each > 0] / len(data)
    seen = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:], strict=False))
    shares_ = [*shares, len(lines) / n, 1 - len(set(lines)) / len(lines)]
    runs = sum(map(bytes.__eq__, words, words[1:])) / n
    return [
        float(np.log1p(len(data))), float(np.log1p(n)), float(np.log1p((len(data) - n) / n)), *np.sqrt(shares_).tolist(), float(np.log1p(len(seen)) / np.log1p(n)), (max(seen.values()) / n) ** 0.5, runs**0.5,
        max(0.0, 1 - len(pairs) / max(1, n - 1)) ** 0.5, float(np.log1p(max(map(len, seen)))), float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class Discriminant:
    """Two classes: means, inverse Cholesky factors, log-determinants, log-priors; scale of the features; temperature."""

    shift: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    temperature: float = 1.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.shift) / self.scale
        far = [(((z - m) @ f.T) ** 2).sum(axis=1) for m, f in zip(self.means, self.factors, strict=True)]
        return (self.offsets[1] - far[1] / 2) - (self.offsets[0] - far[0] / 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / self.temperature, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, pooled: float, diagonal: float) -> Discriminant:
    shift, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - shift) / scale
    parts = [z[y == k] for k in (0, 1)]
    means = np.array([p.mean(axis=0) for p in parts])
    covs = [(p - m).T @ (p - m) / len(p) for p, m in zip(parts, means, strict=True)]
    both = sum(c * len(p) for c, p in zip(covs, parts, strict=True)) / len(z)
    factors, offsets = [], []
    for c, p in zip(covs, parts, strict=True):
        s = (1 - pooled) * c + pooled * both
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + 1e-3 * np.eye(len(s))
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low))
        offsets.append(np.log(len(p) / len(z)) - np.log(np.diag(low)).sum())
    return Discriminant(shift, scale, means, np.array(factors), np.array(offsets))


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant | float:
    """The model with the smallest log loss on every fifth row; a constant score where a class has fewer than ten rows."""
    if min((y == 0).sum(), (y == 1).sum()) < 10:
        return float((y == 1).sum() + 1) / (len(y) + 2)
    apart = np.arange(len(y)) % 5 == 4
    if min(np.bincount(y[apart], minlength=2).min(), np.bincount(y[~apart], minlength=2).min()) < 2:
        apart = np.zeros(len(y), bool)
    best = (np.inf, 0.0, 0.0, 1.0)
    for pooled in (0.02, 0.1, 0.3, 0.6):
        for diagonal in (0.02, 0.1, 0.3, 0.7):
            odds = _fit(x[~apart], y[~apart], pooled, diagonal).log_odds(x[apart] if apart.any() else x)
            sign = np.where((y[apart] if apart.any() else y) == 1, 1.0, -1.0)
            for t in (1.0, 1.5, 2.0, 3.0, 5.0, 8.0):
                best = min(best, (float(np.logaddexp(0, -sign * np.clip(odds / t, -30, 30)).mean()), pooled, diagonal, t))
    model = _fit(x, y, *best[1:3])
    model.temperature = best[3]
    return model


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def features(docs: DataFrame, *keys: str) -> DataFrame:
    """The given columns of docs, and `x`, the statistics of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([statistics(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], x], names=[*keys, "x"])

    held = docs.select(*keys, F.col("text").cast("string"))
    return held.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in held.dtypes[:-1]), "x array<double>"]))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Discriminant | float:
    """The model from labelled documents outside the held-out fold. Null labels and ids are left out; of unequal labels of one id the larger counts."""
    good = labels.filter("doc_id is not null and quality in (0, 1)").filter(~_held_out(F.col("doc_id")))
    some = good.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # `sample` rows of 12 bytes at most
    rows = sorted((r.doc_id, r.quality, r.x) for r in features(chosen, "doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample).collect())
    order = np.argsort([hash((r[0], 7)) for r in rows], kind="stable")
    x, y = np.array([r[2] for r in rows], float).reshape(-1, len(NAMES)), np.array([r[1] for r in rows], int)
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Discriminant | float, *keys: str) -> DataFrame:
    """The given columns of docs and `score` (0 to 1, higher is better) of each row's whole text; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(b.num_columns - 1).to_pylist()], float).reshape(-1, len(NAMES))
            s = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], names=[*keys, "score"])

    held = docs.select(*keys, F.col("text").cast("string"))
    return held.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in held.dtypes[:-1]), "score double"]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least `threshold`, with all their columns.

    Labels that are missing, or hold fewer than ten documents of a class, teach nothing: then all rows stay.
    """
    model, at = learn(docs, labels), docs.columns.index("text")
    if isinstance(model, float):
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(at).to_pylist()], float).reshape(-1, len(NAMES))
            yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, "doc_id").select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
