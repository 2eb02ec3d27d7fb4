import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from trailmark.llm import op8


def tables(spark, n=400):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        words = [rng.choice("the and of sea hill river stone garden window letter".split()) + rng.choice(["", "ly", "s", "ing"]) for _ in range(rng.randint(30, 200))]
        docs.append((i, " ".join(words) + "." if good else " | ".join(w.upper() + "!!" for w in words[: 1 + i % 40]), "src", 0.5))
        if i % 3:
            labels.append((i, int(good), 0))
    docs += [(n, None, "", 0.0), (n + 1, "", None, 0.0), (n + 2, "word " * 200_000, "", 0.0), (None, "no id", "", 0.0), (1, docs[1][1], "", 0.0)]
    labels += [(None, 1, 0), (5, None, 0), (999_999, 0, 0), (1, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, quality string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart_and_never_learned_from(spark):
    docs, labels = tables(spark)
    model = op8.learn(docs, labels)
    rows = {r.doc_id: r.score for r in op8.score(docs, model, "doc_id").collect()}
    assert all(0 <= s <= 1 for s in rows.values()) and len(rows) == 404
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((rows[i] >= op8.THRESHOLD) == (i % 4 > 0) for i in held) >= 0.97 * len(held)
    turned = labels.withColumn("quality", F.when(op8._held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in op8.score(docs, op8.learn(docs, turned), "doc_id").collect()}
    assert again == rows


def test_the_filter_keeps_columns_and_empty_tables_work(spark):
    docs, labels = tables(spark)
    kept = op8.keep_good(docs, labels)
    assert kept.columns == docs.columns and 280 <= kept.count() <= 310
    assert op8.keep_good(docs.limit(0), labels.limit(0)).count() == 0
    assert op8.learn(docs, labels.limit(0)) == 0.5


def test_scores_are_differences_of_log_densities():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(1, 2, (500, 3))])
    y = np.repeat([0, 1], [300, 500])
    m = op8._fit(x, y, 0.0, 0.0)
    z = (x - m.shift) / m.scale
    want = []
    for k in (0, 1):
        p = z[y == k]
        s = np.cov(p.T, bias=True) + 1e-3 * np.eye(3)
        d = z - p.mean(axis=0)
        want.append(np.log(len(p) / len(z)) - np.linalg.slogdet(s)[1] / 2 - np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) / 2)
    assert np.allclose(m.log_odds(x), want[1] - want[0])


def test_all_documents_stay_where_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en") for i in range(30)] + [(None, None, None)], "doc_id long, text string, lang string")
    for rows in ([], [(i, 1) for i in range(30)], [(i, i % 2) for i in range(8)], [(None, 1), (1, None)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        assert sorted(op8.keep_good(docs, labels).collect(), key=str) == sorted(docs.collect(), key=str)
