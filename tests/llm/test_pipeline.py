from itertools import combinations

import corpus_pipeline
from test_op3 import brute_fp
from test_op5 import brute
from trailmark.llm import op4, op8, semicrf

import numpy as np


def tables(spark, path):
    rows = []
    for i in range(60):
        body = " ".join(f"the word{i} of river{i + k} and stone" for k in range(12)) + f". Mail a{i}@b.org now."
        rows.append((i, body if i % 4 else " | ".join(f"W{i}X{k}!!" for k in range(30)), "en", "s", len(body)))
    rows += [(100, rows[1][1], "en", "s", 9), (101, rows[2][1] + " x", "en", "s", 9), (102, "", "en", "s", 0), (103, None, None, None, None), (104, rows[3][1].replace("river3", "benchmark item that is quite long and stands in a benchmark too as it were, says one,"), "en", "s", 1)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    item = "benchmark item that is quite long and stands in a benchmark too as it were, says one"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, [(1, item)]


def test_every_stage_against_plain_python(spark, tmp_path):
    rows, items = tables(spark, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    model = op8.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = [r for r in rows if (model if isinstance(model, float) else model.score(np.array([op8.statistics(r[1])]))[0]) >= op8.THRESHOLD]
    fps = {r[0]: brute_fp(r[1]) for r in kept}
    group = {d: d for d in fps}
    for _ in fps:
        for a, b in combinations(fps, 2):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                group[a] = group[b] = min(group[a], group[b])
    kept = [r for r in kept if group[r[0]] == r[0]]
    bad = {b[0] for b in brute([(r[0], r[1]) for r in kept], items) if b[5]}
    kept = [r for r in kept if r[0] not in bad]
    masked = {r[0]: op4.masked(r[1], semicrf.trained()) for r in kept}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
    assert {r.doc_id: r.text for r in docs.collect()} == masked and len(masked) > 20 and 104 not in masked and 100 not in masked
    assert all("@" not in (t or "") for t in masked.values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(masked)
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        ends = [o + n for o, n in sorted(places)]
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_stages_on_empty_tables(spark, tmp_path):
    rows, _ = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
