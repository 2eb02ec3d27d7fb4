import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trailmark.llm import op7


def gapless(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents_are_cut_and_packed_whole(spark):
    texts = [(i, f"word{i} " * (1 + i * 7 % 300), "x") for i in range(120)] + [(500, "long text. " * 4000, None), (501, None, ""), (502, "", ""), (503, "a", ""), (503, "a", ""), (None, "b c", "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, length string").repartition(9)
    rows = op7.pack_documents(docs).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for doc, text, _ in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(doc, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=str) == sorted(want, key=str)
    used = gapless(rows, 2048)
    assert used <= -(-sum(w[3] for w in want) // 2048) + 1
    assert op7.pack_documents(docs.limit(0)).count() == 0


def test_open_sequences_meet_over_many_partitions(spark):
    items = spark.range(640).select("id", (F.col("id") % 40 + 1).alias("length")).repartition(64)
    rows = op7.pack(items, 100).collect()
    assert len(rows) == 640 and gapless(rows, 100) <= -(-sum(r.length for r in rows) // 100) * 1.1
    same = op7.pack(spark.range(200).select("id", F.lit(60).cast("long").alias("length")).repartition(20), 100).collect()
    assert gapless(same, 100) == 200


def test_all_open_sequences_meet_whatever_their_number(spark, monkeypatch):
    monkeypatch.setattr(op7, "PASSED", 2, raising=False)
    items = spark.range(0, 64, 1, 64).select("id", F.when(F.col("id") < 32, 60).otherwise(40).cast("long").alias("length"))
    rows = op7.pack(items, 100).collect()
    assert len(rows) == 64 and gapless(rows, 100) == 32


def test_runs_of_one_partition_meet(spark, monkeypatch):
    monkeypatch.setattr(op7, "RUN", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        rows = op7.pack(spark.range(0, 64, 1, 1).select("id", F.when(F.col("id") < 32, 60).otherwise(40).cast("long").alias("length")), 100).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 64 and gapless(rows, 100) == 32


def test_plan_is_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(50):
        lengths = rng.integers(1, 90, rng.integers(1, 200))
        sizes, n = np.unique(lengths, return_counts=True)
        rows = op7.plan(dict(zip(sizes.tolist(), n.tolist(), strict=True)), 100)
        bins = defaultdict(int)
        for size, _, items, times, first, offset in sorted(rows.tolist(), key=lambda r: r[4:]):
            for b in range(items // times):
                assert offset == bins[first + b]
                bins[first + b] += size * times
        assert sorted(bins.values()) == sorted(op7.best_fit(lengths, 100)[2].tolist())
