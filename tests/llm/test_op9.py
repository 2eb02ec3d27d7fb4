import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trailmark.llm import op9, rans


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 49407), max_size=300), st.integers(0, 3))
def test_round_trip(ids, repeat):
    ids = np.array(ids * (10**repeat), np.uint32)
    assert np.array_equal(rans.decode(rans.encode(ids)), ids)


def test_large_skewed_uniform_and_broken():
    rng = np.random.default_rng(1)
    for ids in (rng.zipf(1.3, 400_000) % 49408, np.arange(49408), np.zeros(300_001), rng.integers(0, 49408, 290_000), np.append(np.zeros(2_000_000), np.arange(49408))):
        ids = ids.astype(np.uint32)
        data = rans.encode(ids)
        assert np.array_equal(rans.decode(data), ids)
    skewed = (rng.zipf(1.3, 400_000) % 49408).astype(np.uint32)
    data = rans.encode(skewed)
    p = np.unique(skewed, return_counts=True)[1] / len(skewed)
    assert len(data) < 1.1 * -(p * np.log2(p)).sum() * len(skewed) / 8 + 4 * len(p)
    bad = bytearray(data)
    bad[len(bad) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(bad))


def test_files_hold_documents_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op9, "FILE_IDS", 400)
    texts = [(9 - i if i < 9 else i, f"Text {i}, mit Wörtern. " * (i % 13), i) for i in range(150)] + [(300, "lang " * 30_000, 0), (301, None, 0), (302, "", 0), (7, "twice", 0), (None, "no id", 0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, start int").repartition(7)
    op9.write_tokens(docs, f"{tmp_path}/t")
    got = op9.read_tokens(spark, f"{tmp_path}/t").collect()
    t, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for doc, text, _ in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        at += len(ids)
    assert sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got], key=str) == sorted(want, key=str)
    op9.write_tokens(docs.limit(0), f"{tmp_path}/none")
    assert op9.read_tokens(spark, f"{tmp_path}/none").count() == 0


if __name__ == "__main__":
    ids = (np.random.default_rng(0).zipf(1.2, 4_000_000) % 49408).astype(np.uint32)
    t0 = time.time(); d = rans.encode(ids); t1 = time.time(); rans.decode(d); print(len(d) / len(ids), t1 - t0, time.time() - t1)  # noqa: E702
