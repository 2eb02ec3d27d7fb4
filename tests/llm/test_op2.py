import hashlib
import random

import numpy as np
import pytest

from trailmark.llm import op2, suffixes


def brute(rows):
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - 49) if doc is not None else ():
            w = data[p : p + 50]
            first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - 49) if doc is not None else ():
            if first[data[p : p + 50]] < doc:
                gone[p : p + 50] = [True] * 50
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def made():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(8, 60)) for _ in range(6)]
    rows = []
    for i in range(90):
        parts = [text(rng.randint(0, 40)), rng.choice([*passages, "", ""]), text(rng.randint(0, 30)), rng.choice([*passages, ""])[rng.randint(0, 9) :]]
        rows.append((rng.randint(0, 10**6), " ".join(parts)))
    rows += [(5, "a" * 3000), (7, "a" * 120 + "b" + "a" * 60), (3, "ab" * 400), (9, "ab" * 60), (1, None), (2, ""), (4, "x" * 49), (6, "x" * 49), (8, "y" * 50), (10, "y" * 50), (11, "é" * 25), (12, "é" * 26)]
    rows += [rows[0], (rows[0][0], passages[0]), (rows[0][0], passages[0]), (None, passages[0]), (-5, passages[1]), (13, rows[3][1]), (14, passages[2] + " " + "tail " * 3000)]
    return rows


@pytest.mark.parametrize("block", [1 << 23, 2000])
def test_against_every_window(spark, monkeypatch, block):
    monkeypatch.setattr(op2, "BLOCK", block)
    monkeypatch.setattr(op2, "BUCKET", block)
    rows = made()
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, block int, kept string")
    got = op2.remove_repeats(docs, texts=True).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got), key=str) == brute(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_against_every_window_with_frequent_strings(spark, monkeypatch):
    for name, value in (("BLOCK", 2000), ("BUCKET", 2000), ("FREQUENT", 30)):
        monkeypatch.setattr(op2, name, value)
    docs = spark.createDataFrame(made(), "doc_id long, text string").repartition(7)
    assert op2.frequent(docs, sum(len((t or "").encode()) for _, t in made())).max() > 3
    got = op2.remove_repeats(docs).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got), key=str) == brute(made())


def test_no_bucket_grows_with_a_frequent_string(spark, monkeypatch):
    rng = random.Random(6)
    text = " ".join("in the house of " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)) for _ in range(4000))
    data = np.frombuffer(text.encode(), np.uint8)
    monkeypatch.setattr(op2, "FREQUENT", 100)
    docs = spark.createDataFrame([(i, text[a : a + 4000]) for i, a in enumerate(range(0, len(text), 4000))], "doc_id long, text string").repartition(9)

    def largest(rank):
        first, after, least = suffixes.runs(data, np.array([len(data)]), rank)
        size, least = after + suffixes.WIDTH - 1 - first, np.unique(least, return_inverse=True)[1]
        return np.bincount(least, size).max() / size.sum()

    rank = op2.frequent(docs, len(data))
    assert rank.max() > 5
    assert largest(np.zeros_like(rank)) > 0.1  # as it was
    assert largest(rank) < 0.01


def test_empty(spark):
    docs = spark.createDataFrame(made(), "doc_id long, text string")
    assert op2.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 3, 200])
def test_equal_windows_of_repetitive_data(letters):
    rng = np.random.default_rng(letters)
    for n in (60, 500, 3000):
        data = rng.integers(0, letters, n).astype(np.uint8)
        data[n // 2 : n // 2 + n // 4] = data[: n // 4]
        if letters == 2:
            data[:] = np.tile(data[:7], n // 7 + 1)[:n]
            data[n // 3] = 9
        starts = np.arange(n - 49)
        window, klass = suffixes.equal_windows(data, starts)
        got = {}
        for w, k in zip(window.tolist(), klass.tolist(), strict=True):
            got.setdefault(k, []).append(w)
        want = {}
        for p in range(n - 49):
            want.setdefault(data[p : p + 50].tobytes(), []).append(p)
        assert sorted(sorted(v) for v in got.values() if len(v) > 1) == sorted(v for v in want.values() if len(v) > 1)


def test_the_cover_reaches_every_pair():
    cover = set(suffixes.COVER)
    assert all(any({(r + d) % 31, (s + d) % 31} <= cover for d in range(31)) for r in range(31) for s in range(31))
