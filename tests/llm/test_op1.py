import math

import numpy as np

from trailmark.llm import op1

SCHEMA = "vec_id long, embedding array<float>, label int, id string, root int"


def rows():
    rng = np.random.default_rng(8)
    out, n = [], 0

    def add(v, label, i=None):
        nonlocal n
        n += 1
        out.append((n * 3 if i is None else i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label, "x", 1))

    for label in (1, 2):
        centre = rng.normal(size=16)
        for _ in range(70 if label == 1 else 15):
            add(centre + rng.normal(size=16) * 0.12, label)
        add(centre, None)
        add(centre, 3)
        chain = np.eye(16)[0]
        for k in range(9):
            add(np.cos(0.19 * k) * np.eye(16)[0] + np.sin(0.19 * k) * np.eye(16)[1], label)
        for _ in range(25):
            add(chain * 5, label)
        for _ in range(60):
            add(rng.normal(size=16), label)
    for v in (None, [], [0.0] * 16, [None] + [1.0] * 15, [math.nan] * 16, [math.inf] * 16, [1.0] * 4, [1.0] * 4, [1e-30] * 4):
        add(v, 1)
    add([1.0] * 16, 1, 0)
    return out


def brute(given):
    ok = [r[0] is not None and r[2] is not None and bool(r[1]) and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in given]
    unit = [np.array(r[1], float) / np.sqrt((np.array(r[1], float) ** 2).sum()) if o else None for r, o in zip(given, ok, strict=True)]
    n = len(given)
    link = [[i != j and ok[i] and ok[j] and given[i][2] == given[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.98 for j in range(n)] for i in range(n)]
    least = [r[0] for r in given]
    moved = True
    while moved:
        moved = False
        for i in range(n):
            for j in range(n):
                if link[i][j] and least[j] < least[i]:
                    least[i], moved = least[j], True
    return sorted(((r[0], sum(link[i]), least[i], r[0] == least[i]) for i, r in enumerate(given)), key=str)


def test_against_all_pairs(spark, monkeypatch):
    for name, value in (("LEAF", 16), ("BLOCK", 20), ("MEETING", 12), ("BATCH", 50)):
        monkeypatch.setattr(op1, name, value)
    given = rows()
    got = op1.near_duplicates(spark.createDataFrame(given, SCHEMA)).collect()
    want = brute(given)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == want
    assert max(w[1] for w in want) > op1.LIST


def test_repeated_ids_null_ids_and_no_rows(spark):
    given = [(1, [1.0, 0.0], 1, "", 0), (1, [1.0, 0.0], 1, "", 0), (1, [0.0, 1.0], 1, "", 0), (2, [0.0, 1.0], 1, "", 0), (None, [1.0, 0.0], 1, "", 0), (3, [1.0, 0.01], 1, "", 0)]
    got = op1.near_duplicates(spark.createDataFrame(given, SCHEMA)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == sorted([(1, 2, 1, True), (1, 2, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True), (3, 2, 1, False)], key=str)
    assert op1.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rare_pairs_beside_a_hot_group(spark, monkeypatch):
    """Pairs in a narrow cone that one poor forest loses, and a group with most of all links."""
    for name, value in (("LEAF", 4), ("TREES", 1), ("LIST", 2), ("MEETING", 6), ("FORESTS", 1)):
        monkeypatch.setattr(op1, name, value)
    rng = np.random.default_rng(5)
    centre = np.ones(32) / np.sqrt(32)
    noise = lambda size: rng.normal(size=32) * size / np.sqrt(32)
    cone = [centre + noise(0.5) for _ in range(300)]
    vectors = [*cone, *(v + noise(0.1) for v in cone[:60]), *(rng.normal(size=32) for _ in range(20)), *(centre * -1 + noise(0.05) for _ in range(80))]
    given = [(i, [float(np.float32(x)) for x in v], 1, "x", 1) for i, v in enumerate(vectors)]
    got = op1.near_duplicates(spark.createDataFrame(given, SCHEMA)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == brute(given)


def test_few_links_are_found_exactly(spark, monkeypatch):
    """One pair among so many that an audit of MOST classes may see none of it."""
    for name, value in (("LEAF", 4), ("TREES", 1), ("LIST", 1), ("AUDIT", 10), ("MOST", 20), ("WIDE", 64), ("AT_ONCE", 10)):
        monkeypatch.setattr(op1, name, value, raising=False)
    rng = np.random.default_rng(6)
    vectors = [rng.normal(size=24) for _ in range(300)]
    vectors += [v + rng.normal(size=24) * 0.15 for v in vectors[:6]]
    given = [(i, [float(np.float32(x)) for x in v], i % 2, "x", 1) for i, v in enumerate(vectors)]
    got = op1.near_duplicates(spark.createDataFrame(given, SCHEMA)).collect()
    want = brute(given)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == want and any(w[1] for w in want)
