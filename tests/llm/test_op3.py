import re
from itertools import combinations

import xxhash

from trailmark.llm import op3

SCHEMA = "doc_id long, text string, fp string, a int"


def brute_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [brute_fp(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], f"{fps[i]:016x}", least.get(root(i))) for i, r in enumerate(rows)), key=str)


def rows():
    base = " ".join(f"Wort{i} é{i}" for i in range(400))
    out = [(i + 10, base.replace(f"Wort{i * 7} ", f"other{i} "), "x", 1) for i in range(12)]
    out += [(1, base, None, None), (2, base.upper().replace("É", "é"), None, 0), (3, None, "", 1), (4, "", "", 1), (5, " \t\n", "", 1), (6, "one", "", 1)]
    out += [(7, "one two three", "", 1), (8, "a b c d", "", 1), (8, "a b c d", "", 1), (None, "a b c d", "", 1), (None, "lone text of no one else here", "", 1)]
    out += [(9, "x " * 70000, "", 1), (40, "a b c d e\x1cf", "", 1)]
    return out


def test_against_every_pair(spark):
    given = rows()
    got = op3.near_duplicates(spark.createDataFrame(given, SCHEMA))
    got = sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got.collect()), key=str)
    assert got == brute(given)


def test_balls_reach_every_pair_at_distance_four(spark):
    fps = [0, 0b1111, 1 << 63 | 1 << 40 | 1 << 20 | 1, (1 << 64) - 1, (1 << 64) - 2, 0b11111]
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r.a, r.b) for r in op3.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    want = {(min(a, b), max(a, b)) for a, b in combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert got == want


def test_keep_one_and_empty(spark):
    given = spark.createDataFrame(rows(), SCHEMA)
    kept = op3.keep_one(given)
    assert kept.columns == given.columns
    ids = sorted(r.doc_id for r in kept.filter("doc_id is not null").collect())
    assert ids == sorted({r[2] for r in brute(rows()) if r[2] is not None})
    assert op3.near_duplicates(given.limit(0)).count() == 0 == op3.keep_one(given.limit(0)).count()
