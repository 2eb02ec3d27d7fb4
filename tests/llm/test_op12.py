import hashlib
import zlib

import pytest

from trailmark.llm import op12

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, digest string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(nodes):
    """The root of `nodes`, and the siblings of each on the way to it: (left, right) by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at, strict=True):
            run = i // 3 * 3
            p.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        nodes, at = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], paths


def brute(rows):
    by = {}
    for r in rows:
        now = r[4].replace("\n", "") if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
        by.setdefault(r[1], []).append((r[0], leaf(r, r[4]), leaf(r, now)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        trees[s] = tree([x[1] for x in by[s]])
    root, tops = tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for (doc, digest, now), path in zip(by[s], trees[s][1], strict=True):
            folded = now
            for left, right in path + top:
                folded = h(left + folded + right)
            out.append((doc, digest, trees[s][0], root, h("".join(a + b for a, b in path + top)), folded, folded == root))
    return out


def got(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, 5, "clash") for r in rows], SCHEMA).repartition(5)
    return [tuple(r) for r in op12.manifest(docs, op12.tampered(docs), **kw).collect()]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_equals_a_direct_one(spark, levels):
    rows = [(i, "hot", "en", i, f"text {i}\nline") for i in range(100)] + [(i, f"s{i % 7}", None, None, "é\n" * (i % 3)) for i in range(200, 240)]
    rows += [(1000 + i, f"lone{i}", "de", 1, "a\nb") for i in range(12)]
    rows += [(None, None, None, None, None), (None, "hot", "en", 3, "x\n"), (7, None, "en", 2, None), (8, "", "en", 2, ""), (9, "hot", "en", 9, "text 9\nline"), (9, "hot", "fr", 9, "z"), (5, "Ä\U0001f600", "x", 1, "y"), (6, "Ä￿", "x", 1, "y")]
    assert sorted(got(spark, rows, levels=levels), key=repr) == sorted(brute(rows), key=repr)


def test_one_row_and_none(spark):
    rows = [(3, "a", "en", 1, "t\n")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_proofs_are_the_siblings(spark):
    rows = [(i, "a", "en", i, f"t{i}") for i in range(10)]
    for r in got(spark, rows, with_proof=True):
        folded = r[1]
        for step in r[-1]:
            left, right = step.split("|")
            folded = h(left + folded + right)
        assert folded == r[3] and r[6] and h("".join(r[-1]).replace("|", "")) == r[4]


def test_untampered_rows_are_verified(spark):
    docs = spark.createDataFrame([(i, "a", "en", i, "x\ny", 1, "") for i in range(9)], SCHEMA)
    assert all(r.verified for r in op12.manifest(docs).collect())
    changed = {r.doc_id for r in op12.manifest(docs, op12.tampered(docs)).collect() if not r.verified}
    assert changed == {i for i in range(9) if zlib.crc32(str(i).encode()) % 2 == 0}
