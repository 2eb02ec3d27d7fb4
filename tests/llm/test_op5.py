import hashlib
import re

import pytest

from trailmark.llm import op5


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        windows += [(str(item), w[i : i + n]) for i in range(len(w) - n + 1) if n]
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, g in windows:
            for i in range(len(w) - len(g) + 1):
                if w[i : i + len(g)] == g:
                    hit |= set(range(i, i + len(g)))
                    ids.add(item)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


LONG = "Ä One two, three four FIVE six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen."
ITEMS = [(1, LONG), (2, "five six seven"), (10, "solo"), (3, None), (4, "..."), (5, LONG), (6, "a b a b a b a b a b a b a b a b"), (7, "one two three four")]
DOCS = [
    (1, LONG + " end"), (2, "x " * 300 + LONG), (3, None), (4, ""), (5, "five six-seven solo"), (6, "ab " * 9000 + "solo"), (7, "a b " * 12),
    (8, LONG.replace("nine", "nein")), (9, LONG[:80]), (2, "another text, one two three four five"), (1, LONG + " end"), (None, LONG), (11, "ä one two three four five six seven eight nine ten eleven twelve thirteen"),
]


@pytest.mark.parametrize("items", [ITEMS, ITEMS[:1], []])
def test_against_every_place(spark, items):
    docs = spark.createDataFrame([(*d, "z", 0) for d in DOCS], "doc_id long, text string, item_id string, n int")
    bench = spark.createDataFrame([(*i, None) for i in items], "item_id long, text string, doc_id string")
    got = op5.contamination(docs, bench).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in got), key=str)
    want = brute(DOCS, items)
    assert got == want
    kept = op5.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)


def test_shuffled_form_and_empty_documents(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(op5, "BROADCAST_ROWS", 0)
    assert sorted((r.n_hit for r in op5.contamination(docs, bench).collect())) == sorted(w[2] for w in brute(DOCS, ITEMS))
    assert op5.contamination(docs.limit(0), bench).count() == 0
