import random
import re

from trailmark.llm import op10

TEXTS = [
    "Released under the MIT License. mit license", "Licensed under the Apache License, Version 2.0.", "permit license and MIT\nlicense", "CC BY cc by-nc CC-BY", "", None, " .,; ",
    "GNU General\tPublic -- License, version 3. apache licenses", "x " * 100_000 + "(mit license)", "é mit license ünd", "Éapache license", "all rights reserved", "licence", "MIT LICENSÉ mit license9",
]


def base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), sorted((label, i) for phrase, label in op10.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())


def test_base_against_every_place(spark):
    rows = [(i, t, "x", 1.0) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], None, None), (None, TEXTS[1], "", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, score double")
    got = op10.licences(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        n, places = base(t)
        starts = [p for _, p in places]
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for x, _ in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert op10.licences(docs.limit(0)).count() == 0


def edited(rng, notice, edits):
    out = list(notice)
    for _ in range(edits):
        k = rng.randrange(2, len(out) - 2)
        if " " in out[k - 1 : k + 2]:
            continue
        match rng.randrange(3):
            case 0:
                out[k] = "q"
            case 1:
                out.insert(k, "q")
            case 2:
                del out[k]
    return "".join(out)


def test_notices_with_small_edits_are_found_with_their_spans():
    rng = random.Random(5)
    for notice, label in op10.NOTICES:
        for _ in range(20):
            before = rng.choice(["", "some words. ", "x " * 500])
            text = before + edited(rng, notice, len(notice) // op10.LETTERS_PER_EDIT) + rng.choice(["", ". more text follows here"])
            _, _, hits = op10.scan(text)
            assert hits and min(h.first for h in hits) <= len(before.split()) + 2, (label, text)


def test_seeds_lose_no_place_of_the_whole_search():
    rng = random.Random(9)
    words = [w for n, _ in op10.NOTICES for w in n.split()]
    for _ in range(60):
        text = " ".join(edited(rng, " ".join(rng.choice(words) for _ in range(6)), 1) if rng.random() < 0.5 else edited(rng, rng.choice(op10.NOTICES)[0], 2) for _ in range(4))
        found = {n for n, *_ in op10._notices().spans(text)}
        whole = {n for n, (x, _, _) in enumerate(op10._notices().expressions) if x.search(text)}
        assert found == whole


def test_clean_text_has_nothing():
    assert op10.scan("the river and the garden, a permit for the license plate of my car; rights and duties")[1:] == ([], [])


def test_edited_notices_before_an_exact_one():
    text = "licensed undr the mit license licensed under the mit license licensd under the mit license"
    hits = op10.scan(text)[2]
    assert [(h.label, h.edits, h.first, h.last) for h in hits] == [("mit", 1, 0, 4), ("mit", 0, 5, 9), ("mit", 1, 10, 14)]
