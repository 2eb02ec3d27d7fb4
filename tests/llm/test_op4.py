import hashlib
import itertools
import re

import numpy as np
import pytest

from trailmark.llm import op4, semicrf

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PIECES = ["a.b@c.de", "x@y", "a@b.c@d.e", "@", "1.2.3.4.5.6.7.8", "256.1.1.1", "010.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "+1 (988) 555-2485", "+49 30 1234567", "+1", " ", "\n", "é", "7", "-", "+12345678901234567890", "a..b@c-.d-e.f", "..@a.b."]


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and not all(int(p) <= 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_base_against_plain_expressions():
    rng = np.random.default_rng(2)
    for _ in range(3000):
        text = "".join(PIECES[i] for i in rng.integers(0, len(PIECES), rng.integers(0, 9)))
        assert op4.base_spans(text) == brute(text), text


def test_rows(spark):
    key = "AKIA" + "Q7ZB" * 4
    texts = ["mail a.b@c.de and 1.2.3.4", None, "", f"id {key} end", 'so token = "' + "0f3a9" * 8 + '" it', "version 4.0, page 12 of 300; 10:30 on 2021-05-06", "word " * 50_000 + "+1 (988) 555-2485 45 4111 1111 1111 1111", "9" * 100_000, "a" * 100_000 + "@"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, texts[0], None, None), (None, texts[0], "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email int")
    got = op4.personal_data(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        base = brute(t or "") if len(t or "") < 60_000 or " " in t else []
        r = by[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in PATTERNS]
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))
    assert by[3].spans == "secret:3:23" and by[4].spans == "secret:12:52" and by[5].spans == "" and by[1].spans == ""
    hidden = op4.mask(docs)
    assert hidden.columns == docs.columns
    said = {r.doc_id: r.text for r in hidden.collect()}
    assert said[0] == "mail <email> and <ip>" and said[1] is None and said[3] == "id <secret> end" and said[5] == texts[5]
    assert op4.mask(docs.limit(0)).count() == 0 == op4.personal_data(docs.limit(0)).count()


def test_the_model_on_lines_it_has_not_seen():
    w, right, clean, false = semicrf.trained(), 0, 0, 0
    lines = semicrf.examples(500, 77)
    for text, gold in lines:
        u = semicrf.units(text, 0, len(text))
        got = [(semicrf.TYPES[k], text[u[i][0] : u[j - 1][1]]) for i, j, k in semicrf.best(len(u), semicrf.candidates(text, u), w)]
        right += got == gold
        clean += not gold
        false += not gold and bool(got)
    assert right >= 0.97 * len(lines) and false <= 0.01 * clean


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sums_and_best_against_all_segmentations(seed):
    rng = np.random.default_rng(seed)
    n, w = 5, rng.normal(0, 1, (len(semicrf.TYPES), semicrf.N))
    cands = [(i, j, sorted(set(rng.integers(0, semicrf.N, 4).tolist()))) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1) if rng.random() < 0.7]
    labelled = [(i, j, k, w[k, f].sum(), c) for c, (i, j, f) in enumerate(cands) for k in range(len(w))]
    scores, marginal, top = [], np.zeros((len(cands), len(w))), (-1, None)
    for size in range(n + 1):
        for chosen in itertools.combinations(labelled, size):
            if all(a[1] <= b[0] for a, b in itertools.pairwise(sorted(chosen, key=lambda x: x[0]))):
                s = sum(x[3] for x in chosen)
                scores.append(s)
                top = max(top, (s, sorted((x[0], x[1], x[2]) for x in chosen)), key=lambda x: x[0])
                for x in chosen:
                    marginal[x[4], x[2]] += np.exp(s)
        if len(scores) > 400_000:
            pytest.skip("too many segmentations")
    total, got, _ = semicrf.log_sum(n, cands, w)
    assert np.isclose(total, np.logaddexp.reduce(scores)) and np.allclose(got, marginal / np.exp(scores).sum())
    assert semicrf.best(n, cands, w) == top[1]
