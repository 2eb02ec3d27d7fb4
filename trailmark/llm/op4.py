"""Personal data: exact base patterns, and a semi-Markov conditional random field for what they miss.

Base spans are found first and stay. Around the digits and (at)s that they leave, regions of a line are cut out and
segmented by the model (`semicrf`): whole-span features score candidate segments, and the best segmentation chooses
boundaries and types together. Added kinds: secret, and email, ip and phone written in ways the base doesn't cover.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import semicrf
from trailmark.llm.shared import documents

#: Kinds of the base, in the order in which spans of equal start are listed; others follow by name.
KINDS = ("email", "ip", "card", "phone")
#: The base patterns, fixed values. An email is found from its @ outwards, which gives the same spans in linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9]+|[\[(] ?[aA][tT] ?[\])]")
#: A region reaches so many characters to each side of what triggers it, up to the line's ends, and starts and ends at white space.
REACH = 48


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base, ordered by start and kind."""
    out = [("email", *s) for s in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _regions(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches around triggers outside the taken spans; none overlaps a taken span or another region."""
    out: list[list[int]] = []
    k = 0
    for m in _TRIGGER.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k < len(taken) and taken[k][0] < m.end():
            continue
        low = max(taken[k - 1][1] if k else 0, m.start() - REACH, text.rfind("\n", 0, m.start()) + 1)
        line = text.find("\n", m.end())
        high = min(taken[k][0] if k < len(taken) else len(text), m.end() + REACH, line if line >= 0 else len(text))
        # an edge within a word moves outwards to white space, or to a taken span
        while low > (taken[k - 1][1] if k else 0) and not text[low - 1].isspace():
            low -= 1
        while high < (taken[k][0] if k < len(taken) else len(text)) and not text[high].isspace():
            high += 1
        if out and low <= out[-1][1]:
            out[-1][1] = max(high, out[-1][1])
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def spans(text: str, weights: np.ndarray) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and all spans, of one text."""
    base = base_spans(text)
    found = list(base)
    if base or _TRIGGER.search(text):
        taken: list[tuple[int, int]] = []
        for _, a, b in base:
            if taken and a < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
            else:
                taken.append((a, b))
        for a, b in _regions(text, taken):
            u = semicrf.units(text, a, b)
            found += [(semicrf.TYPES[k], u[i][0], u[j - 1][1]) for i, j, k in semicrf.best(len(u), semicrf.candidates(text, u), weights)]
    order = {k: i for i, k in enumerate([*KINDS, *sorted(set(semicrf.TYPES) - set(KINDS))])}
    return base, sorted(found, key=lambda s: (s[1], order[s[0]]))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of each row of docs.

    Counts and digest are the base's; spans lists all, as kind:start:end in code points; n_added are the model's.
    A null text counts as empty; repeated rows get equal results; other columns are ignored.
    """
    weights = semicrf.trained()

    def row(text: str | None) -> tuple:
        base, found = spans(text or "", weights)
        kinds = [k for k, _, _ in base]
        return (*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), len(found) - len(base))

    types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=["doc_id", *names])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def masked(text: str | None, weights: np.ndarray) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first one's name stands."""
    if text is None:
        return None
    _, found = spans(text, weights)
    out, at = [], 0
    for kind, a, b in found:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """docs with personal data in `text` masked; all rows and columns stay, and n_chars, where it is there, follows the text."""
    weights, at = semicrf.trained(), docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [masked(t, weights) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            if counted >= 0:
                was, now = b.column(at).to_pylist(), b.column(counted).to_pylist()
                columns[counted] = pa.array([n if n is None or t == w else len(t or "") for w, t, n in zip(was, texts, now, strict=True)], b.column(counted).type)
            columns[at] = pa.array(texts, b.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir)).drop("n_added")
