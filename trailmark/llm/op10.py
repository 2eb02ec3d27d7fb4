"""Licence scans: exact phrases, and short notices found in spite of small edits.

A notice with room for k edits is split into k + 1 seeds; wherever it stands with at most k edits, one seed stands
exactly (pigeonhole). One automaton finds all seeds of all notices in a text. Around each found seed the regex
library verifies the notice with a bounded number of errors and reports span and edits.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.shared import documents

#: Phrases and labels of the base search: fixed values.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Short notices by label, in words as the scan sees them (small letters, single spaces): public licence texts.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)
#: One edit is allowed for so many letters of a notice.
LETTERS_PER_EDIT = 12
#: Words are what stands between these bytes: 00-2F, 3A-60 and 7B-7F, once A-Z are small letters.
_SMALL = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BREAK = bytes(32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))
_TABLE = bytes(_BREAK[_SMALL[c]] for c in range(256))


class Hit(NamedTuple):
    """A notice in a text: label, edits, first and last word."""

    label: str
    edits: int
    first: int
    last: int


class _Notices:
    """Seeds of all notices in one automaton, and a bounded-error expression for each notice."""

    def __init__(self) -> None:
        self.seeds, self.expressions = ahocorasick.Automaton(), []
        held: dict[str, list[tuple[int, int]]] = {}
        for n, (notice, _) in enumerate(NOTICES):
            edits = len(notice) // LETTERS_PER_EDIT
            cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                held.setdefault(notice[a:b], []).append((n, a))
            exact = regex.compile(rf"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}")
            self.expressions.append((exact, edits, len(notice)))
        for seed, places in held.items():
            self.seeds.add_word(seed, (len(seed), tuple(places)))
        self.seeds.make_automaton()

    def spans(self, joined: str) -> list[tuple[int, int, int, int]]:
        """(notice, edits, start, end) of whole-word matches in a text of words and single spaces, one per place and notice."""
        windows: dict[int, list[list[int]]] = {}
        for at, (size, places) in self.seeds.iter(joined):
            for n, offset in places:
                _, edits, length = self.expressions[n]
                start = at - size + 1 - offset
                a, b = max(0, start - edits), min(len(joined), start + length + edits)
                mine = windows.setdefault(n, [])
                if mine and a <= mine[-1][1]:
                    mine[-1][1] = max(b, mine[-1][1])
                else:
                    mine.append([a, b])
        found = []
        for n, mine in windows.items():
            exact, _, length = self.expressions[n]
            while mine:
                a, b = mine.pop()
                if b - a < length - self.expressions[n][1] or not (m := exact.search(joined, a, b)):
                    continue
                s, e = m.start(), m.end()
                while s < e and joined[s] == " ":
                    s += 1
                while e > s and joined[e - 1] == " ":
                    e -= 1
                # an edited edge may lie within a word; what counts are the words it touches
                found.append((n, sum(m.fuzzy_counts), s, e))
                # the best match of the window comes first; others may stand on both sides of it
                mine += [[a, m.start()], [m.end(), b]]
        return found


@functools.lru_cache(maxsize=1)
def _notices() -> _Notices:
    return _Notices()


def scan(text: str | None) -> tuple[int, list[tuple[str, int]], list[Hit]]:
    """Number of words, (label, first word) of each base place, and the notices found, best first at each place."""
    data = (text or "").encode().translate(_TABLE)
    words = data.split(b" ")
    words = [w for w in words if w]
    joined = b" ".join(words)
    low = joined.decode()
    places, at = [], None

    def word_at(place: int) -> int:
        nonlocal at
        if at is None:
            at = np.flatnonzero(np.frombuffer(low.encode("utf-32-le"), "<u4") == 32)
        return int(np.searchsorted(at, place))

    whole = f" {low} "
    for phrase, label in PHRASES:
        k = whole.find(f" {phrase} ")
        while k >= 0:
            places.append((label, word_at(k)))
            k = whole.find(f" {phrase} ", k + 1)
    hits: list[Hit] = []
    for n, edits, s, e in sorted(_notices().spans(low), key=lambda x: (x[1], x[2], x[0])):
        first, last = word_at(s), word_at(e - 1)
        if not any(h.first <= last and first <= h.last for h in hits):
            hits.append(Hit(NOTICES[n][1], edits, first, last))
    return len(words), places, sorted(hits, key=lambda h: (h.first, h.last))


_COLUMNS = (
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("edits", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))),
)
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,edits:int,first:bigint,last:bigint>>"


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of each row of docs.

    score is 1 for a base place or an unedited notice, falls with the share of a notice that is edited, and is 0
    where nothing is found. spans are the notices: label, edits, first and last word. A null text counts as empty;
    repeated rows get equal results; other columns are ignored; no rows give no rows.
    """

    def row(text: str | None) -> tuple:
        n, places, hits = scan(text)
        starts = [p for _, p in places]
        base = {label for label, _ in places}
        lengths = {label: max(len(x) for x, y in NOTICES if y == label) for _, label in NOTICES}
        score = 1.0 if places else max((1 - h.edits / lengths[h.label] for h in hits), default=0.0)
        return (n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {h.label for h in hits})), score, [h._asdict() for h in hits])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_COLUMNS))], names=["doc_id", *(n for n, _ in _COLUMNS)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {SCHEMA}")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(documents(spark, sf_dir)).drop("spans")
