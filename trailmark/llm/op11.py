"""Structure repair of conversations: turns aligned to an alternating grammar by Wagner-Fischer tables.

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant. Its turns are
aligned to the grammar's string of each feasible length. Strings that end alike share their ends, so one table,
filled from the last turn backwards over "the rest of the turns" and "the last j letters", serves all lengths; it is
filled within a Ukkonen band, outside which more than the incumbent's cost would go into deletions and insertions
alone. Each length whose cost is least is traced into an audit (one letter per edit), and the audits are compared.

Turns stream through in order of their conversation in blocks of BLOCK. A block is aligned for each phase of the
grammar in which it may begin and end, and only the best audit and the running digest of each phase are kept, so a
conversation of any length takes memory for one block and a letter per turn. Its digest is one SHA-256 over all of
its text in order, which is why the turns of one conversation pass through one task; damage, faults and the search
for earlier copies of a turn are spread over all.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 512
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Phases of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40
SPACE = " \t\n\x0b\x0c\r"
AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "conv_id long, place long, edit string, turn long, role string, text string"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped) after the damage; nulls are one space, in the key too."""
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    return conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.when(kind == 4, "user").otherwise(known("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _table(kinds: str, end: int, width: int, bound: int) -> np.ndarray:
    """T[i, j]: the least cost of making the last j letters of a target that ends in phase `end` from kinds[i:].

    Cells are left at FAR where deletions and insertions alone would cost more than `bound`.
    """
    n = len(kinds)
    table = np.full((n + 1, width + 1), FAR, np.int64)
    steps = INSERT * np.arange(width + 1)
    last, other = ("u", "a") if end == USER else ("a", "u")
    letters = np.array([last if j % 2 else other for j in range(width + 1)])  # letters[j]: j-th from the end
    costs = {k: np.where(letters == k.lower(), 0, REROLE) + (TRUNCATED if k.isupper() else 0) for k in set(kinds) - {"x"}}
    table[n] = np.where(steps <= bound, steps, FAR)
    forced = 0
    for i in range(n - 1, -1, -1):
        kind = kinds[i]
        forced += kind == "x"
        free = n - i - forced
        left = bound - DELETE * forced
        low, high = max(0, free - max(0, left) // DELETE), min(width, free + max(0, left) // INSERT)
        if left < 0 or low > high:
            continue
        here = table[i + 1, low : high + 1] + DELETE
        if kind != "x":
            lo = max(low, 1)
            here[lo - low :] = np.minimum(here[lo - low :], table[i + 1, lo - 1 : high] + costs[kind][lo : high + 1])
        table[i, low : high + 1] = np.minimum.accumulate(here - steps[low : high + 1]) + steps[low : high + 1]
    return table


def _trace(kinds: str, table: np.ndarray, i: int, j: int, end: int) -> str:
    """The ASCII-least audit of the least cost at (i, j): delete before insert, insert before keep or rerole."""
    n, out = len(kinds), []
    while i < n or j:
        cost = table[i, j]
        if i < n and cost == table[i + 1, j] + DELETE:
            out.append("D")
            i += 1
        elif j and cost == table[i, j - 1] + INSERT:
            out.append("I")
            j -= 1
        else:
            letter = "ua"[(end == USER) == (j % 2 == 0)]
            out.append("K" if kinds[i].lower() == letter else "R")
            i, j = i + 1, j - 1
    return "".join(out)


def _incumbent(kinds: str, end: int, odd: bool, least: int) -> int:
    """The cost of one alignment that surely exists: sound turns stay, others go, a turn more where the length is wrong."""
    sound = [k for k in kinds if k != "x" and not k.isupper()]
    m = max(least, len(sound))
    m += (m % 2 == 1) != odd
    back = [("u" if end == USER else "a") if k % 2 == 0 else ("a" if end == USER else "u") for k in range(m)][::-1]
    return DELETE * (len(kinds) - len(sound)) + sum(REROLE for a, b in zip(sound, back, strict=False) if a != b) + INSERT * (m - len(sound))


@functools.lru_cache(maxsize=20_000)
def align(kinds: str, begin: int, end: int) -> tuple[int, str] | None:
    """The least cost and ASCII-least audit of making from `kinds` a string that leads from phase to phase.

    `kinds` has a letter for each turn: x must go, u, a, s and o by role, in capitals where the text is cut off. None
    where no string of the grammar leads there.
    """
    n = len(kinds)
    if end in (START, SYSTEM) and begin == end:
        return DELETE * n, "D" * n
    # (cost of the turns before and of the system turn itself, its place): those before it go; -1: no system turn
    heads = [(DELETE * i + TRUNCATED * (k == "S"), i) for i, k in enumerate(kinds) if k in "sS"] if begin == START else []
    if end == SYSTEM:
        return min(((cost + DELETE * (n - i - 1), "D" * i + "K" + "D" * (n - i - 1)) for cost, i in heads), default=None)
    if end == START:
        return None
    heads.append((0, -1))
    odd = (begin == USER) != (end == USER)
    least = 1 if odd else 0 if begin in (USER, ASSISTANT) else 2
    bound = _incumbent(kinds, end, odd, least)
    forced = kinds.count("x")
    table = _table(kinds, end, max(least, n - forced + (bound - DELETE * forced) // INSERT), bound)
    feasible = range(least, table.shape[1], 2)
    costs = [(cost + int(table[i + 1, least::2].min()), cost, i) for cost, i in heads]
    lowest = min(c[0] for c in costs)
    audits = []
    for total, cost, i in costs:
        if total == lowest:
            head = "D" * i + "K" if i >= 0 else ""
            audits += [head + _trace(kinds, table, i + 1, j, end) for j in feasible if table[i + 1, j] == lowest - cost]
    return lowest, min(audits)


class _Walk:
    """One conversation on its way through a task: facts, and for each phase the best audit, its cost and the digest so far."""

    def __init__(self) -> None:
        self.low = self.high = self.seen = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.held: list[tuple[str, str, str]] = []  # kind, role, text
        self.states = {START: (0, "", hashlib.sha256(), False)}

    def add(self, turn: int | None, role: str, text: str, earlier: bool) -> None:
        bare = text.strip(SPACE)
        same = self.seen is not None and self.seen == (turn, role, text)
        if self.seen is not None and self.seen[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += 1
        self.seen = (turn, role, text)
        kind = role[:1] if role[:1] in ("u", "a", "s") else "o"
        if not bare:
            self.blank += 1
            kind = "x"
        elif earlier or same:
            self.duplicate += 1
            kind = "x"
        elif bare[-1] not in ".!?":
            self.truncated += 1
            kind = kind.upper()
        if len(self.held) == BLOCK:
            self.close((START, SYSTEM, USER, ASSISTANT))
        self.held.append((kind, role, text))

    def close(self, ends: tuple[int, ...]) -> None:
        """Aligns the held turns for each phase in which they may begin and end."""
        kinds, states = "".join(k for k, _, _ in self.held), {}
        for end in ends:
            for begin, (cost, audit, *_) in self.states.items():
                if found := align(kinds, begin, end):
                    new = (cost + found[0], audit + found[1], begin, found[1])
                    states[end] = min(states.get(end, new), new)
        if ends == (START, ASSISTANT):  # the conversation ends: one audit is left
            end = min(states, key=lambda e: states[e][:2])
            states = {end: states[end]}
        self.states = {end: (cost, audit, *self._digest(begin, own)) for end, (cost, audit, begin, own) in states.items()}
        self.held = []

    def _digest(self, begin: int, audit: str) -> tuple:
        _, _, digest, some = self.states[begin]
        digest = digest.copy()
        for _, _, role, text in edited(audit, begin, ((None, r, t) for _, r, t in self.held)):
            digest.update((b"\n" if some else b"") + role.encode() + b":" + text.encode())
            some = True
        return digest, some

    def row(self, conv: int | None) -> tuple:
        self.close((START, ASSISTANT))
        ((cost, audit, digest, _),) = self.states.values()
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, (1 << 63) - 1)
        return conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest.hexdigest()


def edited(audit: str, phase: int, rows: Iterator[tuple]) -> Iterator[tuple[str, int | None, str, str]]:
    """The turns that an audit leaves of rows (turn, role, text), each behind its edit; inserted ones have no turn and no text."""
    rows = iter(rows)
    for edit in audit:
        turn, role, text = (None, "", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if phase == USER else "user"
        phase = {"s": SYSTEM, "u": USER}.get(role[:1], ASSISTANT)
        yield edit, turn, role, text


def _prepared(damaged: DataFrame) -> DataFrame:
    """Turns in order of their conversation: conv_id, turn, role, text, earlier (its role and text stand at an earlier turn)."""
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.octet_length("role").cast("string"), "role", "text").cast("binary"), 256)
    rows = damaged.withColumn("key", F.when(F.col("copies") > 0, key))
    # a null turn comes first
    firsts = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("turn").alias("least"), F.max("turn").alias("most"), F.bool_or(F.col("turn").isNull()).alias("null_first"))
    firsts = firsts.filter(F.col("least").isNotNull() & (F.col("null_first") | (F.col("least") < F.col("most"))))
    earlier = F.coalesce(F.col("turn").isNotNull() & (F.col("null_first") | (F.col("least") < F.col("turn"))), F.lit(False))
    marked = rows.join(firsts, "key", "left").select("conv_id", "turn", "role", "text", earlier.alias("earlier"), F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("copies")))).alias("copy"), "copies")
    gone = F.col("copies") == 0
    return marked.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(~gone, F.col("role")).alias("role"), F.when(~gone, F.col("text")).alias("text"), "earlier", gone.alias("gone"))


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.asc_nulls_first("turn"), "role", "text")


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def audits(damaged: DataFrame) -> DataFrame:
    """One row of AUDIT per conversation of `damaged` (conv_id, turn, role, text, copies; copies 0: the turn is lost).

    Turns go in order of turn (nulls first), then role and text; equal rows follow each other, and all but the first
    are duplicates. A null conv_id is a conversation. One whose turns are all lost has zeros, an empty audit and the
    digest of nothing. gaps ignores null turns. Other columns are ignored. No rows give no conversations.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, last = None, None
        for batch in batches:
            out = []
            for conv, turn, role, text, earlier, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if walk is None or conv != last:
                    if walk is not None:
                        out.append(walk.row(last))
                    walk, last = _Walk(), conv
                if not gone:
                    walk.add(turn, role, text, earlier)
            yield _arrow(out, AUDIT)
        if walk is not None:
            yield _arrow([walk.row(last)], AUDIT)

    return _ordered(_prepared(damaged)).mapInArrow(run, AUDIT)


def repaired(damaged: DataFrame) -> DataFrame:
    """The turns that the repair leaves (REPAIRED): place from 0, the edit that made it (K, R or I), turn, role and text."""
    rows = _prepared(damaged).filter(~F.col("gone")).select("conv_id", "turn", "role", "text", F.lit(1).alias("kind"))
    plans = audits(damaged).select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        rows, stream = [], turns()
        for conv, _, _, audit, _ in stream:  # the audit stands before its turns, and takes one for each letter but I
            left = audit.count("D") + audit.count("K") + audit.count("R")
            own = (next(stream)[1:4] for _ in range(left))
            for place, made in enumerate(edited(audit, START, own)):
                rows.append((conv, place, *made))
                if len(rows) >= 10_000:
                    yield _arrow(rows, REPAIRED)
                    rows = []
        yield _arrow(rows, REPAIRED)

    return _ordered(rows.unionByName(plans), "kind").mapInArrow(run, REPAIRED)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
