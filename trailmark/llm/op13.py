"""Shortest-pack-first packing over the histogram of lengths.

Documents are tokenized once and cut every `capacity` ids: whole sequences are done, what remains of each document is
an item. Only the histogram of item lengths (fewer than `capacity` numbers) reaches the driver. Lengths are placed
longest first, each into the shortest packs; packs of equal content are one pattern with a count, so the plan is
bounded by the capacity however many documents there are. Patterns come back to the documents by the rank of an item
among those of its length: its number in its partition, after those of the partitions before.

Documents may be cut freely, so no place is left empty: with T tokens in all items, the T // capacity longest packs
stay, and the items of the shortest packs, laid end to end, are cut to fill the gaps of those that stay. The last
T % capacity tokens go into sequences whose lengths are powers of two, which need no padding either.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.llm.bytebpe import worker_tokenizer
from trailmark.llm.shared import documents, new_path

CAPACITY, END = 2048, 1
STORED = "part long, row long, doc_id long, start long, length long, doc_tokens long, ids_crc32 long, nth long, ids binary"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
COLUMNS = [f.split()[0] for f in PIECE.split(", ")]
SLOT = "length long, first long, last long, filler boolean, at long, times long, place long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def write_pieces(docs: DataFrame, path: str, tokenizer: str, capacity: int = CAPACITY) -> None:
    """Writes each document's ids with an end id, cut every `capacity` ids; `nth` numbers equal lengths of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, seen = TaskContext.get().partitionId(), 0, np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            encode, held = worker_tokenizer(tokenizer).encode, 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(END)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    own = ids[at : at + capacity]
                    data = own.tobytes()
                    rows.append((part, row, doc, at, len(own), len(ids), zlib.crc32(data), int(seen[len(own)]), data))
                    seen[len(own)] += 1
                    row += 1
                held += len(ids)
                if held > 4_000_000:
                    yield _batch(rows, STORED)
                    rows, held = [], 0
            yield _batch(rows, STORED)

    docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, STORED).write.option("compression", "zstd").parquet(path)


class Pattern(NamedTuple):
    """Packs of equal content: their fill and number, and (length, times) of what is in each."""

    fill: int
    packs: int
    content: tuple[tuple[int, int], ...]


def shortest_pack_first(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Places so many items of each length, longest first, each in the shortest pack. Shortest patterns come first."""
    heap: list[tuple[int, int, int, tuple]] = []
    made = 0

    def put(fill: int, packs: int, content: tuple) -> None:
        nonlocal made
        if packs:
            heapq.heappush(heap, (fill, made, packs, content))
            made += 1

    for length, left in sorted(counts.items(), reverse=True):
        while left:
            if heap and heap[0][0] + length <= capacity:
                fill, _, packs, content = heapq.heappop(heap)
                n = min(packs, left)
                put(fill, packs - n, content)
                # one item more of the length that came last is no new entry
                more = (*content[:-1], (length, content[-1][1] + 1)) if content[-1][0] == length else (*content, (length, 1))
                put(fill + length, n, more)
                left -= n
            else:  # nothing has room: a new pack takes items until it has none
                times = capacity // length
                put(times * length, left // times, ((length, times),))
                put(left % times * length, 1 if left % times else 0, ((length, left % times),))
                left = 0
    return [Pattern(fill, packs, content) for fill, _, packs, content in sorted(heap)]


class Plan(NamedTuple):
    """`slots` (see SLOT): items `first` to `last` of a length. Item first + x goes to sequence at + x // times, at place + x % times * length.

    A filler's `at` is its place in the stream of fillers instead. `gaps` are rows of (start in that stream, width,
    first sequence, offset in it): gap k of a row lies in the k-th sequence after its first.
    """

    slots: list[tuple]
    gaps: np.ndarray


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    patterns = shortest_pack_first(counts, capacity)
    total = sum(p.fill * p.packs for p in patterns)
    stay = total // capacity
    excess = sum(p.packs for p in patterns) - stay  # the shortest packs, which are cut up
    slots, gaps, used = [], [], dict.fromkeys(counts, 0)
    sequence = stream = hole = 0
    for fill, packs, content in patterns:
        cut_up = min(packs, excess)
        excess -= cut_up
        for n, filler in ((cut_up, True), (packs - cut_up, False)):
            place = 0
            for length, times in content if n else ():
                slots.append((length, used[length], used[length] + n * times - 1, filler, stream if filler else sequence, times, place))
                used[length] += n * times
                place += length * times
                stream += length * times * n if filler else 0
            if n and not filler:
                if fill < capacity:
                    gaps.append((hole, capacity - fill, sequence, fill))
                    hole += (capacity - fill) * n
                sequence += n
    rest = total % capacity
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            gaps.append((hole, 1 << bit, sequence, 0))
            hole += 1 << bit
            sequence += 1
    return Plan(slots, np.array(gaps, np.int64).reshape(-1, 4))


def fill_gaps(gaps: np.ndarray, at: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of a filler of `length` ids that begins at `at` of the stream."""
    done = 0
    while done < length:
        start, width, sequence, offset = gaps[np.searchsorted(gaps[:, 0], at + done, side="right") - 1].tolist()
        k, into = divmod(at + done - start, width)
        n = min(width - into, length - done)
        yield done, n, sequence + k, offset + into
        done += n


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """PIECE columns: one row per piece of each row of docs; its ids (little-endian unsigned 32-bit) on request.

    A null or empty text is the end id alone, a null doc_id stays null, repeated rows are packed each, other columns
    are ignored, no documents give no rows. Ties (items of one length) are told apart by their rank alone, so which of
    them shares a sequence with which others has no meaning; neither have the numbers of sequences.
    """
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "pieces")
    write_pieces(docs, path, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), capacity)
    stored = spark.read.schema(STORED).parquet(path)
    whole = stored.filter(F.col("length") == capacity).withColumn("sequence_id", -(F.shiftleft("part", 40) + F.col("row")) - 1)
    items = stored.filter(F.col("length") < capacity)
    own = items.groupBy("part", "length").agg((F.max("nth") + 1).alias("own"))
    before = Window.partitionBy("length").orderBy("part")
    starts = own.withColumn("before", F.sum("own").over(before) - F.col("own")).drop("own")
    counts = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.sum("own").alias("n")).collect()}  # fewer than `capacity` rows
    slots, gaps = plan(counts, capacity)
    table = F.broadcast(spark.createDataFrame(slots, SLOT).withColumnRenamed("length", "size"))  # bounded by the capacity

    ranked = items.drop("ids").join(starts, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(table, (F.col("length") == F.col("size")) & F.col("rank").between(F.col("first"), F.col("last"))).withColumn("x", F.col("rank") - F.col("first"))
    fillers = placed.filter("filler").select("part", "row", (F.col("at") + F.col("x") * F.col("length")).alias("at"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, start, length, tokens, ids, at in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                for a, n, sequence, offset in fill_gaps(gaps, at, length):
                    data = ids[4 * a : 4 * (a + n)]
                    rows.append((doc, start + a, n, zlib.crc32(data), tokens, sequence, offset, data))
            yield _batch(rows, PIECE)

    # the ids of those lengths alone travel that have fillers
    cut_lengths = sorted({s[0] for s in slots if s[3]})
    sources = items.filter(F.col("length").isin(cut_lengths)).select("part", "row", "doc_id", "start", "length", "doc_tokens", "ids")
    cut_pieces = sources.join(fillers, ["part", "row"]).select("doc_id", "start", "length", "doc_tokens", "ids", "at").mapInArrow(cut_up, PIECE)

    kept = placed.filter(~F.col("filler")).withColumn("sequence_id", F.col("at") + F.expr("x div times")).withColumn("offset", F.col("place") + F.col("x") % F.col("times") * F.col("length"))
    if with_ids:
        kept = kept.join(items.select("part", "row", "ids"), ["part", "row"])
    columns = COLUMNS if with_ids else COLUMNS[:-1]
    return whole.withColumn("offset", F.lit(0).cast("long")).select(columns).unionByName(kept.select(columns)).unionByName(cut_pieces.select(columns))


def op13_shortest_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
