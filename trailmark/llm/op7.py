"""Hierarchical best-fit packing of documents into sequences.

Pieces are packed best-fit, longest first, within their own partition. Sequences that are nearly full are done.
All others meet as single items and are packed again best-fit, over all partitions: that takes only their number per
fill, so the plan is bounded by the capacity however many they are. An open sequence finds its place in the plan by
its number among those of equal fill, counted in its partition, after those of the partitions before.
Only numbers travel: (document, piece, length), never texts or ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.llm.shared import cut, documents
from trailmark.llm.tokens import worker_tokenizer

CAPACITY, END = 2048, 0
#: Sequences with so few places left are done.
NEARLY = 8
#: A partition is packed in runs of so many pieces.
RUN = 1_000_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with an end id, cut every `capacity` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            texts = worker_tokenizer(tokenizer).encode_all(batch.column(1))
            for doc, found in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids = np.append(found, END).astype("<u4")
                rows += [(doc, k, at, min(capacity, len(ids) - at), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and the offset of each item, and the fill of each bin; longest items first, ties in their order."""
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        if fit := rooms >> size:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if left := room - size:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best fit, longest first, of so many items of each size. Rows: size, number of the first item, items, items in a bin, first bin, offset.

    As `best_fit` does, but equal bins are filled together: the work grows with the sizes, not with the items.
    """
    by_room: dict[int, list[tuple[int, tuple]]] = {}  # bins of equal content: how many, and (size, times) of what is in them

    def put(room: int, bins: int, content: tuple) -> None:
        if bins:
            by_room.setdefault(room, []).append((bins, content))

    for size, left in sorted(counts.items(), reverse=True):
        while left:
            room = min((r for r in by_room if r >= size), default=capacity)
            bins, content = by_room[room].pop() if room in by_room else (left, ())
            if room in by_room and not by_room[room]:
                del by_room[room]
            times = min(room // size, left)
            full = min(bins, left // times)
            put(room - times * size, full, (*content, (size, times)))
            if content:
                put(room, bins - full, content)
            left -= full * times
    rows, used, first = [], dict.fromkeys(counts, 0), 0
    for bins, content in (x for r in sorted(by_room) for x in by_room[r]):
        offset = 0
        for size, times in content:
            rows.append((size, used[size], bins * times, times, first, offset))
            used[size] += bins * times
            offset += size * times
        first += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`items` (length: 1 to capacity, other columns kept) with sequence_id and offset.

    Repeated rows are packed one by one; no items give no sequences. Numbers of sequences have no other meaning.
    """
    items = cut(items)
    parts = max(1, items.rdd.getNumPartitions())

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n, held, rows = TaskContext.get().partitionId(), 0, [], 0
        seen = np.zeros(capacity + 1, np.int64)
        for last, frame in _marked(frames):
            held.append(frame)
            rows += len(frame)
            if rows and (last or rows >= RUN):
                all_ = pd.concat(held, ignore_index=True)
                b, offset, fills = best_fit(all_["length"].to_numpy(), capacity)
                order, each = np.argsort(fills, kind="stable"), np.bincount(fills, minlength=capacity + 1)
                nth = np.empty(len(fills), np.int64)
                nth[order] = np.arange(len(fills)) + (seen - np.cumsum(each) + each)[fills[order]]
                seen += each
                yield all_.assign(part=part, bin=(part << 40) + n + b, at=offset, fill=fills[b], nth=nth[b])
                n, held, rows = n + len(fills), [], 0

    schema = f"{', '.join(f'`{n}` {t}' for n, t in items.dtypes)}, part long, bin long, at long, fill long, nth long"
    placed = cut(items.mapInPandas(local, schema))
    # how many open sequences of each fill a partition has, and how many the partitions before it
    own = placed.filter(F.col("fill") < capacity - NEARLY).groupBy("part", "fill").agg((F.max("nth") + 1).alias("own"))
    upto = F.sum("own").over(Window.partitionBy("fill").orderBy("part"))
    starts = cut(own.withColumn("before", upto - F.col("own")))
    rows = plan({r["fill"]: r["n"] for r in starts.groupBy("fill").agg(F.sum("own").alias("n")).collect()}, capacity)  # a row per fill
    # a number is below 2 ** 48, a fill below 2 ** 15 in keys of 64 bits; larger capacities leave less for numbers
    bits = 63 - int(capacity).bit_length()
    keys = (rows[:, 0] << bits) + rows[:, 1]

    @F.pandas_udf("sequence long, by long")
    def place(fill: pd.Series, number: pd.Series) -> pd.DataFrame:
        x = number.to_numpy()
        if not len(keys):
            return pd.DataFrame({"sequence": x, "by": x})
        size, start, _, times, first, offset = rows[np.searchsorted(keys, (fill.to_numpy() << bits) + np.maximum(x, 0), side="right") - 1].T
        return pd.DataFrame({"sequence": (parts << 40) + first + (x - start) // times, "by": offset + (x - start) % times * size})

    number = placed.join(starts.drop("own"), ["part", "fill"], "left").withColumn("to", place("fill", F.coalesce(F.col("before") + F.col("nth"), F.lit(-1))))
    moves = F.col("before").isNotNull()
    return number.select(
        *[F.col(f"`{c}`") for c in items.columns], F.when(moves, F.col("to.sequence")).otherwise(F.col("bin")).alias("sequence_id"), (F.col("at") + F.when(moves, F.col("to.by")).otherwise(0)).alias("offset")
    )


def _marked(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, pd.DataFrame]]:
    """Each frame with a mark on the last one."""
    before = None
    for frame in frames:
        if before is not None:
            yield False, before
        before = frame
    if before is not None:
        yield True, before


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of each row of docs.

    A null or empty text is the end id alone, a null doc_id stays null, repeated rows are packed each, and other
    columns are ignored.
    """
    return pack(pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), capacity), capacity)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
