"""Removal of long strings that stand in an earlier document too, by blockwise suffix sorting.

Documents are dealt to blocks of about BLOCK bytes. A block's texts are cut into runs of windows (see `suffixes`);
each distinct run goes, with the least doc_id that has it in the block, to the bucket of its smallest hash: a run
that every document has costs one copy per block. Strings of eight bytes are counted beforehand, in a fixed number of
slots, so that no run is filed under a frequent one that has a rarer one; the driver gets the frequent slots only.
A bucket sorts its suffixes and finds each window's least doc_id over all blocks; only stretches with a smaller one
than the block's own go back. The block, cut in the same way again, marks and removes what earlier documents have.
Texts are shuffled once, runs compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.shared import documents
from trailmark.llm.suffixes import SLOT_BITS, WIDTH, count_slots, equal_windows, runs, slot_ranks

#: Bytes of text in a block, and of runs in a bucket, about; buckets that travel, and are decompressed, together.
BLOCK, BUCKET, TOGETHER = 8 << 20, 2 << 20, 24
#: A text's bytes travel about so many times in runs.
SPREAD = 3.3
#: Eight-byte strings that occur so often are frequent; a run has up to 92 bytes for each place of the string it is filed under.
FREQUENT = 10_000
#: Bytes of text that one task counts, about, where there are more than tasks at a time.
COUNTED = 256 << 20


class _Block:
    """The texts of a block that have an id, as one array, with their distinct runs."""

    def __init__(self, table: pa.Table, buckets: int, rank: np.ndarray) -> None:
        rows = sorted(((d, i) for i, d in enumerate(table["doc_id"].to_pylist()) if d is not None))
        texts = table["text"]
        self.rows = [i for _, i in rows]
        held = [(texts[i].as_py() or "").encode() for i in self.rows]
        self.data = np.frombuffer(b"".join(held), np.uint8)
        self.ends = np.cumsum([len(t) for t in held]).astype(np.int64)
        self.first, self.after, least = runs(self.data, self.ends, rank)
        doc = np.searchsorted(self.ends, self.first, side="right")
        self.doc_id = np.array([d for d, _ in rows], np.int64)[doc] if len(rows) else np.zeros(0, np.int64)
        # documents are in ascending order, so a run's first place has the least id
        whole = self.data.tobytes()
        number: dict[bytes, int] = {}
        self.run = np.array([number.setdefault(whole[a:b], len(number)) for a, b in zip(self.first.tolist(), (self.after + WIDTH - 1).tolist(), strict=True)], np.int64)
        self.texts = list(number)
        _, place = np.unique(self.run, return_index=True)
        self.least_doc = self.doc_id[place]
        self.bucket = ((least[place] * np.uint64(0xA24BAED4963EE407)) >> np.uint64(33)).astype(np.int64) % buckets


def _pack(*arrays: np.ndarray, data: bytes = b"") -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(a) for a in arrays], "<u4").tobytes() + b"".join(a.tobytes() for a in arrays) + data)


def _unpack(blob: bytes, *types: str) -> tuple[list[np.ndarray], memoryview]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(raw, "<u4", len(types)), 4 * len(types), []
    for n, t in zip(sizes.tolist(), types, strict=True):
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out, memoryview(raw)[at:]


def _marks(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the stretches."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def _earlier(data: bytes, sizes: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For one bucket's runs (texts one after another, their sizes and least documents): run, first window, windows and
    document of each stretch of windows that a smaller document than the run's own has, ordered by run.

    Equal runs are sorted once, with the least document of all of them.
    """
    ends = np.cumsum(sizes)
    number: dict[bytes, int] = {}
    same = np.array([number.setdefault(data[a:b], len(number)) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], np.int64)
    lengths = np.array([len(t) for t in number], np.int64)
    first = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(first, same, least)
    count = lengths - WIDTH + 1  # windows of each distinct run
    of_run = np.repeat(np.arange(len(lengths)), count)
    inside = np.arange(len(of_run)) - (np.cumsum(count) - count)[of_run]
    window, klass = equal_windows(np.frombuffer(b"".join(number), np.uint8), (np.cumsum(lengths) - lengths)[of_run] + inside)
    found = first[of_run]
    smallest = np.full(int(klass.max()) + 1 if len(klass) else 0, np.iinfo(np.int64).max)
    np.minimum.at(smallest, klass, found[window])
    found[window] = smallest[klass]
    # neighbouring windows of a run with the same earliest document are one stretch
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of_run[1:] != of_run[:-1])
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, len(found)))
    # each run has the stretches of its distinct run, as far as their documents are smaller than its own
    low, high = np.searchsorted(of_run[head], [same, same + 1])
    run = np.repeat(np.arange(len(same)), high - low)
    stretch = np.arange(len(run)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[run]
    better = found[head[stretch]] < least[run]
    run, stretch = run[better], stretch[better]
    return run, inside[head[stretch]], length[stretch], found[head[stretch]]


def frequent(docs: DataFrame, total: int) -> np.ndarray:
    """The rank of each slot of eight-byte strings in docs, whose texts have `total` bytes.

    A task counts many texts and names the slots that have half of the limit's share of its bytes. So what is not named
    of a slot is under half of the limit, and every slot above the limit is found.
    """
    limit = max(FREQUENT, 4 * total >> SLOT_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, own = np.zeros(1 << SLOT_BITS, np.int64), 0
        for batch in batches:
            text = batch.column(0).cast(pa.large_binary())
            _, ends, data = text.buffers()
            at = np.frombuffer(ends, np.int64, len(text) + 1, 8 * text.offset) if len(text) else [0, 0]
            if at[-1] > at[0]:  # strings across the end of a text count too, which only ranks them
                count_slots(np.frombuffer(data, np.uint8)[at[0] : at[-1]], counts)
                own += int(at[-1] - at[0])
        slots = np.flatnonzero(counts > limit / 2 * own / max(total, 1))
        yield pa.record_batch({"slot": pa.array(slots, pa.int32()), "n": pa.array(counts[slots], pa.int64())})

    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, total // COUNTED)
    named = docs.select("text").coalesce(tasks).mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = named.filter(F.col("n") >= limit / 2).toArrow()
    return slot_ranks(found["slot"].to_numpy(), found["n"].to_numpy(), limit / 2)


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, kept_sha256, spans (start, end of each removed stretch, in bytes) for each row of docs; with `texts`, kept too.

    A byte goes if a WIDTH-byte string that covers it also starts in a row with a smaller doc_id. Rows of equal id
    don't remove from each other, rows without an id neither remove nor lose anything, a null text is empty, and
    other columns are ignored.
    """
    held = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, groups = max(1, -(-total // BLOCK)), max(1, int(total * SPREAD) // (BUCKET * TOGETHER))
    buckets = groups * TOGETHER
    rank = docs.sparkSession.sparkContext.broadcast(frequent(held.filter("doc_id is not null"), total))
    dealt = held.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")

    def cut(table: pa.Table) -> pa.Table:
        b = _Block(table, buckets, rank.value)
        order = np.argsort(b.bucket, kind="stable")
        cuts = np.searchsorted(b.bucket[order], np.arange(0, buckets + 1, TOGETHER))
        rows = []
        for g in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[g] : cuts[g + 1]]
            some = [b.texts[r] for r in own.tolist()]
            each = np.bincount(b.bucket[own] - g * TOGETHER, minlength=TOGETHER)  # runs of each bucket, in order
            rows.append((g, _pack(each.astype("<u4"), own.astype("<u4"), np.array([len(t) for t in some], "<u4"), b.least_doc[own].astype("<i8"), data=b"".join(some))))
        return pa.table({"group": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([table["block"][0].as_py()] * len(rows), pa.int32()), "runs": pa.array([r[1] for r in rows], pa.binary())})

    def sort(table: pa.Table) -> pa.Table:
        parts = [_unpack(blob.as_py(), "<u4", "<u4", "<u4", "<i8") for blob in table["runs"]]
        cuts = [np.concatenate(([0], np.cumsum(p[0][0], dtype=np.int64))) for p in parts]
        bytes_at = [np.concatenate(([0], np.cumsum(p[0][2], dtype=np.int64))) for p in parts]
        answers: list[list[list[np.ndarray]]] = [[] for _ in parts]
        for k in range(TOGETHER):  # one bucket at a time
            mine = [slice(c[k], c[k + 1]) for c in cuts]
            sizes = np.concatenate([p[0][2][m] for p, m in zip(parts, mine, strict=True)]).astype(np.int64)
            least = np.concatenate([p[0][3][m] for p, m in zip(parts, mine, strict=True)])
            data = b"".join(p[1][at[m.start] : at[m.stop]] for p, m, at in zip(parts, mine, bytes_at, strict=True))
            run, offset, length, doc = _earlier(data, sizes, least)
            low = 0
            for answer, (arrays, _), m in zip(answers, parts, mine, strict=True):
                own = arrays[1][m]
                a, b = np.searchsorted(run, [low, low + len(own)])
                if b > a:
                    answer.append([own[run[a:b] - low], offset[a:b], length[a:b], doc[a:b]])
                low += len(own)
        rows = [(block, _pack(*(np.concatenate(x).astype(t) for x, t in zip(zip(*answer, strict=True), ("<u4", "<u4", "<u4", "<i8"), strict=True)))) for block, answer in zip(table["block"].to_pylist(), answers, strict=True) if answer]
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "stretches": pa.array([r[1] for r in rows], pa.binary())})

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        b = _Block(table, buckets, rank.value)
        own = b.least_doc[b.run] < b.doc_id if len(b.run) else np.zeros(0, bool)
        starts, ends = [b.first[own]], [b.after[own]]
        order = np.argsort(b.run, kind="stable")
        for blob in replies["stretches"] if replies.num_rows else ():
            (run, offset, length, doc), _ = _unpack(blob.as_py(), "<u4", "<u4", "<u4", "<i8")
            low, high = np.searchsorted(b.run[order], run), np.searchsorted(b.run[order], run, side="right")
            times = high - low
            which = np.repeat(np.arange(len(run)), times)
            place = order[np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + low[which]]
            later = doc[which] < b.doc_id[place]
            place, which = place[later], which[later]
            starts.append(b.first[place] + offset[which])
            ends.append(b.first[place] + offset[which] + length[which])
        s, e = np.concatenate(starts), np.concatenate(ends)
        gone = _marks(len(b.data), s, e + WIDTH - 1)
        rows: list[tuple] = [()] * table.num_rows
        at = 0
        for i, end in zip(b.rows, b.ends.tolist(), strict=True):
            mine, data = gone[at:end], b.data[at:end]
            edges = np.flatnonzero(np.diff(np.concatenate(([False], mine, [False])).astype(np.int8)))
            kept = data[~mine].tobytes() if len(edges) else data.tobytes()
            rows[i] = (end - at, int(mine.sum()), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in edges.reshape(-1, 2).tolist()], kept if texts else None)
            at = end
        for i, r in enumerate(rows):
            if not r:
                kept = (table["text"][i].as_py() or "").encode()
                rows[i] = (len(kept), 0, hashlib.sha256(kept).hexdigest(), [], kept if texts else None)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = [pa.int64(), pa.int64(), pa.string(), span, pa.binary()]
        cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
        return pa.table([table["doc_id"].combine_chunks() if table.num_rows else pa.array([], pa.int64()), *cols], names=["doc_id", "n_bytes", "n_removed", "kept_sha256", "spans", "kept"])

    cut_up = dealt.groupBy("block").applyInArrow(cut, "group int, block int, runs binary")
    replies = cut_up.groupBy("group").applyInArrow(sort, "block int, stretches binary")
    schema = "doc_id long, n_bytes long, n_removed long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, kept binary"
    out = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, schema)
    return out if texts else out.drop("kept")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
