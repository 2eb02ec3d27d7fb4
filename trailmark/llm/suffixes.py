"""Blocks of text cut into runs of windows, and one bucket of suffixes sorted at a time.

A window is a string of WIDTH bytes. All windows whose smallest eight-byte hash is the same belong to one bucket;
neighbours that share it travel together as one run of text, about three bytes for each window. Strings that are
frequent in the whole input come after all others, the most frequent last, whatever their hash: a window is filed under
one of them only if it has no other, so a bucket does not grow with the commonest words. A bucket is sorted
by the first four words of its suffixes, word by word and only where they tie. What ties on all of them is resolved
by a difference cover: positions whose remainder modulo PERIOD lies in COVER are ranked beforehand. For any two
suffixes some shift below PERIOD leads both to ranked positions, and the common prefix of those two, known from
the ranks, says whether the windows agree to their ends. Memory is bounded by one bucket's text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH, GRAM = 50, 8
#: A perfect difference set: every remainder is a difference of two of its members in one way.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Eight-byte strings are counted, and ranked, by the first bits of their hash.
SLOT_BITS, RANKS = 22, 16
#: Positions hashed at a time.
_STEP = 1 << 20
_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros follow the end."""
    whole = np.zeros(len(data) + 2 * GRAM, np.uint8)
    whole[: len(data)] = data
    v = np.empty(len(data), np.uint64)
    for k in range(GRAM):
        n = len(range(k, len(data), GRAM))
        v[k::GRAM] = whole[k : k + GRAM * n].view(">u8")
    return v


def _mixed(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Step by step, a place in data and hashes of 32 bits from there on; where two eight-byte strings share one, their windows share a bucket, no more."""
    for at in range(0, len(data), _STEP):
        v = words(data[at : at + _STEP + GRAM - 1])[:_STEP]
        v *= np.uint64(0x9E3779B97F4A7C15)
        v >>= np.uint64(32)
        yield at, v.astype(np.uint32)


def count_slots(data: np.ndarray, counts: np.ndarray) -> None:
    """Adds to `counts`, by slot, how often the eight-byte strings of data occur."""
    for _, h in _mixed(data):
        np.add.at(counts, h >> np.uint32(32 - SLOT_BITS), 1)


def slot_ranks(slots: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
    """The rank of every slot: 0, or for those given one more for each doubling of the count from `least` on."""
    rank = np.zeros(1 << SLOT_BITS, np.uint8)
    rank[slots] = np.minimum(RANKS - 1, 1 + np.log2(np.maximum(counts / least, 1)).astype(np.int64))
    return rank


def _keys(data: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of the eight bytes from each position on: rank, then hash."""
    keys = np.empty(len(data), np.uint32)
    for at, h in _mixed(data):
        keys[at : at + len(h)] = h >> np.uint32(4) | rank[h >> np.uint32(32 - SLOT_BITS)].astype(np.uint32) << np.uint32(28)
    return keys


def runs(data: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, window after the last, and smallest key of each run, in order; texts end at `ends` in `data`.

    rank: of each slot of hashes (see `slot_ranks`), the same for all texts that are compared.
    """
    if len(data) < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    least = _keys(data, rank)[: len(data) - GRAM + 1]
    for k in (1, 2, 4, 8, 16):
        least = np.minimum(least[:-k], least[k:])
    rest = WIDTH - GRAM + 1 - 32
    least = np.minimum(least[:-rest], least[rest:])  # of window p
    valid = np.zeros(len(least) + 1, np.int8)
    starts = np.concatenate(([0], ends[:-1]))
    whole = ends - starts >= WIDTH
    np.add.at(valid, starts[whole], 1)
    np.add.at(valid, ends[whole] - WIDTH + 1, -1)
    valid = np.cumsum(valid)[:-1] > 0
    first = np.ones(len(least), bool)
    first[1:] = least[1:] != least[:-1]
    first[starts[whole]] = True
    first[1:] |= valid[1:] != valid[:-1]
    cuts = np.flatnonzero(first)
    after = np.append(cuts[1:], len(least))
    good = valid[cuts]
    return cuts[good], after[good], least[cuts[good]]


def _resort(order: np.ndarray, group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within each group of `order`, sorts by key; what is alone then leaves. group: ascending numbers."""
    at = np.lexsort((key, group)) if len(group) and group[-1] else np.argsort(key)
    order, group, key = order[at], group[at], key[at]
    new = np.ones(len(order), bool)
    new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    alone = new & np.append(new[1:], True)
    return order[~alone], np.cumsum(new)[~alone]


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Bytes, WIDTH at most, in which two rows of words agree from their start on."""
    out, same = np.zeros(len(a[0]), np.int64), np.ones(len(a[0]), bool)
    for x, y in zip(a, b, strict=True):
        differ = x ^ y
        bytes_ = np.full(len(x), 8)
        for k in range(8):
            bytes_[(differ >> np.uint64(8 * k)) != 0] = 7 - k
        out += np.where(same, bytes_, 0)
        same &= differ == 0
    return np.minimum(out, WIDTH)


def equal_windows(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of windows that some other window equals, and a class for each: equal windows have equal classes.

    starts: where the windows begin in data, all whole.
    """
    v = words(np.concatenate([data, np.zeros(WIDTH + PERIOD, np.uint8)]))
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for k in range(0, 32, 8):
        order, group = _resort(order, group, v[starts[order] + k])
    if not len(order):
        return order, group
    # long ties: rank the cover's positions that they can lead to
    near = np.zeros(len(data) + PERIOD + 1, np.int32)
    np.add.at(near, starts[order], 1)
    np.add.at(near, starts[order] + PERIOD, -1)
    near = np.flatnonzero(np.cumsum(near)[:-1] > 0)
    sample = near[_IN_COVER[near % PERIOD]]
    sample = sample[np.lexsort([v[np.minimum(sample + k, len(v) - 1)] for k in range(48, -1, -8)])]
    rank = np.zeros(len(data) + PERIOD, np.int64)
    rank[sample] = np.arange(len(sample))
    parts = [v[np.minimum(sample + k, len(v) - 1)] for k in range(0, 56, 8)]
    agree = np.append(0, _common([p[:-1] for p in parts], [p[1:] for p in parts])) if len(sample) else np.zeros(0, np.int64)
    # a shift brings together all suffixes that it leads to ranked positions; any two meet at some shift, so the first
    # of equal windows meets each of the others, and one turn over the shifts gives all of them its number
    at, klass = starts[order], np.arange(len(order))
    for d in range(PERIOD):
        here = np.flatnonzero(_IN_COVER[(at + d) % PERIOD])
        if len(here):
            upto = np.cumsum(agree < WIDTH - d)  # ranks that agree on WIDTH - d bytes share a number
            key = group[here] * (len(sample) + 1) + upto[rank[at[here] + d]]
            by = np.argsort(key)
            head = np.flatnonzero(np.append(True, np.diff(key[by]) != 0))
            klass[here[by]] = np.repeat(np.minimum.reduceat(klass[here[by]], head), np.diff(np.append(head, len(here))))
    return order, klass
