"""A static range asymmetric numeral system for token ids, vectorised over interleaved lanes.

A file is: magic, header, frequency table, then independent blocks. The table is shared by all blocks of the file.
A block's ids are dealt to LANES coder states in turn. Every STEPS steps the states and the place in the block's
words are kept as a checkpoint, so a decoder can begin at any of them; all of them run side by side in NumPy.
Each block has a CRC-32 of its ids, verified on decoding.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import zstandard

MAGIC, SCALE, LANES, STEPS, BLOCK = b"TMTOKEN1", 20, 32, 1024, 1 << 17
LOW, MASK = np.uint64(1 << 31), np.uint64((1 << SCALE) - 1)
HEAD = struct.Struct("<8sIIQ")


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that occur, ascending, and their shares of 2**SCALE, at least one each."""
    symbols, counts = np.unique(ids, return_counts=True)
    if len(symbols) > 1 << SCALE - 1:
        raise ValueError("more symbols than the table has room for")
    share = np.maximum(1, counts * (1 << SCALE) // max(1, counts.sum()))
    over = int(share.sum()) - (1 << SCALE)
    while over > 0:  # many rare symbols were lifted to one: take it from the frequent ones, in proportion
        cut = np.minimum(share - 1, -(-share * over // max(1, int(share[share > 1].sum()))))
        cut[np.cumsum(cut) - cut >= over] = 0
        share -= np.minimum(cut, np.maximum(0, over - (np.cumsum(cut) - cut)))
        over = int(share.sum()) - (1 << SCALE)
    if len(symbols):
        share[np.argmax(share)] -= over
    return symbols.astype(np.uint32), share.astype(np.uint32)


def _encode_blocks(codes: np.ndarray, freq: np.ndarray, start: np.ndarray) -> list[tuple[bytes, bytes]]:
    """codes: numbers of symbols, blocks x steps x lanes. The words and the checkpoints of each block."""
    blocks, steps, lanes = codes.shape
    x = np.full((blocks, lanes), LOW, np.uint64)
    words, sent = np.zeros((steps, blocks, lanes), np.uint32), np.zeros((steps, blocks, lanes), bool)
    states = np.zeros((blocks, -(-steps // STEPS), lanes), "<u8")
    for i in range(steps - 1, -1, -1):
        f, c = freq[codes[:, i]], start[codes[:, i]]
        full = x >= f << np.uint64(63 - SCALE)
        words[i], sent[i] = x.astype(np.uint32), full
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + c
        if i % STEPS == 0:
            states[:, i // STEPS] = x
    out = []
    for k in range(blocks):
        at = np.cumsum(sent[:, k].sum(axis=1))
        points = np.concatenate(([0], at[:-1]))[::STEPS].astype("<u8").tobytes() + states[k].tobytes()
        out.append((words[:, k][sent[:, k]].astype("<u4").tobytes(), points))
    return out


def encode(ids: np.ndarray) -> bytes:
    """One file of the given ids."""
    symbols, share = frequencies(ids)
    freq, start = share.astype(np.uint64), (np.cumsum(share, dtype=np.uint64) - share).astype(np.uint64)
    codes = np.searchsorted(symbols, ids)
    pad = int(np.argmax(share)) if len(share) else 0
    table = zstandard.compress(np.diff(symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + share.astype("<u4").tobytes(), 3)
    out = [HEAD.pack(MAGIC, len(symbols), len(table), len(ids)), table]
    whole = len(ids) // BLOCK
    rest = codes[whole * BLOCK :]
    coded = _encode_blocks(codes[: whole * BLOCK].reshape(whole, -1, LANES), freq, start) if whole else []
    if len(rest):
        last = np.full(-(-len(rest) // LANES) * LANES, pad, np.int64)
        last[: len(rest)] = rest
        coded += _encode_blocks(last.reshape(1, -1, LANES), freq, start)
    for k, (words, points) in enumerate(coded):
        own = ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4")
        out += [struct.pack("<IIII", len(own), len(points), len(words), zlib.crc32(own.tobytes())), points, words]
    return b"".join(out)


def decode(data: bytes) -> np.ndarray:
    """The ids of one file, all checkpoints of all blocks at once; raises ValueError where a file is not whole."""
    magic, n_symbols, n_table, total = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size
    table = np.frombuffer(zstandard.decompress(data[at : at + n_table]), "<u4")
    at += n_table
    symbols, share = np.cumsum(table[:n_symbols], dtype=np.uint32), table[n_symbols:]
    freq, start = share.astype(np.uint64), (np.cumsum(share, dtype=np.uint64) - share).astype(np.uint64)
    of_slot = np.repeat(np.arange(n_symbols), share)
    blocks, states, places, left, words, base = [], [], [], [], [], 0
    while at < len(data):
        n, n_points, n_words, crc = struct.unpack_from("<IIII", data, at)
        points = np.frombuffer(data, "<u8", n_points // 8, at + 16)
        runs = n_points // (8 * (LANES + 1))
        steps = -(-n // LANES)
        blocks.append((n, steps, crc))
        places.append(points[:runs].astype(np.int64) + base)
        states.append(points[runs:].reshape(runs, LANES))
        left += [min(STEPS, steps - STEPS * r) for r in range(runs)]
        words.append(np.frombuffer(data, "<u4", n_words // 4, at + 16 + n_points))
        base += n_words // 4
        at += 16 + n_points + n_words
    if not blocks:
        return np.zeros(0, np.uint32)
    words.append(np.zeros(LANES, "<u4"))  # read, and not used, past the end
    stream, x, place, remaining = np.concatenate(words), np.concatenate(states).astype(np.uint64), np.concatenate(places), np.array(left)
    out = np.zeros((max(left), len(left), LANES), np.int32)
    alive = np.arange(len(left))
    for i in range(max(left)):
        if not (going := remaining[alive] > i).all():  # runs that have ended leave
            x, place, alive = x[going], place[going], alive[going]
        slot = x & MASK
        code = of_slot[slot]
        out[i, alive] = code
        x = freq[code] * (x >> np.uint64(SCALE)) + slot - start[code]
        need = x < LOW
        rank = np.cumsum(need, axis=1)
        word = stream[np.minimum(place[:, None] + rank - 1, len(stream) - 1)]
        x = np.where(need, x << np.uint64(32) | word, x)
        place = place + rank[:, -1]
    ids, run = [], 0
    for n, steps, crc in blocks:
        parts = []
        for r in range(-(-steps // STEPS)):
            parts.append(out[: left[run], run].reshape(-1))
            run += 1
        block = symbols[np.concatenate(parts)[:n]]
        if zlib.crc32(block.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum differs")
        ids.append(block)
    ids = np.concatenate(ids)
    if len(ids) != total:
        raise ValueError("blocks are missing")
    return ids
