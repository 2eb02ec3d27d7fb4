"""Token ids of whole texts with a public tokenizer, fast for texts that repeat their words.

A vocabulary with word ends drops white space and never lets a token cross it, so the ids of a text are those of its
white-space separated chunks in order. A run of texts is split and its chunks numbered by Arrow; each Python worker
keeps the ids of the words it has met (a bounded cache), and gathers the ids of all texts of the run at once. Plain
small words are merged by tiktoken from the same vocabulary, all else by the tokenizers library. A vocabulary of
another kind is not split at all: its texts are encoded whole. `tests/llm/test_tokens.py` holds the ids against
encoding whole texts.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

from trailmark.llm.bytebpe import byte_of_char

#: Words a worker keeps; bytes of the texts that are looked up together.
CACHE, TOGETHER = 300_000, 4 << 20
#: White space as the tokenizers library understands it.
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: The part of it that is rare in texts; without it they are split at spaces and line feeds.
ODD_SPACE = r"[\t\x0b-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A plain word in small letters with the marks that follow it: two units to the tokenizer.
PLAIN = r"^(?P<word>[a-zß-öø-ÿ]*)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
#: What a vocabulary file says if its texts can be split (fixed values of the file format).
NORMALIZERS, WORDS, END = ["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>"


def _merges(told: dict) -> tiktoken.Encoding | None:
    """The vocabulary for tiktoken, the end of a word written as a byte that no text has; None where that isn't the same."""
    model, pre = told["model"], (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    found = [n.get("type") for n in (told.get("normalizer") or {}).get("normalizers") or []]
    if found != NORMALIZERS or pre[0].get("pattern") != {"Regex": WORDS} or model.get("end_of_word_suffix") != END:
        return None
    alphabet, added = byte_of_char(), {t["content"] for t in told.get("added_tokens") or []}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get("".join(m)) != 512 + k for k, m in enumerate(pairs)):
        return None
    ranks = {bytes(alphabet[c] for c in t.removesuffix(END)) + (b"\xff" if t.endswith(END) else b""): i for t, i in vocab.items()}
    # that byte merges with the letter before it first of all: those tokens come before all merges
    return tiktoken.Encoding("file", pat_str=r"[^\s]+", mergeable_ranks=ranks, special_tokens={}) if len(ranks) == len(vocab) else None


class ChunkTokenizer:
    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.merges = _merges(json.load(f))
        self._clear()

    def _clear(self) -> None:
        """Unit k has self.ids[self.ends[k]:self.ends[k + 1]]. Units: plain words and runs of marks, and all other chunks."""
        self.plain: dict[str, int] = {}
        self.other: dict[str, int] = {}
        self.ids, self.ends, self.known = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def _encode(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _pieces(self, units: list[str]) -> list[list[int]]:
        piece = self.merges._core_bpe.encode_single_piece  # noqa: SLF001  (no public call takes bytes)
        return [piece(u.encode() + b"\xff") if u else [] for u in units]

    def _numbers(self, units: pa.Array, met: dict[str, int], encode: Callable[[list[str]], list[list[int]]]) -> np.ndarray:
        """The numbers of units, new ones learnt."""
        coded = units.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [u for u in names if u not in met]:
            flat, sizes = _flat(encode(new))
            self.ids, self.ends = _append(self.ids, self.ends, self.known, flat, sizes)
            met.update(zip(new, range(self.known, self.known + len(new)), strict=True))
            self.known += len(new)
        numbers = np.fromiter(map(met.__getitem__, names), np.int64, len(names))
        return numbers[coded.indices.to_numpy(zero_copy_only=False)]

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, one after the other, and the end of each, behind a first 0."""
        if self.known > CACHE:
            self._clear()
        small = pc.if_else(pc.match_substring_regex(chunks, r"^[\x{0}-\x{ff}]*$"), pc.utf8_lower(chunks), chunks)  # in Latin-1 these are the tokenizer's own
        parts = pc.extract_regex(small, PLAIN)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        pairs = np.full((len(chunks), 2), -1, np.int64)
        words, marks = (pc.struct_field(parts.filter(pa.array(plain)), k) for k in ("word", "marks"))
        pairs[plain] = np.stack([self._numbers(words, self.plain, self._pieces), self._numbers(marks, self.plain, self._pieces)], 1)
        pairs[~plain, 0] = self._numbers(chunks.filter(pa.array(~plain)), self.other, self._encode)
        flat, sizes = _gather(self.ids, self.ends[: self.known + 1], pairs[pairs >= 0])
        each = np.zeros(pairs.shape, np.int64)
        each[pairs >= 0] = sizes
        return flat, np.concatenate([[0], np.cumsum(each.sum(1))])

    def encode_all(self, texts: Sequence[str | None] | pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text as uint32; none for null."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(column):
            return
        column = column.fill_null("").cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) // TOGETHER
        for run in np.split(np.arange(len(column)), np.flatnonzero(np.diff(ends)) + 1):
            yield from self._run(column.slice(run[0], len(run)))

    def _run(self, column: pa.Array) -> Iterator[np.ndarray]:
        if self.merges is None:
            yield from (np.array(self._encode([t])[0], np.uint32) for t in column.to_pylist())
            return
        # "<|" may begin a special token, which is found before a text is split
        whole = pc.match_substring(column, "<|").to_numpy(zero_copy_only=False)
        if pc.any(pc.match_substring_regex(column, ODD_SPACE)).as_py():
            split = pc.split_pattern_regex(column, SPACE)
        else:
            split = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        numbers = split.flatten().dictionary_encode()
        ids, each = _gather(*self._chunks(numbers.dictionary), numbers.indices.to_numpy(zero_copy_only=False))
        offsets = split.offsets.to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.cumsum(each)])[offsets - offsets[0]]
        for i in range(len(column)):
            yield np.array(self._encode([column[i].as_py()])[0], np.uint32) if whole[i] else ids[cuts[i] : cuts[i + 1]]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes


def _gather(ids: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries `at`, one after the other, and the size of each. Entry k has ids[ends[k]:ends[k + 1]]."""
    taken = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(ids[: ends[-1]])).take(pa.array(at))
    return taken.flatten().to_numpy(zero_copy_only=False), np.diff(taken.offsets.to_numpy(zero_copy_only=False))


def _append(ids: np.ndarray, ends: np.ndarray, n: int, more: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both arrays with further entries behind the first n."""
    used = int(ends[n])
    ids, ends = _room(ids, used + len(more)), _room(ends, n + len(sizes) + 1)
    ids[used : used + len(more)] = more
    ends[n + 1 : n + 1 + len(sizes)] = used + np.cumsum(sizes)
    return ids, ends


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """`a`, or a longer copy of it, with room for n rows."""
    return a if n <= len(a) else np.concatenate([a, np.zeros((2 * n - len(a), *a.shape[1:]), a.dtype)])


@functools.lru_cache(maxsize=2)
def worker_tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer for each Python worker."""
    return ChunkTokenizer(path)
