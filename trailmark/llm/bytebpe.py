"""Token ids of whole texts with a byte-level BPE vocabulary file of the tokenizers library.

Where the file is plain byte-level BPE (tokens merge in the order of their ids, no normalizer, the usual split into
words), its vocabulary is handed to tiktoken, which gives the same ids several times faster. Every other file, and
the few texts that hold an added token or that tiktoken refuses, go to the tokenizers library itself.
`tests/llm/test_op13.py` holds the ids against that library.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer


def byte_of_char() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteTokenizer:
    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.added = [t["content"] for t in told.get("added_tokens") or []]
        self.fast = self._fast(told)

    def _fast(self, told: dict) -> tiktoken.Encoding | None:
        model, pre = told["model"], told.get("pre_tokenizer") or {}
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if told.get("normalizer") or model.get("type", "BPE") != "BPE" or any(pre.get(k) != v for k, v in usual.items()):
            return None
        alphabet, vocab = byte_of_char(), {t: i for t, i in model["vocab"].items() if t not in self.added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(len(set(m)) and vocab.get("".join(m)) != 256 + k for k, m in enumerate(merges)) or len(vocab) != 256 + len(merges):
            return None
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items()}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        """The ids as uint32, without special tokens around them; none for null."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast and not any(a in text for a in self.added):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except ValueError:  # its pattern gives up on very long runs of white space
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=2)
def worker_tokenizer(path: str) -> ByteTokenizer:
    """One tokenizer for each Python worker."""
    return ByteTokenizer(path)
