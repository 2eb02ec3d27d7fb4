import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trailmark.llm import op13
from trailmark.llm.bytebpe import ByteTokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE, FAST = Tokenizer.from_file(PATH), ByteTokenizer(PATH)


def padding(rows, capacity):
    """Places left empty, by sequence: none where the fill is a power of two. Sequences must be gapless from 0."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    empty = 0
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        empty += 0 if at & (at - 1) == 0 else capacity - at
    return empty, len(by)


def check(rows, texts, capacity, with_ids):
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for doc, text in texts:
        ids = [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces.pop(doc), key=lambda r: r.start):
            data = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(data))
            assert not with_ids or bytes(r.ids) == data
            at += r.length
        assert at == len(ids)
    assert not pieces


@pytest.mark.parametrize("with_ids", [False, True])
def test_documents_are_packed_whole_without_padding(spark, with_ids):
    texts = [(i, f"word{i} " * (1 + i * 7 % 90)) for i in range(150)] + [(500, "long text. " * 700), (501, None), (502, ""), (503, "\n\n  a \t"), (None, "b c")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in texts], "doc_id long, text string, length int, ids string").repartition(9)
    rows = op13.pack_documents(docs, capacity=256, with_ids=with_ids).collect()
    check(rows, texts, 256, with_ids)
    empty, sequences = padding(rows, 256)
    assert empty == 0 and sequences <= sum(r.length for r in rows) // 256 + 8


def test_repeated_rows_and_one_length(spark):
    docs = spark.createDataFrame([(7, "same words")] * 40, "doc_id long, text string").repartition(5)
    rows = op13.pack_documents(docs, capacity=64).collect()
    tokens = len(WHOLE.encode("same words").ids) + 1
    assert sum(r.length for r in rows) == 40 * tokens and padding(rows, 64)[0] == 0


def test_no_documents(spark):
    assert op13.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 99), max_size=300), st.integers(0, 3))
def test_plan_takes_every_item_once(lengths, shift):
    sizes, n = np.unique(lengths, return_counts=True)
    counts = {int(s): int(k) << shift for s, k in zip(sizes, n, strict=True)}
    patterns = op13.shortest_pack_first(counts, 100)
    placed = defaultdict(int)
    for p in patterns:
        assert p.fill == sum(a * b for a, b in p.content) <= 100
        for length, times in p.content:
            placed[length] += times * p.packs
    assert placed == counts
    slots, gaps = op13.plan(counts, 100)
    fills, taken = defaultdict(int), defaultdict(list)
    for length, first, last, filler, at, times, place in slots:
        taken[length] += range(first, last + 1)
        for x in range(last - first + 1):
            if filler:
                for _, k, sequence, _ in op13.fill_gaps(gaps, at + x * length, length):
                    fills[sequence] += k
            else:
                fills[at + x // times] += length
    assert {k: sorted(v) for k, v in taken.items()} == {k: list(range(v)) for k, v in counts.items()}
    assert all(f == 100 or f & (f - 1) == 0 for f in fills.values())


def test_shortest_packs_are_taken_first():
    # 60 and 50 open packs; 30 goes to the shorter pack, then 25 to the one left shorter
    assert op13.shortest_pack_first({60: 1, 50: 1, 30: 1, 25: 1}, 100) == [(80, 1, ((50, 1), (30, 1))), (85, 1, ((60, 1), (25, 1)))]


@settings(max_examples=400, deadline=None)
@given(st.text() | st.text(alphabet="aAéß.,'st!-0 \n\t\x1c\x85\xa0 <|>İ你"))
def test_same_ids_as_the_library(text):
    assert FAST.fast and FAST.encode(text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_odd_texts_have_the_same_ids():
    for t in (" " * 1_000_000 + "x", "a" * 50_000, "a <|endoftext|>  b", "�\x00z", "x\r\n\r\ny"):
        assert FAST.encode(t).tolist() == WHOLE.encode(t, add_special_tokens=False).ids
    other = ByteTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert other.fast is None and other.encode("Hello there").tolist() == other.whole.encode("Hello there", add_special_tokens=False).ids
