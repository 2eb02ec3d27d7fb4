import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trailmark.llm.tokens import ChunkTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE, CHUNKS = Tokenizer.from_file(PATH), ChunkTokenizer(PATH)


def same(text):
    assert next(CHUNKS.encode_all([text])).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_odd_texts():
    for t in ("", "Hello, World!! it's 'S x'll", "ÀÉ École ß ẞ İstanbul ΣΑΣ ΌΣΟΣ.", "é ́a   b c\x85d e", "a<|endoftext|>b <|startoftext|>", "x\x1cy z\x1f", "12 3a4 ١٢", "__a__ %%%don't", "Ǆ ﬁ Å ﷺ 你好 안녕"):
        same(t)
    assert next(CHUNKS.encode_all([None])).tolist() == []


def test_many_texts_together_and_a_vocabulary_of_another_kind():
    texts = [f"Word{i % 7}, ÉTÉ \n\t straße! x{i}\u2003y " * (i % 5) for i in range(200)] + [None, "", " ", "\n", "a<|endoftext|>b", "\x1c", "Ünï \u212a İ"]
    assert [x.tolist() for x in CHUNKS.encode_all(texts)] == [WHOLE.encode(t or "", add_special_tokens=False).ids for t in texts]
    path = public_tokenizers.path("byte_bpe_50k.json")
    other, whole = ChunkTokenizer(path), Tokenizer.from_file(path)
    assert other.merges is None and next(other.encode_all(["Hello  there"])).tolist() == whole.encode("Hello  there", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text() | st.text(alphabet="aAéÉß.,'!-0 \ń \x1d<|>İΣ"))
def test_same_ids_as_whole_texts(text):
    same(text)
