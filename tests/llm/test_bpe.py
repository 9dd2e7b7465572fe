import array
import hashlib
import random

import pytest
from tokenizers import Tokenizer

from docloom.llm import bpe
from docloom.llm.queries import word_vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_vocabulary())


@pytest.fixture(scope="module")
def own():
    with open(word_vocabulary(), encoding="utf-8") as file:
        return bpe.WordBpe(file.read())


def test_same_as_library_on_odd_texts(library, own):
    rng = random.Random(2)
    signs = [chr(c) for c in range(32, 127)] + list("\t\n\r\x0b\x1c\x85\xa0  İΣσßŉſ×÷éÉñ漢字한éﬁ²½٣😀'​") + ["<|endoftext|>", "'s", "'ll", "<|startoftext|>", "aaaa", "***", "\x1f", "\0"]
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(own.encode(text)) == ids
        assert own.decode(array.array("I", ids)) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 5000, "*" * 3000, "internationalization" * 300, "ab" * 2000 + " x"])
def test_long_words(library, own, text):
    assert list(own.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_cuts_are_never_crossed(own):
    for token in list(own.ids)[::97]:
        inner = token.removesuffix(own.end)
        assert len(own.cuts(bytes(own.characters.index(c) for c in inner))) == 1


def test_documents(spark, documents, library):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in bpe.encode_table(documents, word_vocabulary()).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(array.array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_awkward_rows_and_empty_table(spark, awkward, library):
    got = bpe.encode_table(awkward, word_vocabulary()).collect()
    assert len(got) == awkward.count()
    for r, text in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.n_tokens)), sorted(awkward.collect(), key=lambda r: (r.doc_id or 0, len(r.text or ""))), strict=True):
        assert r.ids == library.encode(text.text or "", add_special_tokens=False).ids
    assert bpe.encode_table(awkward.limit(0), word_vocabulary()).count() == 0


def test_a_word_of_a_megabyte(library, own):
    rng = random.Random(8)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=1_000_000))
    assert list(own.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert text not in own.words


def test_memo_is_bounded_by_bytes():
    memo = bpe.Memo(lambda k: k.encode() * 2, len, 100_000)
    for i in range(5_000):
        assert memo[f"{i:030}"] == f"{i:030}".encode() * 2
        assert sum(len(k) + len(v) + 160 for k, v in memo.items()) == memo.held <= 100_000
    assert memo["x" * 50_000] == b"x" * 100_000 and "x" * 50_000 not in memo
