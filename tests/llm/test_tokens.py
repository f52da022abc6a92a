import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomsieve.llm import bpe, packing

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def model():
    return bpe.ByteBpe(open(BYTES, encoding="utf-8").read())


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("ab cde'sT1 2\n\t.,!éßñ日😀 <|>endoftext"), max_size=60))
def test_encoding_equals_the_library(model, text):
    library = Tokenizer.from_file(BYTES)
    ids = np.frombuffer(model.encode(text), "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert model.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("ab cdE'sT1 2\n\t.,!éÉßñ日😀́ İΣς<|>startoftextend"), max_size=60))
def test_words_equal_the_library(text):
    chunks = packing._loaded(open(WORDS, encoding="utf-8").read())
    assert np.frombuffer(chunks.encode(text), "<u4").tolist() == Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids


def test_cache_limits_change_nothing(model, monkeypatch):
    texts = [f"alpha{i} beta{i % 7}, gamma" for i in range(50)]
    want = [model.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 6)
    assert [bpe.ByteBpe(open(BYTES, encoding="utf-8").read()).encode(t) for t in texts] == want
    chunks = packing._Chunks(open(WORDS, encoding="utf-8").read())
    library = Tokenizer.from_file(WORDS)
    assert [np.frombuffer(chunks.encode(t), "<u4").tolist() for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_encode_decode_rows(docs, corpus):
    library = Tokenizer.from_file(BYTES)
    got = Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in bpe.encode_decode(docs, BYTES).collect())
    want = Counter((i, np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t or "") for i, t, _, _ in corpus)
    assert got == want
    assert bpe.encode_decode(docs.limit(0), BYTES).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 16, 23, 100])
def test_pieces_are_binary(n):
    pieces = packing.pieces_of(n, 8)
    assert [s for s, _ in pieces] == list(np.cumsum([0] + [x for _, x in pieces])[:-1]) and sum(x for _, x in pieces) == n
    assert all(x & (x - 1) == 0 for _, x in pieces) and sorted((x for _, x in pieces), reverse=True) == [x for _, x in pieces]


def test_packing_round_trip(docs, corpus):
    library = Tokenizer.from_file(WORDS)
    rows = packing.pack(docs, WORDS, longest=64).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 for r in rows)
    by_length = Counter(r["length"] for r in rows)
    for length, n in by_length.items():
        assert sorted(r["sequence_id"] // 7 for r in rows if r["length"] == length) == list(range(n))
    want = Counter()
    for i, t, _, _ in corpus:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.update((i, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for s, n in packing.pieces_of(len(ids), 64))
    assert Counter((r["doc_id"], r["start"], r["length"], zlib.crc32(r["ids"]), r["doc_tokens"]) for r in rows) == want
    assert packing.pack(docs.limit(0), WORDS).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, WORDS, longest=100)
