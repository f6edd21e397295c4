"""Token counts and SentencePiece ids against the libraries."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from hitledger.llm import pieces, token_counts

ODD = [
    "", "  ", "a", "Hello  world", "  a b ", "a\nb\tc", "it's we'll don't 's 'S ''s !!'s x's's 's", "12 345 a1b2 ½²٣x", "<|endoftext|>a<|startoftext|>", "<s> x</s><0x0A>",
    "ΣΑΣ ΟΔΟΣ Σ", "İstanbul é é ﬁ", "日本語テスト🙂🙂", "▁x ▁", "a\x1cb\x85c\xa0d", "ab" * 700, "￿￾ x￿", "    " * 20, "'re'r 're don'tthe'", "\x00\x01",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    made = ["".join(rng.choice("abcdefghiéß '.,1st\n<|>llre日𐍈") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    made += ["".join(rng.choice("etaoinshrdlu   ") for _ in range(rng.randint(100, 2000))) for _ in range(20)]
    return ODD + made


@pytest.mark.parametrize("chunk", [3, 64, 1024])
def test_counts(texts, chunk, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.CompiledTokenizer(path).counts(texts).tolist() == want


def test_counts_survive_forgotten_states(texts, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    tokenizer = token_counts.CompiledTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    first = tokenizer.counts(texts).tolist()
    assert tokenizer.counts(texts).tolist() == first


@pytest.mark.parametrize("array_chars", [40, 1 << 19])
def test_ids(texts, array_chars, monkeypatch):
    monkeypatch.setattr(pieces, "ARRAY_CHARS", array_chars)
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    model = pieces.PieceModel(path)
    for _ in range(2):  # the second time from the memo
        ids, ends = model.encode(texts)
        got = [x.tolist() for x in np.split(ids, ends[1:-1])]
        assert got == [library.encode(t) for t in texts]
    assert [model.decode(i) for i in got] == [library.decode(i) for i in got]


def test_known_pairs_are_not_searched():
    model = pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    first = model.encode(["often"])[0].tolist()
    assert (model.slot_code >= 0).any()
    model._verdicts = None  # all pairs of the word are in slots now
    model._forget()
    assert model.encode(["often"])[0].tolist() == first


def test_verdicts_survive_shared_slots(texts, monkeypatch):
    monkeypatch.setattr(pieces, "_SLOT_BITS", 3)
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, ends = pieces.PieceModel(path).encode(texts)
    assert [x.tolist() for x in np.split(ids, ends[1:-1])] == [library.encode(t) for t in texts]


def test_decoding_a_table(spark, documents_of):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = documents_of([(1, "Hello  world\n"), (2, None), (3, "🙂é")])
    rows = pieces.decode(pieces.encode(docs, path), path).orderBy("doc_id").collect()
    assert [r.decoded for r in rows] == ["Hello  world\n", "", "🙂é"]
