"""Pieces of texts and their ids in the cache."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quadframe.llm import words

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PARTS = ["a", "Bc", "é", "ÿ", "ß", "×", "÷", "Σ", "İ", ".", ",", "'s", "'", " ", "  ", "\n", "\t", "\v", "\xa0", "\x1c", "¤", "1", "٣", "漢", "😀", "́", "(", ")", "$", "|", "\0", "Ġ", "y" * 22, "z" * 30, "<|endoftext|>", "<|EndOfText|>"]


def odd(seed, n=2000):
    r = random.Random(seed)
    return ["".join(r.choices(PARTS, k=r.randrange(20))) for _ in range(n)]


def same(got, name, texts):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    ids, counts = got.encode_batch(texts)
    expected = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]


@pytest.mark.parametrize("name", NAMES)
def test_known_words_are_not_encoded_again(name, monkeypatch):
    """Whatever stands behind the marks behind them: that was so for marks at the ends of pieces alone."""
    got = words.CachedTokenizer(public_tokenizers.path(name))
    same(got, name, ["alpha beta, gamma. été; un. a,b"])
    sent = []
    monkeypatch.setattr(got, "_ids", lambda texts, ids=got._ids: sent.extend(texts) or ids(texts))
    texts = ["a beta,(x) gamma.1", "alpha. beta", " été;2 beta; gamma,"]
    same(got, name, texts)
    assert sent and not any(w in t for t in sent for w in ("beta", "gamma", "été"))
    sent.clear()
    same(got, name, texts[::-1])
    assert not sent


@pytest.mark.parametrize("name", NAMES)
def test_odd_texts_twice(name):
    got = words.CachedTokenizer(public_tokenizers.path(name))
    for texts in (odd(1), odd(2), odd(1), [], [""], ["", " ", ""]):
        same(got, name, texts)


@pytest.mark.parametrize("name", NAMES)
def test_cache_begins_anew(name, monkeypatch):
    monkeypatch.setattr(words, "CACHE_PIECES", 50)
    got = words.CachedTokenizer(public_tokenizers.path(name))
    for seed in range(4):
        same(got, name, odd(seed, 100))


@pytest.mark.parametrize("hashes", [0, 3])
def test_pieces_of_one_hash(hashes, monkeypatch):
    """Hashes find pieces, but don't decide."""
    monkeypatch.setattr(words, "_hashes", lambda keys: keys[:, 0] & np.uint64(hashes))
    got = words.CachedTokenizer(public_tokenizers.path(NAMES[1]))
    for seed in (1, 2, 1):
        same(got, NAMES[1], odd(seed, 200))
