"""Token ids against the library itself."""

import random

import numpy as np
import pyarrow as pa
import pytest

from fathomline.llm import tokens
from fathomline.llm.tokens import Words, tokenizer_path


@pytest.fixture(scope="module")
def words():
    return Words(tokenizer_path())


def library(words, text):
    return words.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_every_character_of_the_basic_plane(words):
    texts = [x for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) for x in (f"a{c}b", f"{c} 's{c}")]
    low = [x for x in texts if max(x) < "　"]
    rest = random.Random(3).sample([x for x in texts if max(x) >= "　"], 4000)
    for some in (low, rest):
        ids, places = words.batch(pa.array(some))
        for i, x in enumerate(some):
            assert ids[places[i] : places[i + 1]].tolist() == library(words, x), repr(x)


def test_random_bytes(words):
    rng = random.Random(8)
    parts = [chr(x) for x in range(0x250)] + ["'s", "'LL", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "́", "̸", "İ", "日本", ", ", "). ", " ", "\n"] * 20
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    ids, places = words.batch(pa.array(texts))
    for i, x in enumerate(texts):
        assert ids[places[i] : places[i + 1]].tolist() == library(words, x), repr(x)


def test_odd_batches(words):
    for texts in ([], [None], [""], [None, "", " \n"], ["  a  ", None, "b. "]):
        ids, places = words.batch(pa.array(texts, pa.string()))
        assert [ids[i:j].tolist() for i, j in zip(places[:-1], places[1:], strict=True)] == [library(words, x) for x in texts]
    ids, places = words.batch(pa.array(["x", "a b", "c, d"]).slice(1, 2))
    assert ids.tolist() == library(words, "a b") + library(words, "c, d") and places.tolist()[0] == 0
    assert np.array_equal(words.ids("long. " * 100_000), np.array(library(words, "long. ") * 100_000))


def test_small_caches(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    small = Words(tokenizer_path())
    text = " ".join(f"word{i % 13}, Up{i % 7}! ça{i % 5}" for i in range(300))
    assert small.ids(text).tolist() == library(small, text)
    assert len(small.word) <= 5 and len(small.word.old) <= 5


def test_another_tokenizer():
    other = Words(tokenizer_path("byte_bpe_50k.json"))
    assert not other.plain
