"""Against the tiktoken library, and exact round trips."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm.conftest import AWKWARD, sha
from tessera.llm import bpe

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(FILE, "rb") as f:
        return bpe.Codec.load(f.read())


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_pattern_is_the_given_one():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_random_texts(codec, library):
    r, letters = random.Random(2), "aàé ñ1٣²Ⅷ\n\t\x85\x1c​日本語🙂'sted,.!-—́ſ'S'LL're"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    for text, packed in zip(texts, codec.encode_many(texts), strict=True):
        expected = library.encode_ordinary(text)
        assert np.frombuffer(packed, "<u4").tolist() == expected == codec.encode(text)
        assert codec.decode(expected).decode() == text


def test_batches_and_single_words_agree(codec):
    r = random.Random(3)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 20))).encode() for _ in range(2000)]
    ids, counts = codec.batch.merge(words)
    at = np.cumsum([0, *counts])
    assert all(ids[a:b].tolist() == codec.merge(w) for w, a, b in zip(words, at, at[1:], strict=False))


def test_very_long_words(codec, library):
    for text in ("ab" * 20_000, "a" * 40_000, "".join(random.Random(4).choice("abc") for _ in range(30_000)), " " * 30_000 + "x"):
        assert codec.encode(text) == library.encode_ordinary(text)


def test_cache_does_not_matter(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    text = "some words and some more words and others"
    assert [codec.encode(text) for _ in range(3)] == [library.encode_ordinary(text)] * 3


def test_encode(awkward, nothing, library):
    got = bpe.encode(awkward, FILE, with_ids=True).collect()
    assert len(got) == 12
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    for doc, text, *_ in AWKWARD:
        ids = library.encode_ordinary(text or "")
        assert by[doc]["n_tokens"] == len(ids) and by[doc]["token_ids"] == ids
        assert by[doc]["ids_sha256"] == sha(np.array(ids, "<u4").tobytes()) and by[doc]["decoded_sha256"] == sha(text or "")
    assert bpe.encode(nothing, FILE).count() == 0
