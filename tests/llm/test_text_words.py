import random

import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import text_words
from sieveline.llm.part_enum import signatures

from texts import odd_texts, plain_words, words


@pytest.mark.parametrize("window", [1 << 20, 64, 7])
@pytest.mark.parametrize(("word_byte", "rule"), [(text_words.NOT_SPACE, words), (text_words.PLAIN, plain_words)])
def test_words_equal_the_pattern(monkeypatch, window, word_byte, rule):
    monkeypatch.setattr(text_words, "WINDOW", window)
    monkeypatch.setattr(text_words, "_POWERS", {})
    texts = odd_texts()
    found = text_words.scan(pa.array(texts).slice(1), word_byte, text_words.LOWER)
    keys = {}
    for row, text in enumerate(texts[1:]):
        spans = range(found.first[row], found.first[row + 1])
        spelled = [found.data[found.start[i]:found.end[i]].tobytes().lower().decode() for i in spans]
        assert spelled == rule(text)
        for i, word in zip(spans, spelled):
            assert keys.setdefault(word, found.key[i]) == found.key[i]
    assert len(set(keys.values())) == len(keys)


def test_shingles_are_runs_of_five_words():
    texts = odd_texts()
    keys, rows = text_words.shingle_keys(text_words.scan(pa.array(texts), text_words.NOT_SPACE, text_words.LOWER))
    seen = {}
    for row, text in enumerate(texts):
        w = words(text)
        want = [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
        got = keys[rows == row]
        assert len(got) == len(want)
        for key, shingle in zip(got.tolist(), want):
            assert seen.setdefault(shingle, key) == key
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("size", [4, 5, 8, 9, 13, 14, 22, 26, 31, 32, 45, 60, 100, 150, 300, 900])
def test_similar_sets_share_a_signature(size):
    rng, pick = np.random.default_rng(size), random.Random(size)
    for _ in range(60):
        one = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        lost = pick.randint(0, size // 5)
        more = pick.randint(0, size * 5 // 4 - size)
        while 100 * (size - lost) < 80 * (size + more):
            lost, more = max(lost - 1, 0), max(more - 1, 0)
        if lost + more == 0:
            continue
        two = np.concatenate([one[lost:], rng.integers(0, 1 << 63, more, dtype=np.uint64)])
        sign, owner = signatures(np.concatenate([one, two]), np.array([0, size, size + len(two)]))
        assert set(sign[owner == 0].tolist()) & set(sign[owner == 1].tolist())


def test_small_sets_have_no_signature():
    sign, _ = signatures(np.arange(6, dtype=np.uint64), np.array([0, 3, 3, 6]))
    assert len(sign) == 0
