import random

import numpy as np
import pytest

from sieveline.llm import lsh_forest
from sieveline.llm.jaccard_join import near_duplicate_groups
from sieveline.llm.lsh_forest import forest_groups, minima
from test_jaccard import near_texts
from texts import changed, documents, odd_texts, prose, words


def shingles(text, size):
    w = words(text)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def plain_groups(rows, size=3, percent=85):
    sets = [(r.doc_id, shingles(r.text, size)) for r in rows]
    label = {d: d for d, _ in sets if d is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in sets), key=str)


def cloud(seed, n, size=90):
    """Near copies of a text that is not among them; about half of all pairs link."""
    rng = random.Random(seed)
    base = prose(rng, size).split(" ")
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.choice((1, 1, 2, 3))):
            w[rng.randrange(size)] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("texts", [odd_texts(), near_texts(1), cloud(5, 120)], ids=["odd", "near", "cloud"])
def test_groups_equal_all_pairs(spark, texts):
    docs = documents(spark, texts)
    got = forest_groups(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain_groups(docs.collect())
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_large_cloud_of_near_copies(spark):
    texts = cloud(6, 700) + cloud(7, 150)
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    plain = [type("R", (), {"doc_id": i, "text": t}) for i, t in rows]
    for found, size, percent in ((forest_groups(docs), 3, 85), (near_duplicate_groups(docs), 5, 80)):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str)
        assert got == plain_groups(plain, size, percent)


def test_same_id_with_other_texts(spark):
    rng = random.Random(3)
    one, two = prose(rng, 60), prose(rng, 60)
    docs = spark.createDataFrame([(1, one), (5, one), (5, two), (7, changed(rng, two, 0.01)), (None, one)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in forest_groups(docs).collect()}
    assert got == {(1, 1, True), (5, 1, False), (7, 1, False), (None, None, True)}


def test_empty_table(spark):
    assert forest_groups(documents(spark, [])).count() == 0
    assert [r.component_id for r in forest_groups(documents(spark, [None, "", " "])).collect() if r.doc_id is not None]


def test_minima_of_parts_and_wholes():
    keys = np.array([5, 9, 1 << 60, 77, 3], dtype=np.uint64)
    got = minima(keys, np.array([0, 2, 2, 5]), 7)
    one, two, both = minima(keys[:2], np.array([0, 2]), 7), minima(keys[2:], np.array([0, 3]), 7), minima(keys, np.array([0, 5]), 7)
    assert got.shape == (2, 7) and (got == np.concatenate([one, two])).all()
    assert (both[0] == np.minimum(one[0], two[0])).all()
    assert minima(keys[:0], np.array([0, 0]), 7).shape == (0, 7)


def test_agreement_follows_similarity():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, 2300, dtype=np.uint64)
    one, two = np.sort(keys[:2150]), np.sort(keys[150:])
    got = minima(np.concatenate([one, two]), np.array([0, 2150, 4300]), 2000)
    share = 2000 / 2300
    assert abs((got[0] == got[1]).mean() - share) < 0.04
    assert lsh_forest.TREES * lsh_forest.DEPTH == 144
