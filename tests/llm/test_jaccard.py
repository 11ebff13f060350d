import random

import pytest

from sieveline.llm.components import smallest_reachable
from sieveline.llm.frames import ship_package
from sieveline.llm.jaccard_join import _packed, _shared, _signed, keep_one_of_each_group, near_duplicate_groups
from sieveline.llm.near_pairs import _with_text, packed_texts
from texts import changed, documents, odd_texts, prose, words


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_groups(rows):
    sets = [(r.doc_id, shingles(r.text)) for r in rows]
    label = {d: d for d, _ in sets if d is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in sets), key=str)


def near_texts(seed):
    """Chains and clouds of near copies whose similarities lie around the limit, in many sizes."""
    rng = random.Random(seed)
    out = []
    for n in (8, 10, 14, 18, 22, 28, 33, 40, 55, 80, 130, 210, 500):
        text = prose(rng, n)
        for _ in range(5):
            w = text.split(" ")
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = "changed"
            if rng.random() < 0.5:
                w = w[rng.randint(0, max(1, n // 9)):]
            if rng.random() < 0.3:
                w += prose(rng, max(1, n // 10)).split(" ")
            text = " ".join(w)
            out += [text, changed(rng, text, 0.005)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("texts", [odd_texts(), near_texts(1), near_texts(2)], ids=["odd", "near", "near2"])
def test_groups_equal_all_pairs(spark, texts):
    docs = documents(spark, texts)
    got = sorted((tuple(r) for r in near_duplicate_groups(docs).collect()), key=str)
    assert got == plain_groups(docs.collect())


def test_same_id_with_other_texts(spark):
    rng = random.Random(3)
    one, two = prose(rng, 60), prose(rng, 60)
    docs = spark.createDataFrame([(1, one), (5, one), (5, two), (7, changed(rng, two, 0.01))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicate_groups(docs).collect()} == {(1, 1), (5, 1), (7, 1)}


def test_one_of_each_group_stays(spark):
    rng = random.Random(4)
    text = prose(rng, 100)
    docs = documents(spark, [prose(rng, 50), text, text, changed(rng, text, 0.01), None, "", "", "two words", "two words"])
    left = keep_one_of_each_group(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == [0, 1, 4, 5, 6, 7, None, None]


def test_empty_table(spark):
    assert near_duplicate_groups(documents(spark, [])).count() == 0
    assert keep_one_of_each_group(documents(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i + 1, i) for i in range(100, 140)] + [(7, i) for i in range(200, 230)] + [(9, 9), (None, 3)]
    got = {r.node: r.label for r in smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in (7, *range(200, 230))}


def test_little_is_moved(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, prose(rng, 60)) for i in range(40)], "doc_id long, text string")
    ship_package(spark)
    sign, route = _signed(docs, 5).selectExpr("max(greatest(sign, route))", "min(least(sign, route))").first()
    assert 0 <= route < sign < 2**48
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    texts = packed_texts(docs, docs.select("doc_id"))
    with_a = _with_text(pairs, pairs, 2, texts, "a")
    assert "LeftSemi" in with_a._jdf.queryExecution().executedPlan().toString()
    both = _with_text(with_a, pairs, 2, texts, "b")
    assert sorted((r.a, r.b) for r in both.where("packed_a <> packed_b").collect()) == [(1, 2), (1, 3)]


def test_signatures_travel_packed(spark):
    rng = random.Random(6)
    texts = [prose(rng, 60) for _ in range(300)]
    texts += [changed(rng, x, 0.02) for x in texts[:50]] + texts[:3]
    docs = spark.createDataFrame([(i << 33, x) for i, x in enumerate(texts)] + [(0, texts[0]), (-5, texts[7])], "doc_id long, text string").repartition(3)
    ship_package(spark)
    signed = _signed(docs, 5).selectExpr("coalesce(sign, route) as sign", "doc_id").distinct().collect()
    owners = {}
    for r in signed:
        owners.setdefault(r.sign, set()).add(r.doc_id)
    got = _shared(docs, 5, 20_000).distinct().collect()
    assert sorted(map(tuple, got)) == sorted((s, d) for s, ids in owners.items() if len(ids) > 1 for d in ids)
    rows, most = _packed(docs, 5, 8).selectExpr("count(*)", "max(bucket)").first()
    assert rows <= 3 * 8 and most == 7
