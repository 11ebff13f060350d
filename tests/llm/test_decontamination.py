import random

import pytest

from sieveline.llm.decontamination import contamination, remove_contamination
from texts import documents, odd_texts, plain_words, prose, shout

ITEMS = "item_id long, text string, extra string"


def case(seed=2):
    rng = random.Random(seed)
    long = [prose(rng, n) for n in (10, 11, 30, 60)]
    items = [(i, t, "x") for i, t in enumerate([*long, long[2], long[3][20:], "short item here", "single", None, "", "ab cd " * 12, prose(rng, 9)])]
    items.append((None, prose(rng, 14), "x"))
    texts = odd_texts()
    for i, text in enumerate([t for _, t, _ in items if t]):
        texts += [f"{prose(rng, 20)} {shout(text)}, {prose(rng, 20)}", f"{prose(rng, 5)}\n{text}", text[:len(text) // 2]]
        texts.append(f"{' '.join(text.split(' ')[3:17])} x {' '.join(text.split(' ')[8:])}")
        if i % 2:
            texts.append(f"{text}; {items[0][1]} - {text}")
    return items, texts


def plain(rows, items, window=10):
    spans = {}
    for item, text, _ in items:
        w = plain_words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            spans.setdefault(tuple(w[i:i + k]), set()).add(item)
    sizes = {len(k) for k in spans}
    out = []
    for r in rows:
        w = plain_words(r.text)
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in spans:
                    hit |= set(range(i, i + k))
                    found |= spans[tuple(w[i:i + k])]
        out.append((r.doc_id, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


@pytest.mark.parametrize("block_words", [10 ** 6, 40])
def test_hits_equal_all_windows(spark, block_words):
    items, texts = case()
    docs = documents(spark, texts)
    found = contamination(docs, spark.createDataFrame(items, ITEMS), block_words=block_words)
    got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in found.collect()]
    want = plain(docs.collect(), items)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(n > 0 for _, _, n, _ in want) > 30


@pytest.mark.parametrize("block_words", [10 ** 6, 40])
def test_removed_text_has_no_windows_left_out_of_place(spark, block_words):
    rng = random.Random(8)
    item = prose(rng, 15)
    before, after = "Before, é it; ", "! After it \n"
    items = spark.createDataFrame([(1, item, "x"), (2, prose(rng, 40), "x"), (3, prose(rng, 40), "x")], ITEMS)
    far = prose(rng, 40)
    docs = documents(spark, [f"{before}{shout(item)}{after}{far}", f"{before}{item}", far, None, ""]).where("doc_id is not null")
    out = remove_contamination(docs, items, block_words=block_words)
    assert out.columns == docs.columns
    left = {r.doc_id: r for r in out.collect()}
    assert left[0].text == f"{before}{after}{far}" and left[0].n_chars == len(left[0].text)
    assert 1 not in left and left[2].text == far and left[3].text is None and left[4].text == ""


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b c", "x")], ITEMS)
    assert contamination(documents(spark, []), items).count() == 0
    assert remove_contamination(documents(spark, []), items).count() == 0
    docs = documents(spark, ["a b c d"])
    assert {r.n_hit for r in contamination(docs, items.limit(0)).collect()} == {0}
    assert remove_contamination(docs, items.limit(0)).count() == docs.count()
