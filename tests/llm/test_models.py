import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import byte_network, factorization
from sieveline.llm.license_scan import NAMES, TEMPLATES, patience, scan_licenses, words_of
from sieveline.llm.license_texts import TEXTS
from sieveline.llm.quality import of_quality, score_quality
from sieveline.llm.toxicity import score_toxicity, without_toxic
from texts import documents, odd_texts, prose

SF = "/root/testdata/sf0.1" if os.path.exists("/root/testdata/sf0.1") else "/root/testdata/sf0.01"


def tables(spark):
    return [spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels")]


@pytest.mark.parametrize(("score", "label", "fold", "limit", "accuracy"),
                         [(score_toxicity, "toxic", (3, 1), 0.7, 0.97), (score_quality, "quality", (5, 0), 0.3, 0.97)])
def test_held_out_accuracy(spark, score, label, fold, limit, accuracy):
    docs, labels = tables(spark)
    rows = score(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= limit) for r in rows)
    out = [r for r in rows if r.held_out]
    good = np.mean([r.predicted == r[label] for r in out])
    base = max(np.mean([r[label] for r in out]), 1 - np.mean([r[label] for r in out]))
    assert good >= accuracy > base


def test_held_out_labels_change_nothing(spark):
    docs = documents(spark, [f"good text {i} here" if i % 2 else f"bad idiot {i} there" for i in range(60)]).where("doc_id is not null")
    label = [(i, (i + 1) % 2) for i in range(60)]
    turned = [(i, 1 - x if zlib.crc32(str(i).encode()) % 3 == 1 else x) for i, x in label]
    one, two = (sorted(map(tuple, score_toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (label, turned))
    assert one == two


@pytest.mark.parametrize(("score", "keep", "label"), [(score_toxicity, without_toxic, "toxic"), (score_quality, of_quality, "quality")])
def test_odd_rows_and_empty_tables(spark, score, keep, label):
    docs = documents(spark)
    marks = [(i, i % 2, "x") for i in range(len(odd_texts()))] + [(1, None, "x"), (None, 1, "x"), (3, 1, "x"), (3, 0, "x"), (10 ** 9, 1, "x")]
    labels = spark.createDataFrame(marks, f"doc_id long, {label} int, text string")
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1)}) == 1
    assert keep(docs, labels).columns == docs.columns
    assert score(docs.limit(0), labels).count() == 0
    assert len({r.score for r in score(docs, labels.limit(0)).where("doc_id < 2").collect()}) == 1


def test_pair_terms_are_learned():
    rng = np.random.default_rng(1)
    texts, label = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        texts.append(f"{'insult' if a else ''} {'group' if b else ''} w{rng.integers(50)}")
        label.append(float(a and b))
    first, bucket, value = factorization.hashed_terms(pa.array(texts))
    model = factorization.fit(first, bucket, value, np.array(label, np.float32), rounds=20)
    both, one, other = model.logits(*factorization.hashed_terms(pa.array(["insult group", "insult", "group"])))
    assert both > 1 and one < -1 and other < -1 and both > one + other - model.bias


def test_pairs_of_terms_that_tell_nothing_alone_are_learned():
    rng = np.random.default_rng(2)
    texts, label = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        texts.append(" ".join([*["insult"] * int(a), *["group"] * int(b), *(f"w{x}" for x in rng.integers(300, size=12))]))
        label.append(float(a == b))
    first, bucket, value = factorization.hashed_terms(pa.array(texts))
    label = np.array(label, np.float32)
    half = 2000
    cut = first[half]
    model = factorization.fit(first[:half + 1], bucket[:cut], value[:cut], label[:half], rounds=30)
    right = (model.logits(first[half:] - cut, bucket[cut:], value[cut:]) > 0) == (label[half:] > 0)
    alone = factorization.telling(first[:half + 1], bucket[:cut], label[:half])
    two = factorization.hashed_terms(pa.array(["insult group"]))[1]
    assert not alone[two].any() and factorization.telling_pairs(first[:half + 1], bucket[:cut], label[:half])[two].all()
    assert right.mean() > 0.95


def test_pair_sums_and_pair_counts_equal_the_plain_ones():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"t{x}" for x in rng.integers(40, size=rng.integers(0, 15))) for _ in range(400)]
    first, bucket, value = factorization.hashed_terms(pa.array(texts))
    label = (rng.random(400) < 0.4).astype(np.float32)
    size = 1 << factorization.BITS
    model = factorization.FactorizationMachine(0.3, rng.normal(size=size), rng.normal(size=(size, 4)))
    for i, got in enumerate(model.logits(first, bucket, value)):
        b, x = bucket[first[i]:first[i + 1]], value[first[i]:first[i + 1]]
        want = 0.3 + sum(model.weight[t] * v for t, v in zip(b, x))
        want += sum(model.factor[b[p]] @ model.factor[b[q]] * x[p] * x[q] for q in range(len(b)) for p in range(q))
        assert abs(got - want) < 1e-4 * max(1, abs(want))
    sets = [set(bucket[first[i]:first[i + 1]].tolist()) for i in range(400)]
    want = set()
    spread = label.mean() * (1 - label.mean())
    for p in sorted(set(bucket.tolist())):
        for q in sorted(set(bucket.tolist())):
            cells = [[label[i] for i in range(400) if (p in sets[i], q in sets[i]) == k] for k in ((True, True), (True, False), (False, True), (False, False))]
            if min(map(len, cells)) >= 5:
                beyond = np.mean(cells[0]) - np.mean(cells[1]) - np.mean(cells[2]) + np.mean(cells[3])
                if abs(beyond) > 2.0 * np.sqrt(spread * sum(1 / len(c) for c in cells)):
                    want |= {p, q}
    got = factorization.telling_pairs(first, bucket, label, least=2.0, texts=5, block=7)
    assert set(np.flatnonzero(got).tolist()) == want


def test_chunks_cover_every_byte():
    sizes = [0, 1, 511, 512, 513, 896, 897, 5000]
    offsets = np.cumsum([0, *sizes])
    first, start = byte_network.chunks(np.zeros(offsets[-1], np.uint8), offsets)
    for i, size in enumerate(sizes):
        seen = set()
        for s in start[first[i]:first[i + 1]] - offsets[i]:
            seen |= set(range(s, min(s + byte_network.CHUNK, size)))
        assert seen == set(range(size))


def test_scores_do_not_depend_on_the_batch():
    texts = pa.array(odd_texts())
    net = byte_network.fit(pa.array(["good text"] * 20 + ["B@D!!"] * 20), np.array([1.0] * 20 + [0.0] * 20, np.float32), rounds=20)
    assert np.allclose(net.scores(texts), [net.scores(texts.slice(i, 1))[0] for i in range(len(texts))], atol=1e-6)
    assert net.scores(pa.array(["good text"]))[0] > 0.7 > 0.3 > net.scores(pa.array(["B@D!!"]))[0]


def test_patience_places_rise_and_match():
    import random
    rng = random.Random(9)
    for _ in range(300):
        text, template = ([rng.choice("abcdefgh").encode() for _ in range(rng.randint(0, 14))] for _ in range(2))
        found = patience(text, template)
        assert all(text[a] == template[b] for a, b in found)
        assert all(p < q and r < s for (p, r), (q, s) in zip(found, found[1:]))
    assert len(patience(b"x the work is licensed under this y".split(), b"the work is licensed under this".split())) == 6


def test_licenses_are_found_wherever_they_stand(spark):
    import random
    rng = random.Random(4)
    gpl, mit = TEMPLATES["GPL-3.0"], TEMPLATES["MIT"]
    texts = [gpl, f"{prose(rng, 300)}\n{gpl.upper()}\n{prose(rng, 300)}", f"{gpl} {prose(rng, 30)} {gpl}", f"{mit} and {gpl}",
             mit.replace("hereby", "now"), " ".join(sorted(gpl.split())), f"licensed work under the license, version {prose(rng, 40)} {gpl} the under this",
             prose(rng, 500), None, "", "All Rights, reserved"]
    got = {(r.doc_id, r.license): r for r in scan_licenses(documents(spark, texts).where("doc_id is not null")).distinct().collect()}
    assert sorted(got) == sorted([(i, "GPL-3.0") for i in (0, 1, 2, 3, 6)] + [(3, "MIT"), (4, "MIT"), (10, "all-rights-reserved")])
    assert got[1, "GPL-3.0"].start_word == 300 and got[1, "GPL-3.0"].end_word == 300 + len(words_of(gpl))
    assert 0.8 < got[4, "MIT"].coverage < 1 == got[6, "GPL-3.0"].coverage
    assert scan_licenses(documents(spark, [])).count() == 0


def test_every_kind_of_license_template_is_found(spark):
    import random
    rng = random.Random(6)
    short = [(k, "notice", f"{prose(rng, 40)}\nReleased under the {v}.\n{prose(rng, 40)}") for k, names in NAMES.items() for v in names]
    whole = [(k, "text", f"{prose(rng, 40)}\n{v}\n{prose(rng, 40)}") for k, v in TEXTS.items()]
    half = [(k, "text", " ".join(v.split()[len(v.split()) // 8:])) for k, v in TEXTS.items() if k != "BSD-2-Clause"]
    cases = [*short, *whole, *half, (None, None, "Released under the Foo License."), (None, None, "GNU Lesser General Public License v3 mit license")]
    docs = documents(spark, [x[2] for x in cases]).where("doc_id is not null")
    got = {}
    for r in scan_licenses(docs).distinct().collect():
        got.setdefault(r.doc_id, []).append((r.license, r.template))
    for i, (license, kind, _) in enumerate(cases):
        assert (license, kind) in got.get(i, []) if license else i not in got, (cases[i][:2], got.get(i))
        assert {x for x, _ in got.get(i, [])} <= {license}, (cases[i][:2], got.get(i))
