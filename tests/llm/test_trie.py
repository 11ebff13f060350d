import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from sieveline.llm.list_ranking import rank_list
from sieveline.llm.prefix_trie import prefix_trie
from sieveline.llm.sorted_rows import with_next

SCHEMA = "conv_id long, turn long, role string, text string, next string, depth int, a string, words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_trie(rows):
    """The same trie with dictionaries, one conversation after the other."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    members, words = defaultdict(list), {(): 0}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        whole = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
            if d:
                words[tuple(whole[:d])] = len(WORD.findall(whole[d - 1][1]))
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = {}
    for path in sorted(members, key=len, reverse=True):
        below = [out[x] for x in children[path]]
        convs = [c for c, _ in members[path]]
        ends = ",".join(str(c) for c in sorted(c for c, end in members[path] if end))
        out[path] = (min(convs), len(path), min(c for c, _ in members[path[:-1]]) if path else None, len(convs), len(below),
                     sum(x[5] for x in below) if below else 1, (len(convs) - 1) * words[path] + sum(x[6] for x in below),
                     hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def conversations(seed, n=130):
    rng = random.Random(seed)
    turns = [("user", "hello there"), ("user", "hello  there\n"), ("assistant", "how are you today"), ("", ""), (None, None), ("user", None),
             ("use", "rhello there"), ("assistant", "é ü 日本 語"), ("user", "one two three four five six")]
    rows = []
    for c in [*range(-45, n), None]:
        if rng.random() < 0.1:
            continue
        known = list(range(rng.choice((1, 1, 2, 3, 5, 8))))
        for t in known:
            rows.append((c, None if rng.random() < 0.05 else t, *(turns[t % 3] if rng.random() < 0.6 else rng.choice(turns))))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rows += [(60, 100 + t, "user", f"long tail {t}") for t in range(900)]
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, "x", "w") for r in rows], SCHEMA).repartition(3)


def answer(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                               "ends_sha256").collect()), key=str)


@pytest.mark.parametrize("seed, at_once", [(1, 200_000), (2, 300)])
def test_equals_plain_trie(spark, seed, at_once):
    rows = conversations(seed)
    assert answer(prefix_trie(table(spark, rows), at_once)) == plain_trie(rows)


def test_one_conversation_and_equal_ones(spark):
    rows = [(c, t, "user", f"turn {t} of words") for c in range(20, 3020, 20) for t in range(4)]
    assert answer(prefix_trie(table(spark, rows), 100)) == plain_trie(rows)
    assert answer(prefix_trie(table(spark, [(7, None, None, None)]))) == plain_trie([(7, None, None, None)])


def test_conversation_without_turns(spark):
    rows = [(c, 0, "user", "only") for c in range(1, 19)]
    got = answer(prefix_trie(table(spark, rows)))
    assert got == plain_trie(rows) and any(r[1] == 0 for r in got)


def test_empty_table(spark):
    assert prefix_trie(table(spark, [])).count() == 0
    assert prefix_trie(table(spark, [(None, 1, "user", "x")])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_list_ranking_of_a_shuffled_list(spark, seed):
    rng = random.Random(seed)
    names = [(rng.choice((-5, 3, 10**12)) + i // 7, i % 7) for i in range(3000)]
    names = sorted(set(names))
    rng.shuffle(names)
    rows = [(*x, *(names[i + 1] if i + 1 < len(names) else (None, None)), 1, x[1] - 3) for i, x in enumerate(names)]
    want, place, total = {}, 0, 0
    for x in names:
        want[x] = (place, total)
        place, total = place + 1, total + x[1] - 3
    rng.shuffle(rows)
    got = rank_list(spark.createDataFrame(rows, "a long, b long, c long, d long, one long, w long"), ["one", "w"], 200).collect()
    assert {(r.a, r.b): (r.before_one, r.before_w) for r in got} == want and len(got) == len(want)


def test_next_rows_cross_slices(spark):
    rows = [(i % 3, i) for i in range(50)]
    got = with_next(spark.createDataFrame(rows, "k int, v int").repartition(5), ["k", "v"], ["k", "v"]).collect()
    order = sorted(rows)
    assert {(r.k, r.v): None if r.next is None else tuple(r.next) for r in got} == dict(zip(order, [*order[1:], None]))
