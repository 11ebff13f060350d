import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm.byte_bpe import Counter, Encoder, load, pieces
from sieveline.llm.packing import best_fit_decreasing, pack, pack_documents, sequences, token_pieces
from sieveline.llm.token_counts import token_counts
from texts import documents, odd_texts

NAME = "byte_bpe_50k.json"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab Zé'1٣, \n\t\x1c\x85  　'sll🙂字ǅ́"), st.characters(codec="utf-8")), max_size=60))
def test_pieces_give_the_tokenizers_ids(text):
    want = load(NAME)[0].encode(text, add_special_tokens=False).ids
    assert " ".join(pieces(text)) == text
    assert np.frombuffer(Encoder(NAME)(text), "<u4").tolist() == want
    assert Counter(NAME, {" a": 1})(text) == len(want)


def test_counts_equal_the_library(spark):
    docs = documents(spark)
    tokenizer = load(NAME)[0]
    want = []
    for r in docs.collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 512))
    got = [tuple(r) for r in token_counts(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def plain_best_fit(lengths, most):
    """Sequences used when each piece goes to the tightest room in a sorted list."""
    rooms, used = [], 0
    for need in sorted(lengths, reverse=True):
        at = bisect_left(rooms, need)
        if at == len(rooms):
            used += 1
            room = most
        else:
            room = rooms.pop(at)
        if room > need:
            insort(rooms, room - need)
    return used


@pytest.mark.parametrize("most", [1, 7, 64, 100, 1024])
def test_best_fit_is_gapless_and_as_tight_as_the_plain_rule(most):
    rng = random.Random(most)
    lengths = np.array([rng.choice([most, rng.randint(1, most), rng.randint(1, max(1, most // 9))]) for _ in range(800)])
    sequence, offset = best_fit_decreasing(lengths, most)
    for number in set(sequence.tolist()):
        inside = sequence == number
        order = np.argsort(offset[inside])
        ends = np.cumsum(lengths[inside][order])
        assert offset[inside][order].tolist() == [0, *ends[:-1].tolist()] and ends[-1] <= most
    assert len(set(sequence.tolist())) == plain_best_fit(lengths.tolist(), most)


def test_packed_pieces_hold_every_token(spark):
    docs = documents(spark)
    encode = Encoder(NAME)
    rows = pack_documents(docs, length=256).collect()
    want = []
    for r in docs.collect():
        ids = np.frombuffer(encode(r.text or ""), "<u4").tolist() + [2]
        first = len(ids) % 256 or 256 if len(ids) > 256 else len(ids)
        cuts = [0, *range(first, len(ids) + 1, 256)]
        want += [(r.doc_id, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(str(tuple(r)[:5]) for r in rows) == sorted(map(str, want))
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (s, o, n), (t, p, _) in zip(places, places[1:]):
        assert p == (o + n if s == t else 0)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 256) + 1


def test_shards_are_even_whatever_the_ids(spark):
    pieces = spark.range(6000, numPartitions=5).selectExpr(
        "if(id % 3 = 0, id, null) doc_id", "0 piece", "0L start", "1 + id % 7 length", "0L ids_crc32")
    sizes = [r["count"] for r in pack(pieces, 64, 1000).selectExpr("sequence_id >> 40 shard").groupBy("shard").count().collect()]
    assert sum(sizes) == 6000 and len(sizes) == 6 and max(sizes) < 1200


def test_sequences_are_the_ids_in_place(spark):
    docs = documents(spark, ["a b c", "d e f g", None, "é" * 50]).where("doc_id is not null").dropDuplicates(["doc_id"])
    whole = token_pieces(docs, length=16, with_ids=True)
    placed = pack_documents(docs, length=16)
    ids = {(r.doc_id, r.piece): r.ids for r in whole.collect()}
    got = {r.sequence_id: r.ids for r in sequences(whole, placed).collect()}
    for r in placed.collect():
        assert got[r.sequence_id][r.offset:r.offset + r.length] == ids[r.doc_id, r.piece]
    assert sum(map(len, got.values())) == sum(map(len, ids.values()))


def test_empty_table(spark):
    assert token_counts(documents(spark, [])).count() == 0
    assert pack_documents(documents(spark, [])).count() == 0


def test_fixture_has_special_strings():
    assert any("<|endoftext|>" in (t or "") for t in odd_texts())
