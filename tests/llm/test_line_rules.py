from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sieveline.llm.line_frequency import line_verdicts, remove_frequent_lines
from sieveline.llm.unit_dedup import remove_repeated_units, repeated_passages, repeated_units
from texts import PLAIN_WORD, UPPER, documents, odd_texts, plain_words, prose, shout, words


def plain_figures(text):
    w = words(text, lower=False)
    windows = Counter(zip(w, w[1:], w[2:]))
    repeated = {i + s for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for s in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated))


def normalised(line):
    return " ".join(words(line)).translate(str.maketrans("123456789", "000000000"))


def frequent(rows, least, share):
    documents_of, hosts = defaultdict(set), defaultdict(set)
    for r in rows:
        hosts[r.source].add(r.doc_id)
        for line in (r.text or "").split("\n"):
            if words(line):
                documents_of[r.source, normalised(line)].add(r.doc_id)
    return {k for k, v in documents_of.items() if len(v) > least and len(v) > share * len(hosts[k[0]])}


def test_figures_and_verdicts_equal_plain_rules(spark):
    docs = documents(spark)
    rows = docs.collect()
    often = frequent(rows, 1, 0.01)
    assert often
    want = []
    for r in rows:
        f = plain_figures(r.text)
        lost = sum(len(words(x)) for x in (r.text or "").split("\n") if (r.source, normalised(x)) in often)
        failed = f[0] < 50 or 100 * f[4] > 50 * f[0]
        want.append((r.doc_id, *f, failed, not failed and lost <= 0.5 * f[0], lost, lost > 0.5 * f[0]))
    got = [tuple(r) for r in line_verdicts(docs, min_documents=1).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_frequent_lines_go_and_depleted_documents_too(spark):
    shared, common = "this very line is everywhere", "7 same LINES in all"
    docs = documents(spark, [f"{shared}\nown words of number w{'abcdefgh'[i]} and some more of them to keep\n{common.replace('7', str(i))}" for i in range(8)]
                     + [shared, None, ""])
    left = {r.doc_id: r for r in remove_frequent_lines(docs.where("doc_id is not null").withColumn("source", F.col("lang")), min_documents=2).collect()}
    assert left[3].text == "own words of number wd and some more of them to keep" and left[3].n_chars == len(left[3].text)
    assert 8 not in left and left[9].text is None and left[10].text == ""


def plain_units(rows, min_words):
    seen, out = {}, set()
    unique = {(r.doc_id, r.text): r for r in rows}
    for doc_id, text in sorted(unique, key=lambda k: (k[0] is None, k[0] or 0)):
        at = 0
        for unit, line in enumerate((text or "").split("\n")):
            w = plain_words(line)
            if len(w) >= min_words:
                key = " ".join(w)
                if key in seen:
                    out.add((doc_id, unit, at, at + len(line), *seen[key]))
                else:
                    seen[key] = (doc_id, unit, at)
            at += len(line) + 1
    return out


def test_repeated_units_equal_plain_rule(spark):
    docs = documents(spark).where("doc_id is not null or text is not null")
    got = {tuple(r) for r in repeated_units(docs).drop("text_key").collect()}
    assert got == plain_units(docs.collect(), 10) and len(got) > 20


def test_removal_keeps_other_lines_columns_and_offsets(spark):
    import random
    long = prose(random.Random(5), 60)
    docs = documents(spark, [f"head one\n{long}\ntail", f"head two\n{shout(long)}!\n\nend", long, "head one", None, ""]).where("doc_id is not null")
    out = remove_repeated_units(docs, offsets=True)
    assert out.columns == [*docs.columns, "kept_starts", "kept_ends"]
    left = {r.doc_id: r for r in out.collect()}
    assert left[0].text == f"head one\n{long}\ntail" and left[0].kept_starts is None
    assert left[1].text == "head two\n\nend" and left[1].n_chars == 13
    whole = f"head two\n{shout(long)}!\n\nend"
    assert [whole[a:b] for a, b in zip(left[1].kept_starts, left[1].kept_ends)] == ["head two", "", "end"]
    assert 2 not in left and left[3].text == "head one" and left[4].text is None and left[5].text == ""


def test_paragraphs(spark):
    p = " ".join(f"w{i}" for i in range(12))
    docs = documents(spark, [f"{p}\n{p}\n\nx", f"a\n \n{p}\n{p}", p]).where("doc_id is not null")
    got = [(r.doc_id, r.unit, r.start, r.end, r.kept_doc_id) for r in repeated_units(docs, unit="paragraph").collect()]
    assert got == [(1, 1, 4, 4 + 2 * len(p) + 1, 0)]


def plain_passages(rows, size):
    """Places (in words) to remove from each text, by comparing all runs."""
    seen, gone = {}, defaultdict(set)
    for doc_id, text in sorted({(r.doc_id, r.text) for r in rows if r.text}, key=lambda k: (k[0] is None, k[0] or 0)):
        w = plain_words(text)
        for i in range(len(w) - size + 1):
            first = seen.setdefault(tuple(w[i:i + size]), (doc_id, i))
            if first != (doc_id, i):
                gone[doc_id] |= set(range(max(i, first[1] + size) if first[0] == doc_id else i, i + size))
    return gone


def test_passages_of_any_place_equal_plain_rule(spark):
    import random
    rng = random.Random(8)
    p, q = prose(rng, 50), prose(rng, 70)
    texts = [f"{prose(rng, 20)} {p} {prose(rng, 20)}", f"{prose(rng, 9)}; {shout(p)}, {prose(rng, 7)}\n{q}, {prose(rng, 3)}", p.replace(" ", "\n"),
             f"x {q.replace(' ', chr(10), 40)} y", " ".join(["a b c"] * 60), f"{p.rsplit(' ', 1)[0]} but not the last word", f"{q} {q} end", f"{p} é {p}"]
    docs = documents(spark, texts).where("doc_id is not null")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    for rows, size in ((keyed, 50), (keyed, 7), (documents(spark).where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_key"), "text"), 50)):
        whole = {r.doc_id: r.text for r in rows.collect()}
        got = defaultdict(set)
        for r in repeated_passages(rows, size).collect():
            at = len(plain_words(whole[r.doc_id][:r.start]))
            got[r.doc_id] |= set(range(at, at + len(plain_words(whole[r.doc_id][r.start:r.end]))))
        assert got == plain_passages(rows.collect(), size) and len(got) > 4
    before = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: r for r in remove_repeated_units(docs, offsets=True).collect()}
    assert out[0].text == before[0] and out[5].text == before[5] and 2 not in out
    assert plain_words(out[1].text) == plain_words(before[1].replace(shout(p), "")) and out[3].text == "x y"
    assert plain_words(out[6].text) == ["end"] and plain_words(out[4].text) == (["a", "b", "c"] * 60)[:50] and out[7].text == "é "
    for r in out.values():
        if r.kept_starts is not None:
            assert plain_words(" ".join(before[r.doc_id][a:b] for a, b in zip(r.kept_starts, r.kept_ends))) == plain_words(r.text)


def test_null_ids_and_repeated_rows_lose_units_and_passages(spark):
    import random
    rng = random.Random(9)
    p, line = prose(rng, 52), prose(rng, 15)
    rows = [(3, f"{prose(rng, 5)} {p}"), (3, None), (None, f"x {p} y"), (None, f"x {p} y"), (None, line), (7, f"{line}\nz"), (7, f"{line}\nz"),
            (None, f"{line}\nz"), (9, f"a {p} b"), (9, f"a {p} b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in remove_repeated_units(docs).collect()), key=str)
    want = [rows[0], (3, None), (None, "x y"), (None, "x y"), (7, f"{line}\nz"), (7, f"{line}\nz"), (None, "z"), (9, "a b"), (9, "a b")]
    assert got == sorted(want, key=str)


def test_hot_units_are_met_in_slices(spark, monkeypatch):
    import random
    from sieveline.llm import unit_dedup
    rng = random.Random(10)
    line, p = prose(rng, 12), prose(rng, 55)
    texts = [f"{line}\n{prose(rng, 4)} {i} {p} {i} {prose(rng, 4)}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    whole = sorted(map(tuple, remove_repeated_units(docs, offsets=True).collect()), key=str)
    monkeypatch.setattr(unit_dedup, "SLICE_ROWS", 7)
    monkeypatch.setattr(unit_dedup, "BROADCAST_NUMBERS", 0)
    assert sorted(map(tuple, remove_repeated_units(docs, offsets=True).collect()), key=str) == whole
    assert sum(p in r[1] for r in whole) == 1 and sum(line in r[1] for r in whole) == 1 and len(whole) == 60


@pytest.mark.parametrize("operator", [line_verdicts, remove_frequent_lines, repeated_units, remove_repeated_units])
def test_empty_table(spark, operator):
    assert operator(documents(spark, [])).count() == 0


def test_fixture_has_upper_case_words():
    assert PLAIN_WORD.findall("A".translate(UPPER)) == ["a"] and None in odd_texts()
