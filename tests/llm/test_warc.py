import base64
import hashlib

import pytest

from sieveline.llm.warc import deduplicated_pages, parse_archive, read_archives, resolve_revisits, write_pages
from sieveline.session import scratch_path

PAGES = "page_id long, url string, html string, payload string, record_type string"
BODIES = ["<p>one</p>", "two\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "é 日本 🙂", "", None, "z" * 100_000, "\r\n\r\n", "tail\n"]


def pages(spark, n=60):
    rows = [(i, None if i % 7 == 0 else f"http://x/{i}\r\n a", BODIES[i % len(BODIES)] if i % 3 else f"own {i}", "p", "q") for i in range(n)]
    rows += [(5, "u", "twice", "p", "q"), (5, "u", "twice", "p", "q"), (None, "u", "twice", "p", "q"), (None, "u", None, "p", "q")] if n else []
    return spark.createDataFrame(rows, PAGES).repartition(3)


def digest(body):
    return base64.b32encode(hashlib.sha1((body or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 5])
def test_records_equal_plain_rule(spark, least):
    table = pages(spark)
    rows = [(r.page_id, r.html or "") for r in table.collect()]
    groups = {}
    for page, body in rows:
        groups.setdefault(body, []).append(page)
    want = []
    for body, ids in groups.items():
        ids = sorted(ids, key=lambda x: -1 if x is None else x)
        for at, page in enumerate(ids):
            last = at == len(ids) - 1 or len(body.encode()) < least
            want.append((page, len(body.encode()), digest(body), "response" if last else "revisit", None if last else ids[-1]))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in deduplicated_pages(table, least).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_archives_round_trip_and_revisits_point_to_records(spark):
    first, second = scratch_path(spark, "a"), scratch_path(spark, "b")
    table = pages(spark)
    write_pages(table, first, archive_bytes=50_000)
    resolve_revisits(spark, first, second, archive_bytes=50_000)
    one, two = read_archives(spark, first).collect(), read_archives(spark, second).collect()
    assert len({r.file for r in one}) > 5
    assert sorted(str((r.page_id, r.payload)) for r in one) == sorted(str((r.page_id, r.html or "")) for r in table.collect())
    assert {r.record_type for r in one} == {"response"} and len({r.record_id for r in one + two}) == len(one) + len(two)
    kept = [r for r in two if r.record_type == "response"]
    assert len({r.payload for r in kept}) == len(kept) and {r.payload for r in kept} == {r.payload for r in one}
    assert all(r.payload == "" and r.payload_bytes == len((r_body := {x.payload_digest: x.payload for x in kept}[r.payload_digest]).encode())
               and r_body is not None for r in two if r.record_type == "revisit")
    assert {r.url for r in one if r.page_id == 1} == {"http://x/1%20%20%20a"} and {r.url for r in one if r.page_id == 7} == {None}


def test_empty_table(spark):
    assert deduplicated_pages(pages(spark, 0)).count() == 0
    assert list(parse_archive(b"")) == []
