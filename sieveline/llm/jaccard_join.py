"""N-gram Jaccard join by PartEnum signatures, and the groups of near-duplicates it gives.

A document is the set of its distinct runs of five words. Two documents link when their sets have a
Jaccard similarity of 0.8 or more. Nothing is sampled or capped:

1. Documents with equal sets are one class, represented by the smallest doc_id.
2. Each class is signed (see ``part_enum``); linked sets share a signature. Within each task, classes
   that share a signature are tied to the first of them, so a signature leaves a task once however
   many classes have it. Signatures travel packed, sorted and byte by byte, to one of many buckets; only those met at least
   twice go on.
3. Of the classes with a signature, the one with most shared signatures is its hub: near copies of one text share more with
   that text than with each other. Each class is compared with the hub that it meets most often. These
   links alone join most groups of near copies.
4. Groups that still share a signature grow in rounds (``near_pairs``): hubs are chosen anew, each class of another group
   is compared with a few of them, and when most hubs are refused the pairs across groups that are not proven unlike are
   compared, a few of each class and other group at a time.

Step 4 makes the result exact: a pair is left out only if it is already connected, or proven to be unlike.

Null and empty texts, and texts without words, have no shingles and link with nothing. Texts of one to
four words are one shingle. Rows with the same doc_id are one document if their texts are equal; if
they differ, each row keeps its own count and takes part under that doc_id. A null doc_id links with
nothing and has a null component. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.session import cut_lineage

from .frames import ship_package, without_ids
from .near_pairs import ODD, Groups, equal_sets, odd_sketches, set_digests, sets_of, sketch_table, spared_copies, text_groups
from .part_enum import signatures
from .text_words import mix

SHINGLE = 5
PERCENT = 80

_SETS = "doc_id long, n_shingles long, set_a long, set_b long, " + ", ".join(f"{x} long" for x in ODD)
#: Bits of a signature that are kept: an equal one of unlike sets costs a comparison, never a link, so the rest need not travel.
SIGN = np.uint64((1 << 48) - 1)
#: Signatures that are packed at a time, and about as many as one bucket of them holds.
PACKED = 1 << 20
#: Buckets are numbered by the upper 16 bits of a route.
MOST_BUCKETS = 1 << 16
_SIGNS = "route long, doc_id long, sign long, met boolean"


def document_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b) and the odd sketch of every document; equal sets have equal set_a and set_b."""
    def run(batches):
        for ids, texts in text_groups(batches):
            keys, first = sets_of(texts, shingle)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.diff(first).astype(np.int64)), *map(pa.array, set_digests(keys, first)), *map(pa.array, odd_sketches(keys, first).T)],
                [x.split()[0] for x in _SETS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SETS)


def _sign(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(route, doc_id, sign, lead, met) of the signatures of a few megabytes of texts at a time, as for ``_signed``."""
    for ids, texts in text_groups(batches):
        ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
        keys, first = sets_of(texts, shingle)
        sign, owner = signatures(keys, first)
        sign = sign & SIGN
        order = np.lexsort((ids[owner], sign))
        sign, doc = sign[order], ids[owner[order]]
        lead = np.ones(len(sign), dtype=bool)
        lead[1:] = sign[1:] != sign[:-1]
        number = np.cumsum(lead) - 1
        keep = lead | (doc != doc[lead][number])
        met = np.bincount(number[keep & ~lead], minlength=lead.sum())[number] > 0
        sign, doc, lead, met = (x[keep] for x in (sign, doc, lead, met))
        yield np.where(lead, sign, mix(sign + mix(doc.astype(np.uint64))) & SIGN), doc, sign, lead, met


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """(route, doc_id, sign, met) of all signatures of ``docs``.

    The first document of a group of texts with a signature is a row with the signature as route; ``met`` tells whether others
    of the group have it. These are rows with the signature as sign, and their route is spread.
    """
    def run(batches):
        for route, doc, sign, lead, met in _sign(batches, shingle):
            yield pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(doc), pa.array(sign.view(np.int64), mask=lead),
                                              pa.array(met)], ["route", "doc_id", "sign", "met"])

    return docs.select("doc_id", "text").mapInArrow(run, _SIGNS)


def _planes(numbers: np.ndarray) -> np.ndarray:
    """The bytes of 64-bit ``numbers``, one row for the lowest of all, one for the next, and so on: what is alike lies together."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T


def _from_planes(rows: pa.ChunkedArray) -> np.ndarray:
    planes = [np.frombuffer(x.as_py(), np.uint8).reshape(8, -1) for x in rows]
    return np.ascontiguousarray(np.concatenate(planes, axis=1).T).view("<u8").ravel()


def _packed(docs: DataFrame, shingle: int, buckets: int) -> DataFrame:
    """(bucket, signs, docs): the rows of ``_signed``, dealt to ``buckets`` by their route, many in one row and sorted by signature.

    The highest byte of a sign is 0 for a first document, 1 for one that others met in its group, 2 for the others.
    """
    def pack(parts):
        route, doc, sign, lead, met = (np.concatenate(x) for x in zip(*parts, strict=True))
        bucket = route * np.uint64(buckets) >> np.uint64(48)
        order = np.lexsort((sign, bucket))
        bucket, kind = bucket[order], np.where(lead, met, 2).astype(np.uint64)
        signs, ids = _planes((sign | kind << np.uint64(56))[order]), _planes(doc[order])
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        spans = list(zip(edges[:-1], edges[1:], strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[edges[:-1]].astype(np.int32)), *(pa.array([x[:, a:b].tobytes() for a, b in spans], pa.binary()) for x in (signs, ids))],
            ["bucket", "signs", "docs"])

    def run(batches):
        parts, held = [], 0
        for part in _sign(batches, shingle):
            if len(part[0]):
                parts.append(part)
                held += len(part[0])
            if held >= PACKED:
                yield pack(parts)
                parts, held = [], 0
        if parts:
            yield pack(parts)

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, signs binary, docs binary")


def _shared_in(bucket: pa.Table) -> pa.Table:
    """The signatures of one bucket that at least two documents have."""
    sign, doc = _from_planes(bucket.column("signs")), _from_planes(bucket.column("docs")).view(np.int64)
    kind, sign = sign >> np.uint64(56), sign & SIGN
    lead = kind < 2
    order = np.argsort(sign[lead], kind="stable")
    first, doc_of, met = sign[lead][order], doc[lead][order], kind[lead][order] == 1
    begin = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])[:len(first)])
    if len(begin):
        several = np.minimum.reduceat(doc_of, begin) < np.maximum.reduceat(doc_of, begin)
        met |= np.repeat(several, np.diff(np.append(begin, len(first))))
    return pa.table({"sign": np.concatenate([first[met], sign[~lead]]).view(np.int64), "doc_id": np.concatenate([doc_of[met], doc[~lead]])})


def _shared(docs: DataFrame, shingle: int, elements: int) -> DataFrame:
    """(sign, doc_id): signatures that at least two of ``docs`` have, whose sets hold ``elements`` shingles in all.

    A set has about as many signatures as shingles, so a bucket holds about ``PACKED`` at most; of a hot one only first documents meet there.
    """
    buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), elements // PACKED + 1)
    return _packed(docs, shingle, min(buckets, MOST_BUCKETS)).groupBy("bucket").applyInArrow(_shared_in, "sign long, doc_id long")


def near_duplicate_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    if percent < PERCENT:
        raise ValueError("signatures are made for similarities of 80 percent and more")
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = cut_lineage(document_sets(docs, shingle), "sets")
    real = sets.where("n_shingles > 0 and doc_id is not null")
    copies = equal_sets(real)
    spared = spared_copies(real, copies)
    single = without_ids(docs.where("doc_id is not null"), spared, spared.count())
    elements = real.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    shared = cut_lineage(_shared(single, shingle, elements), "shared")

    often = cut_lineage(shared.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "often")
    first = Window.partitionBy("sign").orderBy(F.desc("n"), "doc_id")
    ties = (shared.join(often, "doc_id").select("doc_id", F.first("doc_id").over(first).alias("hub")).where("doc_id <> hub")
            .groupBy("doc_id", "hub").count().groupBy("doc_id").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("hub")))

    labels = cut_lineage(often.select("doc_id", F.col("doc_id").alias("label")), "labels")
    groups = Groups(docs, sketch_table(real, labels), labels, shingle, percent)
    groups.compare(ties.toDF("a", "b"))
    rows = shared.select(F.col("sign").alias("key"), "doc_id", F.lit(0).alias("depth"))
    groups.by_pairs(groups.by_hubs(rows))
    return groups.component_of(sets, copies)


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs`` without the near-duplicates of an earlier document; all columns stay as they are."""
    groups = near_duplicate_groups(docs)
    gone = cut_lineage(groups.where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return without_ids(docs, gone, gone.count())
