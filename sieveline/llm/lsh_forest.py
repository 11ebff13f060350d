"""Near-duplicates by an LSH forest: several sorted orders of MinHash signatures.

A document is the set of its distinct runs of three words; two link when their sets have a Jaccard similarity of 0.85 or more.

1. Documents with equal sets are one class, represented by the smallest doc_id.
2. Every class has ``TREES`` signatures of ``DEPTH`` minima each. A tree is the sorted order of one of them over all classes,
   dealt into ranges, so that equal signatures spread over several tasks.
3. Neighbours in an order that share a prefix of at least ``SHALLOWEST`` minima are candidates. Each class is
   compared with its best neighbour: the one it is next to in most trees, then with the longest common prefixes.
4. Regions (a tree and a prefix) that still hold several groups go on, each at its own depth: a class looks for another group in its
   deepest region that has one, then further up to the shallowest. Groups grow in rounds, without listing the pairs of a region, until
   none of the shallowest regions can hold another link (``near_pairs``).

Every link is confirmed on the full sets. Two sets of similarity s share a shallowest region with a chance of
1 - (1 - s**SHALLOWEST)**TREES: at 0.85 one pair in some 8,000,000,000 is missed, above it fewer. Nothing else is left out.

Null and empty texts, and texts without words, have no shingles and link with nothing. Texts of one or two
words are one shingle. Rows with the same doc_id are one document if their texts are equal; if they differ, each row
keeps its own count and takes part under that doc_id. A null doc_id links with nothing, has a null component and is kept.
Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.session import cut_lineage

from .frames import ship_package, without_ids
from .near_pairs import ODD, Groups, equal_sets, odd_sketches, set_digests, sets_of, sketch_table, spared_copies, text_groups
from .text_words import mix

SHINGLE = 3
PERCENT = 85
TREES = 24
DEPTH = 6
#: Minima of the shortest prefix that makes two classes candidates.
SHALLOWEST = 3

_SETS = "doc_id long, n_shingles long, set_a long, set_b long, " + ", ".join(f"{x} long" for x in ODD) + ", minima binary"
_NEAR = "tree int, a long, sig_a binary, b long, sig_b binary, common int, slice int, place int"
_VALUE = 4


def minima(keys: np.ndarray, first: np.ndarray, many: int) -> np.ndarray:
    """``many`` minima of each set that has elements (one row a set), each the least of a hash of all its elements."""
    salts = mix(np.arange(1, 2 * many + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(many, 2)
    filled = np.flatnonzero(np.diff(first))
    out = np.empty((len(filled), many), dtype=">u4")
    if len(filled):
        start = first[filled]
        for number, (change, factor) in enumerate(salts):
            hashed = (keys ^ change) * (factor | np.uint64(1))
            out[:, number] = np.minimum.reduceat(hashed, start) >> np.uint64(32)
    return out


def signed_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b), odd sketch and minima (null without shingles) of every document."""
    names = [x.split()[0] for x in _SETS.split(", ")]

    def run(batches):
        for ids, texts in text_groups(batches):
            keys, first = sets_of(texts, shingle)
            size = np.diff(first).astype(np.int64)
            rows = np.full(len(ids), None, dtype=object)
            rows[size > 0] = [x.tobytes() for x in minima(keys, first, TREES * DEPTH)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(size), *map(pa.array, set_digests(keys, first)),
                                              *map(pa.array, odd_sketches(keys, first).T), pa.array(rows, pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(run, _SETS)


def _sorted_neighbours(trees: DataFrame) -> DataFrame:
    """Neighbours of each order with the length of their common prefix, where that is long enough; see ``_NEAR``.

    ``trees`` has tree, sig and doc_id. Rows with a place are the first (0) and last (1) of a range, on their own, as side a.
    """
    n = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [x.split()[0] for x in _NEAR.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]

    def rows(*columns):
        return pa.RecordBatch.from_arrays([pa.array(x, t) if not isinstance(x, pa.Array) else x for x, t in zip(columns, kinds, strict=True)], names)

    def run(batches):
        number, last = TaskContext.get().partitionId(), None
        for batch in batches:
            if not len(batch):
                continue
            tree, sig, doc = (batch.column(x) for x in ("tree", "sig", "doc_id"))
            if last is None:
                yield rows(tree[:1], doc[:1], sig[:1], [None], [None], [0], [number], [0])
            else:
                tree, sig, doc = (pa.concat_arrays([x, y]) for x, y in zip(last, (tree, sig, doc), strict=True))
            last = tuple(x.slice(len(doc) - 1) for x in (tree, sig, doc))
            if len(doc) < 2:
                continue
            values = np.frombuffer(b"".join(sig.to_pylist()), dtype=np.uint8).reshape(len(doc), DEPTH, _VALUE)
            order = tree.to_numpy()
            same = (values[1:] == values[:-1]).all(axis=2) & (order[1:] == order[:-1])[:, None]
            common = np.cumprod(same, axis=1).sum(axis=1)
            at = np.flatnonzero(common >= SHALLOWEST)
            here, after = pa.array(at), pa.array(at + 1)
            none = [None] * len(at)
            yield rows(tree.take(here), doc.take(here), sig.take(here), doc.take(after), sig.take(after), common[at].astype(np.int32), none, none)
        if last is not None:
            tree, sig, doc = last
            yield rows(tree, doc, sig, [None], [None], [0], [number], [1])

    ordered = trees.repartitionByRange(n, "tree", "sig", "doc_id").sortWithinPartitions("tree", "sig", "doc_id")
    found = cut_lineage(ordered.mapInArrow(run, _NEAR), "neighbours")
    # the last row of each range and the first of the next: two rows a range
    ends = found.where("place is not null").select("tree", "a", "sig_a", "slice", "place")
    row, inner = Window.orderBy("slice", "place"), "tree = next_tree and place = 1 and next_place = 0"
    across = (ends.select("tree", "a", "sig_a", "place", *[F.lead(x).over(row).alias(f"next_{x}") for x in ("tree", "a", "sig_a", "place")])
              .where(inner).select("tree", "a", "sig_a", F.col("next_a").alias("b"), F.col("next_sig_a").alias("sig_b")))
    across = across.withColumn("common", sum(
        (F.when(F.substring("sig_a", 1, d * _VALUE) == F.substring("sig_b", 1, d * _VALUE), 1).otherwise(0) for d in range(1, DEPTH + 1)), F.lit(0)))
    columns = ["tree", "a", "sig_a", "b", "sig_b", "common"]
    return cut_lineage(found.where("place is null").select(*columns).unionByName(across.where(F.col("common") >= SHALLOWEST).select(*columns)), "near")


def _best_neighbours(near: DataFrame) -> DataFrame:
    """(a, b): the neighbour of each class that is next to it in most trees, then with the longest common prefixes."""
    pairs = near.where("a <> b").select("a", "b", "common").unionByName(near.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "common"))
    met = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("trees"), F.sum("common").alias("common"))
    best = met.groupBy("a").agg(F.min_by("b", F.struct(-F.col("trees"), -F.col("common"), "b")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def forest_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    if percent < PERCENT:
        raise ValueError("the forest is made for similarities of 85 percent and more")
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = cut_lineage(signed_sets(docs, shingle), "sets")
    real = sets.where("n_shingles > 0 and doc_id is not null")
    copies = equal_sets(real)
    spared = spared_copies(real, copies)
    single = without_ids(real.select("doc_id", "minima"), spared, spared.count())
    start = F.col("tree") * DEPTH * _VALUE + 1
    trees = (single.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
             .select("tree", F.substring("minima", start, F.lit(DEPTH * _VALUE)).alias("sig"), "doc_id"))
    near = _sorted_neighbours(trees)
    inside = near.select("tree", F.col("a").alias("doc_id"), F.col("sig_a").alias("sig")).unionByName(
        near.select("tree", F.col("b").alias("doc_id"), F.col("sig_b").alias("sig"))).distinct()
    regions = cut_lineage(inside.withColumn("depth", F.explode(F.sequence(F.lit(SHALLOWEST), F.lit(DEPTH)))).select(
        F.xxhash64("tree", "depth", F.substring("sig", F.lit(1), F.col("depth") * _VALUE)).alias("key"), "doc_id", "depth"), "regions")
    labels = cut_lineage(regions.select("doc_id").distinct().select("doc_id", F.col("doc_id").alias("label")), "labels")
    groups = Groups(docs, sketch_table(real, labels), labels, shingle, percent)
    groups.compare(_best_neighbours(near))
    groups.by_pairs(groups.by_hubs(regions).where(F.col("depth") == SHALLOWEST))
    found = groups.component_of(sets.select("doc_id", "n_shingles"), copies)
    return found.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
