"""Steps that joins of similar shingle sets share: sets of texts, comparison of pairs, and groups grown in rounds.

Candidates come as rows (key, doc_id, depth): documents with a common key may be alike. Groups are grown without listing
the pairs of a key. In each round one document of every key that still holds several groups is its hub, and
every document of another group is compared with a few hubs at most, of the groups it shares most with. What is found joins groups, so the
next round has fewer. When most hubs are refused, the pairs that lie across groups and may be alike are listed
once, and of those only a few for each document and other group are compared at a time, since one link joins both
groups. A pair is left out only if it is connected already, or proven unlike by its odd sketch: each element flips
one bit of its set's sketch, so two sketches differ in at most as many bits as the sets differ in elements.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.skew import sliced_join
from sieveline.session import cut_lineage

from .components import smallest_reachable
from .frames import BROADCAST_ROWS, only_ids, sized
from .text_words import LOWER, NOT_SPACE, mix, row_groups, scan, shingle_keys

#: Words of 64 bits in an odd sketch.
SKETCH = 16
ODD = [f"odd_{i}" for i in range(SKETCH)]
#: Hubs of a key are chosen in so many ways at a time, by the key.
HUBS = 8
#: Hubs that a document is compared with in a round, each of another group.
HUBS_TRIED = 3
#: Rounds end when fewer than one comparison in so many finds a link, or fewer than one open group in ``RARE`` is joined.
FEW = 16
RARE = 25
#: Rows of one key or document that are joined in one slice.
SLICE_ROWS = 2_000


def distinct_keys(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each of ``n`` texts, one text after the other, and where each begins."""
    order = np.argsort(rows, kind="stable")
    keys, edges = keys[order], np.searchsorted(rows[order], np.arange(n + 1))
    sets = [np.unique(keys[edges[i]:edges[i + 1]]) for i in range(n)]
    return (np.concatenate(sets) if sets else keys), np.cumsum([0, *map(len, sets)])


def sets_of(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, one text after the other, and where each begins."""
    keys, rows = shingle_keys(scan(column, NOT_SPACE, LOWER), shingle)
    return distinct_keys(keys, rows, len(column))


def text_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """doc_ids and texts, a few megabytes at a time."""
    for batch in batches:
        for first, last in row_groups(batch.column("text")):
            part = batch.slice(first, last - first)
            yield part.column("doc_id"), part.column("text")


def set_digests(keys: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two sums of hashes for each set; equal sets have equal sums."""
    sums = []
    for salt in (1, 2):
        total = np.zeros(len(keys) + 1, dtype=np.uint64)
        np.cumsum(mix(keys + np.uint64(salt * 0x5851F42D4C957F2D)), out=total[1:])
        sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return sums


def odd_sketches(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The odd sketch of each set, one row of ``SKETCH`` longs a set."""
    n = len(first) - 1
    bit = (mix(keys) % np.uint64(64 * SKETCH)).astype(np.int64)
    cell = np.repeat(np.arange(n), np.diff(first)) * 64 * SKETCH + bit
    return np.packbits(np.bincount(cell, minlength=n * 64 * SKETCH) & 1).view(np.int64).reshape(n, SKETCH)


def equal_sets(real: DataFrame) -> DataFrame:
    """(doc_id, class_id): documents whose set another document with a smaller id has too; a doc_id of several rows may be there often."""
    same = ["set_a", "set_b", "n_shingles"]
    classes = cut_lineage(real.groupBy(*same).agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
                          .where("copies > 1"), "classes")
    return cut_lineage(real.join(classes, same).where("doc_id <> class_id").select("doc_id", "class_id"), "copies")


def spared_copies(real: DataFrame, copies: DataFrame) -> DataFrame:
    """Documents that are wholly stood for by another one with an equal set: those with one text only."""
    several = (real.groupBy("doc_id").agg(*(f(x).alias(f"{f.__name__}_{x}") for f in (F.min, F.max) for x in ("set_a", "set_b")))
               .where("min_set_a <> max_set_a or min_set_b <> max_set_b"))
    return cut_lineage(copies.select("doc_id").distinct().join(several, "doc_id", "left_anti"), "spared")


def sketch_table(real: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each doc_id of ``ids``: sizes and number of its texts, and the sketch of one of them."""
    return cut_lineage(real.join(ids.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("n_shingles").alias("size"), F.min("n_shingles").alias("least"),
                                      (F.when(F.min("set_a") == F.max("set_a"), 1).otherwise(2)).alias("texts"), *(F.first(x).alias(x) for x in ODD)), "sketches")


def packed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, packed): the compressed texts of the documents in ``ids`` (any number of rows each), written as a table."""
    ids = cut_lineage(ids.distinct(), "members")

    def run(batches):
        for batch in batches:
            packed = [zlib.compress((x.as_py() or "").encode(), 1) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "packed"])

    return cut_lineage(only_ids(docs, ids, ids.count()).mapInArrow(run, "doc_id long, packed binary"), "texts")


def _with_text(joined: DataFrame, pairs: DataFrame, rows: int, texts: DataFrame, side: str) -> DataFrame:
    """``joined``, made of ``pairs``, with the text of one side; documents of more than ``SLICE_ROWS`` pairs are joined in slices."""
    # a text moves only if a pair has it
    ids = pairs.select(side)
    texts = only_ids(texts, ids if rows <= BROADCAST_ROWS else ids.distinct(), rows).toDF(side, f"packed_{side}")
    if rows <= SLICE_ROWS:
        return joined.join(texts, side)
    hot = cut_lineage(pairs.groupBy(side).count().where(F.col("count") > SLICE_ROWS)
                      .select(side, F.ceil(F.col("count") / SLICE_ROWS).cast("int").alias("slices")), "hot")
    if hot.isEmpty():
        return joined.join(texts, side)
    one = F.coalesce("slices", F.lit(1))
    dealt = joined.join(hot, side, "left").withColumn("slice", F.pmod(F.xxhash64("a", "b"), one).cast("int")).drop("slices")
    spread = texts.join(hot, side, "left").withColumn("slice", F.explode(F.sequence(F.lit(0), one - 1))).drop("slices")
    return dealt.join(spread, [side, "slice"]).drop("slice")


def similar_pairs(pairs: DataFrame, rows: int, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the written ``pairs`` (a, b; ``rows`` of them) whose whole sets are similar enough; ``texts`` is a ``packed_texts``."""
    def run(batches):
        for batch in batches:
            ones, twos = batch.column("packed_a"), batch.column("packed_b")
            good = np.zeros(len(batch), dtype=bool)
            for at in range(0, len(batch), 64):
                some = [zlib.decompress(x.as_py()) for pair in zip(ones[at:at + 64], twos[at:at + 64], strict=True) for x in pair]
                keys, first = sets_of(pa.array(some, pa.large_binary()), shingle)
                for i in range(len(some) // 2):
                    size = first[2 * i + 2] - first[2 * i]
                    union = len(np.unique(keys[first[2 * i]:first[2 * i + 2]]))
                    good[at + i] = 100 * (size - union) >= percent * union
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])

    pairs = pairs.select("a", "b")
    joined = _with_text(_with_text(pairs, pairs, rows, texts, "a"), pairs, rows, texts, "b").select("a", "b", "packed_a", "packed_b")
    return cut_lineage(joined.mapInArrow(run, "a long, b long"), "links")


@dataclass
class Groups:
    """Groups of documents that grow link by link.

    ``docs`` has doc_id and text, ``sketches`` is a ``sketch_table``; ``labels`` (doc_id, label) has every document that
    takes part, each in the group of its label, which is the smallest doc_id in it.
    """

    docs: DataFrame
    sketches: DataFrame
    labels: DataFrame
    shingle: int
    percent: int
    tried: DataFrame | None = None
    texts: DataFrame | None = None
    turn: int = field(default=0)
    n_tried: int = field(default=0)

    def __post_init__(self):
        self.many = self.labels.count()

    def _labelled(self, rows: DataFrame, doc: str = "doc_id", label: str = "label") -> DataFrame:
        """``rows`` with the label of their column ``doc``."""
        return rows.join(sized(self.labels.toDF(doc, label), self.many), doc)

    def _untried(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b, ...) that have not been compared either way round."""
        if self.tried is None:
            return pairs
        return pairs.join(sized(self.tried, self.n_tried), (pairs["a"] == F.col("tried_a")) & (pairs["b"] == F.col("tried_b")), "left_anti")

    def _apart(self, a: str, b: str) -> Column:
        """How many bits the sketches of two sides differ in."""
        return sum((F.bit_count(F.col(f"{a}_{x}").bitwiseXOR(F.col(f"{b}_{x}"))) for x in ODD[1:]),
                   F.bit_count(F.col(f"{a}_{ODD[0]}").bitwiseXOR(F.col(f"{b}_{ODD[0]}"))))

    def _alike(self) -> Column:
        """Whether two documents, sides a and b, may be similar enough."""
        return F.expr(f"100 * a_size >= {self.percent} * b_least and 100 * b_size >= {self.percent} * a_least") & (
            F.expr("a_texts > 1 or b_texts > 1")
            | ((100 + self.percent) * self._apart("a", "b") <= (100 - self.percent) * (F.col("a_size") + F.col("b_size"))))

    def _side(self, side: str) -> DataFrame:
        return self.sketches.toDF(side, *[f"{side}_{x}" for x in self.sketches.columns[1:]])

    def _unlike_left_out(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b, ...) that may be alike and have not been compared, with the bits they differ in."""
        near = self._untried(pairs).join(self._side("a"), "a").join(self._side("b"), "b").where(self._alike())
        return near.select(*pairs.columns, self._apart("a", "b").alias("apart"))

    def compare(self, pairs: DataFrame) -> tuple[int, int]:
        """Compare ``pairs`` (a, b) in full and join the groups that they link: the number of pairs and of links."""
        pairs = cut_lineage(pairs.select("a", "b"), "pairs")
        n = pairs.count()
        if not n:
            return 0, 0
        both = pairs.toDF("tried_a", "tried_b").unionByName(pairs.select(F.col("b").alias("tried_a"), F.col("a").alias("tried_b")))
        self.tried = both if self.tried is None else self.tried.unionByName(both)
        self.n_tried += 2 * n
        texts = self.texts if self.texts is not None else packed_texts(self.docs, pairs.select("a").union(pairs.select("b")))
        links = similar_pairs(pairs, n, texts, self.shingle, self.percent)
        found = links.count()
        if found:
            ends = (self._labelled(self._labelled(links, "a", "low"), "b", "high")
                    .where("low <> high").select(F.col("low").alias("a"), F.col("high").alias("b")))
            lower = sized(smallest_reachable(ends).toDF("label", "lower"), 2 * found)
            self.labels = cut_lineage(self.labels.join(lower, "label", "left").select("doc_id", F.coalesce("lower", "label").alias("label")), "labels")
        return n, found

    def _open(self, rows: DataFrame) -> DataFrame:
        """``rows`` whose key holds several groups, with labels and the hub (doc_id, label) of their key in this turn."""
        members = cut_lineage(self._labelled(rows), "labelled")
        toss = F.xxhash64("doc_id", F.pmod("key", F.lit(HUBS)), F.lit(self.turn))
        mixed = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                           F.min_by(F.struct("doc_id", "label"), F.struct(toss, "doc_id")).alias("hub"))
        return cut_lineage(members.join(mixed.where("low < high").select("key", "hub"), "key"), "open")

    def by_hubs(self, rows: DataFrame) -> DataFrame:
        """Grow groups along the keys of ``rows`` until few hubs are linked with anything; the rows that are still open.

        A document is compared with up to ``HUBS_TRIED`` hubs of as many other groups, those that share the deepest and most keys with it.
        """
        self.texts = None
        while True:
            self.turn += 1
            opened = self._open(rows)
            rows = opened.drop("label", "hub")
            # near enough to tell when to stop
            apart = opened.agg(F.approx_count_distinct("label")).first()[0]
            if not apart:
                return rows
            if self.texts is None:  # only open documents are compared from here on
                self.texts = packed_texts(self.docs, opened.select("doc_id"))
            # dealt once by document: its hubs are counted and put in order in one task, few of them before anything is joined
            met = (opened.where(F.col("label") != F.col("hub.label"))
                   .select(F.col("doc_id").alias("a"), F.col("hub.doc_id").alias("b"), F.col("hub.label").alias("other"), "depth").repartition("a")
                   .groupBy("a", "other", "b").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("keys"))
                   .groupBy("a", "other").agg(F.min(F.struct((-F.col("depth")).alias("depth"), (-F.col("keys")).alias("keys"), "b")).alias("best")))
            first = Window.partitionBy("a").orderBy("best")
            few = met.withColumn("place", F.row_number().over(first)).where(F.col("place") <= HUBS_TRIED).select("a", F.col("best.b").alias("b"))
            n, found = self.compare(self._unlike_left_out(few))
            if FEW * found <= n or RARE * found <= apart:
                return rows

    def by_pairs(self, rows: DataFrame) -> None:
        """Compare all that may still link groups across the keys of ``rows``, a few pairs of each document and other group at a time."""
        kept = self._open(rows).select("key", "doc_id", "label").distinct().join(self.sketches, "doc_id")
        kept = cut_lineage(kept, "kept")
        if kept.isEmpty():
            return
        names = [x for x in kept.columns if x != "key"]
        one, two = (kept.select("key", *[F.col(x).alias(f"{s}_{x}") for x in names]) for s in "ab")
        condition = (F.col("a_doc_id") < F.col("b_doc_id")) & (F.col("a_label") != F.col("b_label")) & self._alike()
        met = sliced_join(one, two, ["key"], condition, SLICE_ROWS)
        left = met.select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b"), self._apart("a", "b").alias("apart")).distinct()
        left, at_once = cut_lineage(self._untried(left), "across"), 1
        while True:
            now = self._labelled(self._labelled(left, "a", "a_label"), "b", "b_label").where("a_label <> b_label")
            nearest = Window.partitionBy("a", "b_label").orderBy("apart", "b")
            ranked = cut_lineage(now.withColumn("place", F.row_number().over(nearest)).select("a", "b", "apart", "place"), "ranked")
            if not self.compare(ranked.where(F.col("place") <= at_once))[0]:
                return
            left, at_once = ranked.where(F.col("place") > at_once).drop("place"), at_once * FEW

    def component_of(self, rows: DataFrame, copies: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, component_id) of all ``rows``; ``copies`` are tied to their classes."""
        linked = self.labels.where("doc_id <> label").toDF("a", "b").union(copies.toDF("a", "b"))
        return rows.join(smallest_reachable(linked).toDF("doc_id", "label"), "doc_id", "left").select(
            "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
