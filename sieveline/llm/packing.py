"""Best-fit decreasing packing of token pieces into sequences.

Each document becomes its token ids and an end id. A longer one is cut into full pieces, the first of which
may be shorter. Pieces are dealt over shards by the hash of a number fixed in their written table, so that shards are alike in
size whatever the ids are, and each shard is packed on its own: from the longest to the shortest, each piece goes into the open sequence with the least room
that is enough. A segment tree over remaining capacities finds it in logarithmic time. A shard leaves about one
sequence unfilled, so many shards cost less than one sequence in a thousand.

A null or empty text is the end id alone. Repeated rows are packed each on its own. A null doc_id stays null.
Other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import cut_lineage

from .byte_bpe import Encoder
from .frames import ship_package

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
LENGTH = 1024
#: Pieces of one shard.
SHARD_PIECES = 20_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_PIECES}, sequence_id long, offset long"


class CapacityTree:
    """Numbers of open sequences by remaining capacity; finds the least capacity that is enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, sequence) of the tightest open sequence with room for ``need``, removed."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece and its place there."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int(np.searchsorted(-lengths[order], -most, side="right"))
    sequence[order[:full]] = np.arange(full)
    tree, opened = CapacityTree(most), full
    for at, need in zip(order[full:].tolist(), lengths[order[full:]].tolist(), strict=True):
        found = tree.take(need)
        if found is None:
            found = most, opened
            opened += 1
        room, number = found
        sequence[at], offset[at] = number, most - room
        if room > need:
            tree.add(room - need, number)
    return sequence, offset


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece; ``with_ids`` adds its ids."""
    ship_package(docs.sparkSession)
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:5 + with_ids]

    def run(batches):
        encode = Encoder(tokenizer)
        for batch in batches:
            rows, out = [], [[] for _ in names[1:]]
            for row, text in enumerate(pc.fill_null(batch.column("text"), "")):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                cuts = [0, *range(total % length or length, total + 1, length)] if total > length else [0, total]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[4 * a:4 * b]
                    rows.append(row)
                    for column, value in zip(out, (piece, a, b - a, zlib.crc32(part), part), strict=False):
                        column.append(value)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(x, t) for x, t in zip(out, types, strict=False)]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4") for x in out[4]], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *arrays], names)
        encode.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, _PIECES + ", ids array<long>" * with_ids)


def pack(pieces: DataFrame, length: int = LENGTH, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    pieces = cut_lineage(pieces.withColumn("deal", F.monotonically_increasing_id()), "pieces")
    shards = -(-pieces.count() // shard_pieces) or 1

    def run(key, shard):
        shard = shard.drop_columns("shard").sort_by([(x, "ascending") for x in ("doc_id", "piece", "ids_crc32")])
        sequence, offset = best_fit_decreasing(shard["length"].to_numpy(), length)
        return shard.append_column("sequence_id", pa.array(sequence + (key[0].as_py() << 40))).append_column("offset", pa.array(offset))

    dealt = pieces.select(*(x.split()[0] for x in _PIECES.split(", ")), F.pmod(F.xxhash64("deal"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(run, _PLACED)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(token_pieces(docs, tokenizer, end_id, length), length)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences. ``pieces`` have ids; a sequence is at most one length of tokens."""
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    joined = placed.alias("p").join(pieces.dropDuplicates(key).alias("q"), [F.col(f"p.{k}").eqNullSafe(F.col(f"q.{k}")) for k in key])
    ordered = F.sort_array(F.collect_list(F.struct("p.offset", "q.ids")))
    return joined.groupBy("p.sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
