"""Prefix trie of conversations by the Euler-tour technique.

Conversations are rebuilt so that they share openings, and each distinct opening is a node of a trie. Every node gives
two arcs, one that enters its subtree and one that leaves it; linked in order (children by conv_id) the arcs are one tour.
The tour is ranked as a distributed list (``list_ranking``), with the leaves and the savings of each node as weights of
its entering arc. A subtree is the stretch between its two arcs, so its leaves and savings are differences of the sums
before them. No text leaves its first task: turns are known by a digest of 128 bits and openings by two of 64.

Null role and text count as empty. Turns come in the order of ``turn``, null first; those with the same number by
the MD5 of role and text. Repeated rows are turns of their own. Rows with a null conv_id are left out; an empty table has no
nodes. conv_ids may be negative; the remainder then has the sign of conv_id. Other columns are not looked at.

A conversation may have any number of turns and a node any number of members or children: all orders are cut into
ranges. Only the digest of a node's ends is made in one task, from ready pieces of text, since SHA-256 reads its
input from start to end.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.ordering import rank_in_groups
from sieveline.session import cut_lineage

from .frames import ship_package
from .list_ranking import ROWS_AT_ONCE, rank_list
from .sorted_rows import with_next

#: Conversations of one family take their opening from the first of them.
FAMILY = 20
#: An opening has fewer turns than this.
OPENINGS = 4
#: Ids joined to one piece of text before the digest of a node's ends is made.
IDS_A_PIECE = 5_000


def _opening(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(OPENINGS)).cast("int")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, turn_key, words, last) of every rebuilt turn, and (conv_id, n_turns) of every conversation."""
    text, role = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("text", "role"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("turn_key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    ranked = cut_lineage(rank_in_groups(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("turn_key")], "idx"), "turns")
    sizes = ranked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    lent = (ranked.where(f"conv_id % {FAMILY} = 0 and idx < {OPENINGS}").groupBy(F.col("conv_id").alias("base"))
            .agg(F.array_sort(F.collect_list(F.struct("idx", "turn_key", "words"))).alias("lent")))  # under OPENINGS entries
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    taken = F.coalesce(F.slice("lent", F.lit(1), "h"), F.array().cast("array<struct<idx: int, turn_key: string, words: bigint>>"))
    families = cut_lineage(
        sizes.withColumn("base", base).join(lent, "base", "left").withColumn("h", _opening(F.col("conv_id"))).withColumn("taken", taken)
        .select("conv_id", "n", "h", "taken", (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.size("taken")).alias("n_turns")), "families")
    opening = families.select("conv_id", "n_turns", F.explode("taken").alias("t")).select(
        "conv_id", F.col("t.idx").cast("long").alias("depth"), "t.turn_key", "t.words", (F.col("t.idx") == F.col("n_turns")).alias("last"))
    own = ranked.join(families.select("conv_id", "n", "h", F.size("taken").alias("m")), "conv_id").where("idx > h").select(
        "conv_id", (F.col("idx") - F.col("h") + F.col("m")).cast("long").alias("depth"), "turn_key", "words", (F.col("idx") == F.col("n")).alias("last"))
    return opening.unionByName(own), families.select("conv_id", "n_turns")


def _with_openings(turns: DataFrame) -> DataFrame:
    """``turns`` with a key of all turns up to each (key_a, key_b) and up to the one before it (above_a, above_b).

    The key is the exclusive or of a hash of every turn with its place, taken inside ranges first; a long conversation
    lies in several of them, and only what it brings along from earlier ones is passed on, one row for each range.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = turns.withColumns({"hash_a": F.xxhash64("depth", "turn_key"), "hash_b": F.xxhash64(F.lit("b"), "turn_key", "depth")})
    fixed = cut_lineage(hashed.repartitionByRange(n, "conv_id", "depth").withColumn("_slice", F.spark_partition_id()), "ordered")
    sums = fixed.groupBy("_slice", "conv_id").agg(F.bit_xor("hash_a").alias("a"), F.bit_xor("hash_b").alias("b"))
    earlier = Window.partitionBy("conv_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    brought = sums.select("_slice", "conv_id", F.bit_xor("a").over(earlier).alias("from_a"), F.bit_xor("b").over(earlier).alias("from_b"))
    so_far = Window.partitionBy("_slice", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = fixed.join(F.broadcast(brought.where("from_a is not null")), ["_slice", "conv_id"], "left")  # at most one row per range
    for end in "ab":
        joined = joined.withColumn(f"key_{end}", F.bit_xor(f"hash_{end}").over(so_far).bitwiseXOR(F.coalesce(f"from_{end}", F.lit(0).cast("long"))))
    return joined.select("conv_id", "depth", "words", "last", "key_a", "key_b",
                         *[F.col(f"key_{x}").bitwiseXOR(F.col(f"hash_{x}")).alias(f"above_{x}") for x in "ab"])


def _ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, key_a, key_b, ends_sha256) of the nodes at which a conversation ends; ``ends`` has conv_id and the node."""
    node = ["depth", "key_a", "key_b"]
    ranked = rank_in_groups(ends, node, [F.col("conv_id")], "idx")
    pieces = ranked.groupBy(*node, F.floor((F.col("idx") - 1) / IDS_A_PIECE).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))  # IDS_A_PIECE at most

    def run(batches):
        current, digest = None, None
        for batch in batches:
            out = [[], [], [], []]

            def close(key, digest, out=out):
                for column, value in zip(out, (*key, digest.hexdigest()), strict=True):
                    column.append(value)
            for *key, ids in zip(*(batch.column(x).to_pylist() for x in (*node, "ids")), strict=True):
                if key != current:
                    if current is not None:
                        close(current, digest)
                    current, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())], [*node, "ends_sha256"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in current), pa.array([digest.hexdigest()])], [*node, "ends_sha256"])

    dealt = pieces.repartition(*node).sortWithinPartitions(*node, "piece").select(*node, "ids")
    return dealt.mapInArrow(run, "depth long, key_a long, key_b long, ends_sha256 string")


def _arcs(nodes: DataFrame) -> DataFrame:
    """The tour as a list: an element (conv_id, 2 * depth) enters a node, (conv_id, 2 * depth + 1) leaves it."""
    followed = with_next(nodes, ["depth", "parent_conv_id", "conv_id"], ["depth", "parent_conv_id", "conv_id"])
    place = 2 * F.col("depth")
    nil = F.lit(None).cast("long")
    sibling = (F.col("next.depth") == F.col("depth")) & (F.col("next.parent_conv_id") == F.col("parent_conv_id"))
    down = F.col("first_child").isNotNull()
    enter = F.struct(place.alias("b"), F.when(down, F.col("first_child")).otherwise(F.col("conv_id")).alias("c"),
                     F.when(down, place + 2).otherwise(place + 1).alias("d"), F.when(down, 0).otherwise(1).cast("long").alias("leaves"), F.col("saving").alias("saved"))
    leave = F.struct((place + 1).alias("b"), F.when(sibling, F.col("next.conv_id")).when(F.col("depth") > 0, F.col("parent_conv_id")).otherwise(nil).alias("c"),
                     F.when(sibling, place).when(F.col("depth") > 0, place - 1).otherwise(nil).alias("d"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    return followed.select(F.col("conv_id").alias("a"), F.explode(F.array(enter, leave)).alias("arc")).select("a", "arc.*")


def prefix_trie(conversations: DataFrame, rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """One row for each node; see the head of this module and README for the columns."""
    ship_package(conversations.sparkSession)
    turns, convs = rebuilt_turns(conversations)
    openings = cut_lineage(_with_openings(turns), "openings")
    below = openings.groupBy("depth", "key_a", "key_b").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.min("above_a").alias("above_a"), F.min("above_b").alias("above_b"))
    none = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        none.alias("depth"), none.alias("key_a"), none.alias("key_b"), "conv_id", "n_convs", none.alias("words"),
        F.lit(None).cast("long").alias("above_a"), F.lit(None).cast("long").alias("above_b"))
    plain = cut_lineage(below.unionByName(root), "plain")
    above = plain.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("key_a").alias("above_a"), F.col("key_b").alias("above_b"),
                                            F.col("conv_id").alias("parent_conv_id"))
    top = plain.where("depth = 0").agg(F.min("conv_id")).scalar()
    deep = plain.where("depth > 1").join(above, ["depth", "above_a", "above_b"]).select(*plain.columns, "parent_conv_id")
    shallow = plain.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, top))
    linked = cut_lineage(deep.unionByName(shallow), "linked")
    kids = linked.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(
        F.min("conv_id").alias("first_child"), F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(linked.join(kids, ["depth", "conv_id"], "left").withColumn("saving", (F.col("n_convs") - 1) * F.col("words")), "nodes")

    ranks = rank_list(_arcs(nodes), ["leaves", "saved"], rows_at_once)
    sign = F.when(F.col("b") % 2 == 1, 1).otherwise(-1)
    subtrees = ranks.groupBy(F.col("a").alias("conv_id"), F.floor(F.col("b") / 2).alias("depth")).agg(
        F.sum(sign * F.col("before_leaves")).alias("n_leaves"), F.sum(sign * F.col("before_saved")).alias("saved_tokens"))
    ends = openings.where("last").select("depth", "key_a", "key_b", "conv_id").unionByName(
        convs.where("n_turns = 0").select(none.alias("depth"), none.alias("key_a"), none.alias("key_b"), "conv_id"))
    return (nodes.join(subtrees, ["conv_id", "depth"]).join(_ends_digest(ends), ["depth", "key_a", "key_b"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", none).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))
