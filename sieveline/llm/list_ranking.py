"""Distributed list ranking: prefix sums along a linked list whose elements lie anywhere.

Elements are named by two longs. Each round deals the list into tasks by ranges of the names, joins every run of
elements that lies in one task to a single element, and goes on with the runs. When at most ``ROWS_AT_ONCE`` are left,
one task walks them; the sums then go back down, one join for each round. A round that shortens the list by less
than a quarter is followed by one that brings elements together with their successors by the toss of a coin,
which shortens any list by a quarter on average, so that the rounds grow with the logarithm of the list.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import cut_lineage

#: Elements that one task takes: a bound, not a sample.
ROWS_AT_ONCE = 200_000


def join_runs(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Head of each element's run, the sums of the weights before it in its run, and whether it ends its run.

    Element ``i`` is named (a, b) and followed by (c, d); c is negative infinity as a float, or any name that is not
    among the elements, at the end of a list. ``weights`` has one row for each weight.
    """
    size = len(a)
    names, code = np.unique(a, return_inverse=True)
    width = int(b.max()) + 1
    key = code * width + b
    order = np.argsort(key)
    key = key[order]
    at = np.minimum(np.searchsorted(names, c), len(names) - 1)
    wanted = at * width + d
    place = np.minimum(np.searchsorted(key, wanted), size - 1)
    here = (names[at] == c) & (d >= 0) & (d < width) & (key[place] == wanted)
    follower = order[place[here]]
    head = np.arange(size)
    before = np.zeros_like(weights)
    head[follower] = np.flatnonzero(here)
    before[:, follower] = weights[:, here]
    while True:
        further = head[head]
        if np.array_equal(further, head):
            return head, before, ~here
        before = before + before[:, head]
        head = further


def _level(rows: DataFrame, weights: Sequence[str]) -> DataFrame:
    """Every element with the head of its run, the sums before it there, and whether it is the last of its run."""
    names = ["a", "b", "c", "d", *weights, "head_a", "head_b", *(f"before_{w}" for w in weights)]

    def run(parts):
        parts = list(parts)
        table = pd.concat(parts) if parts else pd.DataFrame()
        if not len(table):
            return
        # the end of the list is its own successor, which no other element can be
        last = table["c"].isna().to_numpy()
        a, b = (table[x].to_numpy(np.int64) for x in "ab")
        c, d = (table[x].fillna(-1).to_numpy(np.int64) for x in "cd")
        head, before, tail = join_runs(a, b, c, np.where(last, -1, d), np.stack([table[w].to_numpy(np.int64) for w in weights]))
        out = table.assign(head_a=a[head], head_b=b[head], **{f"before_{w}": x for w, x in zip(weights, before, strict=True)})
        out["tail"] = tail
        yield out[[*names, "tail"]]

    schema = ", ".join(f"{x} long" for x in names) + ", tail boolean"
    return rows.select("a", "b", F.col("c").cast("long"), F.col("d").cast("long"), *weights).mapInPandas(run, schema)


def rank_list(elements: DataFrame, weights: Sequence[str], rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """(a, b, before_*): the sum of each weight over all elements before each one.

    ``elements`` has a and b (long, b not negative), c and d (the element that follows; null for the last one) and the
    weights (long). It must be one list.
    """
    weights = list(weights)
    current = cut_lineage(elements.select("a", "b", "c", "d", *weights), "list")
    size = current.count()
    levels, tossed, shrunk = [], 0, True
    while size > rows_at_once:
        parts = size // rows_at_once + 1
        if shrunk:
            dealt = current.repartitionByRange(parts, "a", "b")
        else:
            tossed += 1
            heads = (F.xxhash64("a", "b", F.lit(tossed)) % 2 == 0) & F.col("c").isNotNull()
            dealt = current.repartition(parts, F.when(heads, F.xxhash64("c", "d")).otherwise(F.xxhash64("a", "b")))
        level = cut_lineage(_level(dealt, weights), "level")
        levels.append(level)
        current = level.where("tail").select(
            F.col("head_a").alias("a"), F.col("head_b").alias("b"), "c", "d", *[(F.col(w) + F.col(f"before_{w}")).alias(w) for w in weights])
        left = current.count()
        shrunk, size = 4 * left <= 3 * size or not shrunk, left
    sums = [f"before_{w}" for w in weights]
    ranks = _level(current.repartition(1), weights).select("a", "b", *sums)
    for level in reversed(levels):
        above = ranks.toDF("head_a", "head_b", *[f"_{s}" for s in sums])
        ranks = level.join(above, ["head_a", "head_b"]).select("a", "b", *[(F.col(s) + F.col(f"_{s}")).alias(s) for s in sums])
    return ranks
