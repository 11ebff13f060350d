"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# A key is hot above this many rows on either side: two full slices are then compared in one task.
ROWS_PER_SLICE = 20_000


def hot_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], rows_per_slice: int) -> DataFrame:
    """Every hot key with the number of slices each side needs, however many there are."""
    keys = list(keys)

    def large(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias(name)).where(F.col(name) > rows_per_slice)

    both = large(left, "n_left").unionByName(large(right, "n_right"), allowMissingColumns=True)

    def slices(side: str) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.coalesce(F.max(f"n_{side}"), F.lit(1)) / rows_per_slice).cast("int"))

    return both.groupBy(*keys).agg(slices("left").alias("_ls"), slices("right").alias("_rs"))


def sliced_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    condition: Column | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Inner equi-join on ``keys`` that cuts hot keys into a grid of slices.

    The left rows of a hot key fall into ``_ls`` slices and are repeated over the right's ``_rs``,
    and the other way round, so each pair meets exactly once and no task sees more than a slice
    of either side. Slices depend on the size of a key alone. The written table of hot keys is broadcast
    only if Spark finds it small; else it is joined by a shuffle, where adaptive execution splits the
    side with the hot keys. Without hot keys it is a plain join. Key sizes are counted first, in one
    pre-aggregated pass over each side, so the sides should be cheap to read twice. The two sides
    share no column names beyond ``keys``; ``condition`` is evaluated inside the join.
    """
    keys = list(keys)
    hot = cut_lineage(hot_keys(left, right, keys, rows_per_slice), "hot-keys")
    if hot.isEmpty():
        matched = left.join(right, keys)
        return matched if condition is None else matched.where(condition)

    def spread(df: DataFrame, own: str, other: str, own_slice: str, other_slice: str) -> DataFrame:
        mixed = F.xxhash64(*[F.col(c) for c in df.columns])
        return (
            df.join(hot, keys, "left")
            .withColumn(own_slice, F.pmod(mixed, F.coalesce(F.col(own), F.lit(1))).cast("int"))
            .withColumn(other_slice, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)))
            .drop("_ls", "_rs")
        )

    l = spread(left, "_ls", "_rs", "_li", "_ri")
    r = spread(right, "_rs", "_ls", "_ri", "_li")
    matched = l.join(r, [*keys, "_li", "_ri"])
    if condition is not None:
        matched = matched.where(condition)
    return matched.drop("_li", "_ri")
