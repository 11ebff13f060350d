"""Global order without a single-task window: dense positions, ranks, running and tail totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def dense_index(df: DataFrame, order: Sequence[Column], name: str = "idx", start: int = 0,
                slices: int | None = None) -> DataFrame:
    """Positions ``start, start+1, ...`` of the rows under a total order.

    Rows are range-partitioned, the slices fixed in a table so that a lost executor cannot
    renumber them, and each slice is offset by the sizes of those before it. Only the slice sizes
    (one row per slice) go through a single task.
    """
    spark = df.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id())
    fixed = cut_lineage(ranged, "ordered")
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        fixed.groupBy("_slice").agg(F.count("*").alias("_n"))
        .select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    within = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    return (
        fixed.withColumn("_row", within)
        .join(F.broadcast(offsets), "_slice")  # one row per slice
        .withColumn(name, F.col("_offset") + F.col("_row") + (start - 1))
        .drop("_slice", "_row", "_offset")
    )


def rank_in_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank",
                   slices: int | None = None) -> DataFrame:
    """Rank 1, 2, ... of every row within its group, for groups of any size.

    A plain window puts a whole group into one task. Here rows are range-partitioned by key and
    order, so a large group spreads over several slices; each slice holds at most one group that
    began in an earlier one, and only those offsets (one row per slice) are passed around.
    """
    keys = list(keys)
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id())
    fixed = cut_lineage(ranged, "ordered")
    parts = fixed.groupBy("_slice", *keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    continued = parts.withColumn("_offset", F.sum("_n").over(before)).where("_offset IS NOT NULL").drop("_n")
    within = F.row_number().over(Window.partitionBy("_slice", *keys).orderBy(*order))
    return (
        fixed.withColumn("_row", within)
        .join(F.broadcast(continued), ["_slice", *keys], "left")  # at most one row per slice
        .withColumn(name, (F.col("_row") + F.coalesce("_offset", F.lit(0))).cast("int"))
        .drop("_slice", "_row", "_offset").select(*df.columns, name)
    )


def ranked_top(df: DataFrame, order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows under ``order`` with their rank 1..n."""
    return (
        df.orderBy(*order).limit(n)
        .withColumn(name, F.row_number().over(Window.orderBy(*order)))
    )


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  name: str = "rank") -> DataFrame:
    """First ``n`` rows of each group. The limit is applied before the shuffle as well, so a
    group of any size reaches its task already cut down."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def lowest_rows(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str]) -> DataFrame:
    """(keys, value, ties): the row of lowest ``value`` in each group, ties by ``ties``; for few groups.

    The lowest value of each group is found by hash aggregation and looked up again, so only rows
    that are tied for it are ordered. Rows without a value are left out.
    """
    valued = df.where(F.col(value).isNotNull())
    lowest = cut_lineage(valued.groupBy(*keys).agg(F.min(value).alias("_low")), "lowest")
    same = F.col(value) == F.col("_low")
    for key in keys:
        lowest = lowest.withColumnRenamed(key, f"_{key}")
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
    tied = valued.join(lowest, same).groupBy(*keys).agg(F.min(F.struct(value, *ties)).alias("_row"))
    return tied.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in (value, *ties)])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the smallest under ``order``; pre-aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def tail_counts(points: DataFrame, keys: Sequence[str], value: str, weight: str,
                bin_width: float) -> DataFrame:
    """For each distinct ``value`` of a key: ``n_here``, ``n_above`` (strictly greater) and
    ``n_total``, where ``weight`` says how many rows a point stands for.

    Totals are taken in two levels, over coarse bins and inside each bin, so that no task has to
    order all values of one key. Scores carry three decimals, so a bin of 0.05 has at most 50
    different values however many rows a key has; finer data wants a smaller ``bin_width``.
    """
    keys = list(keys)
    distinct = cut_lineage(points.groupBy(*keys, value).agg(F.sum(weight).alias("n_here")), "points")
    binned = distinct.withColumn("_bin", F.floor(F.col(value) / bin_width))
    above = Window.unboundedPreceding, -1
    per_bin = binned.groupBy(*keys, "_bin").agg(F.sum("n_here").alias("_n"))
    over_bins = Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(*above)
    bins = per_bin.select(
        *keys, "_bin",
        F.coalesce(F.sum("_n").over(over_bins), F.lit(0)).alias("_higher_bins"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("n_total"),
    )
    in_bin = Window.partitionBy(*keys, "_bin").orderBy(F.desc(value)).rowsBetween(*above)
    return (
        binned.withColumn("_higher_here", F.coalesce(F.sum("n_here").over(in_bin), F.lit(0)))
        .join(bins, [*keys, "_bin"])
        .withColumn("n_above", F.col("_higher_bins") + F.col("_higher_here"))
        .drop("_bin", "_higher_bins", "_higher_here")
    )


def running_by_round(batches: DataFrame, sums: dict[str, str], mins: dict[str, str]) -> DataFrame:
    """Running totals and minima over (round, batch_id), one input row per batch.

    Runs inside each round first and then adds what earlier rounds ended with; only one row per
    round is ordered globally.
    """
    so_far = Window.unboundedPreceding, Window.currentRow
    in_round = Window.partitionBy("round").orderBy("batch_id").rowsBetween(*so_far)
    earlier = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    rounds = batches.groupBy("round").agg(
        *[F.sum(c).alias(f"_sum_{o}") for o, c in sums.items()],
        *[F.min(c).alias(f"_min_{o}") for o, c in mins.items()],
    )
    carried = rounds.select(
        "round",
        *[F.coalesce(F.sum(f"_sum_{o}").over(earlier), F.lit(0)).alias(f"_before_{o}") for o in sums],
        *[F.min(f"_min_{o}").over(earlier).alias(f"_before_{o}") for o in mins],
    )
    joined = batches.join(carried, "round")
    return joined.select(
        *batches.columns,
        *[(F.sum(c).over(in_round) + F.col(f"_before_{o}")).alias(o) for o, c in sums.items()],
        *[F.least(F.min(c).over(in_round), F.col(f"_before_{o}")).alias(o) for o, c in mins.items()],
    )
