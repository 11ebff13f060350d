"""Neighbours in a global order that no single task holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.session import cut_lineage


def with_next(df: DataFrame, order: Sequence[str], carry: Sequence[str], name: str = "next") -> DataFrame:
    """``df`` with a struct of the ``carry`` columns of the row that follows under ``order``; null at the end.

    Rows are range-partitioned and fixed in a table, so equal leading keys spread over several slices; only the
    first row of each slice is passed to the slice before it. ``order`` should be total, or ties follow in any order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fixed = cut_lineage(df.repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id()), "ordered")
    firsts = fixed.groupBy("_slice").agg(F.min_by(F.struct(*carry), F.struct(*order)).alias("_first"))
    after = firsts.select("_slice", F.lead("_first").over(Window.orderBy("_slice")).alias("_after"))
    follows = F.lead(F.struct(*carry)).over(Window.partitionBy("_slice").orderBy(*order))
    return (fixed.withColumn("_next", follows).join(F.broadcast(after), "_slice")  # one row per slice
            .withColumn(name, F.coalesce("_next", "_after")).drop("_next", "_after", "_slice"))
