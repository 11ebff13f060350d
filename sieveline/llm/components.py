"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import cut_lineage

from .frames import sized


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over ``links`` (columns a, b), for every node in them.

    Each round takes the smallest label among a node's neighbours, then the label of that label, so that
    long chains take far fewer rounds than they have links. Rounds end when no link has two labels; every round is
    written to the shared folder. Minima are combined before each shuffle, so a node may have any number of links.
    Few links, counted first, are joined by broadcast, so that a round shuffles once.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("way")
    both = cut_lineage(links.where("a is not null and b is not null and a <> b").select(ways).select("way.a", "way.b").distinct(), "links")
    rows = both.count()
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                         .select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        ends = both.join(sized(labels.toDF("a", "one"), rows), "a").join(sized(labels.toDF("b", "two"), rows), "b")
        if ends.where("one <> two").isEmpty():
            return labels
        seen = (both.join(sized(labels.toDF("b", "label"), rows), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        lower = cut_lineage(seen.join(sized(labels, rows), "node").select("node", F.least("label", "near").alias("label")), "lower")
        above = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = cut_lineage(lower.join(sized(above, rows), "label").select("node", F.col("next").alias("label")), "labels")
