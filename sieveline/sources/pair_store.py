"""Pairs and the effort spent on them, kept in buckets of (target, ligand).

Tables with equal buckets are joined where they lie: what is still to do is found without moving the ledger or the
pairs, however large they have grown. Rows are appended batch by batch and keep the layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import stored_exhaustiveness
from ..operators.ledger import PAIR
from ..params import DEFAULTS, ScreenParams

#: Effort of a pair with a stored hit, beyond any that can be asked for.
SETTLED = 2**31 - 1


def append_pairs(rows: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Append ``rows`` to a table in buckets of its pairs, which is made if it is not there.

    Each bucket gets one file an append. ``buckets`` must be the same for all tables that are joined; size it for the final ledger.
    """
    writer = rows.repartition(buckets, *PAIR).write.mode("append").format("parquet").bucketBy(buckets, *PAIR).sortBy(*PAIR)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def settled_efforts(facts: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """(target, ligand, exh) of a batch of ledger rows or facts: the highest effort, and ``SETTLED`` for a hit."""
    effort = stored_exhaustiveness(F.col("exh"), F.col("score"), p)
    done = F.when(F.col("score") <= p.hit_score, F.lit(SETTLED)).otherwise(effort)
    return facts.groupBy(*PAIR).agg(F.max(done).cast("int").alias("exh"))


def pending_pairs(spark: SparkSession, pairs: str, efforts: str, exh: int | Column) -> DataFrame:
    """Rows of the table ``pairs`` that no row of the table ``efforts`` settles at the effort asked for."""
    wanted = spark.table(pairs).withColumn("_asked", F.lit(exh) if isinstance(exh, int) else exh)
    done = spark.table(efforts).select(*[F.col(x).alias(f"_{x}") for x in PAIR], F.col("exh").alias("_done"))
    met = (F.col("target") == F.col("_target")) & (F.col("ligand") == F.col("_ligand")) & (F.col("_done") >= F.col("_asked"))
    return wanted.join(done, met, "left_anti").drop("_asked")
