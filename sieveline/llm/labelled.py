"""Bounded samples of labelled documents, to fit models on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(divisor: int, remainder: int) -> Column:
    """Whether a document belongs to the fold that labels are never learned from."""
    return (F.crc32(F.col("doc_id").cast("string")) % divisor == remainder)


def training_texts(docs: DataFrame, labels: DataFrame, label: str, fold: Column, most: int, longest: int) -> DataFrame:
    """(text, label): at most ``most`` labelled documents outside ``fold``, of at most ``longest`` bytes each.

    The rows are chosen by a hash of the id, so that they are the same in every run. Rows without a label or
    text are left out, and of several labels of a document the largest counts.
    """
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
              .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~fold)
              .groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (texts.where(F.col("text").isNotNull() & (F.octet_length("text") <= longest))
            .join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "label"))
