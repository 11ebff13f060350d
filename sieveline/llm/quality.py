"""Quality by a byte-level convolutional network.

The network is fitted on a bounded sample of labelled documents. Whole texts are scored where they are read, chunk by
chunk, with a model of fixed size and without any shuffle.

Null and empty texts are one chunk of zeros. Repeated rows and ties are scored alike. Without any usable label the
score is that of an untrained network. Documents with a null doc_id are scored, and are not held out. Other columns
are not looked at; ``of_quality`` keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_network import ByteNetwork, fit
from .frames import ship_package
from .labelled import held_out, training_texts

#: Labelled documents that the network is fitted on, at most, and the bytes of the longest of them.
SAMPLE, LONGEST = 4_000, 1 << 14
THRESHOLD = 0.3
FOLD = (5, 0)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST, fold: tuple[int, int] = FOLD,
                label: str = "quality") -> ByteNetwork:
    """A network for ``label``, from labelled documents outside the held-out fold."""
    table = training_texts(docs, labels, label, held_out(*fold), sample, longest).toArrow().sort_by("doc_id")
    return fit(table["text"].combine_chunks(), table["label"].to_numpy().astype(np.float32))


def quality_score(spark: SparkSession, network: ByteNetwork, text: Column) -> Column:
    """The network's probability for each text."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(network)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts))

    return score(text.cast("string"))


def score_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    network = fit_quality(docs, labels, **options)
    fold = options.get("fold", FOLD)
    scored = docs.select(F.col("doc_id").cast("long"), quality_score(docs.sparkSession, network, F.col("text")).alias("score"))
    return scored.select("doc_id", F.coalesce(held_out(*fold), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def of_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score at least ``threshold``."""
    return docs.where(quality_score(docs.sparkSession, fit_quality(docs, labels), F.col("text")) >= threshold)
