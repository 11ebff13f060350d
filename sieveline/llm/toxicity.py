"""Toxicity by a factorization machine over hashed terms.

The machine learns pairs of terms as well as terms, so an insult beside a mention of a group weighs more than the
two apart. It is fitted in a task, on a bounded sample of labelled documents; whole texts are scored where they are
read, with a model of fixed size, without any shuffle.

Null and empty texts get the score of the bias alone. Repeated rows and ties are scored alike. Without any
usable label the score is 0.5. Documents with a null doc_id are scored, and are not held out. Only doc_id, the text and the
chosen label are looked at; ``without_toxic`` keeps other columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .factorization import BITS, FactorizationMachine, fit, hashed_terms
from .frames import ship_package
from .labelled import held_out, training_texts
from .text_words import row_groups

#: Labelled documents that the model is fitted on, at most, and the bytes of the longest of them.
SAMPLE, LONGEST = 8_000, 1 << 16
THRESHOLD = 0.7
FOLD = (3, 1)
#: Length of the vector of each term.
FACTORS = 4

_MODEL = "bias double, bucket array<long>, weight array<float>, factor array<float>"


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST, fold: tuple[int, int] = FOLD,
                 label: str = "toxic") -> FactorizationMachine:
    """A model of ``label``, from labelled documents outside the held-out fold."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for low, high in row_groups(batch.column("text")):
                part = batch.slice(low, high - low)
                first, bucket, value = hashed_terms(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), pa.ListArray.from_arrays(first.astype(np.int32), bucket),
                     pa.ListArray.from_arrays(first.astype(np.int32), value)], ["doc_id", "label", "bucket", "value"])

    rows = training_texts(docs, labels, label, held_out(*fold), sample, longest).mapInArrow(
        run, "doc_id long, label int, bucket array<long>, value array<float>")
    found = rows.repartition(1).mapInArrow(_fit_rows, _MODEL).first()
    model = FactorizationMachine(found.bias, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, FACTORS), np.float32))
    model.weight[found.bucket] = found.weight
    model.factor[found.bucket] = np.array(found.factor, np.float32).reshape(-1, FACTORS)
    return model


def _fit_rows(batches):
    """One row, the model of all rows (a bounded sample): its bias and the buckets that it learned."""
    parts = list(batches)
    if parts:
        table = pa.Table.from_batches(parts).sort_by("doc_id").combine_chunks()
        buckets, values, label = (table[x].combine_chunks() for x in ("bucket", "value", "label"))
        first = np.concatenate([[0], np.cumsum(buckets.value_lengths().to_numpy())]).astype(np.int64)
        rows = first, buckets.flatten().to_numpy(), values.flatten().to_numpy(), label.to_numpy().astype(np.float32)
    else:
        rows = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32)
    model = fit(*rows, factors=FACTORS, rounds=30)
    learned = np.flatnonzero((model.weight != 0) | model.factor.any(axis=1))
    lists = [learned, model.weight[learned], model.factor[learned].ravel()]
    yield pa.RecordBatch.from_arrays([pa.array([model.bias]), *(pa.ListArray.from_arrays([0, len(x)], pa.array(x)) for x in lists)],
                                     ["bias", "bucket", "weight", "factor"])


def toxicity_score(spark: SparkSession, model: FactorizationMachine, text: Column) -> Column:
    """The model's probability for each text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        groups = [shared.value.scores(texts.slice(low, high - low)) for low, high in row_groups(texts)]
        return pa.array(np.concatenate([np.zeros(0), *groups]))

    return score(text.cast("string"))


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    model = fit_toxicity(docs, labels, **options)
    fold = options.get("fold", FOLD)
    scored = docs.select(F.col("doc_id").cast("long"), toxicity_score(docs.sparkSession, model, F.col("text")).alias("score"))
    return scored.select("doc_id", F.coalesce(held_out(*fold), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``."""
    return docs.where(toxicity_score(docs.sparkSession, fit_toxicity(docs, labels), F.col("text")) < threshold)
