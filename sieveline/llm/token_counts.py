"""Token counts by a lookup in two tiers, both on the map side.

The lengths of frequent pre-tokens are broadcast as one table of a fixed greatest size. Others are encoded once
by each worker and kept in its cache. No pre-token is shuffled. The table is only a cache, fitted
on a bounded sample of texts: any table gives the same counts.

A null text counts as empty: no bytes, no tokens. Repeated rows and equal texts are counted like others, and a
null doc_id stays null. Special strings inside texts are what the library takes them for by default. Other
columns are not looked at.
"""

from __future__ import annotations

from collections import Counter as Tally

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import Counter, load, pieces
from .frames import ship_package

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Texts that the table of frequent pre-tokens is fitted on, and its greatest size.
SAMPLE_TEXTS, TABLE_SIZE = 4_000, 50_000


def frequent_lengths(docs: DataFrame, tokenizer: str = TOKENIZER, texts: int = SAMPLE_TEXTS, size: int = TABLE_SIZE) -> dict[str, int]:
    """Token counts of the pre-tokens that are most frequent in a sample of about ``texts`` texts."""
    def run(batches):
        _, _, pattern = load(tokenizer)
        tally: Tally[str] = Tally()
        for batch in batches:
            for text in batch.column("text"):
                first, *rest = pieces(text.as_py() or "")
                tally.update(pattern.findall(first))
                for piece in rest:
                    tally.update(pattern.findall(" " + piece))
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], ["pre", "n"])

    rows = docs.count()
    sample = docs.select(F.col("text").cast("string")).where("text is not null")
    if rows > texts:
        sample = sample.sample(fraction=texts / rows, seed=1)
    common = (sample.mapInArrow(run, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
              .where("n > 1").orderBy(F.desc("n"), "pre").limit(size).collect())
    loaded, _, _ = load(tokenizer)
    return {r.pre: len(loaded.encode(r.pre, add_special_tokens=False).ids) for r in common}


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer))

    def run(batches):
        count = Counter(tokenizer, shared.value)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()),
                 pa.array([count(x.as_py()) for x in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
        count.forget()

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
