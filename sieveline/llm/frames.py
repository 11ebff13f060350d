"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one long each that may be broadcast: 16 bytes a row in a hashed relation, about 16 MB.
BROADCAST_ROWS = 1_000_000
#: Rows of two longs that may be: at most some 10 MB.
BROADCAST_PAIRS = 200_000
_SHIPPED: set[str] = set()


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def ship_package(spark: SparkSession) -> None:
    """Send this library to the executors, as ``--py-files`` would; once for each Spark context."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for where, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sized(ids: DataFrame, rows: int) -> DataFrame:
    """``ids``, marked for broadcast only when it was counted to be small."""
    return F.broadcast(ids) if rows <= BROADCAST_ROWS else ids


def sized(pairs: DataFrame, rows: int) -> DataFrame:
    """``pairs``, rows of two longs, marked for broadcast only when they were counted to be few."""
    return F.broadcast(pairs) if rows <= BROADCAST_PAIRS else pairs


def without_ids(docs: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``ids`` (one column, ``rows`` rows, counted before)."""
    other = ids.toDF("_gone")
    return docs.join(_sized(other, rows), docs["doc_id"] == other["_gone"], "left_anti")


def only_ids(docs: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids`` (one column, ``rows`` rows, counted before)."""
    other = ids.toDF("_wanted")
    return docs.join(_sized(other, rows), docs["doc_id"] == other["_wanted"], "left_semi")


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with a new text, and n_chars to match where that column exists."""
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return docs.withColumns(columns)
