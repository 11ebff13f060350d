"""Report sinks. Files are written by the executors, one per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Delimited text with a header."""
    df.write.mode("overwrite").option("sep", sep).option("header", True).option("emptyValue", "").csv(path)


def write_ranked_csv(report: DataFrame, path: str) -> None:
    write_table(report, path, sep=",")


def write_json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows laid out by key for a partitioned write. Adaptive execution cuts a key that holds much of
    the rows into as many tasks as its size asks for, and joins small keys into one."""
    return df.hint("rebalance", *[F.col(k) for k in keys])


def write_per_target(hits: DataFrame, path: str) -> None:
    """Hits in one folder per target."""
    _spread(hits, "target").write.mode("overwrite").partitionBy("target").json(path)


def read_per_target(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What :func:`write_per_target` wrote. Folders are listed by a few tasks for each core; by default Spark starts a
    task for every folder, which costs more than to list it."""
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(4 * spark.sparkContext.defaultParallelism))
    try:
        return spark.read.schema(schema).json(path)
    finally:
        spark.conf.set(setting, before)


def write_facts(facts: DataFrame, path: str) -> None:
    """The fact table in its query layout: a folder per round and batch, for pruning. Rewrites
    only the batches that are present."""
    (_spread(facts, "round", "batch_id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("round", "batch_id").parquet(path))
