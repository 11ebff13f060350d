"""Incremental forms of the ledger and hit tables over files that land batch by batch.

Stateful operators return streaming DataFrames. The sinks write every micro-batch into its own
``epoch=`` folder and only read earlier ones, so a replayed micro-batch rewrites what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scores import stored_exhaustiveness
from ..operators.ledger import PAIR, n
from ..operators.ordering import running_by_round
from ..params import DEFAULTS, ScreenParams
from ..session import cut_lineage
from ..sources.ledger import drop_reader, explode_drops, name_drops


def stream_drops(spark: SparkSession, path: str, files_per_trigger: int | None = None, multi_line: bool = True) -> DataFrame:
    """Facts from batch drops as they land: one JSON object a file, or one a line without ``multi_line``.

    Operator state of queries over them is kept in RocksDB.
    """
    keep_state_on_disk(spark)
    reader = drop_reader(spark.readStream, multi_line)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return explode_drops(name_drops(reader.json(path)))


def keep_state_on_disk(spark: SparkSession) -> None:
    """Keep operator state in RocksDB. Pair state grows with the campaign and should not have to
    fit the executors' heaps. Its rows are not counted, which would look up every key once more before it is written."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")


# --- stateful operators -----------------------------------------------------------------


def best_scores(facts: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Best score and first (round, batch) of every hit pair so far; for update or complete mode."""
    return facts.where(F.col("score") <= p.hit_score).groupBy(*PAIR).agg(
        F.min("score").alias("score"), F.min(F.struct("round", "batch_id")).alias("first_seen"))


def first_hits(facts: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """A pair the first time it is a hit in its round."""
    return facts.where(F.col("score") <= p.hit_score).dropDuplicates(["round", *PAIR])


def new_rows(rows: DataFrame, key: str) -> DataFrame:
    """Each key the first time it comes; the keys seen so far are operator state, so history is not read again."""
    keep_state_on_disk(rows.sparkSession)
    return rows.dropDuplicates([key])


def ledger_effort(facts: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Highest search effort per pair so far."""
    return facts.groupBy(*PAIR).agg(F.max(stored_exhaustiveness(F.col("exh"), F.col("score"), p)).alias("exh"))


def windowed_hits(events: DataFrame, window: str = "1 day", delay: str = "1 day",
                  p: ScreenParams = DEFAULTS) -> DataFrame:
    """Facts, hits and best score per event-time window of a ``ts`` column; in append mode a window is written
    once, when the watermark has passed it, and its state goes."""
    keep_state_on_disk(events.sparkSession)
    return (
        events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w")).agg(
            F.count("*").alias("n_facts"), n(F.col("score") <= p.hit_score).alias("n_hits"),
            F.min("score").alias("best_score"))
        .select(F.col("w.start").alias("window_start"), "n_facts", "n_hits", "best_score")
    )


# --- sinks ------------------------------------------------------------------------------


def epoch_path(path: str, epoch: int) -> str:
    return f"{path.rstrip('/')}/epoch={epoch}"


def read_epochs(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame:
    """Rows of the sink with their ``epoch``; empty before anything was written."""
    try:
        rows = spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).withColumn("epoch", F.lit(0))
    if "epoch" not in rows.columns:
        rows = rows.withColumn("epoch", F.lit(0))
    return rows if before is None else rows.where(F.col("epoch") < before)


def write_epoch(df: DataFrame, path: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(epoch_path(path, epoch))


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
          mode: str = "append", available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch as its own epoch folder."""
    def sink(batch: DataFrame, epoch: int) -> None:
        write_epoch(batch, path, epoch)
    return sink


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Current value of each key from the output of an update-mode query."""
    rest = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "epoch").alias(c) for c in rest])


def pair_trend(pairs: DataFrame) -> DataFrame:
    """One row per (round, batch_id) from the latest state of :func:`best_scores`: its new hits, the hits
    so far and the best score so far.

    A pair counts in the earliest batch that has it, in whatever order and in however many files the
    batches came, and however often a micro-batch was replayed. Batches without a new hit have no row.
    """
    batches = pairs.groupBy("first_seen").agg(F.count("*").alias("new_hits"), F.min("score").alias("best")).select(
        "first_seen.round", "first_seen.batch_id", "new_hits", "best")
    return running_by_round(cut_lineage(batches, "trend"), sums={"cum_hits": "new_hits"}, mins={"best_score": "best"}).select(
        "round", "batch_id", "new_hits", "cum_hits", "best_score")


def partials_sink(path: str, partials: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """What ``partials`` makes of each micro-batch, as its own epoch folder: a replay writes the same rows again.

    The facts themselves are read once, when they come; tables over all of them are merged from the partials.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        write_epoch(partials(batch), path, epoch)
    return sink


def refresh_every(every: int, refresh: Callable[[int], None],
                  sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Run ``refresh`` after each ``every`` micro-batches, over what they wrote.

    It runs when the next micro-batch arrives; call ``refresh`` itself once more when the stream has ended.
    """
    def wrapped(batch: DataFrame, epoch: int) -> None:
        if epoch and epoch % every == 0:
            refresh(epoch)
        sink(batch, epoch)
    return wrapped


def refresh_from(spark: SparkSession, parts: str, schema, merge: Callable[[DataFrame], DataFrame], table: str) -> Callable[[int | None], None]:
    """A refresh that writes what ``merge`` makes of the partials in ``parts``, up to an epoch or of all, to ``table``."""
    def refresh(epoch: int | None = None) -> None:
        merge(read_epochs(spark, parts, schema, before=epoch)).write.mode("overwrite").parquet(table)
    return refresh


def new_rows_sink(path: str, key: str, schema: str,
                  build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Write what ``build`` makes of a micro-batch, without rows whose key an earlier one wrote."""
    def sink(batch: DataFrame, epoch: int) -> None:
        past = read_epochs(batch.sparkSession, path, schema, before=epoch)
        fresh = build(batch).dropDuplicates([key]).join(past.select(key), key, "left_anti")
        write_epoch(fresh, path, epoch)
    return sink
