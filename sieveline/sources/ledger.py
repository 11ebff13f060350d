"""Ledger lines, batch drops, trend logs, id maps and audit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING, DOUBLE, INT, LONG = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()


def _fields(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


FACT = _fields(target=STRING, ligand=STRING, score=DOUBLE, exh=INT)
LEDGER_SCHEMA = FACT
DROP_SCHEMA = _fields(
    round=INT, batch_id=INT, exh=INT, timestamp=STRING,
    kept=T.ArrayType(FACT), near_miss=T.ArrayType(FACT), pruned=T.ArrayType(FACT))
TREND_SCHEMA = _fields(
    type=STRING, round=INT, batch_id=INT, timestamp=STRING, cum_hits=LONG, new_hits_this_batch=LONG,
    best_score=DOUBLE, n_ligands_docked=LONG, prev_near_misses=LONG, upgraded=LONG, upgrade_rate=DOUBLE)

ENTRY = _fields(value=STRING, description=STRING)
AUDIT_SCHEMA = _fields(steps=T.MapType(STRING, _fields(
    started=STRING, completed=STRING, elapsed_sec=DOUBLE,
    params=T.MapType(STRING, ENTRY), stats=T.MapType(STRING, ENTRY),
    api_calls=T.ArrayType(_fields(service=STRING, endpoint=STRING, query=STRING, result_count=INT)),
    warnings=T.ArrayType(_fields(message=STRING)), errors=T.ArrayType(_fields(message=STRING)))))

SECTIONS = ("kept", "near_miss", "pruned")

#: A drop's file name holds its round and batch; the objects themselves lack the round.
DROP_NAME = r"batch_R(\d+)_B(\d+)"
CORRUPT = "_corrupt_record"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Append-only ledger lines; older ones lack ``exh``. Lines that do not parse are skipped, see
    :func:`count_ledger_lines`."""
    return spark.read.schema(LEDGER_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def count_ledger_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n_read, n_skipped) of a ledger's lines."""
    schema = T.StructType([*LEDGER_SCHEMA.fields, T.StructField(CORRUPT, STRING)])
    lines = spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    read = F.col(CORRUPT).isNull() & (F.coalesce(F.length("target"), F.lit(0)) >= 0)
    return lines.agg(F.count_if(read).alias("n_read"), F.count(CORRUPT).alias("n_skipped"))


def explode_drops(drops: DataFrame) -> DataFrame:
    """Facts of batch drops, tagged by section; a fact without ``exh`` takes the drop's."""
    def section(name: str) -> Column:
        listed = F.coalesce(F.col(name), F.array().cast(T.ArrayType(FACT)))
        return F.transform(listed, lambda f: F.struct(F.lit(name).alias("zone"), f.alias("f")))

    tagged = F.concat(*[section(s) for s in SECTIONS])
    rows = drops.select("round", "batch_id", F.col("exh").alias("_file_exh"), F.explode(tagged).alias("_t"))
    return rows.select(
        "round", "batch_id", "_t.f.target", "_t.f.ligand", "_t.f.score",
        F.coalesce("_t.f.exh", "_file_exh").alias("exh"), "_t.zone")


def name_drops(drops: DataFrame) -> DataFrame:
    """Drops with round and batch filled in from their file's name."""
    name = F.col("_metadata.file_path")

    def part(group: int) -> Column:
        return F.regexp_extract(name, DROP_NAME, group).try_cast("int")

    return drops.select(F.coalesce("round", part(1)).alias("round"), F.coalesce("batch_id", part(2)).alias("batch_id"),
                        "exh", *SECTIONS, CORRUPT, name.alias("file"))


def drop_reader(reader, multi_line: bool = True, pattern: str = "*"):
    """A batch or stream reader set up for drops, with text that does not parse kept aside."""
    return (reader.schema(T.StructType([*DROP_SCHEMA.fields, T.StructField(CORRUPT, STRING)])).option("multiLine", multi_line)
            .option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT))


def read_batch_drops(spark: SparkSession, path: str, multi_line: bool = True, pattern: str = "*") -> DataFrame:
    """Facts of all readable batch files below ``path``; :func:`count_drops` tells what was skipped."""
    return explode_drops(name_drops(drop_reader(spark.read, multi_line, pattern).json(path)))


def count_drops(spark: SparkSession, path: str, multi_line: bool = True, pattern: str = "*") -> DataFrame:
    """(file, n_read, n_skipped): drops of each file that parse and that do not."""
    drops = name_drops(drop_reader(spark.read, multi_line, pattern).json(path))
    # Spark refuses to read the column of corrupt text alone, so a section is read beside it
    return drops.groupBy("file").agg(F.count_if(F.col(CORRUPT).isNull() & (F.coalesce(F.size("kept"), F.lit(0)) >= -1)).alias("n_read"),
                                     F.count(CORRUPT).alias("n_skipped"))


def read_trend(spark: SparkSession, path: str) -> DataFrame:
    """Both record kinds of a trend log under one schema; ``kind`` tells them apart."""
    rows = spark.read.schema(TREND_SCHEMA).json(path)
    return rows.withColumn("kind", F.coalesce("type", F.lit("batch"))).withColumn(
        "timestamp", F.try_to_timestamp("timestamp")).drop("type")


def smiles_map(files: DataFrame) -> DataFrame:
    """(ligand, smiles) rows of id-to-structure maps in a ``value`` column."""
    return files.select(F.explode(F.from_json("value", T.MapType(STRING, STRING))).alias("ligand", "smiles"))


def read_smiles_map(spark: SparkSession, path: str) -> DataFrame:
    return smiles_map(spark.read.text(path, wholetext=True))


def audit_log(files: DataFrame) -> DataFrame:
    """Audit logs in a ``value`` column, as their ``steps`` map."""
    return files.select(F.from_json("value", AUDIT_SCHEMA).alias("_l")).select("_l.steps")


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    return audit_log(spark.read.text(path, wholetext=True))
