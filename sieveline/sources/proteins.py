"""Protein records: nested JSON entries, FASTA in and out, comment texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING = T.StringType()
VALUE = T.StructType([T.StructField("value", STRING)])
FULL_NAME = T.StructType([T.StructField("fullName", VALUE)])

ENTRY_SCHEMA = T.StructType([
    T.StructField("primaryAccession", STRING),
    T.StructField("proteinDescription", T.StructType([
        T.StructField("recommendedName", FULL_NAME),
        T.StructField("submittedNames", T.ArrayType(FULL_NAME)),
        T.StructField("submissionNames", T.ArrayType(FULL_NAME)),
    ])),
    T.StructField("genes", T.ArrayType(T.StructType([T.StructField("geneName", VALUE)]))),
    T.StructField("sequence", T.StructType([T.StructField("value", STRING), T.StructField("length", T.IntegerType())])),
    T.StructField("uniProtKBCrossReferences", T.ArrayType(T.StructType([
        T.StructField("database", STRING), T.StructField("id", STRING)]))),
    T.StructField("comments", T.ArrayType(T.StructType([
        T.StructField("commentType", STRING), T.StructField("texts", T.ArrayType(VALUE))]))),
    T.StructField("keywords", T.ArrayType(T.StructType([T.StructField("name", STRING)]))),
    T.StructField("entryType", STRING),
    T.StructField("annotationScore", T.DoubleType()),
])

PROTEIN_SCHEMA = T.StructType([
    T.StructField("accession", STRING), T.StructField("name", STRING), T.StructField("gene", STRING),
    T.StructField("species", STRING), T.StructField("latin", STRING), T.StructField("length", T.IntegerType()),
    T.StructField("sequence", STRING), T.StructField("pdb_ids", T.ArrayType(STRING)),
    T.StructField("chembl_ids", T.ArrayType(STRING)), T.StructField("function", STRING),
    T.StructField("subcellular", STRING), T.StructField("catalytic", STRING),
    T.StructField("keywords", T.ArrayType(STRING)), T.StructField("has_structure", T.BooleanType()),
    T.StructField("has_ligands", T.BooleanType()),
])


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Raw entries, one JSON object per line, with the declared schema."""
    return spark.read.schema(ENTRY_SCHEMA).json(path)


def _of_type(kind: str) -> Column:
    return F.filter("comments", lambda c: c["commentType"] == kind)


def first_comment(kind: str) -> Column:
    """First text of the first comment of a kind."""
    texts = F.try_element_at(_of_type(kind), F.lit(1))["texts"]
    return F.coalesce(F.try_element_at(texts, F.lit(1))["value"], F.lit(""))


def comment_text(kind: str) -> Column:
    """All texts of all comments of a kind, in order."""
    values = F.flatten(F.transform(_of_type(kind), lambda c: F.transform(c["texts"], lambda t: t["value"])))
    return F.array_join(F.coalesce(values, F.array().cast("array<string>")), ". ")


def _references(database: str) -> Column:
    kept = F.filter("uniProtKBCrossReferences", lambda x: x["database"] == database)
    return F.coalesce(F.transform(kept, lambda x: x["id"]), F.array().cast("array<string>"))


def flatten_entries(entries: DataFrame, species: str, latin: str) -> DataFrame:
    """Entries as protein rows."""
    description = F.col("proteinDescription")

    def first_name(field: str) -> Column:
        return F.try_element_at(description[field], F.lit(1))["fullName"]["value"]

    name = F.coalesce(description["recommendedName"]["fullName"]["value"],
                      first_name("submittedNames"), first_name("submissionNames"), F.lit(""))
    out = entries.select(
        F.col("primaryAccession").alias("accession"), name.alias("name"),
        F.coalesce(F.try_element_at("genes", F.lit(1))["geneName"]["value"], F.lit("")).alias("gene"),
        F.lit(species).alias("species"), F.lit(latin).alias("latin"),
        F.coalesce("sequence.length", F.lit(0)).alias("length"),
        F.coalesce("sequence.value", F.lit("")).alias("sequence"),
        _references("PDB").alias("pdb_ids"), _references("ChEMBL").alias("chembl_ids"),
        first_comment("FUNCTION").alias("function"), first_comment("SUBCELLULAR LOCATION").alias("subcellular"),
        first_comment("CATALYTIC ACTIVITY").alias("catalytic"),
        F.coalesce(F.transform("keywords", lambda k: k["name"]), F.array().cast("array<string>")).alias("keywords"),
    )
    return out.withColumn("has_structure", F.size("pdb_ids") > 0).withColumn("has_ligands", F.size("chembl_ids") > 0)


def read_proteome(spark: SparkSession, path: str, species: str = "", latin: str = "") -> DataFrame:
    return flatten_entries(read_entries(spark, path), species, latin)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, accession, description, sequence), one row per record.

    A record ends where a line starts with ``>``, so the files split by record and a ``>`` inside
    a header does no harm. ``db|ACC|name``, ``ACC|gene|name`` and ``ACC text`` headers are told
    apart by the short database tag.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace(F.regexp_replace("value", "\r", ""), r"^>", "")
    split = raw.select(F.split(record, "\n", 2).alias("_r")).where(F.trim(F.col("_r")[0]) != "")
    header, body = F.col("_r")[0], F.coalesce(F.try_element_at("_r", F.lit(2)), F.lit(""))
    words = F.split(F.trim(header), " ", 2)
    parts = F.split(words[0], r"\|")
    tagged = (F.size(parts) > 1) & parts[0].isin("sp", "tr")
    return split.select(
        header.alias("header"), F.when(tagged, F.try_element_at(parts, F.lit(2))).otherwise(parts[0]).alias("accession"),
        F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")).alias("description"),
        F.upper(F.regexp_replace(body, r"\s+", "")).alias("sequence"))


def fasta_records(df: DataFrame, width: int = 60) -> DataFrame:
    """Records as text, sequences wrapped at ``width``; proteins without a sequence are left out."""
    header = F.concat(F.lit(">"), F.concat_ws("|", F.col("accession"), F.col("gene"), F.left("name", F.lit(60))))
    wrapped = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    return df.where(F.coalesce(F.col("sequence"), F.lit("")) != "").select(
        F.concat(header, F.lit("\n"), wrapped).alias("value"))


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    fasta_records(df, width).write.mode("overwrite").text(path)
