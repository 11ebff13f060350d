"""Jobs for co-folding, report tables and audit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import first_match
from ..functions.text import safe_name
from ..params import STRUCTURE_PAGE
from ..session import cut_lineage
from .hits import look_up


def job_name(target: Column, ligand: Column) -> Column:
    return safe_name(F.concat_ws("_", target.cast("string"), ligand.cast("string")))


def build_jobs(hits: DataFrame, sequences: DataFrame, smiles: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """One job per selected hit: its payload, or the reason it is skipped.

    ``hits`` is already cut to the chosen targets and their best ligands; ``done`` lists the names
    of jobs emitted before.
    """
    named = hits.withColumn("job_name", job_name(F.col("target"), F.col("ligand")))
    if done is not None:
        named = named.join(done.select("job_name"), "job_name", "left_anti")
    named = cut_lineage(named, "jobs")
    joined = look_up(named, sequences.select("target", "sequence"), "target")
    wanted = smiles.select("ligand", "smiles").join(named.select("ligand").distinct(), "ligand", "left_semi")
    joined = joined.join(wanted, "ligand", "left")
    no_sequence = F.coalesce(F.col("sequence"), F.lit("")) == ""
    no_smiles = F.coalesce(F.col("smiles"), F.lit("")) == ""
    return joined.withColumn("skip_reason", first_match([(no_sequence, "no_sequence"), (no_smiles, "no_smiles")]))


def job_payload() -> Column:
    """Nested job description: a protein chain and a ligand."""
    protein = F.struct(F.struct(F.array(F.lit("A")).alias("id"), F.col("sequence")).alias("protein"))
    ligand = F.struct(F.struct(F.array(F.lit("B")).alias("id"), F.col("smiles")).alias("ligand"))
    return F.struct(
        F.col("job_name").alias("name"),
        F.array(F.to_json(protein), F.to_json(ligand)).alias("sequences"),
        F.struct(
            F.col("target").cast("string").alias("target_accession"),
            F.col("ligand").cast("string").alias("ligand_id"), "smiles").alias("meta"))


def with_payload(jobs: DataFrame) -> DataFrame:
    """Runnable jobs with their payload as JSON text."""
    ready = jobs.where(F.col("skip_reason").isNull())
    return ready.withColumn("payload", F.to_json(job_payload()))


def round_jobs(jobs: DataFrame, names: DataFrame, name_chars: int = 55) -> DataFrame:
    """The new runnable jobs of each round for submission: what each is, and the file of its payload.

    ``jobs`` has a ``round``; jobs without one belong to the round "latest".
    """
    ready = look_up(jobs.where(F.col("skip_reason").isNull()), names.select("target", "name"), "target")
    tag = F.coalesce(F.concat(F.lit("round_"), F.col("round").cast("string")), F.lit("latest"))
    return ready.select(
        tag.alias("tag"), "job_name", "target", F.left(F.coalesce("name", F.lit("")), F.lit(name_chars)).alias("target_name"),
        "ligand", "smiles", F.concat(F.col("job_name"), F.lit(".json")).alias("file"))


def round_job_counts(listed: DataFrame) -> DataFrame:
    return listed.groupBy("tag").agg(F.count("*").alias("n_jobs"))


def ranked_report(ranked: DataFrame, n_reasons: int = 3) -> DataFrame:
    """The published columns of the target table: short names, the structure's page and the leading reasons."""
    return ranked.select(
        "rank", "accession", "gene", F.left("name", F.lit(80)).alias("name"), "length", "mean_plddt",
        "structure_quality", "druggable_pockets", "allosteric_sites", "host_identity_pct", "host_risk",
        "rnai_evidence", "rnai_count", "final_score",
        F.concat(F.lit(STRUCTURE_PAGE), F.coalesce(F.col("accession").cast("string"), F.lit(""))).alias("structure_url"),
        F.array_join(F.slice("score_reasons", 1, n_reasons), " | ").alias("top_score_reasons"))


def slim(df: DataFrame, columns: tuple[str, ...] = ("sequence", "high_conf_residues")) -> DataFrame:
    """Drop the bulky columns before saving."""
    return df.drop(*columns)


def step_rows(log: DataFrame) -> DataFrame:
    """One row per step of an audit log."""
    return log.select(F.explode("steps").alias("step", "s"))


def audit_summary(log: DataFrame) -> DataFrame:
    """Timing and number of warnings, errors and calls of each step."""
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    return step_rows(log).select(
        "step", F.col("s.started").alias("started"), F.col("s.elapsed_sec").alias("elapsed_sec"),
        size("s.warnings").alias("n_warnings"), size("s.errors").alias("n_errors"), size("s.api_calls").alias("n_api_calls"))


def audit_parameters(log: DataFrame) -> DataFrame:
    """Every parameter of every step."""
    return step_rows(log).select("step", F.explode("s.params").alias("parameter", "p")).select(
        "step", "parameter", F.col("p.value").alias("value"), F.col("p.description").alias("description"))


def audit_statistics(log: DataFrame) -> DataFrame:
    """Every statistic of every step."""
    return step_rows(log).select("step", F.explode("s.stats").alias("statistic", "p")).select(
        "step", "statistic", F.col("p.value").alias("value"), F.col("p.description").alias("description"))
