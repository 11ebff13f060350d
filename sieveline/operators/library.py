"""Choosing compounds: named libraries, the drug-likeness funnel and ADMET columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chem
from ..functions.rules import first_match
from ..params import DEFAULTS, LIBRARY_MODES, SCAFFOLD_LABELS, ScreenParams
from .ledger import n
from .ordering import keep_first

STAGES = ("no_structure", "lipinski", "pains", "qed", "already_prepared", "passed")


def base_predicate(p: ScreenParams = DEFAULTS) -> Column:
    return (
        F.col("mw").between(p.min_mw, p.max_mw) & (F.col("logp") <= p.max_logp)
        & (F.col("hbd") <= p.max_hbd) & (F.col("hba") <= p.max_hba)
        & (F.col("num_ro5_violations") <= p.max_ro5_violations)
        & (F.col("smiles") != "")
    )


def mode_predicate(mode: str, use_fallback: bool = False) -> Column:
    want = LIBRARY_MODES[mode]
    checks = {
        "max_phase": lambda v: F.col("max_phase") == v,
        "min_phase": lambda v: F.col("max_phase") >= v,
        "atc_level1": lambda v: F.col("atc_level1") == v,
        "atc_level2": lambda v: F.col("atc_level1") == want["fallback"] if use_fallback else F.col("atc_level2") == v,
        "natural_product": lambda v: F.col("natural_product") == v,
    }
    out = F.lit(True)
    for name, value in want.items():
        if name in checks:
            out = out & checks[name](value)
    return out


def select_library(compounds: DataFrame, mode: str = "druglike", offset: int = 0, limit: int | None = None,
                   p: ScreenParams = DEFAULTS) -> DataFrame:
    """Compounds of a named library in id order from ``offset``.

    A library by fine class falls back to its coarse class when the fine one is empty; the test
    for that is a scalar subquery of the same plan.
    """
    base = compounds.where(base_predicate(p))
    chosen = mode_predicate(mode)
    if "fallback" in LIBRARY_MODES[mode]:
        fine = base.where(chosen).limit(1).agg(F.count("*")).scalar()
        chosen = F.when(fine > 0, chosen).otherwise(mode_predicate(mode, use_fallback=True))
    picked = base.where(chosen)
    if not offset and limit is None:
        return picked
    ordered = picked.orderBy("ligand")
    return (ordered.offset(offset) if offset else ordered).limit(limit) if limit is not None else ordered.offset(offset)


def first_source(sources: Sequence[DataFrame]) -> DataFrame:
    """The first library source that has any rows, decided inside one plan."""
    out = None
    earlier = F.lit(0)
    for s in sources:
        size = s.limit(1).agg(F.count("*")).scalar()
        part = s.where(earlier == 0)
        out = part if out is None else out.unionByName(part)
        earlier = earlier + size
    return out


def fail_stage(p: ScreenParams = DEFAULTS) -> Column:
    """First stage of the funnel a compound does not get through."""
    strict = chem.lipinski_strict(F.col("mw"), F.col("hbd"), F.col("hba"), F.col("logp"), F.col("rotbonds"), p)
    return first_match([
        (F.coalesce(F.col("smiles"), F.lit("")) == "", "no_structure"),
        (~strict, "lipinski"),
        (F.col("pains"), "pains"),
        (F.col("qed") < p.min_qed, "qed"),
        (F.col("prepared"), "already_prepared"),
    ], "passed")


def library_funnel(compounds: DataFrame, prepared: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Each compound with the stage it stops at; missing descriptors count as passing."""
    done = prepared.select("ligand").distinct().withColumn("_done", F.lit(True))
    joined = compounds.join(done, "ligand", "left").withColumn("prepared", F.col("_done").isNotNull()).drop("_done")
    return joined.withColumn("fail_stage", fail_stage(p))


def funnel_counts(staged: DataFrame) -> DataFrame:
    return staged.groupBy("fail_stage").agg(F.count("*").alias("n_compounds"))


def funnel_work(staged: DataFrame, target_count: int) -> DataFrame:
    """New compounds to prepare, in id order, until prepared and new reach ``target_count``.

    Prepared compounds count where they come up in that order, so a compound is taken while its
    position among passed and prepared ones is below the target.
    """
    counted = staged.where(F.col("fail_stage").isin("passed", "already_prepared"))
    return counted.orderBy("ligand").limit(target_count).where(F.col("fail_stage") == "passed")


def valid_files(files: DataFrame, min_bytes: int = 500) -> DataFrame:
    """Files large enough to hold a molecule and with at least one atom record."""
    has_atoms = F.contains(F.col("content"), F.lit("ATOM")) | F.contains(F.col("content"), F.lit("HETATM"))
    return files.where((F.col("size") >= min_bytes) & has_atoms)


def admet(compounds: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """All rule columns of the toxicity and drug-likeness report."""
    c = F.col
    out = compounds.select(
        "*",
        chem.ro5_violations(c("mw"), c("hbd"), c("hba"), c("logp"), p).alias("ro5_violations"),
        chem.lipinski_lenient(c("mw"), c("hbd"), c("hba"), c("logp"), p).alias("lipinski"),
        chem.veber(c("tpsa"), c("rotbonds")).alias("veber"),
        chem.egan(c("logp"), c("tpsa")).alias("egan"),
        chem.esol_log_s(c("logp"), c("mw"), c("rotbonds"), c("aromatic_atoms"), c("heavy_atoms")).alias("logs_esol"),
        chem.herg_flag(c("basic_n"), c("aromatic_rings"), c("mw"), c("logp")).alias("herg_flag"),
        chem.alert_flag(c("ames_alerts")).alias("ames_flag"),
        chem.alert_names(c("ames_alerts")).alias("ames_names"),
        chem.alert_flag(c("hepatotox_alerts"), weak=None).alias("hepatotox_flag"),
        F.array_join(F.coalesce(c("hepatotox_alerts"), F.array().cast("array<string>")), "|").alias("hepatotox_names"),
    )
    return out.withColumn("admet_flag", chem.overall_flag(
        c("herg_flag"), c("ames_flag"), c("hepatotox_flag"), c("pains"), c("brenk")))


def admet_counts(report: DataFrame) -> DataFrame:
    """How many compounds carry each concern."""
    flag = F.col("admet_flag")
    return report.agg(
        F.count("*").alias("n_compounds"),
        n(flag == "CLEAN").alias("n_clean"),
        n(F.contains(flag, F.lit("hERG"))).alias("n_herg"),
        n(F.contains(flag, F.lit("AMES"))).alias("n_ames"),
        n(F.contains(flag, F.lit("Hepatotox"))).alias("n_hepatotox"),
        n(F.contains(flag, F.lit("PAINS"))).alias("n_pains"),
    )


def scaffold_class(flags: Column, labels: Sequence[str] = SCAFFOLD_LABELS) -> Column:
    """First label, in order, that is among the matched scaffold flags."""
    return first_match([(F.array_contains(flags, label), label) for label in labels], "Other")


def scaffold_classes(hits: DataFrame, flags: str, labels: Sequence[str] = SCAFFOLD_LABELS) -> DataFrame:
    """Class of each ligand, on its best-scored hit."""
    once = keep_first(hits, ["ligand"], ["score", "target"])
    return once.withColumn("scaffold_class", scaffold_class(F.col(flags), labels))


def scaffold_freq(hits: DataFrame, scaffold: str = "murcko_scaffold") -> DataFrame:
    """How often each scaffold occurs; rows without one are left out."""
    return hits.where(F.coalesce(F.col(scaffold), F.lit("")) != "").groupBy(scaffold).agg(
        F.count("*").alias("n_hits"))


def scaffold_summary(freq: DataFrame) -> DataFrame:
    return freq.agg(
        F.count("*").alias("n_unique"), n(F.col("n_hits") == 1).alias("n_singletons"),
        F.coalesce(F.sum("n_hits"), F.lit(0)).cast("bigint").alias("n_total"),
    ).withColumn("diversity", F.round(F.try_divide(F.col("n_unique"), F.col("n_total")), 4))
