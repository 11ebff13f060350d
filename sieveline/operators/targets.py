"""Choosing targets: exclusions, novelty, structure and pocket quality, evidence, final rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import Rule, first_match, rule_score
from ..functions.scores import confidence_label, exact_avg, host_risk, search_box, search_effort
from ..functions.text import contains_any, contains_word, joined, matched_terms, percent_text
from ..params import (
    DEFAULTS, DRUGGABLE_CLASSES, ESSENTIAL_PROCESSES, KNOWN_TARGET_KEYWORDS, MEMBRANE_TERMS,
    PRIORITY_CLASSES, ScreenParams)
from ..session import cut_lineage
from .ledger import n
from .ordering import dense_index, rank_in_groups

# Pockets of one target that a single window ranks.
ROWS_PER_WINDOW = 100_000


def words(column: Column) -> Column:
    """A keyword array as one text."""
    return F.array_join(F.coalesce(column, F.array().cast("array<string>")), " ")


def exclude_known(df: DataFrame, keywords: Sequence[str] = KNOWN_TARGET_KEYWORDS,
                  whole_word: bool = False) -> DataFrame:
    """Drop proteins whose name, gene or keywords mention a known target, in any case."""
    text = F.upper(joined(F.col("name"), F.col("gene"), words(F.col("keywords"))))
    terms = [k.upper() for k in keywords]
    known = contains_word(text, terms) if whole_word else contains_any(text, terms)
    return df.where(~known)


def filter_novelty(df: DataFrame, exclude_pdb: bool = False, exclude_chembl: bool = True) -> DataFrame:
    """Keep proteins without registered ligands, and optionally without an experimental structure."""
    if exclude_pdb:
        df = df.where(~F.col("has_structure"))
    if exclude_chembl:
        df = df.where(~F.col("has_ligands"))
    return df


def novelty_counts(df: DataFrame) -> DataFrame:
    """Size of each novelty branch, in one pass."""
    s, l = F.col("has_structure"), F.col("has_ligands")
    return df.agg(
        F.count("*").alias("n_total"), n(s).alias("with_structure"), n(l).alias("with_ligands"),
        n(~s).alias("no_structure"), n(~l).alias("no_ligands"), n(~s & ~l).alias("neither"))


def filter_length(df: DataFrame, low: int | None = None, high: int | None = None,
                  p: ScreenParams = DEFAULTS) -> DataFrame:
    """Sequence length between the limits, both included."""
    return df.where(F.col("length").between(
        p.min_length if low is None else low, p.max_length if high is None else high))


def availability_gate(df: DataFrame, available: DataFrame, order: Sequence[Column] = (),
                      max_check: int | None = None) -> DataFrame:
    """Keep proteins with a predicted structure on record. With ``max_check``, only the first
    rows under ``order`` are looked at and the rest are dropped."""
    checked = df if max_check is None else df.orderBy(*order).limit(max_check)
    return checked.join(available.select("accession"), "accession", "left_semi").withColumn(
        "alphafold_available", F.lit(True))


def novelty_text() -> Column:
    return F.lower(joined(F.col("name"), F.col("function"), F.col("subcellular"), words(F.col("keywords"))))


def score_novelty(df: DataFrame) -> DataFrame:
    """Additive novelty score with its reasons."""
    text = novelty_text()
    has_structure = F.col("has_structure")
    druggable = first_match([(F.contains(text, F.lit(c)), c) for c in DRUGGABLE_CLASSES])
    score, reasons = rule_score([
        Rule(has_structure, 2, "Experimental PDB structure (+2)"),
        Rule(~has_structure, 2, "No experimental structure (+2)"),
        Rule(~F.col("has_ligands"), 3, "No registered ligands (+3)"),
        Rule(F.coalesce(F.col("function"), F.lit("")) == "", 2, "Unknown function (+2)"),
        Rule(F.coalesce(F.col("alphafold_available"), F.lit(False)) & ~has_structure, 1, "AlphaFold available (+1)"),
        Rule(F.col("length").between(100, 1000), 1, "Ideal docking size (+1)"),
        Rule(druggable.isNotNull(), 1, F.concat(F.lit("Druggable class: "), druggable, F.lit(" (+1)"))),
        Rule(contains_any(text, MEMBRANE_TERMS), 2, "Membrane/receptor protein (+2)"),
        Rule(contains_any(text, ESSENTIAL_PROCESSES), 2, "Essential cellular process (+2)"),
    ])
    return df.withColumn("novelty_score", score).withColumn("novelty_reasons", reasons)


def keyword_class_counts(df: DataFrame, top: int = 50, classes: Sequence[str] = PRIORITY_CLASSES) -> DataFrame:
    """Class mentions among the ``top`` candidates; a candidate may count for several classes."""
    best = df.orderBy(F.desc("novelty_score"), "accession").limit(top)
    text = F.lower(joined(F.col("name"), F.col("function")))
    return best.select(F.explode(matched_terms(text, classes)).alias("class")).groupBy("class").agg(
        F.count("*").alias("n_candidates"))


# --- structures -------------------------------------------------------------------------


def residue_confidence(atoms: DataFrame) -> DataFrame:
    """One row per residue: the confidence on its last alpha-carbon line."""
    alpha = atoms.where((F.col("record") == "ATOM") & (F.col("atom_name") == "CA") & F.col("b").isNotNull())
    return alpha.groupBy("file", "chain", "resnum").agg(F.max_by("b", "line_no").alias("plddt"))


def plddt_summary(atoms: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Mean confidence, confident fraction, suitability and label of each predicted structure."""
    per_file = residue_confidence(atoms).groupBy("file").agg(
        exact_avg(F.col("plddt")).alias("_mean"),
        F.count("*").alias("total_residues"),
        n(F.col("plddt") >= p.min_plddt).alias("high_conf_residues"),
    )
    fraction = F.col("high_conf_residues") / F.col("total_residues")
    return per_file.select(
        "file", F.round("_mean", 2).alias("mean_plddt"), "total_residues", "high_conf_residues",
        F.round(fraction, 3).alias("high_conf_fraction"),
        ((F.col("_mean") >= p.min_plddt_mean) & (fraction >= p.min_plddt_fraction)).alias("suitable"),
        confidence_label(F.col("_mean"), fraction).alias("quality_label"),
    )


def residue_bands(atoms: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Residues with their confidence band, kept as rows."""
    return residue_confidence(atoms).withColumn(
        "band", F.when(F.col("plddt") >= p.min_plddt, "high").otherwise("low"))


def experimental_quality(atoms: DataFrame) -> DataFrame:
    """Alpha-carbon count of experimental structures; they carry no confidence values."""
    alpha = (F.col("record") == "ATOM") & (F.col("atom_name") == "CA")
    counted = atoms.groupBy("file").agg(n(alpha).alias("total_residues"))
    return counted.select(
        "file", "total_residues", (F.col("total_residues") > 0).alias("suitable"),
        F.when(F.col("total_residues") > 0, "EXPERIMENTAL").alias("quality_label"),
        F.lit(None).cast("double").alias("mean_plddt"))


def choose_structure(proteins: DataFrame, experimental: DataFrame, predicted: DataFrame) -> DataFrame:
    """Experimental structure where there is one, else the predicted one, with a status.

    ``experimental`` and ``predicted`` have (accession, file, suitable, mean_plddt, quality_label);
    a null ``suitable`` marks a file that could not be read.
    """
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select("accession", F.struct("file", "suitable", "mean_plddt", "quality_label").alias(tag))

    both = proteins.join(side(experimental, "_e"), "accession", "left").join(side(predicted, "_p"), "accession", "left")
    wants = F.col("has_structure") & (F.size(F.coalesce(F.col("pdb_ids"), F.array().cast("array<string>"))) > 0)
    use_experimental = wants & F.coalesce(F.col("_e.suitable"), F.lit(False))
    picked = F.when(use_experimental, F.col("_e")).otherwise(F.col("_p"))
    source = first_match([
        (use_experimental, "experimental"),
        (F.col("_p").isNotNull() & wants, "alphafold_fallback"),
        (F.col("_p").isNotNull(), "alphafold"),
    ])
    status = first_match([
        (F.col("_s").isNull() & wants, "NO_STRUCTURE"),
        (F.col("_s").isNull(), "NO_ALPHAFOLD"),
        (F.col("_s.suitable").isNull(), "PARSE_FAILED"),
    ], "OK")
    return (
        both.withColumn("_s", picked).withColumn("structure_source", source)
        .withColumn("structure_status", status)
        .withColumn("mean_plddt", F.col("_s.mean_plddt"))
        .withColumn("structure_quality", F.col("_s.quality_label"))
        .withColumn("suitable", F.coalesce(F.col("_s.suitable"), F.lit(False)))
        .drop("_e", "_p", "_s")
    )


def structure_counts(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("structure_status", "structure_source").agg(
        F.count("*").alias("n_proteins"), n(F.col("suitable")).alias("n_suitable"))


# --- pockets and boxes ------------------------------------------------------------------


def druggable(pockets: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Pockets that are druggable and large enough; unknown values count as zero."""
    return pockets.where(
        (F.coalesce("score", F.lit(0.0)) >= p.min_druggability)
        & (F.coalesce("volume", F.lit(0.0)) >= p.min_pocket_volume))


def filter_pockets(pockets: DataFrame, p: ScreenParams = DEFAULTS, rows_per_window: int = ROWS_PER_WINDOW) -> DataFrame:
    """Druggable pockets, ranked by volume: the largest is primary, the others allosteric.

    A target has a handful of pockets, so a window ranks them. Targets of over ``rows_per_window`` are counted first
    and ranked over ranges instead.
    """
    good, order = druggable(pockets, p), [F.desc("volume"), F.col("pocket_id")]
    hot = cut_lineage(good.groupBy("target").count().where(F.col("count") > rows_per_window).select(F.col("target").alias("_hot")), "hot-targets")
    in_window = F.row_number().over(Window.partitionBy("target").orderBy(*order))
    if hot.isEmpty():
        ranked = good.withColumn("pocket_rank", in_window)
    else:
        is_hot = F.col("target").eqNullSafe(F.col("_hot"))
        ranked = good.join(hot, is_hot, "left_anti").withColumn("pocket_rank", in_window).unionByName(
            rank_in_groups(good.join(hot, is_hot, "left_semi"), ["target"], order, "pocket_rank"))
    place = F.col("pocket_rank")
    return ranked.withColumn("pocket_rank", place - 1).withColumn(
        "site_type", F.when(place == 0, "PRIMARY").otherwise(F.concat(F.lit("ALLOSTERIC_"), place)),
    ).withColumn("allosteric_candidate", place > 0)


def pocket_counts(good: DataFrame) -> DataFrame:
    """Druggable pockets of each target that has any, and how many of them are secondary."""
    return good.groupBy("target").agg(F.count("*").alias("druggable_pockets")).withColumn(
        "allosteric_sites", F.col("druggable_pockets") - 1)


def merge_pocket_source(pockets: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """Replace the rows of one source on the targets that were run again."""
    again = new.select("target").distinct().withColumn("source", F.lit(source))
    return pockets.join(again, ["target", "source"], "left_anti").unionByName(
        new.withColumn("source", F.lit(source)), allowMissingColumns=True)


def top_pocket_score(pockets: DataFrame) -> DataFrame:
    return pockets.groupBy("target").agg(F.max("score").alias("top_score"), F.count("*").alias("n_pockets"))


def best_pocket(pockets: DataFrame, min_volume: float = 100.0) -> DataFrame:
    """Most druggable pocket of at least ``min_volume``; of any size where none is."""
    big = F.coalesce("volume", F.lit(0.0)) >= min_volume
    picked = F.min_by(
        F.struct("pocket_id", "score", "volume"),
        F.struct((~big).alias("small"), (-F.coalesce("score", F.lit(0.0))).alias("s"), F.col("pocket_id")))
    return pockets.groupBy("target").agg(picked.alias("_p")).select("target", "_p.pocket_id", "_p.score", "_p.volume")


def pocket_center(pocket_atoms: DataFrame, protein_atoms: DataFrame) -> DataFrame:
    """Mean position of the pocket's atoms, or of the whole protein where no pocket is known."""
    def center(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("target").agg(*[exact_avg(F.col(a)).alias(f"{tag}_{a}") for a in "xyz"])

    both = center(protein_atoms, "_a").join(center(pocket_atoms, "_p"), "target", "full_outer")
    return both.select("target", *[
        F.round(F.coalesce(f"_p_{a}", f"_a_{a}"), 3).alias(f"center_{a}") for a in "xyz"])


def with_search_box(df: DataFrame, mode: str = "ceil", p: ScreenParams = DEFAULTS) -> DataFrame:
    """Box edge and search effort from a ``volume`` column."""
    return df.withColumn("vina_box_size", search_box(F.col("volume"), mode, p)).withColumn(
        "exh", search_effort(F.col("vina_box_size"), p))


def effort_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("exh").agg(F.count("*").alias("n_targets"))


# --- evidence and final rank ------------------------------------------------------------


def host_identity(long: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Highest identity over the hosts with a value, which host it is, and the risk label."""
    known = long.where(F.col("identity").isNotNull())
    out = known.groupBy("accession").agg(
        F.count("*").alias("n_hosts"), F.max(F.struct("identity", "host")).alias("_m"))
    return out.select(
        "accession", "n_hosts", F.col("_m.identity").alias("max_identity"), F.col("_m.host").alias("closest_host"),
        host_risk(F.col("_m.identity"), p).alias("host_risk"))


def host_identity_map(long: DataFrame, hosts: Sequence[str]) -> DataFrame:
    """One column per host, from the long table."""
    return long.groupBy("accession").agg(
        *[F.max(F.when(F.col("host") == h, F.col("identity"))).alias(f"identity_{h}") for h in hosts])


def newly_risky(old: DataFrame, new: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Targets whose highest host identity crossed the limit between two searches."""
    before = old.select("accession", F.col("max_identity").alias("old_identity"))
    after = new.select("accession", F.col("max_identity").alias("new_identity"))
    limit = p.identity_medium
    return after.join(before, "accession", "left").where(
        (F.col("new_identity") > limit) & (F.coalesce("old_identity", F.lit(0.0)) <= limit))


def risk_label(has_sequence: Column, searched: Column, identity: Column, p: ScreenParams = DEFAULTS) -> Column:
    """Risk including the states in which no identity is known."""
    return first_match([
        (~has_sequence, "NO_SEQUENCE"),
        (~searched, "SKIPPED"),
        (identity.isNull(), "ERROR"),
    ], host_risk(identity, p))


def final_score(df: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Novelty score plus pocket, homology, literature and confidence evidence."""
    pockets = F.coalesce(F.col("druggable_pockets"), F.lit(0))
    sites = F.coalesce(F.col("allosteric_sites"), F.lit(0))
    ident, plddt = F.col("max_identity"), F.col("mean_plddt")
    whole = F.concat(percent_text(ident, 0), F.lit("%"))
    score, reasons = rule_score([
        Rule(pockets >= 3, 4, F.concat(pockets, F.lit(" druggable pockets (+4)"))),
        Rule(pockets == 2, 3, "2 druggable pockets (+3)"),
        Rule(pockets == 1, 2, "1 druggable pocket (+2)"),
        Rule(sites >= 2, 3, F.concat(sites, F.lit(" allosteric sites (+3)"))),
        Rule(sites == 1, 2, "1 allosteric site (+2)"),
        Rule(ident < p.identity_low, 4, "Below 20% host homology (+4)"),
        Rule((ident >= p.identity_low) & (ident < p.identity_medium), 2,
             F.concat(F.lit("Low host homology "), whole, F.lit(" (+2)"))),
        Rule(ident >= p.identity_high, -5, F.concat(F.lit("HIGH host homology "), whole, F.lit(" (-5)"))),
        Rule(F.col("rnai_evidence"), 4,
             F.concat(F.lit("RNAi lethality evidence "), F.col("rnai_count"), F.lit(" papers (+4)"))),
        Rule(plddt.isNull(), 2, "Experimental structure (+2)"),
        Rule(plddt >= 90, 2, "Excellent pLDDT (+2)"),
        Rule((plddt >= 80) & (plddt < 90), 1, "Good pLDDT (+1)"),
    ], start=F.coalesce(F.col("novelty_score"), F.lit(0)),
        reasons=F.coalesce(F.col("novelty_reasons"), F.array().cast("array<string>")))
    return df.withColumn("final_score", score).withColumn("score_reasons", reasons)


def rank_targets(df: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Dense global rank by final score, identity as percent text, and the risk label."""
    ranked = dense_index(df, [F.desc("final_score"), F.col("accession")], "rank", start=1)
    return ranked.withColumn("host_identity_pct", percent_text(F.col("max_identity"))).withColumn(
        "host_risk", host_risk(F.col("max_identity"), p))


def rank_totals(ranked: DataFrame) -> DataFrame:
    return ranked.agg(
        F.count("*").alias("n_targets"), n(F.col("host_risk") == "HIGH").alias("n_high_risk"),
        n(F.col("rnai_evidence")).alias("n_rnai"))


def target_roster(ranked: DataFrame, configs: DataFrame, others: Sequence[DataFrame] = ()) -> DataFrame:
    """Ranked targets that have a box, then targets known only from boxes or further lists.

    The first source that names a target wins; ``source_no`` keeps the order of the sources.
    """
    boxed = configs.select("target").distinct()
    known = ranked.join(boxed, "target", "left_semi").select("target", "name")
    sources = [known, boxed, *[o.select("target").distinct() for o in others]]
    tagged = [
        s.select("target", (F.col("name") if "name" in s.columns else F.lit(None).cast("string")).alias("name"),
                 F.lit(i).alias("source_no"))
        for i, s in enumerate(sources)
    ]
    merged = tagged[0]
    for t in tagged[1:]:
        merged = merged.unionByName(t)
    return merged.groupBy("target").agg(F.min(F.struct("source_no", "name")).alias("_m")).select(
        "target", "_m.source_no", F.coalesce("_m.name", F.col("target").cast("string")).alias("name"))


def stage_funnel(stages: Sequence[tuple[str, Column]], df: DataFrame) -> DataFrame:
    """Rows that pass each stage on top of all before it, counted in one scan."""
    passed, counts = F.lit(True), []
    for name, predicate in stages:
        passed = passed & F.coalesce(predicate, F.lit(False))
        counts.append(n(passed).alias(name))
    wide = df.agg(*counts)
    order = F.array(*[
        F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage"), F.col(s).alias("n_rows"))
        for i, (s, _) in enumerate(stages)])
    return wide.select(F.inline(order))


def proteome_counts(df: DataFrame) -> DataFrame:
    """What the proteome holds: structures, ligands, and proteins without a function."""
    return df.agg(
        F.count("*").alias("n_proteins"), n(F.col("has_structure")).alias("with_structure"),
        n(F.col("has_ligands")).alias("with_ligands"),
        n(F.coalesce(F.col("function"), F.lit("")) == "").alias("no_function"))
