"""Hit tables: best scores, per-target statistics, promiscuity, selection and ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import (
    exact_avg, identity_bucket, score_bin, selectivity_ratio, selectivity_verdict)
from ..params import DEFAULTS, STATIC_EXCLUSIONS, ScreenParams
from ..session import cut_lineage
from .ledger import PAIR, n
from .ordering import ranked_top, tail_counts, top_per_group

BEST_FIRST = ("score", "target", "ligand")


def exclude_ids(df: DataFrame, ids: Sequence | DataFrame, key: str = "ligand") -> DataFrame:
    """Drop rows whose id is listed, from a short list or a table with column ``key``."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key), key, "left_anti")
    listed = F.col(key).cast("string").isin(*map(str, ids)) if ids else F.lit(False)
    return df.where(~F.coalesce(listed, F.lit(False)))


def top_hits(facts: DataFrame, threshold: float | None = None, top: int | None = None,
             exclude: Sequence | DataFrame = STATIC_EXCLUSIONS, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Best score of each (target, ligand) at or below the threshold, with the round it was first
    a hit. The threshold is applied to the facts, so it reaches the scan. Ligands that are known to stick
    to everything are left out by default."""
    cut = p.hit_score if threshold is None else threshold
    hits = exclude_ids(facts.where(F.col("score") <= cut), exclude).groupBy(*PAIR).agg(
        F.min("score").alias("score"), F.min("round").alias("first_seen_round"))
    return hits if top is None else hits.orderBy(*BEST_FIRST).limit(top)


def _by_score(rows: DataFrame, p: ScreenParams) -> DataFrame:
    """Per target: rows, hits, leads and the best (score, ligand), in one pass.

    Rows are first counted for each score of a target with its smallest ligand: a hash aggregation before any shuffle that
    leaves as many rows as a target has different scores, so nothing is read again to look the best one up.
    """
    levels = rows.groupBy("target", "score").agg(F.count("*").alias("_n"), F.min("ligand").alias("ligand"))

    def below(cut: float) -> Column:
        return F.coalesce(F.sum(F.when(F.col("score") <= cut, F.col("_n"))), F.lit(0)).cast("bigint")

    return levels.groupBy("target").agg(
        F.sum("_n").cast("bigint").alias("n_scored"), below(p.hit_score).alias("n_hits"), below(p.lead_score).alias("n_leads"),
        F.min("score").alias("best_score"), F.min_by("ligand", "score").alias("best_ligand"))  # a target has each score once


def target_partials(facts: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """(target, n_scored, n_hits, best_score, best_ligand) of some of the facts; see :func:`merge_targets`."""
    return _by_score(facts.where(F.col("score").isNotNull()), p).drop("n_leads")


def _with_rate(totals: DataFrame) -> DataFrame:
    negative = F.col("best_score") < 0
    return totals.select(
        "target", "n_scored", "n_hits", F.round(F.col("n_hits") / F.col("n_scored"), 3).alias("hit_rate"),
        *[F.when(negative, F.col(c)).alias(c) for c in ("best_score", "best_ligand")])


def merge_targets(partials: DataFrame) -> DataFrame:
    """Statistics of all facts from the partials of parts of them, in whatever order and number."""
    merged = partials.groupBy("target").agg(
        F.sum("n_scored").cast("bigint").alias("n_scored"), F.sum("n_hits").cast("bigint").alias("n_hits"),
        F.min(F.struct("best_score", "best_ligand")).alias("_best"))
    return _with_rate(merged.select("target", "n_scored", "n_hits", "_best.best_score", "_best.best_ligand"))


def target_stats(facts: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Per target: scored facts, hits, hit rate, and the best ligand where the best is negative."""
    return _with_rate(target_partials(facts, p))


def merge_hits(partials: DataFrame) -> DataFrame:
    """:func:`top_hits` of all facts from that of parts of them."""
    return partials.groupBy(*PAIR).agg(F.min("score").alias("score"), F.min("first_seen_round").alias("first_seen_round"))


def docking_summary(poses: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Per target: ligands docked, hits, leads and the best pose."""
    per_ligand = poses.where(F.col("score").isNotNull()).groupBy(*PAIR).agg(F.min("score").alias("score"))
    return _by_score(per_ligand, p).select(
        "target", F.col("n_scored").alias("total_docked"), F.col("n_hits").alias("hits"), F.col("n_leads").alias("leads"),
        F.col("best_score").alias("best_energy"), "best_ligand")


def docking_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.sum("total_docked").cast("bigint").alias("total_docked"),
        F.sum("hits").cast("bigint").alias("total_hits"),
        F.sum("leads").cast("bigint").alias("total_leads"),
        n(F.col("hits") > 0).alias("targets_with_hits"),
    )


# --- promiscuity ------------------------------------------------------------------------


def promiscuity(facts: DataFrame, n_targets: int | None = None, fraction: float | None = None,
                only_hits: bool = True, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Every ligand's share of the targets, and whether it is flagged as promiscuous.

    ``n_targets`` defaults to all targets scored in ``facts``.
    """
    cut = p.promiscuous_fraction if fraction is None else fraction
    seen = facts.where(F.col("score") <= p.hit_score) if only_hits else facts.where(F.col("score").isNotNull())
    total = F.lit(n_targets) if n_targets is not None else facts.agg(F.countDistinct("target")).scalar()
    per_ligand = (
        seen.groupBy("ligand", "target").agg(F.min("score").alias("score"))
        .groupBy("ligand").agg(
            F.count("*").alias("n_targets"), F.min("score").alias("best_score"), F.max("score").alias("worst_score"))
        .withColumn("total_targets", total.cast("bigint"))
    )
    share = F.col("n_targets") / F.col("total_targets")
    return (
        per_ligand.withColumn("fraction", F.round(share, 3))
        .withColumn("promiscuous", share >= cut)
        .withColumn("reason", F.when(
            F.col("promiscuous"),
            F.format_string("Hits %d/%d targets", F.col("n_targets"), F.col("total_targets"))))
    )


def promiscuous_detail(facts: DataFrame, flagged: DataFrame, only_hits: bool = True,
                       p: ScreenParams = DEFAULTS) -> DataFrame:
    """Best score of each flagged ligand on each target, as rows."""
    seen = facts.where(F.col("score") <= p.hit_score) if only_hits else facts.where(F.col("score").isNotNull())
    ids = flagged.where("promiscuous").select("ligand")
    return seen.join(ids, "ligand", "left_semi").groupBy("ligand", "target").agg(F.min("score").alias("score"))


def promiscuity_split(report: DataFrame, known: DataFrame) -> DataFrame:
    """Flagged ligands, marked as already on the exclusion list or new."""
    listed = known.select("ligand").distinct().withColumn("_known", F.lit(True))
    return report.where("promiscuous").join(listed, "ligand", "left").withColumn(
        "known", F.col("_known").isNotNull()).drop("_known")


# --- joins to dimensions ----------------------------------------------------------------


def look_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of a few fixed rows to a large table with one row per key.

    The table is reduced to the wanted keys first, so it is only scanned, where a plain outer join
    would shuffle all of it. ``rows`` should be a written table: its size then tells Spark whether
    the keys may be broadcast.
    """
    return rows.join(table.join(rows.select(key).distinct(), key, "left_semi"), key, "left")


def enrich_hits(hits: DataFrame, targets: DataFrame, compounds: DataFrame,
                selectivity: DataFrame | None = None, top: int = 50,
                order: Sequence[str] = BEST_FIRST) -> DataFrame:
    """Ranked top hits with target, compound and selectivity columns; no hit is lost."""
    best = cut_lineage(ranked_top(hits, [F.col(c) for c in order], top), "top")
    out = look_up(best, targets, "target")
    for table in (compounds, selectivity):
        if table is not None:
            out = out.join(table.join(best.select("ligand").distinct(), "ligand", "left_semi"), "ligand", "left")
    return out


def append_new(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Insert-only merge: rows of ``new`` whose key is not there yet."""
    fresh = new.join(existing.select(*key), list(key), "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def annotate_scores(targets: DataFrame, stats: DataFrame) -> DataFrame:
    """Write fresh statistics onto targets, but only where the new best is negative."""
    cols = ["best_score", "best_ligand", "n_hits", "hit_rate"]
    new = stats.where(F.col("best_score") < 0).select(
        "target", *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_new"))
    joined = targets.join(new, "target", "left")
    keep = [c for c in targets.columns if c not in cols]

    def updated(c: str) -> Column:
        fresh = F.round(F.col("_best_score"), 3) if c == "best_score" else F.col(f"_{c}")
        old = F.col(c) if c in targets.columns else F.lit(None)
        return F.when(F.col("_new"), fresh).otherwise(old).alias(c)

    return joined.select(*keep, *[updated(c) for c in cols])


def selectivity(primary: DataFrame, host: DataFrame, tiers: int = 4, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Host over primary score for each ligand; ligands without a host score stay as failed."""
    joined = primary.select("ligand", F.col("score").alias("primary_score")).join(
        host.select("ligand", F.col("score").alias("host_score")), "ligand", "left")
    a, b = F.col("primary_score"), F.col("host_score")
    ratio = selectivity_ratio(a, b)
    return joined.select(
        "ligand", "primary_score", "host_score",
        F.round(ratio, 4).alias("ratio"),
        (ratio < p.moderate_ratio).alias("selective"),
        selectivity_verdict(a, b, tiers, p).alias("verdict"),
    )


def verdict_counts(selective: DataFrame) -> DataFrame:
    return selective.groupBy("verdict").agg(F.count("*").alias("n_ligands"))


# --- selection --------------------------------------------------------------------------


def select_hits(hits: DataFrame, n_targets: int = 5, n_hits: int = 5,
                targets: Sequence | None = None) -> DataFrame:
    """Best ``n_hits`` of each of the best ``n_targets`` targets, or of a given list."""
    order = [F.col("score"), F.col("ligand")]
    if targets is not None:
        return top_per_group(hits.where(F.col("target").isin(*targets)), ["target"], order, n_hits)
    return _best_of_best(hits, n_targets, n_hits, "rank")


def _best_of_best(hits: DataFrame, n_targets: int, n_hits: int, name: str) -> DataFrame:
    """One pass over the hits: cut every target to its best hits, then pick the targets from that."""
    ranked = cut_lineage(top_per_group(hits, ["target"], [F.col("score"), F.col("ligand")], n_hits, name), "ranked")
    best = ranked.where(F.col(name) == 1).orderBy("score", "target").limit(n_targets).select("target")
    return ranked.join(F.broadcast(best), "target", "left_semi")  # ``n_targets`` rows


def priority_targets(hits: DataFrame, targets: DataFrame, top: int = 10) -> DataFrame:
    """First ``top`` targets: those with clean hits by best score, then scored ones, then the
    rest by final score."""
    clean = hits.groupBy("target").agg(F.min("score").alias("_key")).withColumn("_tier", F.lit(1))
    scored = F.col("best_score") < 0
    listed = targets.select(
        "target",
        F.when(scored, F.col("best_score")).otherwise(-F.coalesce(F.col("final_score"), F.lit(0))).cast("double").alias("_key"),
        F.when(scored, F.lit(2)).otherwise(F.lit(3)).alias("_tier"),
    )
    merged = (
        clean.unionByName(listed).groupBy("target").agg(F.min(F.struct("_tier", "_key")).alias("_k"))
        .select("target", F.col("_k._tier").alias("tier"), F.col("_k._key").alias("_key"))
    )
    return ranked_top(merged, [F.col("tier"), F.col("_key"), F.col("target")], top).drop("_key")


def hits_by_target(hits: DataFrame, top: int) -> DataFrame:
    """Ligands per target in score order, over the ``top`` hits overall."""
    best = hits.orderBy(*BEST_FIRST).limit(top)
    return best.groupBy("target").agg(
        F.count("*").alias("n_ligands"),
        F.transform(F.array_sort(F.collect_list(F.struct("score", "ligand"))), lambda s: s["ligand"]).alias("ligands"),
    )


def secondary_pocket_plan(pockets: DataFrame, hits: DataFrame, n_targets: int = 5, n_ligands: int = 10,
                          pocket_index: int | None = None) -> DataFrame:
    """Best ligands of the best multi-pocket targets against their secondary pockets.

    ``pockets`` has (target, pocket_idx) with 0 for the primary pocket.
    """
    multi = pockets.groupBy("target").agg(F.count("*").alias("_n")).where(F.col("_n") >= 2).select("target")
    eligible = hits.join(multi, "target", "left_semi")
    best = _best_of_best(eligible, n_targets, n_ligands, "ligand_rank")
    other = F.col("pocket_idx") >= 1 if pocket_index is None else F.col("pocket_idx") == pocket_index
    return pockets.where(other).select("target", "pocket_idx").join(
        best.select("target", "ligand", "score", "ligand_rank"), "target")


def multipocket_summary(facts: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Per (target, pocket): docked, hits and the best ligand."""
    return facts.where(F.col("score").isNotNull()).groupBy("target", "pocket_idx").agg(
        F.count("*").alias("n_docked"),
        n(F.col("score") <= p.hit_score).alias("n_hits"),
        F.min(F.struct("score", "ligand")).alias("_b"),
    ).select("target", "pocket_idx", "n_docked", "n_hits",
             F.col("_b.score").alias("best_score"), F.col("_b.ligand").alias("best_ligand"))


def multipocket_hits(facts: DataFrame, threshold: float | None = None, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Best score of every (target, pocket, ligand) that reaches the threshold."""
    cut = p.hit_score if threshold is None else threshold
    return facts.where(F.col("score") <= cut).groupBy("target", "pocket_idx", "ligand").agg(F.min("score").alias("score"))


# --- distributions and rank recovery ----------------------------------------------------


def percentile_rank(reference: DataFrame, hits: DataFrame, bin_width: float = 0.05) -> DataFrame:
    """Share of a target's hits that each reference score beats, in percent.

    Reference scores enter the hit histogram as points of weight zero, so one pass of tail
    counts answers all of them; targets without hits drop out.
    """
    points = (
        hits.where(F.col("score").isNotNull()).select("target", "score", F.lit(1).alias("_w"))
        .unionByName(reference.where(F.col("score").isNotNull()).select("target", "score", F.lit(0).alias("_w")))
    )
    tails = tail_counts(points, ["target"], "score", "_w", bin_width).where(F.col("n_total") > 0)
    return reference.join(tails, ["target", "score"]).select(
        *reference.columns,
        F.col("n_above").cast("bigint").alias("n_worse"),
        F.col("n_total").cast("bigint").alias("n_hits"),
        F.round(100.0 * F.col("n_above") / F.col("n_total"), 2).alias("percentile"),
    )


def rank_recovery(reference: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per compound: mean score, mean percentile and best target over the targets it was scored on."""
    scores = reference.where(F.col("score").isNotNull()).groupBy("compound").agg(
        F.count("*").alias("n_scored"),
        F.round(exact_avg(F.col("score")), 3).alias("avg_score"),
        F.min(F.struct("score", "target")).alias("_b"),
    )
    ranks = ranked.groupBy("compound").agg(F.round(exact_avg(F.col("percentile")), 2).alias("avg_percentile"))
    return scores.join(ranks, "compound", "left").select(
        "compound", "n_scored", "avg_score", "avg_percentile",
        F.col("_b.score").alias("best_score"), F.col("_b.target").alias("best_target"))


def recovery_verdict(recovery: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """PASS / MARGINAL / FAIL by the number of compounds above the percentile bar."""
    counted = recovery.agg(n(F.col("avg_percentile") >= p.recovery_percentile).alias("n_pass"))
    return counted.withColumn("verdict", F.when(F.col("n_pass") >= p.recovery_pass, "PASS").when(
        F.col("n_pass") >= p.recovery_marginal, "MARGINAL").otherwise("FAIL"))


def score_distribution(facts: DataFrame, exact: bool = True, bin_width: float = 0.05) -> DataFrame:
    """Count, minimum, median and maximum per target.

    The exact median reads positions off tail counts, which holds for a target of any size;
    ``exact=False`` uses Spark's percentile sketch.
    """
    scored = facts.where(F.col("score").isNotNull())
    if not exact:
        return scored.groupBy("target").agg(
            F.count("*").alias("n_scored"), F.min("score").alias("min_score"),
            F.percentile_approx("score", 0.5).alias("median_score"), F.max("score").alias("max_score"))
    tails = tail_counts(scored.select("target", "score", F.lit(1).alias("_w")), ["target"], "score", "_w", bin_width)
    below = F.col("n_total") - F.col("n_above") - F.col("n_here")

    def at(position: Column) -> Column:
        return F.max(F.when((below <= position) & (position < below + F.col("n_here")), F.col("score")))

    return tails.groupBy("target").agg(
        F.max("n_total").cast("bigint").alias("n_scored"), F.min("score").alias("min_score"),
        ((at(F.floor((F.col("n_total") - 1) / 2)) + at(F.floor(F.col("n_total") / 2))) / 2).alias("median_score"),
        F.max("score").alias("max_score"))


def score_histogram(facts: DataFrame, width: float = 0.5) -> DataFrame:
    return facts.where(F.col("score").isNotNull()).groupBy(score_bin(F.col("score"), width).alias("bin")).agg(
        F.count("*").alias("n_facts"))


def risk_scatter(targets: DataFrame, stats: DataFrame) -> DataFrame:
    """One point per scored target: best score against host identity, evidence and pockets."""
    percent = F.coalesce(F.col("max_identity"), F.lit(0.0)) * 100
    return targets.join(stats.where(F.col("best_score").isNotNull()).select("target", "best_score"), "target").select(
        "target", "best_score", F.round(percent, 2).alias("identity_pct"),
        identity_bucket(percent).alias("risk"),
        F.coalesce(F.col("rnai_evidence"), F.lit(False)).alias("rnai_evidence"),
        F.coalesce(F.col("druggable_pockets"), F.lit(1)).alias("druggable_pockets"))


def property_space(rows: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Hit properties that parse as numbers, with their place in the rule-of-five box."""
    cast = {c: F.col(c).try_cast("double") for c in ("mw", "logp", "score")}
    out = rows.select("target", "ligand", *[v.alias(c) for c, v in cast.items()],
                      (F.col("pan_tick") == "Yes").alias("pan_tick"))
    return out.where("mw IS NOT NULL AND logp IS NOT NULL AND score IS NOT NULL").select(
        "*", ((F.col("mw") <= p.max_mw) & (F.col("logp") <= p.max_logp)).alias("in_ro5_box"),
        score_bin(F.col("score")).alias("score_bin"))
