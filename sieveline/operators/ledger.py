"""The screening ledger: zones, work planning, batches, trends and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.scores import score_tier, score_zone, stored_exhaustiveness
from ..params import DEFAULTS, ScreenParams
from ..session import cut_lineage
from .ordering import dense_index, keep_first, lowest_rows, running_by_round, top_per_group

PAIR = ["target", "ligand"]
TARGETS_PER_SLICE = 1000
#: Rows of a plan, one for each target and batch, that a task forms on average.
ROWS_PER_TASK = 4_000_000
#: Batches up to which a table with a row for each is broadcast: about 30 bytes a row.
BROADCAST_BATCHES = 1_000_000


def n(predicate: Column) -> Column:
    """How many rows meet ``predicate``."""
    return F.count_if(predicate).cast("bigint")


# --- zones and retention ----------------------------------------------------------------


def zone_split(facts: DataFrame, threshold: float | None = None, margin: float | None = None,
               p: ScreenParams = DEFAULTS) -> DataFrame:
    """Tag each scored fact as hit, near_miss or clear_fail; unscored facts are skipped."""
    return facts.where(F.col("score").isNotNull()).withColumn(
        "zone", score_zone(F.col("score"), threshold, margin, p))


def zone_counts(zoned: DataFrame, size: str | None = None) -> DataFrame:
    """Facts and stored bytes per zone, in one pass."""
    total = F.sum(size) if size else F.lit(0)
    return zoned.groupBy("zone").agg(
        F.count("*").alias("n_facts"), F.coalesce(total, F.lit(0)).cast("bigint").alias("total_bytes"))


def retention_plan(files: DataFrame, threshold: float | None = None, mode: str = "archive",
                   p: ScreenParams = DEFAULTS) -> DataFrame:
    """What happens to each stored pose: leads and hits stay, the rest is archived or pruned.

    The score stays on every row, so pruning a pose never loses its score.
    """
    if mode not in ("archive", "prune"):
        raise ValueError("mode is archive or prune")
    tiered = files.withColumn("tier", score_tier(F.col("score"), threshold, p))
    keep = F.col("tier").isin("lead", "hit", "unknown")
    return tiered.withColumn("action", F.when(keep, "keep").otherwise(mode))


def retention_totals(plan: DataFrame, size: str = "size") -> DataFrame:
    """Bytes before, after and saved."""
    kept = F.when(F.col("action") == "keep", F.col(size)).otherwise(0)
    return plan.agg(
        F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes_before"),
        F.coalesce(F.sum(kept), F.lit(0)).cast("bigint").alias("bytes_after"),
    ).withColumn("bytes_saved", F.col("bytes_before") - F.col("bytes_after"))


def write_tiers(plan: DataFrame, path: str) -> None:
    """Rewrite the pose table with one folder per action and tier."""
    plan.write.mode("overwrite").partitionBy("action", "tier").parquet(path)


def tier_counts(files: DataFrame, size: str = "size", threshold: float | None = None,
                p: ScreenParams = DEFAULTS) -> DataFrame:
    """Leads, hits, moderate and weak poses per target, and their bytes."""
    tier = score_tier(F.col("score"), threshold, p)
    return files.groupBy("target").agg(
        n(tier == "lead").alias("leads"),
        n(tier == "hit").alias("hits"),
        n(tier == "moderate").alias("moderate"),
        n(tier == "weak").alias("weak"),
        F.sum(size).cast("bigint").alias("total_bytes"),
    )


# --- the ledger itself ------------------------------------------------------------------


def compact_ledger(rows: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Highest search effort spent on each pair, with rules for rows that lack it."""
    effort = stored_exhaustiveness(F.col("exh"), F.col("score"), p)
    return rows.groupBy(*PAIR).agg(F.max(effort).cast("int").alias("exh"))


def ledger_counts(ledger: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    permanent = F.col("exh") >= p.permanent_exhaustiveness
    return ledger.agg(
        F.count("*").alias("n_total"), n(permanent).alias("n_permanent"), n(~permanent).alias("n_redockable"))


def pending_work(pairs: DataFrame, ledger: DataFrame, hits: DataFrame, exh: int | Column) -> DataFrame:
    """Pairs still to dock: no stored hit, and no ledger entry of at least the effort asked for.

    Both sides are folded into one set of pairs with the effort that settles them, so the
    candidates are shuffled once.
    """
    settled = (
        hits.select(*PAIR).withColumn("_done", F.lit(2**31 - 1))
        .unionByName(ledger.select(*PAIR, F.col("exh").alias("_done")))
        .groupBy(*PAIR).agg(F.max("_done").alias("_done"))
    )
    asked = F.lit(exh) if isinstance(exh, int) else exh
    wanted = pairs.withColumn("_asked", asked)
    on = (
        (wanted["target"] == settled["target"]) & (wanted["ligand"] == settled["ligand"])
        & (settled["_done"] >= wanted["_asked"])
    )
    return wanted.join(settled, on, "left_anti").drop("_asked")


def assign_batches(ligands: DataFrame, size: int) -> DataFrame:
    """Stable batches of ``size`` ligands in id order."""
    return dense_index(ligands, [F.col("ligand")]).withColumn(
        "batch_id", F.floor(F.col("idx") / size).cast("int"))


def plan_pairs(targets: DataFrame, batches: DataFrame, batch_id: int | None = None) -> DataFrame:
    """Every target with every ligand of the chosen batches.

    Each target is first repeated per batch number and then meets only that batch's ligands, so
    the pairs come out of an ordinary join on the batch. Targets are cut into slices, and a batch
    is repeated per slice, so that no task forms more than TARGETS_PER_SLICE x batch size pairs.
    """
    chosen = batches if batch_id is None else batches.where(F.col("batch_id") == batch_id)
    last = chosen.agg(F.max("batch_id")).scalar()
    first = chosen.agg(F.min("batch_id")).scalar()
    slices = F.ceil(targets.agg(F.count("*")).scalar() / TARGETS_PER_SLICE).cast("int")
    repeated = (
        targets.select("target")
        .withColumn("batch_id", F.explode(F.sequence(first, last)))
        .withColumn("_slice", F.pmod(F.xxhash64("target"), slices).cast("int"))
    )
    spread = chosen.select("ligand", "batch_id").withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    return repeated.join(spread, ["batch_id", "_slice"]).select("target", "ligand", "batch_id")


def batch_totals(batches: DataFrame, *totals: Column) -> tuple[DataFrame, Row]:
    """``totals`` of each batch as a written table, broadcast if counted to be small, and its first and last number."""
    table = cut_lineage(batches.groupBy("batch_id").agg(*totals), "totals")
    ends = table.agg(F.min("batch_id").alias("first"), F.max("batch_id").alias("last"), F.count("*").alias("n")).first()
    return F.broadcast(table) if ends["n"] <= BROADCAST_BATCHES else table, ends


def plan_tasks(targets: DataFrame, ends: Row) -> int:
    """Number of tasks that the rows of a plan are formed in. The targets alone are few bytes, which Spark would leave in one task."""
    rows = targets.count() * (ends["last"] - ends["first"] + 1)
    return max(-(-rows // ROWS_PER_TASK), int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def plan_totals(targets: DataFrame, batches: DataFrame) -> DataFrame:
    """Number of pairs and sum of ligand ids per (target, batch) of the whole plan, without forming the pairs.

    Every target meets all ligands of a batch, so the totals of a batch are taken once and repeated per target.
    """
    totals, ends = batch_totals(batches, F.count("*").alias("n_pairs"), F.sum("ligand").alias("ligand_sum"))
    if ends["last"] is None:
        return targets.select("target").join(totals, F.lit(False)).select("target", *totals.columns)
    numbers = F.sequence(F.lit(ends["first"]), F.lit(ends["last"]))
    asked = targets.repartition(plan_tasks(targets, ends), "target").groupBy("target").agg(F.count("*").alias("_asked"))
    return asked.select("*", F.explode(numbers).alias("batch_id")).join(totals, "batch_id").select(
        "target", "batch_id", *[(F.col(c) * F.col("_asked")).alias(c) for c in ("n_pairs", "ligand_sum")])


def plan_counts(targets: DataFrame, batches: DataFrame, settled: DataFrame) -> DataFrame:
    """Pairs left per (target, batch) without forming the pairs: batch size minus settled pairs.

    Only batches in which a target has settled pairs are shuffled, and the first batch of every target. Each of
    these rows then stands for the batches up to the target's next one, which are formed where they are returned.
    """
    batches = cut_lineage(batches.select("ligand", "batch_id"), "batches")
    sizes, ends = batch_totals(batches, F.count("*").alias("n_ligands"))
    columns = "target", "batch_id", "n_ligands", "n_done", (F.col("n_ligands") - F.col("n_done")).alias("n_pending")
    if ends["last"] is None:
        none = F.lit(0).cast("bigint").alias("n_done")
        return targets.select("target", none).join(sizes, F.lit(False)).select(*columns)
    first, after = (F.lit(x).cast(batches.schema["batch_id"].dataType) for x in (ends["first"], ends["last"] + 1))
    done = settled.select(*PAIR).where("target IS NOT NULL").distinct().join(batches, "ligand")
    marks = (
        done.select("target", "batch_id", F.lit(1).alias("_done"), F.lit(0).alias("_asked"))
        .unionByName(targets.select("target", first.alias("batch_id"), F.lit(0).alias("_done"), F.lit(1).alias("_asked")))
        .groupBy("target", "batch_id").agg(F.sum("_done").alias("_done"), F.sum("_asked").alias("_asked"))
        .repartition(plan_tasks(targets, ends), "target")
    )
    in_order = Window.partitionBy("target").orderBy("batch_id")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = marks.select(
        "target", "_done", F.col("batch_id").alias("_from"),
        F.coalesce(F.lead("batch_id").over(in_order), after).alias("_until"),
        F.first("_asked").over(so_far).alias("_asked"),
    ).where("_asked > 0")
    numbers = F.explode(F.sequence(F.col("_from"), F.col("_until") - 1)).alias("batch_id")
    here = F.when(F.col("batch_id") == F.col("_from"), F.col("_done")).otherwise(0)
    return (
        runs.select("*", numbers).join(sizes, "batch_id")
        .withColumns({"n_ligands": F.col("n_ligands") * F.col("_asked"), "n_done": here * F.col("_asked")})
        .select(*columns)
    )


# --- batches, rounds and trends ---------------------------------------------------------


def batch_summary(facts: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """One row per (round, batch): what was asked, what came back, and hits.

    A target counts as ok in a batch when at least one score is present there.
    """
    batch = ["round", "batch_id"]
    by_ligand = facts.groupBy(*batch, "ligand").agg(n(F.col("score") <= p.hit_score).alias("_hits")).groupBy(*batch).agg(
        F.count("ligand").alias("n_ligands"), F.sum("_hits").alias("total_hits"))
    by_target = facts.groupBy(*batch, "target").agg(F.count("score").alias("_scores")).groupBy(*batch).agg(
        F.count("target").alias("n_targets"), n(F.col("target").isNotNull() & (F.col("_scores") > 0)).alias("n_ok"))
    by_target = by_target.withColumnsRenamed({"round": "_round", "batch_id": "_batch"})
    same = F.col("round").eqNullSafe(F.col("_round")) & F.col("batch_id").eqNullSafe(F.col("_batch"))
    return by_ligand.join(by_target, same).select(
        *batch, "n_ligands", "n_targets", "n_ok", "total_hits", (F.col("n_targets") - F.col("n_ok")).alias("n_failed"))


def batch_top(facts: DataFrame, k: int = 5) -> DataFrame:
    """Best ``k`` (target, ligand) of each batch, one per target, as in the batch report."""
    best = lowest_rows(facts, ["round", "batch_id", "target"], "score", ["ligand"])
    return top_per_group(best, ["round", "batch_id"], [F.col("score"), F.col("target"), F.col("ligand")], k)


def batch_failed(facts: DataFrame) -> DataFrame:
    """(round, batch, target) without a single score."""
    return (
        facts.groupBy("round", "batch_id", "target").agg(F.count("score").alias("_s"))
        .where(F.col("_s") == 0).drop("_s")
    )


def nest_top(top: DataFrame) -> DataFrame:
    """``top_5``-style array per batch; the input holds only k rows per batch."""
    return top.groupBy("round", "batch_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "score", "target", "ligand"))),
            lambda r: F.struct(r["score"], r["target"], r["ligand"]),
        ).alias("top"))


def batch_report(facts: DataFrame, times: DataFrame, k: int = 5, p: ScreenParams = DEFAULTS) -> DataFrame:
    """One row per (round, batch) as the batch log has it: counts, elapsed seconds to one decimal, the best ``k``
    entries and the failed targets.

    ``times`` has started and completed of each (round, batch_id). The list of failed targets is as long as
    a batch has targets.
    """
    batch = ["round", "batch_id"]
    elapsed = F.round(F.unix_micros("completed") / 1e6 - F.unix_micros("started") / 1e6, 1)
    spans = times.groupBy(*batch).agg(F.min("started").alias("started"), F.max("completed").alias("completed"))
    failed = batch_failed(facts).groupBy(*batch).agg(F.array_sort(F.collect_list("target")).alias("failed_targets"))
    report = batch_summary(facts, p)
    for part in (spans.select(*batch, elapsed.alias("elapsed_s"), F.col("completed").alias("completed_at")),
                 nest_top(batch_top(facts, k)), failed):
        report = report.join(part, batch, "left")
    none = F.array().cast(report.schema["failed_targets"].dataType)
    return report.withColumn("failed_targets", F.coalesce("failed_targets", none))


def campaign_status(summary: DataFrame) -> DataFrame:
    """Totals over all batches and how many had failures."""
    return summary.agg(
        F.count("*").alias("n_batches"),
        F.sum("n_ligands").cast("bigint").alias("total_ligands"),
        F.sum("total_hits").cast("bigint").alias("total_hits"),
        n(F.col("n_failed") > 0).alias("n_warn"),
        n(F.col("n_failed") == 0).alias("n_ok"),
    )


def campaign_top(facts: DataFrame, k: int = 5) -> DataFrame:
    """Best ``k`` batch entries of the whole campaign."""
    return batch_top(facts, k).orderBy("score", "target", "ligand", "round", "batch_id").limit(k).drop("rank")


def round_summary(facts: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """One row per round: sizes, distinct hits and the best pair. The facts are read once, into one row per round and pair."""
    pairs = cut_lineage(facts.groupBy("round", *PAIR).agg(F.max("exh").alias("exh"), F.min("score").alias("score")), "round-pairs")
    by_ligand = pairs.groupBy("round", "ligand").agg(F.max("exh").alias("_exh"), n(F.col("score") <= p.hit_score).alias("_hits")).groupBy("round").agg(
        F.max("_exh").alias("exh"), F.count("ligand").alias("n_ligands"), F.sum("_hits").cast("bigint").alias("n_hits"))
    # the best ligand of each score and target first, by hash aggregation; the best of these is looked for among few rows
    by_target = pairs.groupBy("round", "target", "score").agg(F.min("ligand").alias("ligand")).groupBy("round", "target").agg(
        F.min("score").alias("score"), F.min_by("ligand", "score").alias("ligand")).groupBy("round").agg(
        F.count("target").alias("n_targets"), F.min(F.when(F.col("score").isNotNull(), F.struct("score", "target", "ligand"))).alias("_best"))
    rounds = by_ligand.join(by_target.withColumnRenamed("round", "_round"), F.col("round").eqNullSafe(F.col("_round")))
    return rounds.select("round", "exh", "n_ligands", "n_targets", "n_hits", F.col("_best.score").alias("best_score"),
                         F.col("_best.ligand").alias("best_ligand"), F.col("_best.target").alias("best_target"))


def upsert_rounds(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those of the same round."""
    return existing.join(new.select("round").distinct(), "round", "left_anti").unionByName(new)


def write_rounds(rounds: DataFrame, path: str) -> None:
    """Upsert into a table kept by round: only the rounds present are rewritten."""
    (rounds.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("round").parquet(path))


def packed_batch(round_no: Column, batch_id: Column) -> Column:
    """Round and batch as one number that orders like the pair."""
    return F.call_function("shiftleft", round_no.cast("bigint"), F.lit(32)) + batch_id


def hit_trend(facts: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Per batch: new distinct hits, hits so far, best score so far and ligands docked so far."""
    batch = ["round", "batch_id"]
    hits = facts.where(F.col("score") <= p.hit_score)
    # (round, batch) as one number: a struct would force the largest aggregation here to sort
    first = hits.groupBy(*PAIR).agg(F.min(packed_batch(F.col("round"), F.col("batch_id"))).alias("_first")).groupBy(
        "_first").agg(F.count("*").alias("new_hits"))
    hit_score = F.when(F.col("score") <= p.hit_score, F.col("score"))
    batches = (
        facts.groupBy(*batch, "ligand").agg(F.min(hit_score).alias("_best"))
        .groupBy(*batch).agg(F.count("*").alias("batch_ligands"), F.min("_best").alias("batch_best"))
        .withColumn("_first", packed_batch(F.col("round"), F.col("batch_id")))
        .join(first, "_first", "left").drop("_first")
        .withColumn("new_hits", F.coalesce("new_hits", F.lit(0)))
    )
    batches = cut_lineage(batches, "batches")  # one row per batch, used twice
    return running_by_round(
        batches,
        sums={"cum_hits": "new_hits", "n_ligands_docked": "batch_ligands"},
        mins={"best_score": "batch_best"},
    ).select("round", "batch_id", "cum_hits", "new_hits", "best_score", "n_ligands_docked")


def trend_from_cumulative(trend: DataFrame) -> DataFrame:
    """New hits of each record as the non-negative step of the cumulative count in its round."""
    step = F.col("cum_hits") - F.lag("cum_hits").over(Window.partitionBy("round").orderBy("batch_id"))
    return trend.withColumn("new_hits", F.greatest(F.lit(0), F.coalesce(step, F.col("cum_hits"))))


def near_miss_upgrade(ledger: DataFrame, hits: DataFrame, round_no: int | None = None,
                      prev_round: int | None = None, p: ScreenParams = DEFAULTS) -> DataFrame:
    """How many distinct earlier near-misses are hits now. ``prev_round`` narrows to one round."""
    zone = score_zone(F.col("score"), p=p)
    rows = ledger if prev_round is None else ledger.where(F.col("round") == prev_round)
    near = rows.where(zone == "near_miss").select(*PAIR).distinct()
    flagged = near.join(hits.select(*PAIR).distinct().withColumn("_hit", F.lit(True)), PAIR, "left")
    counted = flagged.agg(
        F.count("*").alias("prev_near_misses"), n(F.col("_hit").isNotNull()).alias("upgraded"))
    rate = F.coalesce(F.try_divide(F.col("upgraded"), F.col("prev_near_misses")), F.lit(0.0))
    out = counted.withColumn("upgrade_rate", F.round(rate, 4))
    return out if round_no is None else out.withColumn("round", F.lit(round_no))


# --- merging scores ---------------------------------------------------------------------


def merge_score_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per-target statistics from two sources: ``b`` fills what ``a`` lacks and wins when better.

    Inputs have (target, best_score, best_ligand, n_scored, n_hits). When ``b`` is better its best
    is taken and the score lists of both count; otherwise ``a`` stays as it is.
    """
    cols = ["best_score", "best_ligand", "n_scored", "n_hits"]
    l = a.select("target", *[F.col(c).alias(f"_a_{c}") for c in cols])
    r = b.select("target", *[F.col(c).alias(f"_b_{c}") for c in cols])
    a_empty = F.coalesce(F.col("_a_best_score"), F.lit(0.0)) == 0
    b_better = F.col("_b_best_score") < F.col("_a_best_score")

    def best(c: str) -> Column:
        return F.when(a_empty & F.col("_b_best_score").isNotNull(), F.col(f"_b_{c}")).when(
            b_better, F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}"))

    def count(c: str) -> Column:
        return F.when(a_empty & F.col("_b_best_score").isNotNull(), F.col(f"_b_{c}")).when(
            b_better, F.col(f"_a_{c}") + F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}"))

    return l.join(r, "target", "full_outer").select(
        "target", best("best_score").alias("best_score"), best("best_ligand").alias("best_ligand"),
        count("n_scored").cast("bigint").alias("n_scored"), count("n_hits").cast("bigint").alias("n_hits"))


def apply_refinement(hits: DataFrame, refined: DataFrame) -> DataFrame:
    """Replace the score of refined pairs."""
    new = refined.where(F.col("score").isNotNull()).groupBy(*PAIR).agg(F.min("score").alias("_new"))
    return hits.join(new, PAIR, "left").withColumn(
        "score", F.coalesce("_new", "score")).drop("_new")


def refine_deltas(hits: DataFrame, refined: DataFrame, p: ScreenParams = DEFAULTS) -> DataFrame:
    """Old score, new score, delta and outcome of each refined pair."""
    old = hits.select(*PAIR, F.col("score").alias("old_score"))
    new = refined.select(*PAIR, F.col("score").alias("new_score"))
    delta = F.round(F.col("new_score") - F.col("old_score"), 3)
    outcome = (
        F.when(F.col("new_score").isNull(), "failed")
        .when(F.col("delta") < -p.refinement_band, "improved")
        .when(F.col("delta") > p.refinement_band, "worsened")
        .otherwise("unchanged")
    )
    return new.join(old, PAIR, "left").withColumn("delta", delta).withColumn("outcome", outcome)


def outcome_counts(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("outcome").agg(F.count("*").alias("n_pairs"))


def failure_log(failures: DataFrame) -> DataFrame:
    """Failures per target and reason."""
    return failures.groupBy("target", "reason").agg(F.count("*").alias("n_failures"))


def dedupe_facts(facts: DataFrame) -> DataFrame:
    """Best fact per pair; ties go to the earliest round and batch."""
    return keep_first(facts, PAIR, ["score", "round", "batch_id"])
