"""Ledger queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scores import score_tier
from ..operators import hits as H
from ..operators import ledger as L
from ..operators.ordering import keep_first
from ..session import scratch_path
from ..sources import pair_store as S
from .registry import query

PAIRS = ["target", "ligand"]

ZONE = """CASE WHEN score <= -7 THEN 'hit' WHEN score <= -5.5 THEN 'near_miss' ELSE 'clear_fail' END"""
TIER = """CASE WHEN score IS NULL THEN 'unknown' WHEN score <= -9 THEN 'lead' WHEN score <= -7 THEN 'hit'
    WHEN score <= -5 THEN 'moderate' ELSE 'weak' END"""
EFFORT = "coalesce(exh, CASE WHEN score <= -5.5 THEN 4 ELSE 9999 END)"


@query("classify_score", f"SELECT {TIER} AS tier, count(*) AS n_facts, min(score) AS best FROM facts GROUP BY 1")
def classify_score(t):
    return t.facts.groupBy(score_tier(F.col("score")).alias("tier")).agg(
        F.count("*").alias("n_facts"), F.min("score").alias("best"))


@query("zone_split", f"""SELECT {ZONE} AS zone, count(*) AS n_facts, CAST(sum(size) AS BIGINT) AS total_bytes
    FROM facts WHERE score IS NOT NULL GROUP BY 1""")
def zone_split(t):
    return L.zone_counts(L.zone_split(t.facts), "size")


@query("zone_rows", f"""SELECT round, batch_id, target, ligand, score, {ZONE} AS zone
    FROM facts WHERE score IS NOT NULL""")
def zone_rows(t):
    return L.zone_split(t.facts).select(
        "round", "batch_id", "target", "ligand", "score", "zone")


@query("retention_plan", f"""SELECT {TIER} AS tier, CASE WHEN {TIER} IN ('lead', 'hit', 'unknown') THEN 'keep' ELSE 'archive' END AS action,
    count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_bytes FROM facts GROUP BY 1, 2""")
def retention_plan(t):
    return L.retention_plan(t.facts).groupBy("tier", "action").agg(
        F.count("*").alias("n_files"), F.sum("size").alias("total_bytes"))


@query("retention_totals", f"""s AS (SELECT CAST(sum(size) AS BIGINT) AS bytes_before,
    CAST(sum(CASE WHEN {TIER} IN ('lead', 'hit', 'unknown') THEN size ELSE 0 END) AS BIGINT) AS bytes_after FROM facts)
    SELECT *, bytes_before - bytes_after AS bytes_saved FROM s""")
def retention_totals(t):
    return L.retention_totals(L.retention_plan(t.facts, mode="prune"))


@query("tiered_rewrite", f"""SELECT {TIER} AS tier, CASE WHEN {TIER} IN ('lead', 'hit', 'unknown') THEN 'keep' ELSE 'archive' END AS action, target,
    count(*) AS n_files, min(score) AS best_score FROM facts GROUP BY 1, 2, 3""")
def tiered_rewrite(t):
    path = scratch_path(t.spark, "tiers")
    L.write_tiers(L.retention_plan(t.facts.select("target", "ligand", "score", "size")), path)
    return t.spark.read.parquet(path).groupBy("tier", "action", "target").agg(
        F.count("*").alias("n_files"), F.min("score").alias("best_score"))


@query("tier_counts", f"""SELECT target, count(*) FILTER (WHERE {TIER} = 'lead') AS leads, count(*) FILTER (WHERE {TIER} = 'hit') AS hits,
    count(*) FILTER (WHERE {TIER} = 'moderate') AS moderate, count(*) FILTER (WHERE {TIER} = 'weak') AS weak,
    CAST(sum(size) AS BIGINT) AS total_bytes FROM facts GROUP BY target""")
def tier_counts(t):
    return L.tier_counts(t.facts)


@query("compact_ledger", f"SELECT target, ligand, CAST(max({EFFORT}) AS INT) AS exh FROM ledger_rows GROUP BY 1, 2")
def compact_ledger(t):
    return L.compact_ledger(t.ledger)


@query("ledger_counts", f"""l AS (SELECT target, ligand, max({EFFORT}) AS exh FROM ledger_rows GROUP BY 1, 2)
    SELECT count(*) AS n_total, count(*) FILTER (WHERE exh >= 9999) AS n_permanent,
    count(*) FILTER (WHERE exh < 9999) AS n_redockable FROM l""")
def ledger_counts(t):
    return L.ledger_counts(L.compact_ledger(t.ledger))


PENDING = f"""pairs AS (SELECT DISTINCT target, ligand FROM facts),
    l AS (SELECT target, ligand, max({EFFORT}) AS exh FROM ledger_rows GROUP BY 1, 2)
    SELECT target, ligand FROM pairs p
    WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.target = p.target AND l.ligand = p.ligand AND l.exh >= 8)
      AND NOT EXISTS (SELECT 1 FROM facts h WHERE h.score <= -7 AND h.target = p.target AND h.ligand = p.ligand)"""


@query("pending_work", PENDING)
def pending_work(t):
    return L.pending_work(t.facts.select(*PAIRS).distinct(), L.compact_ledger(t.ledger), H.top_hits(t.facts), 8)


@query("pending_work_bucketed", PENDING)
def pending_work_bucketed(t):
    """The same work list from bucketed tables: the efforts come in by rounds, and nothing is moved to compare."""
    pairs, efforts = (f"{x}_{uuid.uuid4().hex}" for x in ("pairs", "efforts"))
    buckets = max(8, t.spark.sparkContext.defaultParallelism)
    S.append_pairs(t.facts.select(*PAIRS).distinct(), pairs, buckets, scratch_path(t.spark, "pairs"))
    where = scratch_path(t.spark, "efforts")
    for part in (F.col("round") < 4, ~(F.col("round") < 4)):
        S.append_pairs(S.settled_efforts(t.ledger.where(part)), efforts, buckets, where)
    return S.pending_pairs(t.spark, pairs, efforts, 8)


@query("assign_batches", """SELECT ligand, row_number() OVER (ORDER BY ligand) - 1 AS idx,
    CAST((row_number() OVER (ORDER BY ligand) - 1) // 75 AS INT) AS batch_id FROM compounds""")
def assign_batches(t):
    return L.assign_batches(t.compounds.select("ligand"), 75)


@query("plan_pairs", """b AS (SELECT ligand, (row_number() OVER (ORDER BY ligand) - 1) // 400 AS batch_id FROM compounds)
    SELECT target, CAST(batch_id AS INT) AS batch_id, count(*) AS n_pairs, CAST(sum(ligand) AS BIGINT) AS ligand_sum
    FROM target_dim CROSS JOIN b GROUP BY 1, 2""")
def plan_pairs(t):
    return L.plan_totals(t.targets, L.assign_batches(t.compounds.select("ligand"), 400))


@query("plan_counts", """b AS (SELECT ligand, (row_number() OVER (ORDER BY ligand) - 1) // 400 AS batch_id FROM compounds),
    d AS (SELECT DISTINCT target, ligand FROM facts WHERE score <= -7)
    SELECT t.target, CAST(b.batch_id AS INT) AS batch_id, count(*) AS n_ligands, count(d.ligand) AS n_done,
    count(*) - count(d.ligand) AS n_pending
    FROM target_dim t CROSS JOIN b LEFT JOIN d ON d.target = t.target AND d.ligand = b.ligand GROUP BY 1, 2""")
def plan_counts(t):
    batches = L.assign_batches(t.compounds.select("ligand"), 400)
    return L.plan_counts(t.targets, batches, t.facts.where("score <= -7").select(*PAIRS))


@query("batch_summary", """SELECT round, batch_id, count(DISTINCT ligand) AS n_ligands, count(DISTINCT target) AS n_targets,
    count(DISTINCT CASE WHEN score IS NOT NULL THEN target END) AS n_ok,
    count(DISTINCT target) - count(DISTINCT CASE WHEN score IS NOT NULL THEN target END) AS n_failed,
    count(*) FILTER (WHERE score <= -7) AS total_hits FROM facts GROUP BY 1, 2""")
def batch_summary(t):
    return L.batch_summary(t.facts)


BATCH_TOP = """best AS (SELECT round, batch_id, target, min(score) AS score, arg_min(ligand, (score, ligand)) AS ligand
        FROM (SELECT round, batch_id, target, ligand, score FROM facts WHERE score IS NOT NULL) GROUP BY 1, 2, 3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY round, batch_id ORDER BY score, target, ligand) AS rank FROM best)"""


@query("batch_top", BATCH_TOP + " SELECT round, batch_id, target, score, ligand, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5")
def batch_top(t):
    return L.batch_top(t.facts)


@query("batch_top_nested", BATCH_TOP + """ SELECT round, batch_id,
    string_agg(target || ':' || ligand, ' ' ORDER BY rank) AS top FROM ranked WHERE rank <= 5 GROUP BY 1, 2""")
def batch_top_nested(t):
    return L.nest_top(L.batch_top(t.facts)).select("round", "batch_id", F.array_join(
        F.transform("top", lambda s: F.concat_ws(":", s["target"].cast("string"), s["ligand"].cast("string"))), " ").alias("top"))


@query("batch_report", BATCH_TOP + """, n5 AS (SELECT round, batch_id, string_agg(target || ':' || ligand, ' ' ORDER BY rank) AS top FROM ranked WHERE rank <= 5 GROUP BY 1, 2),
    ft AS (SELECT round, batch_id, target FROM facts GROUP BY 1, 2, 3 HAVING count(score) = 0),
    fl AS (SELECT round, batch_id, string_agg(CAST(target AS VARCHAR), ' ' ORDER BY target) AS failed_targets FROM ft GROUP BY 1, 2),
    ts AS (SELECT year(l_shipdate) - 1994 AS round, month(l_shipdate) AS batch_id, min(l_shipdate) AS s, max(l_shipdate) AS e FROM lineitem GROUP BY 1, 2),
    b AS (SELECT round, batch_id, count(DISTINCT ligand) AS n_ligands, count(DISTINCT target) AS n_targets, count(DISTINCT CASE WHEN score IS NOT NULL THEN target END) AS n_ok,
        count(*) FILTER (WHERE score <= -7) AS total_hits FROM facts GROUP BY 1, 2)
    SELECT b.*, n_targets - n_ok AS n_failed, round(epoch(e) - epoch(s), 1) AS elapsed_s, top, coalesce(failed_targets, '') AS failed_targets
    FROM b LEFT JOIN n5 USING (round, batch_id) LEFT JOIN fl USING (round, batch_id) LEFT JOIN ts USING (round, batch_id)""")
def batch_report(t):
    day = F.col("l_shipdate").cast("timestamp")
    times = t.read("lineitem").select((F.year("l_shipdate") - 1994).alias("round"), F.month("l_shipdate").alias("batch_id"),
                                      day.alias("started"), day.alias("completed"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return L.batch_report(t.facts, times).drop("completed_at").withColumn("failed_targets", text("failed_targets")).withColumn("top", F.array_join(
        F.transform("top", lambda s: F.concat_ws(":", s["target"].cast("string"), s["ligand"].cast("string"))), " "))


@query("batch_failed", """SELECT round, batch_id, ligand AS target FROM facts GROUP BY 1, 2, 3 HAVING count(score) = 0""")
def batch_failed(t):
    return L.batch_failed(t.facts.withColumn("target", F.col("ligand")))


@query("campaign_status", """s AS (SELECT round, batch_id, count(DISTINCT ligand) AS n_ligands,
    count(DISTINCT target) - count(DISTINCT CASE WHEN score IS NOT NULL THEN target END) AS n_failed,
    count(*) FILTER (WHERE score <= -7) AS total_hits FROM facts GROUP BY 1, 2)
    SELECT count(*) AS n_batches, CAST(sum(n_ligands) AS BIGINT) AS total_ligands, CAST(sum(total_hits) AS BIGINT) AS total_hits,
    count(*) FILTER (WHERE n_failed > 0) AS n_warn, count(*) FILTER (WHERE n_failed = 0) AS n_ok FROM s""")
def campaign_status(t):
    return L.campaign_status(L.batch_summary(t.facts))


@query("campaign_top", BATCH_TOP + """ SELECT round, batch_id, target, score, ligand FROM ranked WHERE rank <= 5
    ORDER BY score, target, ligand, round, batch_id LIMIT 5""")
def campaign_top(t):
    return L.campaign_top(t.facts)


ROUNDS = """pairs AS (SELECT round, target, ligand, min(score) AS score, max(exh) AS exh FROM facts GROUP BY 1, 2, 3),
    best AS (SELECT round, target, ligand, score, row_number() OVER (PARTITION BY round ORDER BY score, target, ligand) AS rn
        FROM pairs WHERE score IS NOT NULL),
    rounds AS (SELECT p.round, max(exh) AS exh, count(DISTINCT p.ligand) AS n_ligands, count(DISTINCT p.target) AS n_targets,
        count(*) FILTER (WHERE p.score <= -7) AS n_hits, max(b.score) AS best_score, max(b.ligand) AS best_ligand,
        max(b.target) AS best_target FROM pairs p LEFT JOIN best b ON b.round = p.round AND b.rn = 1 GROUP BY p.round)"""


@query("round_summary", ROUNDS + " SELECT * FROM rounds")
def round_summary(t):
    return L.round_summary(t.facts)


@query("upsert_rounds", ROUNDS + """, early AS (SELECT round, count(*) AS n FROM facts GROUP BY 1)
    SELECT round, n AS n_hits FROM early WHERE round > 3 UNION ALL SELECT round, n_hits FROM rounds WHERE round <= 3""")
def upsert_rounds(t):
    stale = t.facts.groupBy("round").agg(F.count("*").alias("n_hits"))
    fresh = L.round_summary(t.facts).where("round <= 3").select("round", "n_hits")
    path = scratch_path(t.spark, "rounds")
    L.write_rounds(stale, path)
    L.write_rounds(fresh, path)
    return t.spark.read.parquet(path).select(F.col("round").cast("int").alias("round"), "n_hits")


@query("hit_trend", """f AS (SELECT target, ligand, min(round * 100 + batch_id) AS b FROM facts WHERE score <= -7 GROUP BY 1, 2),
    n AS (SELECT b, count(*) AS new_hits FROM f GROUP BY 1),
    d AS (SELECT round, batch_id, count(DISTINCT ligand) AS lig, min(CASE WHEN score <= -7 THEN score END) AS best FROM facts GROUP BY 1, 2)
    SELECT round, batch_id, CAST(sum(coalesce(new_hits, 0)) OVER w AS BIGINT) AS cum_hits, coalesce(new_hits, 0) AS new_hits,
    min(best) OVER w AS best_score, CAST(sum(lig) OVER w AS BIGINT) AS n_ligands_docked
    FROM d LEFT JOIN n ON n.b = d.round * 100 + d.batch_id
    WINDOW w AS (ORDER BY round, batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def hit_trend(t):
    return L.hit_trend(t.facts)


@query("trend_steps", """h AS (SELECT round, batch_id, count(*) AS n FROM facts WHERE score <= -7 GROUP BY 1, 2),
    c AS (SELECT round, batch_id, CAST(sum(n) OVER (PARTITION BY round ORDER BY batch_id) AS BIGINT) AS cum_hits FROM h)
    SELECT round, batch_id, cum_hits, greatest(0, coalesce(cum_hits - lag(cum_hits) OVER (PARTITION BY round ORDER BY batch_id), cum_hits)) AS new_hits FROM c""")
def trend_steps(t):
    from pyspark.sql import Window

    n = t.facts.where("score <= -7").groupBy("round", "batch_id").agg(F.count("*").alias("n"))
    cumulative = n.select("round", "batch_id", F.sum("n").over(Window.partitionBy("round").orderBy("batch_id")).alias("cum_hits"))
    return L.trend_from_cumulative(cumulative)


@query("near_miss_upgrade", f"""nm AS (SELECT DISTINCT target, ligand FROM facts WHERE score > -7 AND score <= -5.5),
    m AS (SELECT count(*) AS a, count(h.target) AS b FROM nm LEFT JOIN top_pairs h ON h.target = nm.target AND h.ligand = nm.ligand)
    SELECT a AS prev_near_misses, b AS upgraded, round(coalesce(b / nullif(a, 0), 0), 4) AS upgrade_rate FROM m""")
def near_miss_upgrade(t):
    return L.near_miss_upgrade(t.facts, H.top_hits(t.facts))


@query("near_miss_upgrade_by_round", f"""nm AS (SELECT DISTINCT target, ligand FROM facts WHERE score > -7 AND score <= -5.5 AND round = 2),
    h AS (SELECT DISTINCT target, ligand FROM facts WHERE score <= -7 AND round = 3),
    m AS (SELECT count(*) AS a, count(h.target) AS b FROM nm LEFT JOIN h ON h.target = nm.target AND h.ligand = nm.ligand)
    SELECT CAST(3 AS INT) AS round, a AS prev_near_misses, b AS upgraded, round(coalesce(b / nullif(a, 0), 0), 4) AS upgrade_rate FROM m""")
def near_miss_upgrade_by_round(t):
    return L.near_miss_upgrade(t.facts, H.top_hits(t.facts.where("round = 3")), round_no=3, prev_round=2)


# seen from the ligand's side: some ligands have scores from one source only
STATS = """SELECT ligand AS target, min(score) AS best_score, arg_min(target, (score, target)) AS best_ligand, count(*) AS n_scored,
    count(*) FILTER (WHERE score <= -7) AS n_hits FROM (SELECT * FROM facts WHERE score IS NOT NULL AND {where}) GROUP BY ligand"""


@query("merge_score_sources", f"""a AS ({STATS.format(where="round % 2 <> 0")}),
    b AS ({STATS.format(where="round % 2 = 0")})
    SELECT coalesce(a.target, b.target) AS target,
    CASE WHEN a.target IS NULL OR b.best_score < a.best_score THEN b.best_score ELSE a.best_score END AS best_score,
    CASE WHEN a.target IS NULL OR b.best_score < a.best_score THEN b.best_ligand ELSE a.best_ligand END AS best_ligand,
    CASE WHEN a.target IS NULL THEN b.n_scored WHEN b.best_score < a.best_score THEN a.n_scored + b.n_scored ELSE a.n_scored END AS n_scored,
    CASE WHEN a.target IS NULL THEN b.n_hits WHEN b.best_score < a.best_score THEN a.n_hits + b.n_hits ELSE a.n_hits END AS n_hits
    FROM a FULL JOIN b ON a.target = b.target""")
def merge_score_sources(t):
    swapped = t.facts.select("round", F.col("ligand").alias("target"), F.col("target").alias("ligand"), "score")
    return L.merge_score_sources(H.target_stats(swapped.where("round % 2 <> 0")), H.target_stats(swapped.where("round % 2 = 0")))


@query("apply_refinement", """r AS (SELECT target, ligand, min(score) AS new FROM facts WHERE round = 7 AND score IS NOT NULL GROUP BY 1, 2)
    SELECT h.target, h.ligand, h.first_seen_round, coalesce(r.new, h.score) AS score
    FROM top_pairs h LEFT JOIN r ON r.target = h.target AND r.ligand = h.ligand""")
def apply_refinement(t):
    return L.apply_refinement(H.top_hits(t.facts), t.facts.where("round = 7"))


REFINED = """old AS (SELECT target, ligand, min(score) AS score FROM facts WHERE round <= 4 AND score <= -7 GROUP BY 1, 2),
    new AS (SELECT target, ligand, min(score) AS score FROM facts WHERE round > 4 GROUP BY 1, 2),
    d AS (SELECT n.target, n.ligand, n.score AS new_score, o.score AS old_score, round(n.score - o.score, 3) AS delta
        FROM new n LEFT JOIN old o ON o.target = n.target AND o.ligand = n.ligand),
    r AS (SELECT *, CASE WHEN new_score IS NULL THEN 'failed' WHEN delta < -0.05 THEN 'improved' WHEN delta > 0.05 THEN 'worsened'
        ELSE 'unchanged' END AS outcome FROM d)"""


def _refined(t):
    new = t.facts.where("round > 4").groupBy(*PAIRS).agg(F.min("score").alias("score"))
    return L.refine_deltas(H.top_hits(t.facts.where("round <= 4")), new)


@query("refine_deltas", REFINED + " SELECT target, ligand, new_score, old_score, delta, outcome FROM r")
def refine_deltas(t):
    return _refined(t)


@query("refine_outcomes", REFINED + " SELECT outcome, count(*) AS n_pairs FROM r GROUP BY 1")
def refine_outcomes(t):
    return L.outcome_counts(_refined(t))


@query("failure_log", """SELECT target, CASE WHEN line % 2 = 0 THEN 'timeout' ELSE 'no_output' END AS reason, count(*) AS n_failures
    FROM facts WHERE score IS NULL OR score > -1 GROUP BY 1, 2""")
def failure_log(t):
    reason = F.when(F.col("line") % 2 == 0, "timeout").otherwise("no_output")
    return L.failure_log(t.facts.where("score IS NULL OR score > -1").withColumn("reason", reason))


@query("dedupe_facts", """r AS (SELECT round, batch_id, target, ligand, score,
    row_number() OVER (PARTITION BY target, ligand ORDER BY score, round, batch_id) AS rn FROM facts WHERE score IS NOT NULL)
    SELECT round, batch_id, target, ligand, score FROM r WHERE rn = 1""")
def dedupe_facts(t):
    return L.dedupe_facts(t.facts.where("score IS NOT NULL").select("round", "batch_id", "target", "ligand", "score"))


@query("keep_first_per_ligand", """r AS (SELECT ligand, target, score, row_number() OVER (PARTITION BY ligand ORDER BY score, target) AS rn FROM top_pairs)
    SELECT ligand, target, score FROM r WHERE rn = 1""")
def keep_first_per_ligand(t):
    return keep_first(H.top_hits(t.facts).select("ligand", "target", "score"), ["ligand"], ["score", "target"])


@query("pair_set_operations", """nm AS (SELECT DISTINCT target, ligand FROM facts WHERE score > -7 AND score <= -5.5),
    h AS (SELECT DISTINCT target, ligand FROM facts WHERE score <= -7),
    u AS (SELECT * FROM nm UNION SELECT * FROM h), i AS (SELECT * FROM nm INTERSECT SELECT * FROM h), e AS (SELECT * FROM nm EXCEPT SELECT * FROM h)
    SELECT 'union' AS operation, count(*) AS n_pairs FROM u UNION ALL SELECT 'intersect', count(*) FROM i
    UNION ALL SELECT 'except', count(*) FROM e""")
def pair_set_operations(t):
    near = t.facts.where("score > -7 AND score <= -5.5").select(*PAIRS).distinct()
    hits = t.facts.where("score <= -7").select(*PAIRS).distinct()
    # membership flags of each pair answer all three set operations in one aggregation
    flags = (
        near.withColumn("near", F.lit(1)).unionByName(hits.withColumn("hit", F.lit(1)), allowMissingColumns=True)
        .groupBy(*PAIRS).agg(F.max("near").alias("near"), F.max("hit").alias("hit")))
    counts = flags.agg(
        F.count("*").alias("union"),
        F.count_if(F.col("near").isNotNull() & F.col("hit").isNotNull()).alias("intersect"),
        F.count_if(F.col("hit").isNull()).alias("except"))
    return counts.unpivot([], ["union", "intersect", "except"], "operation", "n_pairs")
