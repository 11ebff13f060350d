"""Hit, promiscuity, selectivity and rank-recovery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hits as H
from ..operators.ordering import ranked_top
from .registry import query

STATS = """t_stats AS (SELECT target, count(*) AS n_scored, count(*) FILTER (WHERE score <= -7) AS n_hits,
    round(count(*) FILTER (WHERE score <= -7) / count(*), 3) AS hit_rate,
    min(CASE WHEN score < 0 THEN score END) AS best_score, arg_min(ligand, (score, ligand)) FILTER (WHERE score < 0) AS best_ligand
    FROM (SELECT * FROM facts WHERE score IS NOT NULL {and_where}) GROUP BY target)"""
ALL_STATS = STATS.format(and_where="")


@query("top_hits", "SELECT target, ligand, score, first_seen_round FROM top_pairs")
def top_hits(t):
    return H.top_hits(t.facts)


@query("top_hits_limited", """SELECT target, ligand, min(score) AS score, min(round) AS first_seen_round FROM facts
    WHERE score <= -9 AND ligand NOT IN (10, 11, 12) GROUP BY 1, 2 ORDER BY score, target, ligand LIMIT 100""")
def top_hits_limited(t):
    return H.top_hits(t.facts, threshold=-9.0, top=100, exclude=(10, 11, 12))


@query("first_seen_round", "SELECT first_seen_round, count(*) AS n_pairs, min(score) AS best_score FROM top_pairs GROUP BY 1")
def first_seen_round(t):
    return H.top_hits(t.facts).groupBy("first_seen_round").agg(F.count("*").alias("n_pairs"), F.min("score").alias("best_score"))


@query("exclude_flagged_ids", "SELECT target, ligand, score FROM top_pairs WHERE ligand NOT IN (SELECT ligand FROM compounds WHERE pains)")
def exclude_flagged_ids(t):
    flagged = t.compounds.where("pains").select("ligand")
    return H.exclude_ids(H.top_hits(t.facts), flagged).select("target", "ligand", "score")


@query("static_exclusions", """SELECT CAST(target AS VARCHAR) AS target, 'CHEMBL' || ligand AS ligand, score FROM top_pairs
    WHERE ligand NOT IN (10, 11, 12, 112998, 9937, 429188)""")
def static_exclusions(t):
    named = t.facts.select("round", F.col("target").cast("string").alias("target"), F.concat(F.lit("CHEMBL"), "ligand").alias("ligand"), "score")
    return H.top_hits(named).select("target", "ligand", "score")


@query("target_stats", ALL_STATS + " SELECT * FROM t_stats")
def target_stats(t):
    return H.target_stats(t.facts)


DOCKED = """d AS (SELECT target, ligand, min(score) AS score FROM facts WHERE score IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT target, count(*) AS total_docked, count(*) FILTER (WHERE score <= -7) AS hits,
    count(*) FILTER (WHERE score <= -9) AS leads, min(score) AS best_energy, arg_min(ligand, (score, ligand)) AS best_ligand FROM d GROUP BY 1)"""


@query("docking_summary", DOCKED + " SELECT * FROM s")
def docking_summary(t):
    return H.docking_summary(t.facts)


@query("docking_totals", DOCKED + """ SELECT CAST(sum(total_docked) AS BIGINT) AS total_docked, CAST(sum(hits) AS BIGINT) AS total_hits,
    CAST(sum(leads) AS BIGINT) AS total_leads, count(*) FILTER (WHERE hits > 0) AS targets_with_hits FROM s""")
def docking_totals(t):
    return H.docking_totals(H.docking_summary(t.facts))


PROMISCUOUS = """p AS (SELECT ligand, target, min(score) AS score FROM yearly WHERE {where} GROUP BY 1, 2),
    n AS (SELECT count(DISTINCT target) AS total FROM yearly),
    r AS (SELECT ligand, count(*) AS n_targets, min(score) AS best_score, max(score) AS worst_score, max(total) AS total_targets
        FROM p, n GROUP BY 1),
    report AS (SELECT *, round(n_targets / total_targets, 3) AS fraction, n_targets / total_targets >= {cut} AS promiscuous,
        CASE WHEN n_targets / total_targets >= {cut} THEN 'Hits ' || n_targets || '/' || total_targets || ' targets' END AS reason FROM r)"""
HITS_ONLY = PROMISCUOUS.format(where="score <= -7", cut="0.8")


@query("promiscuity", HITS_ONLY + " SELECT * FROM report")
def promiscuity(t):
    return H.promiscuity(t.yearly)


@query("promiscuity_any_score", PROMISCUOUS.format(where="score IS NOT NULL", cut="1.0") + """
    SELECT promiscuous, count(*) AS n_ligands, min(best_score) AS best_score FROM report GROUP BY 1""")
def promiscuity_any_score(t):
    return H.promiscuity(t.yearly, fraction=1.0, only_hits=False).groupBy("promiscuous").agg(
        F.count("*").alias("n_ligands"), F.min("best_score").alias("best_score"))


@query("promiscuous_detail", HITS_ONLY + """ SELECT p.ligand, CAST(p.target AS INT) AS target, p.score FROM p JOIN report r
    ON r.ligand = p.ligand WHERE r.promiscuous""")
def promiscuous_detail(t):
    return H.promiscuous_detail(t.yearly, H.promiscuity(t.yearly))


@query("promiscuity_split", HITS_ONLY + """ SELECT ligand, n_targets, ligand IN (SELECT ligand FROM compounds WHERE pains) AS known
    FROM report WHERE promiscuous""")
def promiscuity_split(t):
    report = H.promiscuity(t.yearly)
    return H.promiscuity_split(report, t.compounds.where("pains")).select("ligand", "n_targets", "known")


@query("clean_hits", HITS_ONLY + """ SELECT target, ligand, score FROM top_pairs
    WHERE ligand NOT IN (SELECT ligand FROM report WHERE promiscuous)""")
def clean_hits(t):
    flagged = H.promiscuity(t.yearly).where("promiscuous")
    return H.exclude_ids(H.top_hits(t.facts), flagged).select("target", "ligand", "score")


@query("enrich_hits", """best AS (SELECT *, row_number() OVER (ORDER BY score, target, ligand) AS rank FROM top_pairs),
    sel AS (SELECT ligand, max(score) AS host_score FROM facts WHERE score IS NOT NULL GROUP BY 1)
    SELECT CAST(rank AS INT) AS rank, b.target, b.ligand, b.score, b.first_seen_round, d.name, d.max_identity, d.pan_tick,
    c.smiles, c.mw, s.host_score FROM best b LEFT JOIN target_dim d ON d.target = b.target
    LEFT JOIN compounds c ON c.ligand = b.ligand LEFT JOIN sel s ON s.ligand = b.ligand WHERE rank <= 60""")
def enrich_hits(t):
    host = t.facts.where("score IS NOT NULL").groupBy("ligand").agg(F.max("score").alias("host_score"))
    return H.enrich_hits(
        H.top_hits(t.facts), t.targets.select("target", "name", "max_identity", "pan_tick"),
        t.compounds.select("ligand", "smiles", "mw"), host, top=60)


@query("append_new_targets", """SELECT target, name, 'ranked' AS origin FROM target_dim WHERE target % 2 = 0
    UNION ALL SELECT target, NULL AS name, 'added' AS origin FROM (SELECT target FROM target_dim WHERE target % 2 <> 0 UNION SELECT target FROM facts)
    WHERE target NOT IN (SELECT target FROM target_dim WHERE target % 2 = 0)""")
def append_new_targets(t):
    existing = t.targets.where("target % 2 = 0").select("target", "name", F.lit("ranked").alias("origin"))
    new = t.targets.where("target % 2 <> 0").select("target").union(t.facts.select("target")).distinct().withColumn("origin", F.lit("added"))
    return H.append_new(existing, new, ["target"])


@query("annotate_scores", ALL_STATS + """
    SELECT d.target, d.name, CASE WHEN s.target IS NOT NULL THEN round(s.best_score, 3) ELSE d.acctbal END AS best_score, s.best_ligand, s.n_hits, s.hit_rate
    FROM target_dim d LEFT JOIN t_stats s ON s.target = d.target AND s.best_score < 0""")
def annotate_scores(t):
    old = t.targets.select("target", "name", F.col("acctbal").alias("best_score"))
    return H.annotate_scores(old, H.target_stats(t.facts))


SELECTIVITY = """a AS (SELECT ligand, CASE WHEN min(score) > -11.5 THEN 0 ELSE min(score) END AS primary_score
        FROM facts WHERE target % 2 = 0 AND score IS NOT NULL GROUP BY 1),
    b AS (SELECT ligand, min(score) AS host_score FROM facts WHERE target % 2 = 1 AND score IS NOT NULL GROUP BY 1),
    j AS (SELECT a.ligand, primary_score, host_score, CASE WHEN primary_score <> 0 THEN host_score / primary_score END AS r
        FROM a LEFT JOIN b ON a.ligand = b.ligand)"""


def _selectivity(t, tiers=4):
    scored = t.facts.where("score IS NOT NULL")
    best = F.min("score")
    primary = scored.where("target % 2 = 0").groupBy("ligand").agg(F.when(best > -11.5, 0.0).otherwise(best).alias("score"))
    host = scored.where("target % 2 = 1").groupBy("ligand").agg(best.alias("score"))
    return H.selectivity(primary, host, tiers)


@query("selectivity", SELECTIVITY + """ SELECT ligand, primary_score, host_score, round(r, 4) AS ratio, r < 0.8 AS selective,
    CASE WHEN host_score IS NULL THEN 'docking failed' WHEN r IS NULL THEN 'no primary score' WHEN r < 0.6 THEN 'SELECTIVE'
    WHEN r < 0.8 THEN 'Mod selective' WHEN r <= 1 THEN 'Non-selective' ELSE 'RISKY' END AS verdict FROM j""")
def selectivity(t):
    return _selectivity(t)


@query("selectivity_verdicts", SELECTIVITY + """ SELECT CASE WHEN host_score IS NULL THEN 'docking failed' WHEN r IS NULL THEN 'no primary score'
    WHEN r < 0.6 THEN 'SELECTIVE' WHEN r < 0.8 THEN 'Mod selective' ELSE 'Non-selective' END AS verdict, count(*) AS n_ligands FROM j GROUP BY 1""")
def selectivity_verdicts(t):
    return H.verdict_counts(_selectivity(t, tiers=3))


SELECTED = """best AS (SELECT target FROM top_pairs GROUP BY 1 ORDER BY min(score), target LIMIT {n}),
    r AS (SELECT target, ligand, score, row_number() OVER (PARTITION BY target ORDER BY score, ligand) AS rank
        FROM top_pairs WHERE target IN (SELECT target FROM best))"""


@query("select_hits", SELECTED.format(n=5) + " SELECT target, ligand, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 7")
def select_hits(t):
    return H.select_hits(H.top_hits(t.facts), n_targets=5, n_hits=7).select("target", "ligand", "score", "rank")


@query("select_hits_listed", """r AS (SELECT target, ligand, score, row_number() OVER (PARTITION BY target ORDER BY score, ligand) AS rank
    FROM top_pairs WHERE target IN (3, 4)) SELECT target, ligand, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def select_hits_listed(t):
    return H.select_hits(H.top_hits(t.facts), targets=(3, 4)).select("target", "ligand", "score", "rank")


@query("priority_targets", STATS.format(and_where="AND target % 2 <> 0") + """,
    clean AS (SELECT target, min(score) AS k, 1 AS tier FROM facts WHERE score <= -7 AND target % 2 = 0 GROUP BY 1),
    listed AS (SELECT d.target, CASE WHEN s.best_score < 0 THEN s.best_score ELSE -novelty_score END AS k,
        CASE WHEN s.best_score < 0 THEN 2 ELSE 3 END AS tier FROM target_dim d LEFT JOIN t_stats s ON s.target = d.target),
    u AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY tier, k) AS rn FROM (SELECT * FROM clean UNION ALL SELECT * FROM listed))
    SELECT target, CAST(tier AS INT) AS tier, CAST(row_number() OVER (ORDER BY tier, k, target) AS INT) AS rank FROM u WHERE rn = 1
    ORDER BY rank LIMIT 80""")
def priority_targets(t):
    clean = t.facts.where("score <= -7 AND target % 2 = 0")
    stats = H.target_stats(t.facts.where("target % 2 <> 0")).select("target", "best_score")
    listed = t.targets.select("target", F.col("novelty_score").alias("final_score")).join(stats, "target", "left")
    return H.priority_targets(clean, listed, 80)


@query("hits_by_target", """b AS (SELECT * FROM top_pairs ORDER BY score, target, ligand LIMIT 400)
    SELECT target, count(*) AS n_ligands, string_agg(CAST(ligand AS VARCHAR), ' ' ORDER BY score, ligand) AS ligands FROM b GROUP BY 1""")
def hits_by_target(t):
    out = H.hits_by_target(H.top_hits(t.facts), 400)
    return out.withColumn("ligands", F.array_join(F.transform("ligands", lambda x: x.cast("string")), " "))


@query("ranked_hits", """SELECT CAST(row_number() OVER (ORDER BY score, target, ligand) AS INT) AS rank, target, ligand, score
    FROM top_pairs ORDER BY rank LIMIT 50""")
def ranked_hits(t):
    hits = H.top_hits(t.facts).select("target", "ligand", "score")
    return ranked_top(hits, [F.col("score"), F.col("target"), F.col("ligand")], 50)


POCKETS = """pk AS (SELECT DISTINCT target, CAST(line % (1 + target % 3) AS INT) AS pocket_idx FROM facts)"""


def _pockets(t):
    return t.facts.select("target", (F.col("line") % (1 + F.col("target") % 3)).cast("int").alias("pocket_idx")).distinct()


@query("secondary_pocket_plan", POCKETS + """, multi AS (SELECT target FROM pk GROUP BY 1 HAVING count(*) >= 2),
    best AS (SELECT target FROM top_pairs WHERE target IN (SELECT target FROM multi) GROUP BY 1 ORDER BY min(score), target LIMIT 6),
    r AS (SELECT target, ligand, score, row_number() OVER (PARTITION BY target ORDER BY score, ligand) AS ligand_rank
        FROM top_pairs WHERE target IN (SELECT target FROM best))
    SELECT pk.target, pk.pocket_idx, r.ligand, r.score, CAST(r.ligand_rank AS INT) AS ligand_rank
    FROM pk JOIN r ON r.target = pk.target WHERE pk.pocket_idx >= 1 AND r.ligand_rank <= 8""")
def secondary_pocket_plan(t):
    return H.secondary_pocket_plan(_pockets(t), H.top_hits(t.facts), n_targets=6, n_ligands=8)


@query("multipocket_summary", """p AS (SELECT target, ligand, score, CAST(line % 3 AS INT) AS pocket_idx FROM facts WHERE score IS NOT NULL)
    SELECT target, pocket_idx, count(*) AS n_docked, count(*) FILTER (WHERE score <= -7) AS n_hits, min(score) AS best_score,
    arg_min(ligand, (score, ligand)) AS best_ligand FROM p GROUP BY 1, 2""")
def multipocket_summary(t):
    return H.multipocket_summary(t.facts.withColumn("pocket_idx", (F.col("line") % 3).cast("int")))


@query("multipocket_hits", "SELECT target, CAST(line % 3 AS INT) AS pocket_idx, ligand, min(score) AS score FROM facts WHERE score <= -7 GROUP BY 1, 2, 3")
def multipocket_hits(t):
    return H.multipocket_hits(t.facts.withColumn("pocket_idx", (F.col("line") % 3).cast("int")))


@query("multipocket_totals", """h AS (SELECT target, line % 3 AS pocket_idx, ligand FROM facts WHERE score <= -7 GROUP BY 1, 2, 3)
    SELECT count(*) AS n_hits, count(DISTINCT target) AS n_targets FROM h""")
def multipocket_totals(t):
    return H.multipocket_hits(t.facts.withColumn("pocket_idx", (F.col("line") % 3).cast("int"))).agg(
        F.count("*").alias("n_hits"), F.countDistinct("target").alias("n_targets"))


RANKED = """h AS (SELECT target, score FROM top_pairs),
    ranked AS (SELECT k.compound, k.target, k.score, (SELECT count(*) FROM h WHERE h.target = k.target AND h.score > k.score) AS n_worse,
        (SELECT count(*) FROM h WHERE h.target = k.target) AS n_hits FROM (SELECT DISTINCT * FROM known_actives) k),
    p AS (SELECT *, round(100 * n_worse / n_hits, 2) AS percentile FROM ranked WHERE n_hits > 0)"""
RECOVERY = """, s AS (SELECT compound, count(*) AS n_scored, round(avg(score), 3) AS avg_score, min(score) AS best_score,
        arg_min(target, (score, target)) AS best_target FROM (SELECT DISTINCT * FROM known_actives) GROUP BY 1),
    q AS (SELECT compound, round(avg(percentile), 2) AS avg_percentile FROM p GROUP BY 1),
    rec AS (SELECT s.*, q.avg_percentile FROM s LEFT JOIN q ON q.compound = s.compound)"""


def _ranked(t):
    actives = t.known_actives.distinct()
    return actives, H.percentile_rank(actives, H.top_hits(t.facts))


@query("percentile_rank", RANKED + " SELECT compound, target, score, n_worse, n_hits, percentile FROM p")
def percentile_rank(t):
    return _ranked(t)[1]


@query("rank_recovery", RANKED + RECOVERY + " SELECT compound, n_scored, avg_score, avg_percentile, best_score, best_target FROM rec")
def rank_recovery(t):
    return H.rank_recovery(*_ranked(t))


@query("recovery_verdict", RANKED + RECOVERY + """, v AS (SELECT count(*) FILTER (WHERE avg_percentile >= 60) AS n_pass FROM rec)
    SELECT n_pass, CASE WHEN n_pass >= 3 THEN 'PASS' WHEN n_pass >= 1 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict FROM v""")
def recovery_verdict(t):
    return H.recovery_verdict(H.rank_recovery(*_ranked(t)))


@query("score_distribution", """SELECT target, count(*) AS n_scored, min(score) AS min_score, median(score) AS median_score,
    max(score) AS max_score FROM facts WHERE score IS NOT NULL GROUP BY 1""")
def score_distribution(t):
    return H.score_distribution(t.facts)


@query("score_histogram", "SELECT floor(score / 0.5) * 0.5 AS bin, count(*) AS n_facts FROM facts WHERE score IS NOT NULL GROUP BY 1")
def score_histogram(t):
    return H.score_histogram(t.facts)


@query("risk_scatter", ALL_STATS + """ SELECT d.target, s.best_score, round(coalesce(max_identity, 0) * 100, 2) AS identity_pct,
    CASE WHEN coalesce(max_identity, 0) * 100 < 20 THEN 'low_risk' WHEN coalesce(max_identity, 0) * 100 < 40 THEN 'medium_risk' ELSE 'high_risk' END AS risk,
    rnai_evidence, druggable_pockets FROM target_dim d JOIN t_stats s ON s.target = d.target""")
def risk_scatter(t):
    return H.risk_scatter(t.targets, H.target_stats(t.facts))


@query("property_space", """r AS (SELECT h.target, h.ligand, CASE WHEN h.ligand % 7 = 0 THEN NULL ELSE c.mw END AS mw, c.logp, h.score, h.target % 4 = 0 AS pan_tick
    FROM top_pairs h JOIN compounds c ON c.ligand = h.ligand)
    SELECT *, mw <= 500 AND logp <= 5 AS in_ro5_box, floor(score / 0.5) * 0.5 AS score_bin FROM r WHERE mw IS NOT NULL""")
def property_space(t):
    rows = H.top_hits(t.facts).join(t.compounds.select("ligand", "mw", "logp"), "ligand").select(
        "target", "ligand", F.when(F.col("ligand") % 7 == 0, "n/a").otherwise(F.col("mw").cast("string")).alias("mw"),
        F.col("logp").cast("string").alias("logp"), F.col("score").cast("string").alias("score"),
        F.when(F.col("target") % 4 == 0, "Yes").otherwise("No").alias("pan_tick"))
    return H.property_space(rows)
