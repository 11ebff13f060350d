"""Formulas on published values and on the boundaries of each rule."""

import pytest
from pyspark.sql import functions as F

from sieveline.functions import chem, scores, text
from sieveline.functions.rules import Rule, first_match, rule_score
from sieveline.operators import contacts, hits, homology, ledger, library, targets


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(v, kind="double"):
    return F.lit(v).cast(kind)


@pytest.mark.parametrize("score,tier", [
    (-9.0, "lead"), (-8.999, "hit"), (-7.0, "hit"), (-6.999, "moderate"), (-5.0, "moderate"), (-4.999, "weak"), (None, "unknown")])
def test_tiers(spark, score, tier):
    assert one(spark, scores.score_tier(lit(score))) == tier


@pytest.mark.parametrize("score,zone", [
    (-7.0, "hit"), (-6.999, "near_miss"), (-5.5, "near_miss"), (-5.499, "clear_fail"), (None, None)])
def test_zones(spark, score, zone):
    assert one(spark, scores.score_zone(lit(score))) == zone


@pytest.mark.parametrize("exh,score,stored", [
    (None, -5.5, 4), (None, -5.4, 9999), (None, None, 9999), (6, -5.4, 6), (None, -12.0, 4)])
def test_legacy_effort(spark, exh, score, stored):
    assert one(spark, scores.stored_exhaustiveness(lit(exh, "int"), lit(score))) == stored


@pytest.mark.parametrize("identity,risk", [
    (0.0, "VERY LOW"), (0.2, "LOW"), (0.4, "MEDIUM"), (0.8, "HIGH"), (0.199, "VERY LOW"), (None, None)])
def test_host_risk(spark, identity, risk):
    assert one(spark, scores.host_risk(lit(identity))) == risk


@pytest.mark.parametrize("volume,box", [(2519.0, 25), (None, 20), (0.0, 20), (300.0, 20), (1e6, 30)])
def test_search_box(spark, volume, box):
    assert one(spark, scores.search_box(lit(volume))) == box


def test_search_box_floor(spark):
    assert one(spark, scores.search_box(lit(2519.0), "floor")) == 24


@pytest.mark.parametrize("box,exh", [(20, 4), (25, 6), (30, 8), (40, 8), (None, 4)])
def test_search_effort(spark, box, exh):
    assert one(spark, scores.search_effort(lit(box, "int"))) == exh


@pytest.mark.parametrize("primary,host,ratio,verdict", [
    (-11.781, 6.298, -0.5346, "SELECTIVE"), (-13.125, -5.61, 0.4274, "SELECTIVE"), (-10.0, -7.0, 0.7, "Mod selective"),
    (-10.0, -10.0, 1.0, "Non-selective"), (-10.0, -10.1, 1.01, "RISKY"), (0.0, -5.0, None, "no primary score"),
    (None, -5.0, None, "no primary score"), (-10.0, None, None, "docking failed")])
def test_selectivity(spark, primary, host, ratio, verdict):
    a = spark.createDataFrame([("L", primary)], "ligand string, score double")
    b = spark.createDataFrame([("L", host)], "ligand string, score double")
    row = hits.selectivity(a, b).first()
    assert (row.ratio, row.verdict) == (ratio, verdict)


def test_selectivity_keeps_unscored_ligands(spark):
    a = spark.createDataFrame([("L", -9.0), ("M", -8.0)], "ligand string, score double")
    b = spark.createDataFrame([("L", -3.0)], "ligand string, score double")
    assert {r.ligand: r.verdict for r in hits.selectivity(a, b).collect()} == {"L": "SELECTIVE", "M": "docking failed"}


@pytest.mark.parametrize("identity,coverage,call", [
    (61.462, 99.3, "Pan-tick ortholog"), (61.0, 70.0, "Pan-tick ortholog"), (61.0, 69.9, "Putative ortholog"),
    (40.0, 10.0, "Putative ortholog"), (39.9, 99.0, "Distant homolog"), (None, None, "No hit")])
def test_ortholog_call(spark, identity, coverage, call):
    assert one(spark, scores.ortholog_call(lit(identity), lit(coverage))) == call


def test_ortholog_summary_with_one_species(spark):
    calls = homology.ortholog_calls(
        spark.createDataFrame([("A",)], "accession string"),
        spark.createDataFrame([("A", "x", 61.462, 99.3)], "accession string, species string, identity_pct double, coverage_pct double"),
        ("x", "y"))
    row = homology.ortholog_summary(calls).first()
    assert (row.n_strong_orthologs, row.species_coverage, row.pan_tick) == (1, 1, True)


def test_promiscuity_published_case(spark):
    rows = [("L", i, -8.0) for i in range(111)] + [("M", i, -8.0) for i in range(110)]
    facts = spark.createDataFrame(rows, "ligand string, target int, score double")
    got = {r.ligand: (r.fraction, r.promiscuous) for r in hits.promiscuity(facts, n_targets=138).collect()}
    assert got == {"L": (0.804, True), "M": (0.797, False)}


def test_trend_published_case(spark):
    rows = [(1, 9, 30358), (1, 10, 30362), (1, 11, 30739), (1, 12, 30700)]
    out = ledger.trend_from_cumulative(spark.createDataFrame(rows, "round int, batch_id int, cum_hits long"))
    assert [r.new_hits for r in out.orderBy("batch_id").collect()] == [30358, 4, 377, 0]


@pytest.mark.parametrize("herg,ames,htox,pains,brenk,flag", [
    ("Flag", "Low risk", "Low risk", False, True, "FLAG(hERG)"), ("Possible", "Low risk", "Low risk", True, False, "WARN(hERG?,PAINS)"),
    ("Flag", "Flag", "Flag", True, True, "FLAG(hERG,AMES,Hepatotox)"), ("Low risk", "Possible", "Low risk", False, True, "WARN(AMES?,Brenk)"),
    ("Low risk", "Low risk", "Low risk", False, False, "CLEAN")])
def test_overall_flag(spark, herg, ames, htox, pains, brenk, flag):
    assert one(spark, chem.overall_flag(F.lit(herg), F.lit(ames), F.lit(htox), F.lit(pains), F.lit(brenk))) == flag


@pytest.mark.parametrize("alerts,flag,names", [
    (["SecAmine"], "Possible", "SecAmine"), (["SecAmine", "ArNitro"], "Flag", "ArNitro"), ([], "Low risk", ""), (None, "Low risk", "")])
def test_alerts(spark, alerts, flag, names):
    df = spark.createDataFrame([(alerts,)], "a array<string>")
    assert tuple(df.select(chem.alert_flag(F.col("a")), chem.alert_names(F.col("a"))).first()) == (flag, names)


@pytest.mark.parametrize("basic,rings,mw,logp,flag", [
    (1, 2, 301.0, 2.1, "Flag"), (1, 2, 300.0, 2.1, "Possible"), (1, 1, 400.0, 3.0, "Possible"), (0, 3, 400.0, 3.0, "Low risk"), (1, 0, 400.0, 3.0, "Low risk")])
def test_herg(spark, basic, rings, mw, logp, flag):
    assert one(spark, chem.herg_flag(lit(basic, "int"), lit(rings, "int"), lit(mw), lit(logp))) == flag


def test_esol_without_heavy_atoms(spark):
    got = one(spark, chem.esol_log_s(lit(1.0), lit(100.0), lit(2, "int"), lit(0, "int"), lit(0, "int")))
    assert got == pytest.approx(0.16 - 0.63 - 0.62 + 0.132, abs=0.006)


@pytest.mark.parametrize("score,status", [(-10.96, "PASS"), (-13.5, "PASS"), (-13.6, "FAIL"), (None, "FAILED")])
def test_reference_check(spark, score, status):
    case = spark.createDataFrame([(score, -11.5, 2.0)], "score double, reference_score double, tolerance double")
    assert contacts.reference_check(case).first().status == status


@pytest.mark.parametrize("raw,clean", [
    ("CHEMBL10_out", "CHEMBL10"), ("CHEMBL10_out.pdbqt", "CHEMBL10"), ("CHEMBL10.pdbqt", "CHEMBL10"), ("CHEMBL10", "CHEMBL10"), ("_outer", "_outer")])
def test_ligand_ids(spark, raw, clean):
    assert one(spark, text.normalise_ligand(F.lit(raw))) == clean


@pytest.mark.parametrize("fraction,shown", [(0.0, "0.0"), (0.615, "61.5"), (None, "")])
def test_percent_text(spark, fraction, shown):
    assert one(spark, text.percent_text(lit(fraction))) == shown


def test_rule_score_ignores_unknown_predicates(spark):
    df = spark.createDataFrame([(1, None)], "a int, b int")
    total, why = rule_score([Rule(F.col("a") > 0, 2, "a"), Rule(F.col("b") > 0, 5, "b")], start=1)
    assert tuple(df.select(total, why).first()) == (3, ["a"])


def test_first_match_order(spark):
    assert one(spark, first_match([(F.lit(None).cast("boolean"), "x"), (F.lit(True), "y"), (F.lit(True), "z")], "w")) == "y"


def protein(**over):
    base = dict(accession="P", name="", gene="", function="x", subcellular="", keywords=[], length=500,
                has_structure=False, has_ligands=True, alphafold_available=None)
    return {**base, **over}


SCHEMA = ("accession string, name string, gene string, function string, subcellular string, keywords array<string>, "
          "length int, has_structure boolean, has_ligands boolean, alphafold_available boolean")


def proteins(spark, *rows):
    order = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in order) for r in rows], SCHEMA)


@pytest.mark.parametrize("over,points", [
    ({}, 3), (dict(length=99), 2), (dict(length=1000), 3), (dict(length=1001), 2), (dict(has_ligands=False), 6),
    (dict(function=""), 5), (dict(function=None), 5), (dict(alphafold_available=True), 4), (dict(alphafold_available=True, has_structure=True), 3),
    (dict(name="Kinase receptor"), 6), (dict(keywords=["DNA replication"]), 5)])
def test_novelty(spark, over, points):
    assert targets.score_novelty(proteins(spark, protein(**over))).first().novelty_score == points


def test_novelty_names_first_class(spark):
    row = targets.score_novelty(proteins(spark, protein(name="protein kinase RECEPTOR"))).first()
    assert "Druggable class: receptor (+1)" in row.novelty_reasons


def test_known_targets_match_inside_words_unless_asked_not_to(spark):
    rows = [protein(accession="A", name="Tracheal protein"), protein(accession="B", gene="ache"), protein(accession="C", keywords=["Sodium channel"]),
            protein(accession="D", name="kinase")]
    df = proteins(spark, *rows)
    assert {r.accession for r in targets.exclude_known(df).collect()} == {"D"}
    assert {r.accession for r in targets.exclude_known(df, whole_word=True).collect()} == {"A", "D"}


def test_length_limits_are_inclusive(spark):
    df = proteins(spark, *[protein(accession=str(n), length=n) for n in (149, 150, 1500, 1501)])
    assert {r.accession for r in targets.filter_length(df).collect()} == {"150", "1500"}


def test_pocket_limits_and_order(spark):
    rows = [("T", 1, 0.5, 300.0), ("T", 2, 0.9, 900.0), ("T", 3, 0.49, 900.0), ("T", 4, 0.9, None), ("T", 5, None, 800.0), ("U", 1, 0.9, 299.0)]
    good = targets.filter_pockets(spark.createDataFrame(rows, "target string, pocket_id int, score double, volume double"))
    assert {(r.target, r.pocket_id, r.site_type) for r in good.collect()} == {("T", 2, "PRIMARY"), ("T", 1, "ALLOSTERIC_1")}


@pytest.mark.parametrize("sequence,signal", [
    ("M" * 10 + "G" * 5 + "L" * 15, True), ("M" * 29, False), ("Q" * 15 + "L" * 15, False), ("Q" * 15 + "S" + "L" * 14, True),
    ("Q" * 13 + "S" + "Q" + "Q" * 8 + "L" * 7, False), ("g" * 15 + "l" * 15, True)])
def test_gpi_signal(spark, sequence, signal):
    assert one(spark, homology.gpi_signal(F.lit(sequence))) is signal


def test_merge_score_sources_cases(spark):
    schema = "target string, best_score double, best_ligand string, n_scored long, n_hits long"
    a = spark.createDataFrame([("both", -8.0, "a", 10, 2), ("zero", 0.0, None, 3, 0), ("left", -6.0, "a", 5, 0), ("keep", -9.0, "a", 4, 1)], schema)
    b = spark.createDataFrame([("both", -9.0, "b", 5, 1), ("zero", -7.5, "b", 2, 1), ("right", -7.0, "b", 1, 1), ("keep", -8.0, "b", 6, 1)], schema)
    got = {r.target: tuple(r)[1:] for r in ledger.merge_score_sources(a, b).collect()}
    assert got == {"both": (-9.0, "b", 15, 3), "zero": (-7.5, "b", 2, 1), "left": (-6.0, "a", 5, 0), "right": (-7.0, "b", 1, 1), "keep": (-9.0, "a", 4, 1)}


def test_refinement_band(spark):
    old = spark.createDataFrame([("T", c, -8.0) for c in "abcd"], "target string, ligand string, score double")
    new = spark.createDataFrame([("T", "a", -8.051), ("T", "b", -8.05), ("T", "c", -7.9), ("T", "d", None)], "target string, ligand string, score double")
    got = {r.ligand: r.outcome for r in ledger.refine_deltas(old, new).collect()}
    assert got == {"a": "improved", "b": "unchanged", "c": "worsened", "d": "failed"}


def test_library_fallback_only_when_empty(spark):
    cols = "ligand int, smiles string, mw double, logp double, hbd int, hba int, num_ro5_violations int, max_phase int, atc_level1 string, atc_level2 string"
    row = lambda i, l2: (i, "C", 300.0, 1.0, 1, 1, 0, 4, "P", l2)
    fine = spark.createDataFrame([row(1, "P03"), row(2, "P01")], cols)
    coarse = spark.createDataFrame([row(1, "P02"), row(2, "P01")], cols)
    assert {r.ligand for r in library.select_library(fine, "ectoparasiticide").collect()} == {1}
    assert {r.ligand for r in library.select_library(coarse, "ectoparasiticide").collect()} == {1, 2}


def test_empty_tables(spark):
    facts = spark.createDataFrame([], "round int, batch_id int, target string, ligand string, score double, exh int")
    assert hits.top_hits(facts).count() == 0
    assert ledger.hit_trend(facts).count() == 0
    upgrade = ledger.near_miss_upgrade(facts, hits.top_hits(facts)).first()
    assert (upgrade.prev_near_misses, upgrade.upgraded, upgrade.upgrade_rate) == (0, 0, 0.0)
    assert hits.score_distribution(facts).count() == 0


def test_fixed_text_rounds_the_exact_value(spark):
    """Every percentage of two decimals, and a few ties, as C and SQL print them."""
    values = [i / 10000 * 100 for i in range(10000)] + [0.5, 1.5, 12.5, 0.25, 0.35, 2.675, -0.25, -0.35, 1e20]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    shown = rows.select("v", *[text.fixed_text(F.col("v"), d).alias(f"d{d}") for d in (0, 1, 2)]).collect()
    assert [tuple(r) for r in shown] == [(v, f"{v:.0f}", f"{v:.1f}", f"{v:.2f}") for v in values]


def test_final_score_and_rank_print_identity_exactly(spark):
    rows = spark.createDataFrame([(1, 0.225), (2, 0.1235), (3, 0.825), (4, 0.3)], "accession long, max_identity double").selectExpr(
        "*", "0 druggable_pockets", "0 allosteric_sites", "false rnai_evidence", "0 rnai_count", "50.0D mean_plddt", "0 novelty_score", "array('base') novelty_reasons")
    scored = targets.final_score(rows)
    reasons = {r.accession: r.score_reasons[1] for r in scored.collect()}
    assert reasons[1] == "Low host homology 22% (+2)" and reasons[3] == "HIGH host homology 82% (-5)"
    assert {r.accession: r.host_identity_pct for r in targets.rank_targets(scored).collect()} == {1: "22.5", 2: "12.3", 3: "82.5", 4: "30.0"}


def test_gpi_signal_keeps_the_length_of_the_tail(spark):
    """One character stays one character in upper case; before, a sharp s became two and moved the window."""
    tail = "q" * 13 + "qqqqqqg" + "ACFILMVWYA"
    assert one(spark, homology.gpi_signal(F.lit("q" + tail)))
    assert one(spark, homology.gpi_signal(F.lit("q" + tail.replace("ACFILMVWYA", "acfilmvw\u00df\u00df"))))
    assert not one(spark, homology.gpi_signal(F.lit("q" * 11 + "g\u00df" + "q" * 7 + "ACFILMVWYA")))
