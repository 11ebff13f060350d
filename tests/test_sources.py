"""Readers on files as other tools write them."""

import json
import time

from pyspark.sql import functions as F

from sieveline.operators import reports, targets
from sieveline.session import SHUFFLE_CLEANUP, cut_lineage
from sieveline.sources import ledger as SL
from sieveline.sources import proteins as SP
from sieveline.sources import sinks
from sieveline.sources import structures as SS


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_entries(spark, tmp_path):
    full = {"primaryAccession": "P1", "proteinDescription": {"submissionNames": [{"fullName": {"value": "Name"}}]}, "genes": [],
            "sequence": {"value": "MK", "length": 2}, "comments": [{"commentType": "INDUCTION", "texts": [{"value": "a"}, {"value": "b"}]},
                                                                  {"commentType": "INDUCTION", "texts": [{"value": "c"}]}],
            "uniProtKBCrossReferences": [{"database": "PDB", "id": "1ABC"}, {"database": "GO", "id": "x"}]}
    put(tmp_path / "e.json", json.dumps(full) + "\n" + json.dumps({"primaryAccession": "P2"}) + "\n")
    rows = {r.accession: r for r in SP.read_proteome(spark, str(tmp_path), "tick", "Ixodes").collect()}
    assert rows["P1"].name == "Name" and rows["P1"].pdb_ids == ["1ABC"] and rows["P1"].has_structure and not rows["P1"].has_ligands
    assert rows["P2"].name == "" and rows["P2"].gene == "" and rows["P2"].length == 0 and rows["P2"].keywords == []
    texts = {r[0]: r[1] for r in SP.read_entries(spark, str(tmp_path)).select("primaryAccession", SP.comment_text("INDUCTION")).collect()}
    assert texts == {"P1": "a. b. c", "P2": ""}


def test_fasta(spark, tmp_path):
    put(tmp_path / "a.fasta", ">sp|P1|NAME_X desc -> more\nmk\nLL\n>ACC2|gene|Some name\nAAA\n\n>ACC3 free text\r\nCC\r\nDD\r\n>EMPTY\n")
    rows = {r.accession: (r.sequence, r.description) for r in SP.read_fasta(spark, str(tmp_path)).collect()}
    assert rows == {"P1": ("MKLL", "desc -> more"), "ACC2": ("AAA", "name"), "ACC3": ("CCDD", "free text"), "EMPTY": ("", "")}


def test_fasta_wraps_at_sixty(spark):
    df = spark.createDataFrame([("A", "g", "n" * 80, "M" * 120), ("B", "g", "n", "")], "accession string, gene string, name string, sequence string")
    lines = SP.fasta_records(df).first().value.split("\n")
    assert lines == [">A|g|" + "n" * 60, "M" * 60, "M" * 60]
    assert SP.fasta_records(df).count() == 1


def test_pose_scores(spark, tmp_path):
    remark = "REMARK VINA RESULT:    %s      0.000      0.000\n"
    put(tmp_path / "T1_results" / "CHEMBL8905_out.pdbqt", "MODEL 1\n" + remark % "-6.714" + "MODEL 2\n" + remark % "-6.9")
    put(tmp_path / "T1_pocket2_results" / "L_out.pdbqt", remark % "-8.1")
    put(tmp_path / "T1_results" / "empty_out.pdbqt", "nothing\n")
    poses = SS.read_pose_scores(spark, str(tmp_path))
    assert {tuple(r) for r in SS.first_pose(poses).collect()} == {("T1", 0, "CHEMBL8905", -6.714), ("T1", 2, "L", -8.1)}
    assert {tuple(r) for r in SS.best_pose(poses).collect()} == {("T1", 0, "CHEMBL8905", -6.9), ("T1", 2, "L", -8.1)}


PDB = """HEADER    X
ATOM      1  N   MET A   1      11.104   6.134  -6.504  1.00 50.00           N
ATOM      2  CA  MET A   1      11.639   6.071  -5.147  1.00 91.50           C
ATOM      3  CA  MET A   1      11.700   6.000  -5.100  1.00 92.50           C
ATOM      4  HA  MET A   1      12.000   6.000  -5.000  1.00 92.50           H
ATOM      5  CA  GLY B   1       1.000   2.000   3.000  1.00 40.00
HETATM    6  O   HOH A 101       x.xxx   2.000   3.000  1.00 40.00           O
"""


def test_atoms_and_confidence(spark, tmp_path):
    put(tmp_path / "m.pdb", PDB)
    atoms = SS.read_atoms(spark, str(tmp_path), pattern="*.pdb")
    assert [(r.atom_name, r.element, r.resname, r.chain, r.x) for r in atoms.orderBy("line_no").collect()] == [
        ("N", "N", "MET", "A", 11.104), ("CA", "C", "MET", "A", 11.639), ("CA", "C", "MET", "A", 11.7), ("CA", "C", "GLY", "B", 1.0)]
    row = targets.plddt_summary(atoms).first()
    assert (row.mean_plddt, row.total_residues, row.high_conf_fraction, row.suitable, row.quality_label) == (66.25, 2, 0.5, False, "LOW")
    assert targets.experimental_quality(atoms).first().total_residues == 3


def test_pose_atoms_stop_at_first_model(spark, tmp_path):
    line = "ATOM      1  C1  LIG A   1       1.000   2.000   3.000  1.00  0.00    +0.100 %-2s\n"
    put(tmp_path / "p.pdbqt", "MODEL 1\n" + line % "C" + line % "OA" + line % "HD" + "ENDMDL\nMODEL 2\n" + line % "C" + "ENDMDL\n")
    atoms = SS.read_atoms(spark, str(tmp_path), kind="pose", pattern="*.pdbqt")
    assert sorted(r.element for r in atoms.collect()) == ["C", "O"]


def test_receptor_keeps_atom_records(spark, tmp_path):
    put(tmp_path / "m.pdb", PDB.replace("x.xxx", "1.000"))
    assert SS.read_atoms(spark, str(tmp_path), kind="receptor").count() == 4
    assert SS.read_atoms(spark, str(tmp_path)).count() == 5


def test_pockets(spark, tmp_path):
    put(tmp_path / "T_info.txt", "Pocket 1 :\n\tScore : 0.3\n\tDruggability Score : 0.8\n\tVolume : 512.5\nPocket 2 :\n\tVolume : -\n")
    rows = {r.pocket_id: (r.target, r.score, r.volume) for r in SS.read_pocket_report(spark, str(tmp_path)).collect()}
    assert rows == {1: ("T", 0.8, 512.5), 2: ("T", None, None)}
    put(tmp_path / "U.pdb_predictions.csv", "name     ,  rank,   score, probability, sas_points, surf_atoms,   center_x,   center_y,   center_z, residue_ids\n"
        "# comment\npocket1  ,     1,   12.50,   0.7,   80,   30,   1.0,  2.0,  3.0, A_1 A_2\npocket2  ,     2,   bad,   0.7,   80,   30,   1.0,  2.0,  3.0, A_1\n")
    rows = SS.read_pocket_predictions(spark, str(tmp_path)).collect()
    assert [(r.target, r.pocket_id, r.score, r.volume, r.center_z) for r in rows] == [("U", 1, 12.5, 600.0, 3.0)]


def test_boxes(spark, tmp_path):
    body = "receptor = r.pdbqt\n# size = 9\ncenter_x = 1.5\ncenter_y = -2\ncenter_z=3\nsize_x = 20\nsize_y = 20\nsize_z = 20\nout = o\nnum_modes = 9\n"
    put(tmp_path / "A_vina.conf", body)
    put(tmp_path / "B_vina.conf", "center_x = 1\n")
    assert [tuple(r) for r in SS.read_box_configs(spark, str(tmp_path)).collect()] == [("A", 1.5, -2.0, 3.0, 20.0, 20.0, 20.0)]
    kept = SS.strip_run_keys(SS.config_lines(spark, str(tmp_path), "A_*")).collect()
    assert len(kept) == 8 and not any(r.value.startswith(("out", "num_modes")) for r in kept)


def test_alignments(spark, tmp_path):
    put(tmp_path / "h.tsv", "Q\tS\t61.462\t544\t661\t700\t1e-100\t500\nQ\tR\t30\t10\t0\t700\t1\t5\n")
    rows = {r.subject_id: (r.species, r.coverage_pct) for r in SS.read_alignments(spark, str(tmp_path), "x").collect()}
    assert rows == {"S": ("x", 82.3), "R": ("x", 0.0)}


def test_ledger_drops_and_trend(spark, tmp_path):
    put(tmp_path / "l" / "a.jsonl", '{"target":"T","ligand":"a","score":-5.5}\nbroken\n{"target":"T","ligand":"b","score":null,"exh":8}\n')
    assert {tuple(r) for r in SL.read_ledger(spark, str(tmp_path / "l")).collect()} == {("T", "a", -5.5, None), ("T", "b", None, 8)}
    drop = {"round": 2, "batch_id": 3, "exh": 4, "kept": [{"target": "T", "ligand": "a", "score": -8.0}],
            "near_miss": [{"target": "T", "ligand": "b", "score": -6.0, "exh": 8}]}
    put(tmp_path / "d" / "batch_R2_B3.json", json.dumps(drop, indent=2))
    rows = {tuple(r) for r in SL.read_batch_drops(spark, str(tmp_path / "d")).collect()}
    assert rows == {(2, 3, "T", "a", -8.0, 4, "kept"), (2, 3, "T", "b", -6.0, 8, "near_miss")}
    put(tmp_path / "t" / "t.jsonl", '{"type":"near_miss_upgrade","round":2,"timestamp":"2026-05-26T10:00:00.123456","prev_near_misses":5,"upgraded":1,"upgrade_rate":0.2}\n'
        '{"round":2,"batch_id":0,"timestamp":"2026-05-26T11:00:00","cum_hits":10,"new_hits_this_batch":10,"best_score":-9.0,"n_ligands_docked":5}\n')
    trend = {r.kind: r for r in SL.read_trend(spark, str(tmp_path / "t")).collect()}
    assert trend["batch"].cum_hits == 10 and trend["near_miss_upgrade"].upgraded == 1 and trend["batch"].timestamp is not None


def test_maps_and_audit(spark, tmp_path):
    put(tmp_path / "s" / "m.json", json.dumps({"L1": "CCO", "L2": ""}, indent=1))
    assert {tuple(r) for r in SL.read_smiles_map(spark, str(tmp_path / "s")).collect()} == {("L1", "CCO"), ("L2", "")}
    log = {"steps": {"01": {"started": "x", "elapsed_sec": 1.5, "params": {"p": {"value": [1, 2], "description": "d"}}, "stats": {}, "warnings": [{"message": "w"}]}}}
    put(tmp_path / "a" / "log.json", json.dumps(log))
    audit = SL.read_audit_log(spark, str(tmp_path / "a"))
    assert tuple(reports.audit_summary(audit).first()) == ("01", "x", 1.5, 1, 0, 0)
    assert tuple(reports.audit_parameters(audit).first()) == ("01", "p", "[1,2]", "d")


def test_statistics_table_is_empty_without_stats(spark, tmp_path):
    put(tmp_path / "log.json", json.dumps({"steps": {"01": {"stats": {}}}}))
    assert reports.audit_statistics(SL.read_audit_log(spark, str(tmp_path))).count() == 0


def test_prediction_columns_follow_each_files_header(spark, tmp_path):
    put(tmp_path / "A_predictions.csv", "name,rank,score,probability,surf_atoms,center_x,center_y,center_z\np1,1,10.0,0.9,3,1,2,3\n")
    put(tmp_path / "B_predictions.csv", "# note\nname, rank, probability, score, center_z, center_y, center_x, surf_atoms\np1, 1, 0.8, 20.0, 3, 2, 1, 4\n")
    rows = {r.target: r for r in SS.read_pocket_predictions(spark, str(tmp_path)).collect()}
    assert (rows["A"].score, rows["A"].probability, rows["A"].volume) == (10.0, 0.9, 60.0)
    assert (rows["B"].score, rows["B"].probability, rows["B"].volume, rows["B"].center_x, rows["B"].center_z) == (20.0, 0.8, 80.0, 1.0, 3.0)


def test_pose_names_are_read_once_a_file(spark):
    """No pattern is matched above the step that turns a file into its poses."""
    files = spark.createDataFrame([
        ("/x/T1_pocket3_results/L1_out.pdbqt", "REMARK VINA RESULT:  -7.5 0 0\nREMARK VINA RESULT:  -6 0 0\n"),
        ("/x/T_results_results/L2.pdbqt", "REMARK VINA RESULT: 1.25\n"), ("_results/L3.pdbqt", "REMARK VINA RESULT: 1"),
        ("/x/other/L4.pdbqt", "REMARK VINA RESULT: 2"), ("L5.pdbqt", "REMARK VINA RESULT: 3"), ("/x/T6_results/L6_out.pdbqt", "none")], "path string, value string")
    poses = SS.pose_scores(files)
    assert sorted(tuple(r) for r in poses.collect()) == [
        ("", 0, "L3", 1, 1.0), ("", 0, "L4", 1, 2.0), ("", 0, "L5", 1, 3.0), ("T1", 3, "L1", 1, -7.5), ("T1", 3, "L1", 2, -6.0), ("T_results", 0, "L2", 1, 1.25)]
    above = poses._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")[0]
    assert "regexp" not in above


def test_folders_of_targets_are_listed_by_a_few_tasks(spark, tmp_path):
    hits = spark.range(300).select((F.col("id") % 150).alias("target"), F.col("id").alias("ligand"), (-F.col("id") / 8).alias("score"))
    sinks.write_per_target(hits, f"{tmp_path}/hits")
    context, setting = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    context.setJobGroup("list folders", "")
    back = sinks.read_per_target(spark, f"{tmp_path}/hits", "ligand bigint, score double, target bigint")
    context.setJobGroup("", "")
    tracker = context.statusTracker()
    stages = [i for job in tracker.getJobIdsForGroup("list folders") for i in tracker.getJobInfo(job).stageIds]
    assert 0 < sum(tracker.getStageInfo(i).numTasks for i in stages) <= 4 * context.defaultParallelism < 150
    assert spark.conf.get(setting) == before
    assert {tuple(r) for r in back.select("target", "ligand", "score").collect()} == {tuple(r) for r in hits.collect()}


def test_written_step_leaves_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before = shuffled()
    table = cut_lineage(spark.range(20_000).withColumn("key", F.xxhash64("id")).repartition(5, "key"))
    for _ in range(50):  # files are removed in the background
        left = shuffled() - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and table.count() == 20_000
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"
