"""Distributed joins, orderings and clusters against straightforward loops, with hot keys forced."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import annotation, bit_grid, contacts, hits, homology, ledger, ordering, similarity, skew, targets
from sieveline.plans import QUERIES
from sieveline.sources import pair_store


def bits_table(spark, rows):
    return spark.createDataFrame(rows, "ligand int, fp_bits array<int>")


def random_bits(n, n_bits=70, seed=1, copies=0):
    rng = random.Random(seed)
    rows = [(i, sorted(rng.sample(range(n_bits), rng.randint(1, 12)))) for i in range(n)]
    return rows + [(n + i, rows[0][1]) for i in range(copies)]


def tanimoto(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b)


def folded(rows):
    groups = {}
    for i, bits in rows:
        groups.setdefault(tuple(sorted(set(bits))), []).append(i)
    return {min(ids): (bits, len(ids)) for bits, ids in groups.items()}


@pytest.mark.parametrize("min_sim", [0.0, 0.2, 0.5, 1.0])
@pytest.mark.parametrize("rows_per_slice", [3, 20_000])
def test_tanimoto_pairs(spark, min_sim, rows_per_slice):
    rows = random_bits(60, copies=20)
    fps = similarity.distinct_fingerprints(bits_table(spark, rows), 70)
    got = {(r.a, r.b): r.similarity for r in similarity.tanimoto_pairs(fps, min_sim, 70, rows_per_slice).collect()}
    kinds = folded(rows)
    want = {(a, b): tanimoto(kinds[a][0], kinds[b][0]) for a in kinds for b in kinds
            if a < b and set(kinds[a][0]) & set(kinds[b][0]) and tanimoto(kinds[a][0], kinds[b][0]) >= min_sim}
    assert got == pytest.approx(want)


def test_tanimoto_pairs_come_once(spark):
    fps = similarity.distinct_fingerprints(bits_table(spark, random_bits(40)), 70)
    pairs = similarity.tanimoto_pairs(fps, 0.1, 70, rows_per_slice=2)
    assert pairs.count() == pairs.select("a", "b").distinct().count()


@pytest.mark.parametrize("rows_per_slice", [3, 20_000])
def test_nearest_similarity_without_near_neighbours(spark, rows_per_slice):
    rng = random.Random(5)
    bits = 320
    rows = [(i, sorted(rng.sample(range(300), 12))) for i in range(60)] + [(100 + i, [300 + 2 * i, 301 + 2 * i]) for i in range(5)]
    fps = similarity.distinct_fingerprints(bits_table(spark, rows), bits)
    want = {i: max(tanimoto(a, b) for j, b in rows if j != i) for i, a in rows}
    assert sum(v < 0.2 for v in want.values()) > 40
    got = {r.fp_id: r.nn_similarity for r in similarity.nearest_similarity(fps, bits, rows_per_slice=rows_per_slice).collect()}
    assert got == pytest.approx(want)
    ordered = similarity.rare_first(fps, bits)
    reached = {r.fp_id: r.reached for r in similarity.reached_similarity(ordered, ordered, bits).collect()}
    assert set(reached) == {i for i, v in want.items() if v > 0}
    assert all(0 < v <= want[i] + 1e-12 for i, v in reached.items())
    probes = similarity._probes(ordered.join(spark.createDataFrame(list(reached.items()), "fp_id int, reached double"), "fp_id"), F.col("reached"), "a")
    assert probes.count() < sum(len(b) for i, b in rows if want[i] > 0)


def test_nearest_neighbor(spark):
    rows = random_bits(50, copies=5) + [(900, []), (901, [69])]
    got = {r.ligand: r.nn_similarity for r in similarity.nearest_neighbor(bits_table(spark, rows), 70).collect()}
    want = {}
    for i, a in rows:
        sims = [tanimoto(a, b) for j, b in rows if j != i and (a or b)]
        want[i] = max(sims)
    assert got == pytest.approx(want)


def sequential_clusters(rows, cutoff):
    """Largest neighbourhood first, ties by id; each takes what is still free."""
    near = {i: {j for j, b in rows if j != i and tanimoto(a, b) >= cutoff} for i, a in rows}
    free, clusters = set(near), []
    for i in sorted(near, key=lambda k: (-len(near[k]), k)):
        if i in free:
            taken = {i} | (near[i] & free)
            free -= taken
            clusters.append(taken)
    return {i: n for n, members in enumerate(clusters) for i in members}


@pytest.mark.parametrize("seed,cutoff", [(1, 0.2), (2, 0.35), (3, 0.5)])
def test_clusters_equal_the_sequential_rule(spark, seed, cutoff):
    rows = random_bits(40, n_bits=24, seed=seed, copies=6)
    got = {r.ligand: r.cluster for r in similarity.butina(bits_table(spark, rows), 24, cutoff).collect()}
    assert got == sequential_clusters(rows, cutoff)


@pytest.mark.parametrize("rows_per_block", [3, 8192])
@pytest.mark.parametrize("n_bits,cutoff", [(24, 0.3), (150, 0.05)])
def test_clusters_by_blocks(spark, n_bits, cutoff, rows_per_block):
    """Rounds of any block size give the sequential rule's clusters, and counts without a list of pairs."""
    rows = random_bits(40, n_bits=n_bits, seed=4, copies=3) + [(500, [])]
    table = bits_table(spark, rows)
    fps = similarity.distinct_fingerprints(table, n_bits).cache()
    near = {i: sum(1 for j, b in rows if set(a) != set(b) and (a or b) and tanimoto(a, b) >= cutoff) for i, a in rows}
    counts = {r.fp_id: r.n for r in bit_grid.neighbour_counts(fps, cutoff, n_bits, rows_per_block).collect()}
    assert counts == {i: near[i] for i in counts} and len(counts) == len(folded(rows))
    clusters = {r.fp_id: r.cluster for r in similarity.greedy_by_blocks(fps, cutoff, n_bits, rows_per_block).collect()}
    listed = {r.fp_id: r.cluster for r in similarity.greedy_clusters(fps, similarity.tanimoto_pairs(fps, cutoff, n_bits)).collect()}
    assert clusters == listed


def test_least_shared_is_exact():
    sizes = np.arange(0, 130)
    for t in (0.0, 0.1, 0.3, 0.5, 0.8, 1.0):
        for size in range(0, 130, 7):
            got = bit_grid.least_shared(size, sizes, t)
            for other, least in zip(sizes.tolist(), got.tolist()):
                fits = [n for n in range(1, min(size, other) + 1) if n / (size + other - n) >= t]
                assert least == fits[0] if fits else least > min(size, other)


def test_similarity_lists_no_pair_per_bit(spark):
    for name in ("tanimoto_join", "nearest_neighbor"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "bit#" not in plan


def test_sliced_join_with_hot_keys(spark):
    left = spark.range(400).select((F.col("id") % 3).alias("k"), F.col("id").alias("a"))
    right = spark.range(300).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 5).cast("long").alias("k"), F.col("id").alias("b"))
    got = skew.sliced_join(left, right, ["k"], (F.col("a") + F.col("b")) % 2 == 0, rows_per_slice=20)
    want = left.join(right, "k").where((F.col("a") + F.col("b")) % 2 == 0)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("rows_per_slice", [2, 20_000])
def test_contacts(spark, rows_per_slice):
    rng = random.Random(5)
    atom = lambda: (rng.choice("CNOS"), *(round(rng.uniform(-9, 9), 3) for _ in range(3)))
    lig = [("p%d" % (i % 2), *atom()) for i in range(25)] + [("p0", "C", 0.0, 0.0, 0.0)]
    rec = [("p%d" % (i % 2), "A", i % 12, rng.choice(["PHE", "GLY"]), *atom()) for i in range(120)]
    rec += [("p0", "B", 50, "GLY", "C", 4.0, 0.0, 0.0), ("p0", "B", 51, "GLY", "N", 0.0, 3.5, 0.0)]
    ldf = spark.createDataFrame(lig, "pose string, element string, x double, y double, z double")
    rdf = spark.createDataFrame(rec, "pose string, chain string, resnum int, resname string, element string, x double, y double, z double")
    got = {(r.pose, r.chain, r.resnum, r.resname): (r.distance, r.type) for r in contacts.contacts(ldf, rdf, rows_per_slice=rows_per_slice).collect()}
    want = {}
    polar = set("NOFS")
    for p, e, x, y, z in lig:
        for q, c, n, name, f, a, b, d in rec:
            dist = ((x - a) ** 2 + (y - b) ** 2 + (z - d) ** 2) ** 0.5
            if p == q and dist <= 4.0:
                entry = want.setdefault((q, c, n, name), [99.0, 0])
                entry[0] = min(entry[0], dist)
                entry[1] = max(entry[1], 2 if e in polar and f in polar and dist <= 3.5 else 1 if e == f == "C" else 0)
    assert got.keys() == want.keys()
    for k, (distance, kind) in got.items():
        assert distance == pytest.approx(want[k][0], abs=0.0051)
        assert kind == ("vdw", "hydrophobic", "hbond")[want[k][1]]


@pytest.mark.parametrize("rows_per_slice", [2, 20_000])
@pytest.mark.parametrize("share", [0.1, 0.5, 0.9])
def test_kmer_containment(spark, rows_per_slice, share):
    rng = random.Random(7)
    subject = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(3, 60)))) for i in range(25)] + [(30, "a" * 50), (31, "é\nñ" * 9)]
    query = [(i, s[3:30] + "xy") for i, s in subject if len(s) > 20] + [(99, "zzzzzzzz"), (98, "ab")]
    make = lambda rows: spark.createDataFrame(rows, "id int, sequence string")
    got = {r.query_id: (r.subject_id, r.n_shared, r.n_kmers)
           for r in homology.kmer_containment(make(query), make(subject), 4, share, rows_per_slice).collect()}
    kmers = lambda s: {s[i:i + 4] for i in range(len(s) - 3)}
    want = {}
    for q, s in query:
        own = kmers(s)
        best = max(((len(own & kmers(t)), -j) for j, t in subject), default=None)
        if own and best[0] and best[0] >= share * len(own):
            want[q] = (-best[1], best[0], len(own))
    assert got == want


@pytest.mark.parametrize("rows_per_slice", [1, 20_000])
def test_literature(spark, rows_per_slice):
    texts = ["Ixodes RNAi of abcX shows lethal effect", "tick silencing; long-name protein here", "TICK knockdown of ABCX and long name  protein",
             "tickle RNAi abcX", "abcX in Ixodes only", "Amblyomma lethality abcX", "Amblyomma lethal abcXY"]
    docs = spark.createDataFrame(list(enumerate(texts)), "pmid int, text string")
    tg = spark.createDataFrame([("T1", "abcX", "zz"), ("T2", "", "long name protein"), ("T3", None, "abc")], "target string, gene string, name string")
    found = annotation.literature_matches(tg, docs, rows_per_slice=rows_per_slice)
    assert {(r.target, r.pmid) for r in found.collect()} == {("T1", 0), ("T1", 2), ("T2", 1), ("T2", 2)}
    evidence = {r.target: (r.rnai_evidence, r.rnai_count, r.pmids) for r in annotation.literature_evidence(tg, found, n_ids=1).collect()}
    assert evidence == {"T1": (True, 2, [0]), "T2": (True, 2, [1]), "T3": (False, 0, None)}


def test_dense_index(spark):
    rows = list(range(500))
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(i,) for i in rows], "v int").repartition(7)
    got = ordering.dense_index(df, [F.desc("v")], start=1, slices=6)
    assert {r.v: r.idx for r in got.collect()} == {v: 500 - v for v in rows}


def test_tail_counts_and_percentiles_over_bins(spark):
    rng = random.Random(2)
    rows = [("T", round(rng.uniform(-12, -1), 2)) for _ in range(400)] + [("U", -7.0)] * 5
    facts = spark.createDataFrame(rows, "target string, score double")
    ref = spark.createDataFrame([("c", "T", -7.0), ("c", "T", -20.0), ("c", "T", 0.0), ("d", "U", -7.0), ("e", "V", -7.0)], "compound string, target string, score double")
    got = {(r.compound, r.target, r.score): r.n_worse for r in hits.percentile_rank(ref, facts).collect()}
    assert got == {(c, t, s): sum(1 for u, v in rows if u == t and v > s) for c, t, s in
                   [("c", "T", -7.0), ("c", "T", -20.0), ("c", "T", 0.0), ("d", "U", -7.0)]}
    medians = {r.target: r.median_score for r in hits.score_distribution(facts).collect()}
    values = sorted(v for u, v in rows if u == "T")
    assert medians == pytest.approx({"T": (values[199] + values[200]) / 2, "U": -7.0})


def test_plan_pairs_and_counts(spark):
    targets = spark.createDataFrame([(f"T{i}",) for i in range(7)], "target string")
    batches = spark.createDataFrame([(f"L{i}", i // 4) for i in range(10)], "ligand string, batch_id int")
    pairs = ledger.plan_pairs(targets, batches)
    assert {tuple(r) for r in pairs.collect()} == {(f"T{t}", f"L{i}", i // 4) for t in range(7) for i in range(10)}
    assert pairs.count() == 70
    assert ledger.plan_pairs(targets, batches, batch_id=1).count() == 28
    done = spark.createDataFrame([("T0", "L0"), ("T0", "L1"), ("T3", "L9"), ("T3", "L9")], "target string, ligand string")
    left = {(r.target, r.batch_id): r.n_pending for r in ledger.plan_counts(targets, batches, done).collect()}
    assert left[("T0", 0)] == 2 and left[("T3", 2)] == 1 and left[("T6", 1)] == 4


def test_plan_totals_without_pairs(spark):
    targets = spark.createDataFrame([(i,) for i in range(7)], "target long")
    batches = spark.createDataFrame([(i, i // 4) for i in range(10)], "ligand long, batch_id int")
    totals = {(r.target, r.batch_id): (r.n_pairs, r.ligand_sum) for r in ledger.plan_totals(targets, batches).collect()}
    assert totals == {(t, b): [(4, 6), (4, 22), (2, 17)][b] for t in range(7) for b in range(3)}
    assert ledger.plan_totals(targets, batches.where("ligand < 0")).count() == 0
    plan = QUERIES["plan_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ligand#" not in plan  # no ligand is left where targets are repeated


def test_rows_of_a_plan_are_formed_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ledger, "ROWS_PER_TASK", 30, raising=False)
    targets = spark.createDataFrame([(i,) for i in range(100)] + [(7,)], "target long").coalesce(1)
    batches = spark.createDataFrame([(i, i // 4) for i in range(10)], "ligand long, batch_id int")
    totals = ledger.plan_totals(targets, batches).withColumn("task", F.spark_partition_id()).collect()
    sizes = Counter(r.task for r in totals)
    assert len(sizes) > 5 and max(sizes.values()) < 100  # 303 / 30 tasks, not the one that holds the targets
    got = {(r.target, r.batch_id): (r.n_pairs, r.ligand_sum) for r in totals}
    ones = [(4, 6), (4, 22), (2, 17)]
    assert len(totals) == 300
    assert got == {(t, b): tuple(x * (2 if t == 7 else 1) for x in ones[b]) for t in range(100) for b in range(3)}


def test_plan_counts_moves_only_settled_pairs(spark, monkeypatch):
    monkeypatch.setattr(ledger, "ROWS_PER_TASK", 30, raising=False)
    rng = random.Random(5)
    ids = [*range(20), 7, None]  # one target twice, one unknown, targets 20 to 24 are not asked for
    ligands = [(i, i // 6) for i in range(60) if i // 6 != 4]  # batch 4 is missing
    pairs = [(rng.choice([*range(3, 25), None]), rng.choice([*range(70), None])) for _ in range(300)]
    pairs += [(3, i) for i in range(60)]
    targets = spark.createDataFrame([(i,) for i in ids], "target long")
    batches = spark.createDataFrame(ligands, "ligand long, batch_id int")
    left = ledger.plan_counts(targets, batches, spark.createDataFrame(pairs, "target long, ligand long"))
    plan = left._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Generate explode")]  # nothing is shuffled or sorted once the batches are formed
    assert "Sort" not in above and "Exchange" not in above
    assert [f.dataType.simpleString() for f in left.schema] == ["bigint", "int", "bigint", "bigint", "bigint"]
    known = {p for p in pairs if None not in p}
    want = {}
    for t in ids:
        for c, b in ligands:
            n, done = want.get((t, b), (0, 0))
            want[t, b] = n + 1, done + ((t, c) in known)
    rows = left.collect()
    assert len(rows) == len(want) == 21 * 9
    assert {(r.target, r.batch_id): (r.n_ligands, r.n_done) for r in rows} == want
    assert all(r.n_pending == r.n_ligands - r.n_done for r in rows)
    assert left.select(F.spark_partition_id().alias("task")).distinct().count() > 3
    assert ledger.plan_counts(targets, batches.limit(0), targets.select("target", F.lit(1).cast("long").alias("ligand"))).count() == 0


def test_annotation_tables_are_not_broadcast(spark):
    for name in ("fill_annotation", "annotation_report"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2


def test_pending_work_rules(spark):
    pairs = spark.createDataFrame([("T", c) for c in "abcd"], "target string, ligand string")
    book = spark.createDataFrame([("T", "a", 8), ("T", "b", 4), ("T", "d", 9999)], "target string, ligand string, exh int")
    found = spark.createDataFrame([("T", "b")], "target string, ligand string")
    assert {r.ligand for r in ledger.pending_work(pairs, book, found, 8).collect()} == {"c"}
    assert {r.ligand for r in ledger.pending_work(pairs, book, found.limit(0), 8).collect()} == {"b", "c"}


def test_running_totals_cross_rounds(spark):
    rows = [(r, b, r * 10 + b, float(-r - b)) for r in (1, 2, 4) for b in (0, 1, 5)]
    df = spark.createDataFrame(rows, "round int, batch_id int, n long, s double")
    got = [(r.cum, r.best) for r in ordering.running_by_round(df, {"cum": "n"}, {"best": "s"}).orderBy("round", "batch_id").collect()]
    want, total, best = [], 0, None
    for _, _, n, s in sorted(rows):
        total, best = total + n, s if best is None else min(best, s)
        want.append((total, best))
    assert got == want


def test_rank_in_groups_with_a_large_group(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r.k, r.v): r["rank"] for r in ordering.rank_in_groups(df, ["k"], [F.desc("v")], slices=8).collect()}
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    assert got == {(k, v): i + 1 for k, vs in groups.items() for i, v in enumerate(sorted(vs, reverse=True))}


def test_every_hot_key_is_sliced(spark):
    """More hot keys than any fixed table would hold, and pairs still meet exactly once."""
    from sieveline.operators.skew import hot_keys, sliced_join
    left = spark.range(36_000).selectExpr("id % 12000 as k", "id as a")
    right = spark.range(12_000).selectExpr("id as k", "id as b")
    assert hot_keys(left, right, ["k"], 2).count() == 12_000
    joined = sliced_join(left, right, ["k"], rows_per_slice=2)
    assert joined.count() == 36_000 == joined.distinct().count()


def test_exact_mean_keeps_large_values_and_fails_loudly(spark):
    import pytest
    from pyspark.sql import functions as F
    from sieveline.functions.scores import exact_avg
    mean = lambda *v: spark.createDataFrame([(x,) for x in v], "v double").agg(exact_avg(F.col("v")).alias("m")).first().m
    assert mean(1e12, 2.0) == 5.00000000001e11 and mean(1e-9, 3e-9, None) == 2e-9 and mean(None) is None
    with pytest.raises(Exception):
        mean(1e30, 1.0)


def test_best_rows_are_hash_aggregated(spark):
    """No sort of all facts and no expansion of them in the plans."""
    import contextlib
    import io
    from sieveline.operators import hits, ledger
    facts = spark.range(500).selectExpr("cast(id % 3 as int) round", "cast(id % 4 as int) batch_id", "id % 7 target", "id ligand",
                                        "-cast(id % 13 as double) score", "4 exh")
    for operator in (hits.target_stats, hits.docking_summary, ledger.batch_summary, ledger.round_summary):
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            operator(facts).explain()
        assert "Expand" not in text.getvalue()
        tied = text.getvalue().count("SortAggregate")
        assert tied <= 2, text.getvalue()  # only the rows tied for the lowest score are ordered


def test_balls_reach_few_cells(spark):
    rng = random.Random(8)
    atoms = [("p", "C", *(rng.uniform(-20, 20) for _ in range(3))) for _ in range(2000)] + [("p", "C", 0.0, 0.0, 0.0), ("p", "C", 6.0, -6.0, 3.0)]
    df = spark.createDataFrame(atoms, "pose string, lig_element string, lx double, ly double, lz double")
    rows = contacts.touched_cells(df, 4.0, 6.0).groupBy("lx", "ly", "lz").agg(F.collect_list(F.struct("cx", "cy", "cz")).alias("cells")).collect()
    assert len(rows) == len(atoms) and 10 < sum(len(r.cells) for r in rows) / len(rows) < 11 < 27
    for r in rows[:200]:
        at, cells = (r.lx, r.ly, r.lz), {tuple(c) for c in r.cells}
        assert len(cells) == len(r.cells)
        for _ in range(50):  # wherever a partner may be, its cell is among them
            step = [rng.gauss(0, 1) for _ in range(3)]
            long = 4.0 * rng.random() ** (1 / 3) / sum(x * x for x in step) ** 0.5
            assert tuple(int((a + x * long) // 6.0) for a, x in zip(at, step)) in cells


@pytest.mark.parametrize("rows_per_window", [3, 100_000])
def test_pockets_of_hot_targets(spark, rows_per_window):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", None, "a", "b"]), i, 0.9, float(rng.randint(400, 430))) for i in range(80)]
    df = spark.createDataFrame(rows, "target string, pocket_id int, score double, volume double")
    good = targets.filter_pockets(df, rows_per_window=rows_per_window)
    want = {}
    for t, i, _, v in sorted(rows, key=lambda r: (-r[3], r[1])):
        want[t, i] = sum(k[0] == t for k in want)
    assert {(r.target, r.pocket_id): r.pocket_rank for r in good.collect()} == want
    if rows_per_window > 80:
        assert "rangepartitioning" not in good._jdf.queryExecution().executedPlan().toString()


def test_bucketed_pairs_are_compared_in_place(spark, tmp_path):
    rng = random.Random(10)
    pairs = [(t, i) for t in range(6) for i in range(40)] + [(None, 1)]
    facts = [(*rng.choice(pairs[:-1]), rng.choice([-8.0, -6.0, -4.0, None]), rng.choice([None, 4, 8, 16])) for _ in range(300)]
    make = lambda rows: spark.createDataFrame(rows, "target int, ligand int, score double, exh int")
    pair_store.append_pairs(spark.createDataFrame(pairs, "target int, ligand int"), "to_dock", 5, str(tmp_path / "pairs"))
    for part in (facts[:100], facts[100:]):
        pair_store.append_pairs(pair_store.settled_efforts(make(part)), "efforts", 5, str(tmp_path / "efforts"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        left = pair_store.pending_pairs(spark, "to_dock", "efforts", 8)
        got = {tuple(r) for r in left.collect()}
        plan = left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        for table in ("to_dock", "efforts"):
            spark.sql(f"DROP TABLE {table}")
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    kept = ledger.compact_ledger(make(facts))
    best = hits.top_hits(make(facts).selectExpr("*", "1 as round", "1 as batch_id"), exclude=())
    assert got == {tuple(r) for r in ledger.pending_work(spark.createDataFrame(pairs, "target int, ligand int"), kept, best, 8).collect()}
    assert (None, 1) in got and 20 < len(got) < len(pairs)
