"""Incremental operators: replay safety, refresh timing, and equality with the batch operators."""

import json

from pyspark.sql import functions as F

from sieveline.operators import hits, ledger
from sieveline.plans import QUERIES
from sieveline.plans.bindings import Tables
from sieveline.plans.sources import drop_chunks
from sieveline.sources.ledger import SECTIONS, count_drops, read_batch_drops
from sieveline.streaming import incremental as I

FACTS = [(1, 0, "T", "a", -8.0, 4), (1, 0, "T", "b", -6.0, 4), (1, 1, "U", "a", -7.0, 8), (2, 0, "T", "a", -9.0, 8), (2, 0, "T", "b", -7.5, 8)]
COLUMNS = "round int, batch_id int, target string, ligand string, score double, exh int"


def land(spark, path, rows, name):
    facts = spark.createDataFrame(rows, COLUMNS)
    fact = F.struct("target", "ligand", "score", "exh")
    zone = lambda z: F.collect_list(F.when(z, fact))
    hit, near = F.col("score") <= -7, (F.col("score") > -7) & (F.col("score") <= -5.5)
    by = dict(zip(SECTIONS, (hit, near, ~hit & ~near)))
    facts.groupBy("round", "batch_id").agg(*[zone(c).alias(s) for s, c in by.items()]).coalesce(1).write.json(f"{path}/{name}")


def run(stream, sink, checkpoint, mode):
    q = I.start(stream, sink, checkpoint, mode)
    q.awaitTermination()


def test_streams_equal_batch(spark, tmp_path):
    for i, rows in enumerate((FACTS[:2], FACTS[2:3], FACTS[3:])):
        land(spark, tmp_path / "in", rows, i)
    batch = spark.createDataFrame(FACTS, COLUMNS)
    source = lambda: I.stream_drops(spark, f"{tmp_path}/in", 1, multi_line=False)

    run(I.best_scores(source()), I.table_sink(f"{tmp_path}/best"), f"{tmp_path}/c1", "update")
    best = I.latest(spark.read.option("basePath", f"{tmp_path}/best").parquet(f"{tmp_path}/best"), ["target", "ligand"])
    assert {(r.target, r.ligand, r.score) for r in best.collect()} == {
        (r.target, r.ligand, r.score) for r in hits.top_hits(batch).collect()}

    run(I.ledger_effort(source()), I.table_sink(f"{tmp_path}/effort"), f"{tmp_path}/c2", "update")
    effort = I.latest(spark.read.option("basePath", f"{tmp_path}/effort").parquet(f"{tmp_path}/effort"), ["target", "ligand"])
    assert {tuple(r) for r in effort.collect()} == {tuple(r) for r in ledger.compact_ledger(batch).collect()}

    run(I.first_hits(source()), I.table_sink(f"{tmp_path}/first"), f"{tmp_path}/c3", "append")
    assert spark.read.parquet(f"{tmp_path}/first").count() == 4  # T/a again in round 2



def drop_file(folder, round_no, batch, facts, part=0):
    """A drop as it is really written: indented, without a round, which only the file name has."""
    body = {"batch_id": batch, "exh": 4, "kept": [{"target": t, "ligand": l, "score": s} for t, l, s in facts], "near_miss": [], "pruned": []}
    (folder / str(part)).mkdir(parents=True, exist_ok=True)
    (folder / str(part) / f"batch_R{round_no}_B{batch}_compressed.json").write_text(json.dumps(body, indent=2))


def test_trend_with_split_late_and_replayed_files(spark, tmp_path):
    folder, checkpoint = tmp_path / "in", f"{tmp_path}/c"
    folder.mkdir()
    landings = [
        [(1, 0, [("T", "a", -8.0)], 0)], [(1, 0, [("T", "b", -9.0), ("U", "b", -7.5)], 1)],  # one batch in two files
        [(2, 0, [("T", "c", -7.0), ("T", "a", -10.0)], 2)], [(1, 1, [("T", "c", -7.1)], 3)],  # a batch of round 1 comes late
        [(1, 0, [("T", "a", -8.0)], 4)]]  # the same pair once more
    every = []
    for files in landings:
        for round_no, batch, facts, part in files:
            drop_file(folder, round_no, batch, facts, part)
            every += [(round_no, batch, t, l, s) for t, l, s in facts]
        run(I.best_scores(I.stream_drops(spark, str(folder), 1)), I.table_sink(f"{tmp_path}/best"), checkpoint, "update")
    pairs = I.latest(spark.read.option("basePath", f"{tmp_path}/best").parquet(f"{tmp_path}/best"), ["target", "ligand"])
    got = {(r.round, r.batch_id, r.new_hits, r.cum_hits) for r in I.pair_trend(pairs).collect()}
    facts = spark.createDataFrame(every, "round int, batch_id int, target string, ligand string, score double")
    want = {(r.round, r.batch_id, r.new_hits, r.cum_hits) for r in ledger.hit_trend(facts).where("new_hits > 0").collect()}
    assert got == want == {(1, 0, 3, 3), (1, 1, 1, 4)}


def test_replayed_micro_batch_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("T", "a", -8.0, (1, 0)), ("U", "a", -7.0, (1, 0))], "target string, ligand string, score double, first_seen struct<round:int,batch_id:int>")
    sink = I.table_sink(f"{tmp_path}/pairs")
    for epoch in (0, 1, 1, 1):
        sink(rows, epoch)
    pairs = I.latest(spark.read.option("basePath", f"{tmp_path}/pairs").parquet(f"{tmp_path}/pairs"), ["target", "ligand"])
    assert [(r.new_hits, r.cum_hits) for r in I.pair_trend(pairs).collect()] == [(2, 2)]


def test_drops_as_written_are_read_alike(spark, tmp_path):
    folder = tmp_path / "in"
    drop_file(folder, 3, 7, [("T", "a", -8.0), ("T", "b", -9.0)])
    (folder / "broken.json").write_text("{ no json")
    batch = read_batch_drops(spark, str(folder))
    want = {(3, 7, "T", "a", -8.0, 4, "kept"), (3, 7, "T", "b", -9.0, 4, "kept")}
    assert {tuple(r) for r in batch.collect()} == want
    assert sorted((r.n_read, r.n_skipped) for r in count_drops(spark, str(folder)).collect()) == [(0, 1), (1, 0)]
    run(I.stream_drops(spark, str(folder)), I.table_sink(f"{tmp_path}/out"), f"{tmp_path}/c", "append")
    assert {tuple(r)[:7] for r in spark.read.parquet(f"{tmp_path}/out/epoch=0").collect()} == want


def test_jobs_are_emitted_once(spark, tmp_path):
    sink = I.new_rows_sink(f"{tmp_path}/jobs", "job", "job string", lambda b: b.select("job"))
    frame = lambda *names: spark.createDataFrame([(x,) for x in names], "job string")
    sink(frame("a", "b", "a"), 0)
    sink(frame("b", "c"), 1)
    sink(frame("b", "c"), 1)
    got = [tuple(r) for r in I.read_epochs(spark, f"{tmp_path}/jobs", "job string").select("epoch", "job").orderBy("epoch", "job").collect()]
    assert got == [(0, "a"), (0, "b"), (1, "c")]


def test_refresh_runs_between_batches_only(spark):
    seen, written = [], []
    sink = I.refresh_every(2, seen.append, lambda b, e: written.append(e))
    for epoch in range(5):
        sink(None, epoch)
    assert seen == [2, 4] and written == [0, 1, 2, 3, 4]


def test_refresh_merges_partials_and_closes(spark, tmp_path):
    parts, table = f"{tmp_path}/parts", f"{tmp_path}/stats"
    schema = "target string, n_scored long, n_hits long, best_score double, best_ligand string"
    refresh = I.refresh_from(spark, parts, schema, hits.merge_targets, table)
    sink = I.refresh_every(2, refresh, I.partials_sink(parts, hits.target_partials))
    rows = [*FACTS, (2, 1, "V", "c", None, 4), (2, 1, "U", "z", -7.0, 4), (3, 0, "W", "a", 0.5, 4)]
    batches = [rows[:2], rows[2:4], rows[4:6], rows[6:]]
    frame = lambda some: spark.createDataFrame(some, COLUMNS)
    stats = lambda df: sorted(map(tuple, df.collect()))
    for epoch, some in enumerate(batches):
        sink(frame(some), epoch)
        sink(frame(some), epoch)  # replayed
    assert stats(spark.read.parquet(table)) == stats(hits.target_stats(frame(rows[:4])))
    refresh()
    assert stats(spark.read.parquet(table)) == stats(hits.target_stats(frame(rows)))
    assert stats(hits.target_stats(frame(rows))) == [("T", 4, 3, 0.75, -9.0, "a"), ("U", 2, 2, 1.0, -7.0, "a"), ("W", 1, 0, 0.0, None, None)]


def test_hits_merge_from_partials(spark):
    frame = lambda some: spark.createDataFrame(some, COLUMNS)
    merged = hits.merge_hits(hits.top_hits(frame(FACTS[:3])).unionByName(hits.top_hits(frame(FACTS[3:]))))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, hits.top_hits(frame(FACTS)).collect()))


def test_statistics_read_the_facts_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame(FACTS, COLUMNS).write.parquet(f"{tmp_path}/facts")
    facts = spark.read.parquet(f"{tmp_path}/facts")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for operator in (hits.target_stats, hits.docking_summary):
        found = plan(operator(facts))
        assert found.count("FileScan") == 1 and "Join" not in found
    written = []
    monkeypatch.setattr(ledger, "cut_lineage", lambda df, label: (written.append(plan(df)), spark.createDataFrame(df.collect(), df.schema))[1])
    rounds = ledger.round_summary(facts)
    assert len(written) == 1 and written[0].count("FileScan") == 1 and "FileScan" not in plan(rounds)
    assert sorted(map(tuple, rounds.collect())) == [(1, 8, 2, 2, 2, -8.0, "a", "T"), (2, 8, 2, 1, 2, -9.0, "a", "T")]


def test_landed_files_follow_the_size_not_the_number_of_drops(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("sieveline.plans.sources.FACTS_PER_DROP", 10)
    monkeypatch.setattr("sieveline.plans.streams.scratch_path", lambda spark, label: f"{tmp_path}/{label}")
    tables = Tables(spark, "/root/testdata/sf0.001")
    drops = tables.facts.groupBy("round", "batch_id").count().count() * drop_chunks(tables)
    assert drops > 300
    got = {tuple(r) for r in QUERIES["stream_refresh"](spark, tables.path).select("target", "n_scored", "n_hits").collect()}
    landed = list((tmp_path / "landing").rglob("part-*"))
    assert 0 < len(landed) < drops / 10
    read = read_batch_drops(spark, f"{tmp_path}/landing", multi_line=False)
    columns = ["round", "batch_id", "target", "ligand", "score"]
    facts = tables.facts.withColumns({c: F.col(c).cast("string") for c in ("target", "ligand")}).select(columns)
    assert read.select(columns).exceptAll(facts).count() == facts.exceptAll(read.select(columns)).count() == 0
    want = facts.where("score is not null").groupBy("target").agg(F.count("*"), F.count_if(F.col("score") <= -7))
    assert got == {tuple(r) for r in want.collect()}


def test_latest_takes_whole_numbers_and_structs_of_the_last_epoch(spark):
    rows = spark.createDataFrame([("a", 0, 5, (1, 2)), ("a", 1, 3, (0, 9)), ("b", 0, 7, (4, 4)), ("a", 2, None, (0, 8))],
                                 "key string, epoch int, exh int, first_seen struct<round: int, batch_id: int>")
    assert sorted((r.key, r.exh, tuple(r.first_seen)) for r in I.latest(rows, ["key"]).collect()) == [("a", None, (0, 8)), ("b", 7, (4, 4))]
    plan = I.latest(rows.drop("first_seen"), ["key"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
