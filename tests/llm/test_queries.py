import os

import pytest

import corpus_pipeline
from sieveline.llm.decontamination import remove_contamination
from sieveline.llm.jaccard_join import keep_one_of_each_group
from sieveline.llm.packing import pack_documents
from sieveline.llm.queries import ORACLE, QUERIES, REPEATED_UNITS_SQL
from sieveline.llm.toxicity import without_toxic
from sieveline.llm.unit_dedup import remove_repeated_units, repeated_units

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want, got = ([tuple(r) for r in rows] for rows in (cursor.fetchall(), df.select(*columns).collect()))
    assert sorted(map(str, got)) == sorted(map(str, want)) and got


def test_repeated_units_match_sql(spark, con):
    got = repeated_units(spark.read.parquet(f"{SF}/documents.parquet")).drop("text_key").collect()
    want = con.execute(REPEATED_UNITS_SQL).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_stages_hand_on_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("labels", "benchmark"))
    assert len(corpus_pipeline.STAGES) == 5
    plain = [lambda d: without_toxic(d, labels), keep_one_of_each_group, remove_repeated_units,
             lambda d: remove_contamination(d, benchmark), pack_documents]
    before = docs
    for at, ((_, stage), alone) in enumerate(zip(corpus_pipeline.STAGES, plain)):
        after = stage(spark, before, SF)
        rows = sorted(map(str, after.collect()))
        assert rows == sorted(map(str, alone(before).collect()))
        if at < 4:
            assert after.schema.names == docs.schema.names and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
            assert after.where("n_chars <> char_length(text)").count() == 0
            before = spark.createDataFrame(after.collect(), docs.schema)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == rows


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0 if name == "documents" else 10).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
