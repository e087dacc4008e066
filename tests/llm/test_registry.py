import os

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from foliant.llm import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_gives_the_same(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    got, want = registry.QUERIES[name](spark, FOLDER).toPandas(), con.execute(registry.SQL[name]).df()
    rows = lambda df: sorted(tuple(map(str, x)) for x in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_one_query_an_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 11))


def test_pipeline(spark):
    from tests.llm.test_tokens import check_sequences

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, FOLDER)
        assert after.columns == docs.columns
        assert 0 < after.count() <= at.count()
        at = after
    got = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert set(got["doc_id"]) == {r["doc_id"] for r in at.collect()}
    check_sequences(got, 2048)


@pytest.fixture
def odd_folder(spark, tmp_path, odd_docs):
    """Tables with nulls, repeated rows, empty and long texts, and columns that clash with names used inside."""
    base = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40)
    clash = ["h", "s", "n", "key", "kept", "good", "drop", "keeper", "kept_id", "row_of_id", "removal_id", "sampled_id", "leaked_id", "Text_Kept", "root"]
    rows = base.union(base.limit(5)).union(odd_docs.select(*base.columns))
    rows.selectExpr("*", *[f"cast(doc_id as string) AS `{c}`" for c in clash]).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, k % 2, 0) for k in range(12)] + [(1, 0, 0), (None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, "Alpha beta gamma delta. Same line here today."), (2, None), (2, ""), (None, "x y")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_on_odd_tables(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, odd_folder)
        assert after.columns == docs.columns and after.count() <= at.count()
        assert all(r["h"] == (None if r["doc_id"] is None else str(r["doc_id"])) == r["root"] for r in after.collect())
        assert after.where("doc_id IS NULL").count() == 1  # it can't be told apart, so it stays
        at = after
    ids = [r["doc_id"] for r in at.collect()]
    assert len(ids) == len(set(ids)) > 10
    got = corpus_pipeline.run(spark, odd_folder)
    assert {r["doc_id"] for r in got.collect()} == set(ids)


def test_pipeline_on_empty_tables(spark, odd_folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd_folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    spark.read.parquet(f"{odd_folder}/documents.parquet").limit(3).write.parquet(f"{tmp_path}/few/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{odd_folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/few/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/few").count() > 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_on_odd_tables(spark, odd_folder, name):
    n = spark.read.parquet(f"{odd_folder}/documents.parquet").count()
    got = registry.QUERIES[name](spark, odd_folder).count()
    assert got == n or name in ("op2_template_decontamination", "op9_importance_resampling", "op10_best_fit_packing")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_gives_the_same_on_odd_tables(spark, odd_folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd_folder}/documents.parquet/*.parquet')")
    got, want = registry.QUERIES[name](spark, odd_folder).toPandas(), con.execute(registry.SQL[name]).df()
    rows = lambda df: sorted(tuple("" if pd.isna(x) else str(x).removesuffix(".0") for x in row) for row in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_what_a_stage_writes_is_deleted(spark):
    from foliant.llm import common

    before = set(common._scratch)
    path = common.fresh_path(spark, "result")
    with common.temporary(spark):
        common.materialise(spark.range(5).toDF("x"), "within").write.parquet(path)
    assert set(common._scratch) - before == {path} and spark.read.parquet(path).count() == 5
