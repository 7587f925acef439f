"""Registered queries against their SQL twins, and the pipeline as a whole."""

import pytest

from checks import compare
from sitescan.llm.oracles import ORACLE_SQL
from sitescan.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("conversations", "benchmark", "labels", "documents", "embeddings")


def test_one_query_for_each_operator():
    import __spark_entry__

    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = compare.duck(SF_DIR)
    for table in TABLES:
        con.execute(f"create or replace view {table} as select * from '{SF_DIR}/{table}.parquet'")
    assert compare.differences(QUERIES[name](spark, SF_DIR).toPandas(), con.sql(ORACLE_SQL[name]).df()) == []


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = docs.collect()
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        assert set(map(tuple, out.collect())) <= set(map(tuple, rows)), name
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    bad = {i for i, r in labels.items() if r["quality"] == 0}
    assert kept and not kept & bad
