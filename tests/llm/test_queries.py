"""The registered queries: SQL where there is some, the pipeline stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from moodmill.catalog.registry import Query
from moodmill.llm.queries import QUERIES, SQL
from tests.oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert difference(spark, connect(SF_DIR), Query(name, QUERIES[name], SQL[name]), SF_DIR) is None


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    twin = docs.filter("doc_id = 1")
    docs = docs.unionByName(twin).unionByName(
        spark.createDataFrame([(900001, None, "en", "src", 0), (900002, "short", "en", "src", 5)], docs.schema)
    )
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
            assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "near_duplicates":
            assert docs.filter("doc_id = 1").count() <= 1
        if name == "secrets":
            assert kept[name] == kept["near_duplicates"]
            assert docs.filter(F.col("text").rlike('token = "[0-9a-f]{40}"')).count() == 0
    assert not kept["quality"] & {900001, 900002}
    assert kept["packing"] == kept["mixing"]
