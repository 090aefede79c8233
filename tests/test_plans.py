"""Shapes of physical plans that matter at scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evidex.functions import visibility as v
from evidex.operators import ingest as op
from evidex.operators import logs as lg

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "visible_documents", "documents_ready", "rerank", "select_evidence", "evidence_strength", "keyword_rescue",
    "pack_evidence", "playbook_findings", "review_table", "limit_hits", "ground_claims", "model_cost",
])
def test_no_nested_loops(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_chunking_has_no_shuffle_of_its_own(spark):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr("concat('d', doc_id) AS document_id", "text")
    text = plan(op.chunk_documents(df))
    assert "Exchange" not in text and "Window" not in text and "Python" not in text


def test_filters_reach_the_scan(spark, tmp_path):
    rows = spark.range(10).selectExpr("id", "concat('u', id % 3) AS user_id", "'matter' AS scope", "concat('m', id) AS matter_id",
                                      "'c' AS conversation_id", "CAST(2000 + id AS INT) AS year", "'x' AS court",
                                      "CAST('2024-01-01 00:00:00' AS TIMESTAMP_NTZ) AS created_at", "'/api' AS path")
    rows.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert "EqualTo(user_id,u1)" in plan(table.filter(v.matter_documents("u1", "m4")))
    assert "EqualTo(year,2004)" in plan(table.filter(v.legal_metadata({"year": "2004"})))
    text = plan(lg.filter_log(table, since="2024-01-01 00:00:00", user_id="u2").select("id"))
    assert "GreaterThanOrEqual(created_at" in text and "matter_id" not in text.split("ReadSchema")[1]


def test_embedding_slot(spark):
    sized = F.udf(lambda x: [float(len(x))], "array<double>")
    got = op.embed(spark.createDataFrame([(" a ",), (" ",)], "text string"), sized).collect()
    assert [(r["text"], r["embedding"]) for r in got] == [(" a ", [float(len("search_document: a"))])]
