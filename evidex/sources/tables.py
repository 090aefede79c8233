"""The given tables, and the engine's own tables derived from them by Spark.

The derived tables add owners, scopes, questions and so on as plain columns of
the given rows.  The expressions are written in the SQL both Spark and the
oracle understand, so each table has one definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- documents ---------------------------------------------------------------
DOCS = {
    "document_id": "concat('d', doc_id)",
    "doc_id": "doc_id",
    "user_id": "concat('u', doc_id % 37)",
    "scope": "CASE WHEN doc_id % 4 = 0 THEN 'user' WHEN doc_id % 4 = 1 THEN 'matter' ELSE 'conversation' END",
    "matter_id": "CASE WHEN doc_id % 4 IN (1, 3) THEN concat('m', doc_id % 11) END",
    "conversation_id": "CASE WHEN doc_id % 4 IN (2, 3) THEN concat('c', doc_id % 23) END",
    "filename": (
        "CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 17 = 0 THEN concat(source, '/..') "
        "ELSE concat('up/', source, '-', doc_id, CASE WHEN doc_id % 5 = 0 THEN '.txt' WHEN doc_id % 5 = 1 "
        "THEN '.MD' WHEN doc_id % 5 = 2 THEN '.csv' WHEN doc_id % 5 = 3 THEN '.docx' ELSE '' END) END"
    ),
    "mime_type": "CASE WHEN doc_id % 3 = 0 THEN 'text/plain' WHEN doc_id % 3 = 1 THEN 'application/msword' END",
    "byte_size": "n_chars * 4000",
    "lang": "lang",
    "source": "source",
    "text": "text",
}

MESSAGES = {
    "conv_id": "conv_id",
    "turn": "turn",
    "role": "role",
    "text": "text",
    "user_id": "concat('u', conv_id % 37)",
    "matter_id": "CASE WHEN conv_id % 3 = 0 THEN concat('m', conv_id % 11) END",
}

EVENTS = {
    "event_id": "event_id",
    "ts": "ts",
    "user_id": "concat('u', user_id)",
    "event_type": "event_type",
    "value": "value",
    "props": "props",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def select_sql(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {table}"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(load(spark, sf_dir, "documents"), DOCS)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(load(spark, sf_dir, "conversations"), MESSAGES)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(load(spark, sf_dir, "events"), EVENTS)
