"""The corpus pipeline: toxic documents go, near duplicates go, personal data is masked, languages reach their shares, batches form.

Every stage takes the documents the stage before kept, as written Parquet, and returns the
columns of ``documents`` (the last one adds its own).  Columns of other names pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.llm import mixing, ngram_join, packing, pii, toxicity
from evidex.llm.common import staged, table
from evidex.llm.queries import SHARES

TOXIC = toxicity.THRESHOLD


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored ``TOXIC`` or more go; the classifier learns from every label."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.reject(docs, model, TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id."""
    return ngram_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else masked


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of languages short of their share are repeated by their rate."""
    sample = mixing.labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("lang"))
    mixed = mixing.mix(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text"), sample, SHARES, floor=1.0)
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their length, bucket, batch and place."""
    return packing.pack_texts(docs, keep_text=True)


STAGES = [
    ("toxicity", toxic), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", packed),
]
ORACLE_SQL = None  # a trained classifier decides the first stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
