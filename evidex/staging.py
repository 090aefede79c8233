"""Cutting lineage: a table written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame

from evidex.streaming.work import shared_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet under the cluster's shared folder; later reads do not compute it again."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
