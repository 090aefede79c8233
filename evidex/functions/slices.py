"""Splitting long groups exactly, so that one large key spreads over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICE_TURNS = 1024


def sliced(messages: DataFrame, lookback: int, size: int | None = None) -> DataFrame:
    """Conversations cut into slices of consecutive turns, each led by the turns it looks back to.

    Windows over ``(conv_id, _slice)`` that reach at most ``lookback`` rows back see what they
    would see over the whole conversation; keep rows with ``_slice = _own`` afterwards.
    ``turn`` counts the messages of a conversation.
    """
    size = size or SLICE_TURNS
    own = F.floor(F.col("turn") / size).cast("bigint")
    late = F.col("turn") % size >= size - lookback
    return messages.withColumn("_own", own).withColumn(
        "_slice", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))
    )


def positions(rows: DataFrame, by: list[str], bucket: Column, order: list[Column], newest_first: bool = True) -> DataFrame:
    """``position`` of every row in its group's order, computed per bucket of the leading sort column.

    ``bucket`` must follow the leading column of ``order`` (nulls last).  Rows are numbered
    inside ``(group, bucket)``; the counts of the buckets before give the offset, so a group
    with a large share of all rows is sorted by many tasks.
    """
    known = rows.withColumn("_b", bucket).withColumn("_none", F.col("_b").isNull().cast("int"))
    keys = [*by, "_none", "_key"]
    keyed = known.withColumn("_key", F.coalesce(F.col("_b").cast("string"), F.lit("")))
    counts = keyed.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("_b").alias("_at"))
    leading = F.desc("_at") if newest_first else F.asc("_at")
    before = Window.partitionBy(*by).orderBy("_none", leading).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*keys, "_before")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        keyed.withColumn("_place", inside).join(offsets, keys)
        .withColumn("position", (F.col("_place") + F.col("_before")).cast("bigint")).select(*rows.columns, "position")
    )
