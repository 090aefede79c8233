"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``label``) of every node with an edge to another; the label is the least node reachable.

    ``edges`` has columns ``a`` and ``b``.  Each round every node joins its least neighbour and
    the edges are rewritten between what is left, so rounds grow with the logarithm of the
    graph.  Each round ends in written tables; a hub's edges meet in a combinable minimum.
    """
    tidy = lambda e: e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = staged(tidy(edges.select("a", "b")), "edges")
    both = left.union(left.select("b", "a"))
    labels = both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        step = staged(both.groupBy(F.col("a").alias("from")).agg(F.least("from", F.min("b")).alias("to")), "steps")
        labels = staged(
            labels.join(step, labels["label"] == step["from"], "left").select("node", F.coalesce("to", "label").alias("label")), "labels"
        )
        head, tail = step.toDF("a", "to_a"), step.toDF("b", "to_b")
        moved = left.join(head, "a").join(tail, "b")
        left = staged(tidy(moved.select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))), "edges")
    return labels
