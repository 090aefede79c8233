"""Evaluation of plans, retrieval and packed answers (family Q)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.identity import resource_key
from evidex.operators.grade import concept_in
from evidex.rules import answers as ra


def planner_accuracy(predictions: DataFrame, cases: DataFrame, key: list[str]) -> DataFrame:
    """Share of right answer modes and authority needs, per expected mode and overall (``all``).

    The overall row is the sum of the per-mode rows, not a second pass.
    """
    joined = cases.join(predictions, key)
    mode = F.count_if(F.col("answer_mode").eqNullSafe(F.col("expected_mode"))).alias("mode_hits")
    authority = F.count_if(F.col("requires_authority") == F.col("expected_authority")).alias("authority_hits")
    per_mode = joined.groupBy(F.col("expected_mode").alias("mode")).agg(F.count("*").alias("cases"), mode, authority)
    overall = per_mode.agg(F.sum("cases").alias("cases"), F.sum("mode_hits").alias("mode_hits"), F.sum("authority_hits").alias("authority_hits"))
    both = per_mode.unionByName(overall.select(F.lit("all").alias("mode"), "cases", "mode_hits", "authority_hits")).filter("cases > 0")
    return both.select(
        "mode", "cases", (F.col("mode_hits") / F.col("cases")).alias("mode_accuracy"),
        (F.col("authority_hits") / F.col("cases")).alias("authority_accuracy"),
    )


def retrieval_check(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case whether the expected kind of source came back and how many expected topics its texts cover."""
    text = F.lower(F.coalesce("text", F.lit("")))
    found = (
        hits.select("query_id", "source_type", text.alias("_t")).join(cases, "query_id")
        .select("query_id", (F.coalesce("source_type", F.lit("legal")) == F.col("expected_source_type")).alias("_source"),
                F.transform("expected_topics", lambda c: concept_in(c, F.col("_t"))).alias("_covered"), "expected_topics")
    )
    # Topics are exploded, so each is one combinable flag per case.
    topics = (
        found.select("query_id", F.posexplode("_covered").alias("i", "ok")).groupBy("query_id", "i").agg(F.bool_or("ok").alias("ok"))
        .groupBy("query_id").agg(F.avg(F.col("ok").cast("int")).alias("topic_coverage"))
    )
    sources = found.groupBy("query_id").agg(F.bool_or("_source").alias("source_found"))
    return (
        cases.select("query_id").join(sources, "query_id", "left").join(topics, "query_id", "left")
        .select("query_id", F.coalesce("source_found", F.lit(False)).alias("source_found"),
                F.coalesce("topic_coverage", F.lit(0.0)).alias("topic_coverage"))
    )


def over_budget(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Invariant, expected empty: packed evidence above the budget of its kind."""
    kind = F.when(F.col("source_type").isin("conversation", "matter", "web"), F.col("source_type")).otherwise("legal")
    used = packed.groupBy("query_id", kind.alias("kind")).agg(F.sum("packed_tokens").alias("used"))
    room: Column = F.lit(None).cast("bigint")
    for name in ("legal", "conversation", "matter", "web"):
        room = F.when(F.col("kind") == name, F.col(f"{name}_budget")).otherwise(room)
    return used.join(budgets, "query_id").withColumn("budget", room).filter(F.col("used") > F.col("budget")).select(
        "query_id", "kind", "used", "budget"
    )


def split_resources(resources: DataFrame) -> DataFrame:
    """Invariant, expected empty: a document shown as more than one resource of an answer."""
    return resources.filter(F.col("document_id").isNotNull()).groupBy("query_id", "document_id").agg(
        F.count("*").alias("resources")
    ).filter(F.col("resources") > 1)


def invented_citations(guarded: DataFrame, claims: DataFrame, key: list[str]) -> DataFrame:
    """Invariant, expected empty: unsupported short case citations still in the final answer."""
    bad = claims.filter(
        F.col("status").isin("unsupported", "contradicted") & F.col("claim").rlike("(?iU)" + ra.CASE) & (F.length("claim") < 80)
    ).select(*key, "claim")
    return guarded.filter(~F.col("document_mode") & (F.col("grounding_status") != "strong")).join(bad, key).filter(
        F.contains("answer", F.col("claim"))
    ).select(*key, "claim")


def same_resource(sources: DataFrame) -> DataFrame:
    """Number of resource keys per document: one each."""
    key = resource_key("document_id", "chunk_id", "source_id")
    return sources.filter(F.col("document_id").isNotNull()).groupBy("query_id", "document_id").agg(
        F.size(F.collect_set(key)).cast("bigint").alias("resource_keys")
    )
