"""Ownership and access audits (B9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions import text as tx


def audit_conversations(conversations: DataFrame, matters: DataFrame,
                        acting_user: str | None = None) -> DataFrame:
    """Violations only: conversations whose linked matter belongs to someone else.

    With ``acting_user`` the conversation's own owner is tested first.
    """
    owner = F.lit(acting_user) if acting_user else F.col("user_id")
    joined = conversations.join(
        matters.select("matter_id", F.col("owner_id").alias("_owner")), "matter_id", "left"
    )
    violation = F.when(F.col("user_id") != owner, F.lit("conversation_owner_mismatch")).when(
        F.col("_owner") != owner, F.lit("matter_owner_mismatch")
    )
    return (
        joined.withColumn("violation", violation)
        .filter(F.col("violation").isNotNull())
        .select(*conversations.columns, "violation")
    )


def audit_document_access(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Outcome of each request for one document: ok, not_found, forbidden or not_ready."""
    d = documents.select(
        "document_id", F.col("user_id").alias("_owner"), F.col("scope").alias("_scope"),
        F.col("matter_id").alias("_matter"), F.col("conversation_id").alias("_conversation"),
        tx.is_blank("text").alias("_blank"),
    )
    in_conversation = (F.col("_scope") == "conversation") & F.col("_conversation").eqNullSafe(
        F.col("conversation_id")
    )
    in_matter = (F.col("_scope") == "matter") & F.coalesce(
        F.col("_matter") == F.col("matter_id"), F.lit(False)
    )
    outcome = (
        F.when(F.col("_owner").isNull() | (F.col("_owner") != F.col("user_id")), "not_found")
        .when(~(in_conversation | in_matter), "forbidden")
        .when(F.col("_blank"), "not_ready")
        .otherwise("ok")
    )
    return (
        requests.join(d, "document_id", "left")
        .withColumn("outcome", outcome)
        .select(*requests.columns, "outcome")
    )
