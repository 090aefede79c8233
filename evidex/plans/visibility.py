"""Family B: who may see which document."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import visibility as v
from evidex.operators import ownership
from evidex.plans.common import DOCS_CTE, MESSAGES_CTE, with_ctes
from evidex.sources import tables as t

# One grant per conversation: the owner asks inside a conversation and maybe a matter.
GRANTS = {
    "query_id": "conv_id",
    "user_id": "concat('u', conv_id % 37)",
    "matter_id": "CASE WHEN conv_id % 2 = 0 THEN concat('m', conv_id % 11) END",
    "conversation_id": "CASE WHEN conv_id % 3 > 0 THEN concat('c', conv_id % 23) END",
    "document_id": "concat('d', conv_id)",
}
GRANTS_CTE = f"grants AS (SELECT DISTINCT * FROM ({t.select_sql(GRANTS, 'conversations')}))"


def grants(spark, d):
    return t.project(t.load(spark, d, "conversations"), GRANTS).distinct()


def _docs(spark, d):
    return t.docs(spark, d).select("document_id", "user_id", "scope", "matter_id", "conversation_id")


def owner_documents(spark, d):
    return _docs(spark, d).filter(v.user_scope("u7"))


def _batch(rule):
    def run(spark, d):
        return v.visible_to(_docs(spark, d), grants(spark, d), rule).select("query_id", "document_id")

    return run


def scoped_document(spark, d):
    g = grants(spark, d).select(
        "query_id", *[F.col(c).alias(f"g_{c}") for c in ("user_id", "matter_id", "conversation_id", "document_id")]
    )
    rule = v.document_id_scoped(
        F.col("g_user_id"), F.col("g_document_id"), F.col("g_matter_id"), F.col("g_conversation_id")
    )
    return _docs(spark, d).join(g, rule).select("query_id", "document_id", "scope")


def _one_key(rule, key):
    def run(spark, d):
        g = grants(spark, d).select("query_id", F.col("user_id").alias("g_user"), F.col(key).alias("g_key"))
        return _docs(spark, d).join(g, rule(F.col("g_user"), F.col("g_key"))).select("query_id", "document_id")

    return run


def corpus_filter(spark, d):
    corpus = t.docs(spark, d).selectExpr(
        "document_id", "1980 + doc_id % 40 AS year",
        "CASE WHEN doc_id % 3 = 0 THEN 'Supreme Court' WHEN doc_id % 3 = 1 THEN 'High Court' END AS court",
    )
    return corpus.filter(v.legal_metadata({"year": "1999", "court": "Supreme Court", "section": "54-c"}))


def ownership_audit(spark, d):
    conversations = t.messages(spark, d).select("conv_id", "user_id", "matter_id").distinct()
    matters = t.load(spark, d, "orders").selectExpr(
        "concat('m', o_orderkey) AS matter_id", "concat('u', o_custkey % 37) AS owner_id"
    )
    return ownership.audit_conversations(conversations, matters)


def document_access(spark, d):
    return ownership.audit_document_access(grants(spark, d), t.docs(spark, d)).select(
        "query_id", "document_id", "outcome"
    )


QUERIES = {
    "visible_owner_documents": owner_documents,
    "visible_documents": _batch(v.document_visibility),
    "visible_single_document": scoped_document,
    "visible_conversation_documents": _one_key(v.conversation_documents, "conversation_id"),
    "visible_matter_documents": _one_key(v.matter_documents, "matter_id"),
    "visible_matter_linked_documents": _one_key(v.matter_linked_conversation_documents, "matter_id"),
    "corpus_metadata_filter": corpus_filter,
    "visible_memories": _batch(v.memory_visibility),
    "ownership_audit": ownership_audit,
    "document_access_audit": document_access,
}

_JOIN = with_ctes(DOCS_CTE, GRANTS_CTE)
_PAIR = "SELECT g.query_id, d.document_id FROM docs d JOIN grants g ON d.user_id = g.user_id WHERE "
ORACLE = {
    "visible_owner_documents": with_ctes(DOCS_CTE)
    + "SELECT document_id, user_id, scope, matter_id, conversation_id FROM docs WHERE user_id = 'u7'",
    "visible_documents": _JOIN + _PAIR + """d.scope = 'user'
 OR (d.scope IN ('matter', 'conversation') AND d.matter_id = g.matter_id)
 OR (d.scope = 'conversation' AND d.conversation_id = g.conversation_id)""",
    "visible_memories": _JOIN + _PAIR + """d.scope = 'user' OR (d.scope = 'matter' AND d.matter_id = g.matter_id)
 OR (d.scope = 'conversation' AND d.conversation_id = g.conversation_id)""",
    "visible_single_document": _JOIN + """
SELECT g.query_id, d.document_id, d.scope FROM docs d JOIN grants g USING (document_id, user_id)
WHERE d.scope = 'user' OR (d.scope = 'matter' AND d.matter_id = g.matter_id)
 OR (d.scope = 'conversation' AND d.conversation_id = g.conversation_id)""",
    "visible_conversation_documents": _JOIN + _PAIR
    + "d.scope = 'conversation' AND d.conversation_id = g.conversation_id",
    "visible_matter_documents": _JOIN + _PAIR + "d.scope = 'matter' AND d.matter_id = g.matter_id",
    "visible_matter_linked_documents": _JOIN + _PAIR + "d.scope = 'conversation' AND d.matter_id = g.matter_id",
    "corpus_metadata_filter": """
SELECT * FROM (SELECT 'd' || doc_id AS document_id, 1980 + doc_id % 40 AS year,
  CASE WHEN doc_id % 3 = 0 THEN 'Supreme Court' WHEN doc_id % 3 = 1 THEN 'High Court' END AS court FROM documents)
WHERE year = 1999 AND court = 'Supreme Court'""",
    "ownership_audit": with_ctes(MESSAGES_CTE) + """
SELECT c.conv_id, c.user_id, c.matter_id, 'matter_owner_mismatch' AS violation
FROM (SELECT DISTINCT conv_id, user_id, matter_id FROM messages) c
JOIN orders o ON c.matter_id = 'm' || o.o_orderkey WHERE 'u' || (o.o_custkey % 37) <> c.user_id""",
    "document_access_audit": _JOIN + r"""
SELECT g.query_id, g.document_id, CASE
  WHEN d.document_id IS NULL OR d.user_id <> g.user_id THEN 'not_found'
  WHEN NOT ((d.scope = 'conversation' AND d.conversation_id IS NOT DISTINCT FROM g.conversation_id)
    OR (d.scope = 'matter' AND g.matter_id IS NOT NULL AND d.matter_id IS NOT DISTINCT FROM g.matter_id)) THEN 'forbidden'
  WHEN NOT regexp_matches(d.text, '\S') THEN 'not_ready' ELSE 'ok' END AS outcome
FROM grants g LEFT JOIN docs d ON g.document_id = d.document_id""",
}
