"""Tenant isolation predicates.

Each is a ``Column`` of equality tests only, so a filter built from them is
pushed to the Parquet scan.  An argument may be a Python value (one request) or
a ``Column`` (batch form: the grants table of a join condition); a missing
Python value drops its branch, a null column makes its branch false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Value = str | Column | None


def _eq(name: str, value: Value) -> Column:
    return F.col(name) == (value if isinstance(value, Column) else F.lit(value))


def _branch(scope: str, **keys: Value) -> Column | None:
    if any(v is None or (isinstance(v, str) and v == "") for v in keys.values()):
        return None
    return reduce(lambda a, b: a & b, [F.col("scope") == scope] + [_eq(k, v) for k, v in keys.items()])


def _any(user: Value, branches: list[Column | None]) -> Column:
    present = [b for b in branches if b is not None]
    return user_scope(user) & F.coalesce(reduce(lambda a, b: a | b, present), F.lit(False))


def user_scope(user: Value) -> Column:
    return _eq("user_id", user)


def document_visibility(user: Value, matter: Value = None, conversation: Value = None) -> Column:
    return _any(user, [
        F.col("scope") == "user",
        _branch("matter", matter_id=matter),
        _branch("conversation", matter_id=matter),
        _branch("conversation", conversation_id=conversation),
    ])


def memory_visibility(user: Value, matter: Value = None, conversation: Value = None) -> Column:
    """Like documents, but a matter does not open its conversations' memories."""
    return _any(user, [
        F.col("scope") == "user",
        _branch("matter", matter_id=matter),
        _branch("conversation", conversation_id=conversation),
    ])


def document_id_scoped(user: Value, document: Value, matter: Value = None,
                       conversation: Value = None) -> Column:
    return _eq("document_id", document) & memory_visibility(user, matter, conversation)


def conversation_documents(user: Value, conversation: Value) -> Column:
    return user_scope(user) & (F.col("scope") == "conversation") & _eq("conversation_id", conversation)


def matter_documents(user: Value, matter: Value) -> Column:
    return user_scope(user) & (F.col("scope") == "matter") & _eq("matter_id", matter)


def matter_linked_conversation_documents(user: Value, matter: Value) -> Column:
    return user_scope(user) & (F.col("scope") == "conversation") & _eq("matter_id", matter)


def legal_metadata(filters: dict[str, str] | None) -> Column:
    """Year and court are hard filters; a section is only a ranking hint."""
    tests = [F.lit(True)]
    year, court = (filters or {}).get("year"), (filters or {}).get("court")
    if year:
        # A plain comparison with a number is pushed to the scan.
        text = str(year).strip()
        tests.append(F.col("year") == int(text) if text.isdigit() else F.col("year").cast("string") == text)
    if court:
        tests.append(F.col("court") == court)
    return reduce(lambda a, b: a & b, tests)


def visible_to(rows: DataFrame, grants: DataFrame, rule=document_visibility) -> DataFrame:
    """Batch form: each grant ``(query_id,user_id,matter_id,conversation_id)`` with the rows it sees.

    Rows and grants meet on the owner and a key of the scope, so no grant meets rows of its
    owner that it does not see.  A row of a conversation can be seen through its matter and
    through the conversation; of the two the matter counts.
    """
    through_matter = rule is document_visibility
    key = lambda kind, value: F.concat(F.lit(kind), value)
    of_row = F.when(F.col("scope") == "user", F.array(F.lit("u"))).when(
        F.col("scope") == "matter", F.array(key("m:", F.col("matter_id")))
    ).when(F.col("scope") == "conversation", F.array(
        *([key("l:", F.col("matter_id"))] if through_matter else []), key("c:", F.col("conversation_id"))
    ))
    opens = [F.lit("u"), key("m:", F.col("matter_id")), key("c:", F.col("conversation_id"))]
    of_grant = F.array(*opens, *([key("l:", F.col("matter_id"))] if through_matter else []))
    keyed = rows.withColumn("_key", F.explode(F.filter(of_row, lambda k: k.isNotNull())))
    g = grants.select(
        "query_id", F.col("user_id").alias("g_user"), F.col("matter_id").alias("g_matter"),
        F.explode(F.filter(of_grant, lambda k: k.isNotNull())).alias("_opens"),
    )
    seen = keyed.join(g, (F.col("user_id") == F.col("g_user")) & (F.col("_key") == F.col("_opens")))
    if through_matter:
        both = F.startswith("_key", F.lit("c:")) & F.coalesce(F.col("matter_id") == F.col("g_matter"), F.lit(False))
        seen = seen.filter(~both)
    return seen.drop("g_user", "g_matter", "_opens", "_key")
