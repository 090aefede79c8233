"""Canonical ids for documents, chunks and resources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidex.functions.text import as_col, strip

_HEX = "[0-9a-f]"
_PREFIXED = (
    "^([0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12})(?:[:/]|$)"
)


def hyphenate(hex32: Column) -> Column:
    """32 hex digits written in the 8-4-4-4-12 form."""
    return F.regexp_replace(
        hex32, f"^({_HEX}{{8}})({_HEX}{{4}})({_HEX}{{4}})({_HEX}{{4}})({_HEX}{{12}})$",
        "$1-$2-$3-$4-$5",
    )


def normalize_document_id(c: Column | str) -> Column:
    """UUIDs in any spelling become lower-case hyphenated; blank becomes null."""
    value = F.lower(strip(c))
    digits = F.translate(F.regexp_replace(value, "urn:|uuid:", ""), "{}-", "")
    return F.when(digits.rlike(f"^{_HEX}{{32}}$"), hyphenate(digits)).otherwise(
        F.nullif(value, F.lit(""))
    )


def canonical_doc_id(document_id: Column | str, chunk_id: Column | str) -> Column:
    """The document's own id, else the UUID that prefixes ``uuid:index`` chunk ids."""
    from_chunk = F.regexp_extract(strip(chunk_id), _PREFIXED, 1)
    return F.coalesce(normalize_document_id(document_id), normalize_document_id(from_chunk))


def _clean_chunk(chunk_id: Column | str) -> Column:
    return F.nullif(F.lower(strip(chunk_id)), F.lit(""))


def chunk_key(document_id, chunk_id, chunk_index, source_id) -> Column:
    doc = canonical_doc_id(document_id, chunk_id)
    cid = _clean_chunk(chunk_id)
    sid = F.nullif(as_col(source_id), F.lit(""))
    return F.coalesce(
        F.concat(F.lit("doc:"), doc, F.lit(":chunk:"), cid),
        F.concat(F.lit("doc:"), doc, F.lit(":index:"), as_col(chunk_index).cast("string")),
        F.concat(F.lit("chunk:"), cid),
        F.concat(F.lit("source:"), sid),
        F.lit("unknown"),
    )


def resource_key(document_id, chunk_id, source_id) -> Column:
    """One document is one resource; names never merge two documents."""
    doc = canonical_doc_id(document_id, chunk_id)
    sid = F.nullif(as_col(source_id), F.lit(""))
    return F.coalesce(
        F.concat(F.lit("doc:"), doc),
        F.concat(F.lit("legal-chunk:"), _clean_chunk(chunk_id)),
        F.concat(F.lit("source:"), sid),
        F.lit("unknown"),
    )


def hit_key(document_id, chunk_id, chunk_index, hit_id) -> Column:
    """Key under which two retrieved hits are exact copies of each other."""
    doc = canonical_doc_id(document_id, F.coalesce(as_col(chunk_id), as_col(hit_id)))
    cid = F.when(as_col(chunk_id) != "", F.lower(strip(chunk_id)))
    return F.coalesce(
        F.concat(F.lit("chunk:"), doc, F.lit(":"), cid),
        F.concat(F.lit("chunk:"), cid),
        F.concat(F.lit("doc:"), doc, F.lit(":"), as_col(chunk_index).cast("string")),
        F.concat(F.lit("id:"), as_col(hit_id)),
    )


def point_id(document_id: Column | str, chunk_index: Column | str) -> Column:
    """Deterministic storage id: md5 of ``doc:index`` written as a UUID."""
    digest = F.md5(F.concat_ws(":", as_col(document_id), as_col(chunk_index).cast("string")))
    return hyphenate(digest)
