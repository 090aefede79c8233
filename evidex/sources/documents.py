"""Text files as a table of documents (A1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.functions.text import const_map
from evidex.operators.ingest import base_name, file_suffix

TEXT_SUFFIXES = (".txt", ".md", ".csv")
# Media types by file suffix.
MIME_BY_SUFFIX = {
    ".txt": "text/plain", ".md": "text/markdown", ".csv": "text/csv",
    ".htm": "text/html", ".html": "text/html", ".pdf": "application/pdf",
}
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
# Stands in for U+FFFD characters that really are in the file.
_REAL_REPLACEMENT = "\x00\x00"


def decode_utf8(content: Column) -> Column:
    """UTF-8 text with invalid bytes dropped; genuine U+FFFD characters survive."""
    raw = content.cast("string")
    held = F.replace(raw, F.lit("�"), F.lit(_REAL_REPLACEMENT))
    cleaned = F.replace(F.make_valid_utf8(held), F.lit("�"), F.lit(""))
    repaired = F.replace(cleaned, F.lit(_REAL_REPLACEMENT), F.lit("�"))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(repaired)


def from_binary_files(files: DataFrame) -> DataFrame:
    """Batch or streaming ``binaryFile`` rows to ``path,name,mime,text,bytes``."""
    suffix = file_suffix("path")
    mime = F.coalesce(F.element_at(const_map(MIME_BY_SUFFIX), suffix), F.lit("application/octet-stream"))
    readable = _readable(suffix)
    return files.select(
        "path",
        base_name("path").alias("name"),
        mime.alias("mime"),
        F.when(readable, decode_utf8(F.col("content"))).otherwise("").alias("text"),
        F.col("length").alias("bytes"),
    )


def _readable(suffix: Column) -> Column:
    return suffix.isin(*TEXT_SUFFIXES, *[s for s, mime in MIME_BY_SUFFIX.items() if mime.startswith("text/")])


def _any_case(suffix: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every file below ``path``, one or several, as a document row.

    Only files with a text suffix are opened, however large the others are: those are listed
    without their content.
    """
    def files(glob: str) -> DataFrame:
        return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)

    texts = sorted({*TEXT_SUFFIXES, *(s for s, mime in MIME_BY_SUFFIX.items() if mime.startswith("text/"))})
    opened = files("*{" + ",".join(map(_any_case, texts)) + "}")
    closed = files("*").select("path", "modificationTime", "length").filter(~_readable(file_suffix("path")))
    return from_binary_files(opened).unionByName(from_binary_files(closed.withColumn("content", F.lit(None).cast("binary"))))
