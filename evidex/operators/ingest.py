"""From raw documents to an index of chunks (family A)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evidex.functions import text as tx
from evidex.functions.fold import let
from evidex.functions.identity import normalize_document_id, point_id

MAX_UPLOAD_BYTES = 25 * 1024 * 1024
CHUNK_SIZE = 1200
CHUNK_OVERLAP = 200
PREVIEW_LIMIT = 500

# File types accepted for upload.
ALLOWED_SUFFIXES = (".pdf", ".txt", ".md", ".csv")
ALLOWED_MIMES = ("application/pdf", "text/plain", "text/markdown", "text/csv")

# Line breaks and the blanks that are not line breaks, as regex class bodies.
NEWLINE = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
INLINE = r"\t\x1f\p{Zs}"


def base_name(filename: Column | str) -> Column:
    return F.regexp_extract(tx.as_col(filename), r"([^/]+)/*$", 1)


def file_suffix(filename: Column | str) -> Column:
    return F.lower(F.regexp_extract(base_name(filename), r"^.+(\.[^.]+)$", 1))


def file_stem(filename: Column | str) -> Column:
    return F.regexp_replace(base_name(filename), r"(?<=.)\.[^.]+$", "")


def gate_documents(df: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Add ``accepted`` and the first failing rule as ``reason``."""
    name, base = F.coalesce(F.col("filename"), F.lit("")), base_name("filename")
    allowed = file_suffix("filename").isin(*ALLOWED_SUFFIXES) | F.lower(
        F.coalesce(F.col("mime_type"), F.lit(""))
    ).isin(*ALLOWED_MIMES)
    reason = (
        F.when(name == "", F.lit("filename_missing"))
        .when(F.col("byte_size") > max_bytes, F.lit("file_too_large"))
        .when(base.isin("", ".", ".."), F.lit("filename_missing"))
        .when(~allowed, F.lit("unsupported_type"))
    )
    return df.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def mark_processed(df: DataFrame) -> DataFrame:
    ready = ~tx.is_blank("text")
    return df.select(
        "*",
        F.when(ready, F.col("text")).alias("extracted_text"),
        ready.alias("processed"),
        ready.alias("vectorized"),
    )


def derive_display_name(text: Column | str, filename: Column | str) -> Column:
    """First line when it reads like a title, else the file's stem."""
    head = F.split(tx.lstrip(text), rf"[{NEWLINE}][{tx.SPACE}]*", 3)
    first, second = tx.rstrip(F.get(head, F.lit(0))), tx.rstrip(F.get(head, F.lit(1)))
    size = F.length(first)
    upper = (F.upper(first) == first) & (F.lower(first) != first)
    byline = F.coalesce(second.rlike(rf"(?i)^by[{tx.SPACE}]+."), F.lit(False))
    titled = (
        (size <= 120)
        & ~F.lower(first).rlike("^(?:section|chapter|page) ")
        & (byline | ((size <= 80) & (upper | ~F.endswith(first, F.lit(".")))))
    )
    return F.when(~tx.is_blank(text) & titled, first).otherwise(file_stem(filename))


def derive_author(text: Column | str) -> Column:
    """First line of the form ``by ...``."""
    line = F.regexp_extract(
        tx.as_col(text),
        rf"(?i)(?:^|[{NEWLINE}])[{INLINE}]*(by[{INLINE}]+[^{NEWLINE}{INLINE}][^{NEWLINE}]*)", 1,
    )
    return F.nullif(tx.strip(line), F.lit(""))


def preview(text: Column | str, limit: int = PREVIEW_LIMIT) -> Column:
    def shown(flat: Column) -> Column:
        cut = F.concat(tx.rstrip(F.substring(flat, 1, limit - 1)), F.lit("…"))
        return F.when(flat != "", F.when(F.length(flat) <= limit, flat).otherwise(cut))

    return let(tx.collapse(text), shown)


def character_count(text: Column | str) -> Column:
    return F.coalesce(F.length(tx.strip(text)), F.lit(0)).cast("bigint")


def chunk_documents(df: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    doc_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """Overlapping windows with dense index and true offsets into the source text.

    The text is cut once into ``step``-sized blocks and each window is its block
    plus the head of the following ones, so the cost is linear in the document
    (a ``substring`` per window would rescan the text each time).  Numbering
    happens inside the array: no shuffle and no window function.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than the window size")
    followers = -(-size // step)
    blocks = F.regexp_extract_all(F.col(text_col), F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))

    def window(i: Column) -> Column:
        raw = F.substring(F.array_join(F.slice(F.col("_blocks"), i + 1, followers), ""), 1, size)
        # What is left of the front blanks is measured on a text cut once.
        return let(raw, lambda raw: let(tx.lstrip(raw), lambda body: F.struct(
            tx.rstrip(body).alias("text"), (i * step + F.length(raw) - F.length(body)).cast("bigint").alias("start_offset"),
        )))

    windows = F.filter(
        F.transform(F.sequence(F.lit(0), F.size("_blocks") - 1), window),
        lambda w: w["text"] != "",
    )
    keep = [c for c in df.columns if c != text_col]
    return (
        df.filter(F.col(text_col) != "")
        .select(*keep, blocks.alias("_blocks"))
        .select(*keep, F.posexplode(windows).alias("_pos", "_w"))
        .select(
            *keep,
            F.col("_pos").cast("bigint").alias("chunk_index"),
            F.col("_w.text").alias("text"),
            F.col("_w.start_offset").alias("start_offset"),
            (F.col("_w.start_offset") + F.length("_w.text")).alias("end_offset"),
        )
        .transform(lambda c: assign_ids(c, doc_col))
    )


def assign_ids(chunks: DataFrame, doc_col: str = "document_id") -> DataFrame:
    return chunks.select(
        "*",
        F.concat_ws(":", F.col(doc_col), F.col("chunk_index").cast("string")).alias("chunk_id"),
        point_id(doc_col, "chunk_index").alias("point_id"),
    )


INDEX_KEY = ["document_id", "user_id"]


def delete_document_chunks(index: DataFrame, keys: DataFrame) -> DataFrame:
    # Keys of one batch repeat once per chunk; distinct first keeps the anti side small.
    return index.join(keys.select(*INDEX_KEY).distinct(), INDEX_KEY, "left_anti")


def upsert_document_chunks(index: DataFrame, new: DataFrame) -> DataFrame:
    """Replace all chunks of every ``(document_id, user_id)`` present in ``new``."""
    return delete_document_chunks(index, new).unionByName(new.select(*index.columns))


def set_matter(index: DataFrame, updates: DataFrame) -> DataFrame:
    """Re-assign the matter of existing chunks; ``updates`` has one row per document."""
    u = updates.select(*INDEX_KEY, F.col("matter_id").alias("_matter"), F.lit(True).alias("_hit"))
    matter = F.when(F.col("_hit"), F.col("_matter")).otherwise(F.col("matter_id"))
    return (
        index.join(u, INDEX_KEY, "left")
        .withColumn("matter_id", matter)
        .select(*index.columns)
    )


def merge_by_index(chunks: DataFrame) -> DataFrame:
    """Document text as its chunks in order with a blank line between them.

    The grouped array is one document, which the upload gate bounds at 25 MB.
    """
    ordered = F.sort_array(F.collect_list(F.struct("chunk_index", "text")))
    return (
        chunks.filter(~tx.is_blank("text"))
        .groupBy("document_id")
        .agg(ordered.alias("_parts"))
        .select(
            "document_id",
            F.array_join(F.col("_parts.text"), "\n\n").alias("text"),
            F.size("_parts").cast("bigint").alias("chunk_count"),
        )
    )


def chunk_body() -> Column:
    def filled(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    return tx.strip(F.coalesce(filled("chunk_text"), filled("text"), filled("content"), F.lit("")))


def looks_like_start(body: Column) -> Column:
    """Text that opens with a capital, or a quotation mark and a capital."""
    return body.rlike("^[\\p{Lu}\\p{Lt}]|^['\"“‘][\\p{Lu}\\p{Lt}]")


def library_detail(points: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per document: metadata from its best chunk, text from ``texts``.

    Best is the first parent, else the last chunk that looks like a start, else
    the first chunk; ``ordinal`` is the storage order of the points.
    """
    body = chunk_body()
    parent = F.coalesce(F.col("is_parent"), F.lit(False)) | (
        F.lower(F.coalesce(F.col("chunk_role"), F.lit(""))) == "parent"
    )
    # A parent ends the search, so later starts count only before the first parent.
    kind = F.when(parent, 2).when(looks_like_start(body), 1).otherwise(0)
    rank = F.struct(
        kind.alias("kind"),
        F.when(kind == 1, F.col("ordinal")).otherwise(-F.col("ordinal")).alias("place"),
    )
    meta = F.max_by(
        F.struct("filename", "title", "law_name", "document_type", "year", "publication_year"), rank
    )
    picked = points.groupBy("document_id").agg(meta.alias("m"))
    filename = F.coalesce(F.nullif("m.filename", F.lit("")), F.col("document_id"))
    year = F.coalesce(F.nullif("m.year", F.lit("")), F.nullif("m.publication_year", F.lit("")))
    return picked.join(texts, "document_id").select(
        "document_id",
        filename.alias("filename"),
        F.coalesce(F.nullif("m.title", F.lit("")), filename).alias("title"),
        F.col("m.law_name").alias("law_name"),
        F.col("m.document_type").alias("document_type"),
        tx.strip(year).try_cast("bigint").alias("year"),
        "text",
        F.substring("text", 1, PREVIEW_LIMIT).alias("text_preview"),
        F.length("text").cast("bigint").alias("character_count"),
        "chunk_count",
    )


def prepare_embedding_input(df: DataFrame, task: str = "search_document") -> DataFrame:
    """Trimmed, non-blank texts carrying the task prefix exactly once."""
    prefix = f"{task}: "
    body = tx.strip("text")
    prefixed = F.when(F.startswith(body, F.lit(prefix)), body).otherwise(F.concat(F.lit(prefix), body))
    return df.filter(~tx.is_blank("text")).withColumn("embedding_input", prefixed)


def embed(df: DataFrame, embed_fn, task: str = "search_document") -> DataFrame:
    """Rows with ``embedding`` from a caller's vectorised function (a pandas UDF over texts)."""
    return prepare_embedding_input(df, task).withColumn("embedding", embed_fn(F.col("embedding_input"))).drop("embedding_input")


def validate_vectors(df: DataFrame, dim: int) -> DataFrame:
    """Quarantine frame: rows whose vector is missing or of the wrong length."""
    size = F.coalesce(F.size(F.col("embedding")), F.lit(0))
    return df.withColumn("vector_size", F.greatest(size, F.lit(0)).cast("bigint")).filter(
        F.col("vector_size") != dim
    )


def verify_index(df: DataFrame, dim: int) -> DataFrame:
    """One row: point count, vector sizes and how often each payload key is filled."""
    payload = [c for c in df.columns if c != "embedding"]
    sizes = F.size("embedding")
    return df.agg(
        F.count("*").alias("points"),
        F.min(sizes).cast("bigint").alias("min_vector_size"),
        F.max(sizes).cast("bigint").alias("max_vector_size"),
        F.coalesce(F.bool_and(sizes == dim), F.lit(True)).alias("vector_size_ok"),
        *[F.count(c).alias(f"filled_{c}") for c in payload],
    )


# Payload fields taken over as they are.
PAYLOAD_TEXTS = (
    "heading", "law_name", "document_type", "category", "sub_category", "practice_area", "summary", "parent_chunk_id",
    "validation_status", "chunk_role", "section",
)
PAYLOAD_NUMBERS = ("page_number", "start_offset", "end_offset", "paragraph_index")


def normalize_payload(points: DataFrame, source_type: str = "legal") -> DataFrame:
    """Raw points (JSON ``payload``) to the chunk schema, invalid points dropped."""
    p = F.try_parse_json("payload")

    def get(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(p, f"$.{path}", kind)

    def truthy(path: str) -> Column:
        return F.nullif(get(path), F.lit(""))

    dropped = (
        F.coalesce(get("is_parent", "boolean"), F.lit(False))
        | ~F.coalesce(get("embedded", "boolean"), F.lit(True))
        | ~F.coalesce(get("is_retrieval_valid", "boolean"), F.lit(True))
    )
    scope = get("scope")
    inferred = F.when(scope.isin("conversation", "matter"), scope).otherwise(F.lit(source_type))
    year = F.coalesce(truthy("publication_year"), get("source.publication_year"), get("year")).try_cast("bigint")
    none = F.array().cast("array<string>")
    listed = lambda path: F.coalesce(get(path, "array<string>"), none).alias(path)
    score = F.col("score").cast("double") if "score" in points.columns else F.lit(None).cast("double")
    return points.filter(~dropped).select(
        F.coalesce(get("chunk_id"), F.col("point_id")).alias("id"),
        F.coalesce(get("chunk_id"), F.col("point_id")).alias("chunk_id"),
        F.coalesce(score, F.lit(0.0)).alias("score"),
        normalize_document_id(get("document_id")).alias("document_id"),
        get("chunk_index", "bigint").alias("chunk_index"),
        F.coalesce(get("text"), get("chunk_text"), F.lit("")).alias("text"),
        F.coalesce(truthy("filename"), get("source.filename")).alias("filename"),
        get("title").alias("title"),
        get("court").alias("court"),
        year.alias("year"),
        year.alias("publication_year"),
        F.coalesce(truthy("jurisdiction"), get("province")).alias("jurisdiction"),
        scope.alias("scope"),
        F.lit(source_type).alias("source"),
        inferred.alias("source_type"),
        get("user_id").alias("user_id"),
        get("matter_id").alias("matter_id"),
        get("conversation_id").alias("conversation_id"),
        *[get(c).alias(c) for c in PAYLOAD_TEXTS],
        listed("sections"), listed("keywords"),
        get("embedded", "boolean").alias("embedded"),
        *[get(c, "bigint").alias(c) for c in PAYLOAD_NUMBERS],
    )


def documents_ready(scopes: DataFrame, docs: DataFrame) -> DataFrame:
    """Per scope row, whether its owner has a ready document in its matter or conversation.

    Each visibility branch is its own equi semi-join, so nothing is paired by owner alone.
    """
    ready = docs.filter(F.col("processed") & F.col("vectorized"))

    def keys(scope: str, key: str) -> DataFrame:
        return (
            ready.filter(F.col("scope") == scope)
            .select(F.col("user_id"), F.concat_ws("|", F.lit(key), F.col(key)).alias("_k"))
            .where(F.col(key).isNotNull())
        )

    open_keys = (
        keys("conversation", "conversation_id")
        .union(keys("matter", "matter_id"))
        .union(keys("conversation", "matter_id"))
        .distinct()
        .withColumn("_open", F.lit(True))
    )
    wanted = scopes.select(
        "*",
        F.explode(
            F.array(
                F.concat_ws("|", F.lit("conversation_id"), F.coalesce("conversation_id", F.lit("\x00"))),
                F.concat_ws("|", F.lit("matter_id"), F.coalesce("matter_id", F.lit("\x00"))),
            )
        ).alias("_k"),
    )
    return (
        wanted.join(open_keys, ["user_id", "_k"], "left")
        .groupBy(*scopes.columns)
        .agg(F.coalesce(F.bool_or("_open"), F.lit(False)).alias("ready"))
    )
