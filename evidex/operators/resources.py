"""Numbered sources, resources and citations (family L)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidex.functions import text as tx
from evidex.functions.fold import let, unique_values
from evidex.functions.slices import positions
from evidex.functions.identity import canonical_doc_id, chunk_key, normalize_document_id, resource_key
from evidex.operators.ingest import preview
from evidex.staging import staged
from evidex.operators.rank import (
    first_of_key, greedy, hit_order, hit_score, near_duplicate, offsets_overlap, source_reference,
)

EXCERPT_LIMIT = 800
NUMBER_BUCKET, SCORE_STEPS = 1024, 500


def number_sources(hits: DataFrame) -> DataFrame:
    """Sources numbered by position (or score), with excerpt and rounded relevance.

    Numbers are given inside buckets of the position (or score), so a long list is numbered by
    many tasks.
    """
    rows = hits.withColumnRenamed("position", "_position")
    if "position" in hits.columns:
        numbered = positions(rows, ["query_id"], F.floor(F.col("_position") / NUMBER_BUCKET).cast("bigint"), [F.asc("_position")], newest_first=False)
    else:
        numbered = positions(rows, ["query_id"], F.floor(hit_score() * SCORE_STEPS).cast("bigint"), hit_order())
    numbered = numbered.withColumnRenamed("position", "number").withColumnRenamed("_position", "position")
    return numbered.select(
        *hits.columns, F.col("number").cast("bigint").alias("number"),
        preview("text", EXCERPT_LIMIT).alias("excerpt"),
        F.bround(hit_score(), 4).alias("relevance"),
    ).withColumn("source_id", F.concat(F.lit("source-"), F.col("number").cast("string")))


def build_sources(hits: DataFrame) -> DataFrame:
    """Numbered sources with the names and references shown to a reader."""
    names = [F.nullif(F.col(c), F.lit("")) for c in ("display_name", "filename", "title", "law_name", "document_type")]
    return number_sources(hits).withColumns({
        "source_type": F.coalesce("source_type", F.lit("legal")),
        "document_id": canonical_doc_id("document_id", F.coalesce("chunk_id", "id")),
        "document_name": F.coalesce(*names),
        "source_reference": source_reference(),
    })


# --- display and resource cuts ------------------------------------------------------

DISPLAY_RATIO, DISPLAY_GAP, DISPLAY_MAX, DISPLAY_FALLBACK = 0.72, 0.18, 3, 2
RESOURCE_RATIO, RESOURCE_GAP, RESOURCE_MAX = 0.90, 0.10, 3


def display_sources(sources: DataFrame, used: DataFrame) -> DataFrame:
    """Cited sources, else the few that score close to the best one.

    ``used(query_id, sources_used array<bigint>)``.
    """
    cited = F.coalesce(F.array_contains("sources_used", F.col("number")), F.lit(False))
    marked = sources.join(used.select("query_id", "sources_used"), "query_id", "left").withColumn("_cited", cited)
    whole = marked.groupBy("query_id").agg(F.bool_or("_cited").alias("_any"), F.max("relevance").alias("_top"))
    rows = marked.join(whole, "query_id")
    close = F.greatest(F.col("_top") * F.lit(DISPLAY_RATIO), F.col("_top") - F.lit(DISPLAY_GAP))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "number"))
    best = rows.filter(~F.col("_any")).withColumn("_n", place).filter(F.col("_n") <= DISPLAY_MAX).filter(
        F.when(F.col("_top") <= 0, F.col("_n") <= DISPLAY_FALLBACK).otherwise(F.col("relevance") >= close)
    )
    return rows.filter("_any AND _cited").select(*sources.columns).unionByName(best.select(*sources.columns))


def mentions_section(needles: Column) -> Column:
    """The source names the section in one of its spellings; a source is read only if there are any."""
    filled = [F.coalesce(F.col(c), F.lit("")) for c in ("text", "excerpt", "section")]
    names = [F.coalesce(F.col(c), F.lit("")) for c in ("law_name", "filename", "document_name", "source_reference")]
    sections = F.concat_ws(" ", F.coalesce("sections", F.array().cast("array<string>")))
    blob = F.lower(tx.normalize_hyphens(F.concat_ws(" ", *filled, sections, *names)))
    forms = let(blob, lambda t: F.struct(t.alias("text"), F.replace(t, F.lit("-"), F.lit("")).alias("bare")))
    named = let(forms, lambda f: F.exists(
        needles, lambda n: F.contains(f["text"], n) | F.contains(f["bare"], F.replace(n, F.lit("-"), F.lit(""))),
    ))
    return F.when(F.size(needles) > 0, named).otherwise(False)


def resource_sources(sources: DataFrame, hints: DataFrame) -> DataFrame:
    """All evidence of the few documents whose best source scores close to the top.

    ``hints(query_id, section)`` narrows to sources naming the section when any does.
    """
    return sources.join(resource_places(sources, hints), ["query_id", "number"]).select(*sources.columns, "position")


def resource_places(sources: DataFrame, hints: DataFrame) -> DataFrame:
    """``query_id, number, position`` of the sources ``resource_sources`` shows.

    What the cuts look at is written once, without texts: they read it several times, and each
    time the sources would be searched and numbered again.
    """
    pool = staged((
        sources.filter(F.coalesce("source_type", F.lit("")) != "web")
        .join(hints.select("query_id", tx.section_needles("section").alias("_needles")), "query_id", "left")
        .withColumn("_doc", F.coalesce(normalize_document_id("document_id"), F.nullif("filename", F.lit("")), F.col("source_id")))
        .withColumn("_match", F.coalesce(mentions_section(F.col("_needles")), F.lit(False)))
        .select("query_id", "number", "relevance", "_doc", "_match")
    ), "resource-pool")
    named = pool.groupBy("query_id").agg(F.bool_or("_match").alias("_any"))
    pool = pool.join(named, "query_id").filter(F.col("_match") | ~F.col("_any"))
    docs = pool.groupBy("query_id", "_doc").agg(F.max("relevance").alias("_best"), F.min("number").alias("_first"))
    w = Window.partitionBy("query_id")
    close = F.when(F.col("_top") <= 0, 0.0).otherwise(
        F.greatest(F.col("_top") * F.lit(RESOURCE_RATIO), F.col("_top") - F.lit(RESOURCE_GAP))
    )
    best = docs.withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_best"), "_first"))).filter(F.col("_rank") <= RESOURCE_MAX)
    top = docs.groupBy("query_id").agg(F.max("_best").alias("_top"))
    kept = best.join(top, "query_id").filter(F.col("_best") >= close)
    place = F.row_number().over(w.orderBy("_rank", F.desc("relevance"), "number"))
    return (
        pool.join(kept.select("query_id", "_doc", "_rank"), ["query_id", "_doc"])
        .select("query_id", "number", place.cast("bigint").alias("position"))
    )


# --- resources ----------------------------------------------------------------------

def build_resources(sources: DataFrame) -> DataFrame:
    """One row per document of an answer: its best source leads, the rest is merged into one text.

    Runs on the sources selected for an answer, a list the limits bound.  Copies of a
    chunk are removed first; the passages of one document are then folded in place.
    """
    ident = chunk_key("document_id", "chunk_id", "chunk_index", "source_id")
    key = resource_key("document_id", "chunk_id", "source_id")
    norm = tx.passage_norm(F.coalesce(F.nullif("text", F.lit("")), F.col("excerpt")))
    item = F.struct(
        (-F.col("relevance")).alias("neg"), F.col("number").alias("number"), ident.alias("key"),
        F.col("start_offset").cast("bigint").alias("s"), F.col("end_offset").cast("bigint").alias("e"),
        norm.alias("n"), tx.passage_tokens(norm).alias("t"),
        F.struct(*[c for c in sources.columns if c != "query_id"]).alias("row"),
    )
    lists = sources.groupBy("query_id", key.alias("_key")).agg(F.sort_array(F.collect_list(item)).alias("items"))

    def first_place(x: Column) -> Column:
        return F.array_min(F.transform(F.filter("items", lambda y: y["key"] == x["key"]), lambda y: y["number"]))

    # Equal relevance: the chunk mentioned first leads, whichever of its copies is best.
    ranked = F.sort_array(F.transform(first_of_key(F.col("items")), lambda x: F.struct(
        x["neg"].alias("neg"), first_place(x).alias("first"), x["s"].alias("s"), x["e"].alias("e"),
        x["n"].alias("n"), x["t"].alias("t"), x["row"].alias("row"),
    )))

    def repeats(x: Column, y: Column) -> Column:
        return offsets_overlap(y["s"], y["e"], x["s"], x["e"]) | near_duplicate(y["n"], x["n"], y["t"], x["t"])

    distinct = lists.withColumn("ranked", ranked).withColumn("kept", greedy(F.col("ranked"), repeats))
    texts = F.filter(
        F.transform("kept", lambda k: tx.strip(F.coalesce(F.nullif(k["row"]["excerpt"], F.lit("")), k["row"]["text"], F.lit("")))),
        lambda s: s != "",
    )
    best = F.get(F.col("kept"), F.lit(0))["row"]
    doc = canonical_doc_id(best["document_id"], best["chunk_id"])
    rows = distinct.select(
        "query_id", F.coalesce(F.concat(F.lit("resource-"), doc), F.concat(F.lit("resource-"), F.col("_key"))).alias("resource_id"),
        doc.alias("document_id"),
        F.coalesce(F.nullif(best["display_name"], F.lit("")), best["document_name"]).alias("display_name"),
        best["filename"].alias("filename"), best["source_type"].alias("source_type"),
        best["source_id"].alias("source_id"), best["number"].alias("source_number"),
        merge_passages(texts).alias("excerpt"), F.size("kept").cast("bigint").alias("passages"),
        best["relevance"].alias("relevance"),
    )
    top = rows.groupBy("query_id").agg(F.max("relevance").alias("_top"))
    return rows.join(top, "query_id").withColumn("relevance_percent", relevance_percent(F.col("relevance"), F.col("_top"))).drop("_top")


def relevance_percent(value: Column, top: Column) -> Column:
    """Share of the answer's best relevance in whole percent."""
    return F.when(top > 0, F.bround(value / F.nullif(top, F.lit(0.0)) * 100, 0)).otherwise(0).cast("bigint")


def merge_passages(texts: Column) -> Column:
    """Passages joined with blank lines; of two that repeat each other the longer stays in place."""
    def same(x: Column, y: Column) -> Column:
        xn, yn = tx.passage_norm(x), tx.passage_norm(y)
        near = near_duplicate(yn, xn, tx.passage_tokens(yn), tx.passage_tokens(xn))
        return F.contains(x, y) | F.contains(y, x) | near

    def step(parts: Column, x: Column) -> Column:
        hit = F.filter(F.transform(parts, lambda p, i: F.when(same(x, p), i)), lambda i: i.isNotNull())
        at = F.get(hit, F.lit(0))
        longer = F.transform(parts, lambda p, i: F.when((i == at) & (F.length(x) > F.length(p)), x).otherwise(p))
        return F.when(F.size(hit) > 0, longer).otherwise(F.concat(parts, F.array(x)))

    return F.array_join(F.aggregate(texts, F.array().cast("array<string>"), step), "\n\n")


# --- citations ----------------------------------------------------------------------

# Fields a citation takes from the first chunk that fills them.
CITATION_FIELDS = (
    "document_id", "filename", "heading", "law_name", "document_type", "court", "year", "summary", "source_type",
    "display_name",
)
CITATION_KEYWORDS = 12


def citation_key() -> Column:
    doc = canonical_doc_id("document_id", F.coalesce("chunk_id", "id"))
    cid = F.nullif(F.col("chunk_id"), F.lit(""))
    law = F.when(F.size("sections") > 0, F.concat(F.lit("law:"), F.nullif("law_name", F.lit("")), F.lit(":"), F.array_join("sections", ",")))
    return F.coalesce(
        F.concat(F.lit("doc:"), doc, F.lit(":"), F.col("chunk_index").cast("string")),
        F.concat(F.lit("doc:"), doc, F.lit(":chunk:"), cid),
        F.concat(F.lit("doc:"), doc), law,
        F.concat(F.lit("chunk:"), F.coalesce(F.nullif("id", F.lit("")), F.substring(F.coalesce("text", F.lit("")), 1, 40))),
    )


def build_citations(hits: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Citation cards of an answer; ``hits`` carries the source ``number``.

    With ``used`` only the cited sources count, when any of them exists.
    """
    if used is not None:
        w = Window.partitionBy("query_id")
        cited = F.coalesce(F.array_contains("sources_used", F.col("number")), F.lit(False))
        hits = (
            hits.join(used.select("query_id", "sources_used"), "query_id", "left").withColumn("_cited", cited)
            .withColumn("_any", F.bool_or("_cited").over(w)).filter(F.col("_cited") | ~F.col("_any"))
            .drop("_cited", "_any", "sources_used")
        )
    empty = F.array().cast("array<string>")

    def first_filled(value: Column) -> Column:
        return F.min_by(value, F.when(value.cast("string") != "", F.col("number")))

    def ordered(value: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.struct(F.col("number"), value.alias("v")))), lambda s: s["v"])

    first = F.row_number().over(Window.partitionBy("query_id", "_key").orderBy("number")) == 1
    title = F.when(F.col("_lead"), F.coalesce(F.nullif("display_name", F.lit("")), F.col("title"))).otherwise(F.col("title"))
    cards = (
        hits.withColumn("_key", citation_key()).withColumn("_lead", first)
        .withColumn("_excerpt", preview("text", EXCERPT_LIMIT))
        .withColumn("_score", F.bround(hit_score(), 4)).withColumn("_cid", F.coalesce("chunk_id", "id"))
        .groupBy("query_id", "_key").agg(
            F.max_by("_cid", F.struct("_score", -F.col("number"))).alias("citation_id"),
            F.max("_score").alias("score"), first_filled(title).alias("title"),
            *[first_filled(F.col(c)).alias(c) for c in CITATION_FIELDS],
            F.min_by("_cid", "number").alias("chunk_id"), F.min_by("page_number", "number").alias("page"),
            F.min_by("source_reference", "number").alias("source_reference"),
            ordered(F.coalesce("sections", empty)).alias("_sections"), ordered(F.coalesce("keywords", empty)).alias("_keywords"),
            F.array_distinct(F.filter(ordered(F.col("_excerpt")), lambda e: e.isNotNull())).alias("_parts"),
            F.count("*").alias("_n"),
        )
    )
    # A card of one chunk keeps its lists as they are; merging removes repeats.
    sections = F.when(F.col("_n") > 1, unique_values(F.flatten("_sections"))).otherwise(F.flatten("_sections"))
    capped = F.transform("_keywords", lambda k: F.slice(k, 1, CITATION_KEYWORDS))
    keywords = F.when(F.col("_n") > 1, F.slice(unique_values(F.flatten(F.concat(F.slice(capped, 1, 1), F.slice("_keywords", 2, 2**30)))), 1, CITATION_KEYWORDS)).otherwise(F.flatten(capped))
    excerpt = F.when(F.size("_parts") <= 1, F.get("_parts", F.lit(0))).otherwise(preview(F.array_join("_parts", " … "), EXCERPT_LIMIT))
    return cards.select(
        "query_id", "citation_id", "title", *CITATION_FIELDS, "chunk_id", "page", "source_reference",
        sections.alias("sections"), keywords.alias("keywords"), excerpt.alias("excerpt"), "score",
    )


# --- flat source lists ----------------------------------------------------------------

def flat_sources(hits: DataFrame) -> DataFrame:
    """Best hit per filename, title, law and sections; copies collapse before the shuffle."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("filename", "title", "law_name")],
                      F.array_join(F.coalesce("sections", F.array().cast("array<string>")), ","))
    others = [c for c in hits.columns if c != "query_id"]
    best = F.max_by(F.struct(*others), F.struct(F.coalesce("score", F.lit(0.0)), -F.col("ordinal")))
    excerpt = F.nullif(F.substring(tx.strip("text"), 1, EXCERPT_LIMIT), F.lit(""))
    return (
        hits.groupBy("query_id", key.alias("_key")).agg(best.alias("r")).select("query_id", "r.*")
        .withColumn("excerpt", excerpt).withColumn("score", F.bround("score", 4))
    )


def citation_label() -> Column:
    def filled(c: str) -> Column:
        return F.nullif(F.col(c).cast("string"), F.lit(""))

    name = F.coalesce(filled("title"), filled("law_name"), filled("filename"))
    sections = F.when(F.size("sections") > 0, F.concat(F.lit("Sections: "), F.array_join("sections", ", ")))
    return F.concat_ws(" | ", name, sections, filled("court"), F.when(F.col("year") != 0, F.col("year").cast("string")))


def inline_citations(hits: DataFrame) -> DataFrame:
    """Distinct citation labels of a query in order of first use.

    Labels are made distinct before they are collected.
    """
    labels = (
        hits.withColumn("_label", citation_label()).filter(F.col("_label") != "")
        .groupBy("query_id", "_label").agg(F.min("ordinal").alias("_at"))
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_at", "_label"))), lambda s: s["_label"])
    return labels.groupBy("query_id").agg(F.array_join(ordered, "; ").alias("citations"))


def top_sources(hits: DataFrame, limit: int = 5) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal"))
    return hits.withColumn("rank", place.cast("bigint")).filter(F.col("rank") <= limit)


def used_source_counts(used: DataFrame, sources: DataFrame) -> DataFrame:
    """How many used source numbers point at each kind of source (repeats count)."""
    numbers = used.select("query_id", F.explode("sources_used").alias("number"))
    found = numbers.join(sources.select("query_id", "number", "source_type"), ["query_id", "number"])
    counts = found.groupBy("query_id").agg(
        *[F.count_if(F.col("source_type") == k).alias(f"{k}_used") for k in ("legal", "conversation", "matter", "web")]
    )
    return used.select("query_id").join(counts, "query_id", "left").fillna(0)
