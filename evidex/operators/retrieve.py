"""Retrieval joins around the vector search (family C, relational part)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidex.functions import text as tx
from evidex.functions.identity import canonical_doc_id
from evidex.functions.slices import sliced
from evidex.operators.ingest import derive_author, derive_display_name

# Default result sizes.
RETRIEVAL_LIMIT, LEGAL_LIMIT, CONVERSATION_LIMIT, MATTER_LIMIT = 10, 6, 2, 2
KEYWORD_FLOOR, KEYWORD_PER_VARIANT = 0.72, 8
WEB_FLOOR = 0.55
DOCUMENT_TASKS = ("summarization", "document_qa")
SHORT_CHILD = 120
INCOMPLETE_STATUS = ("orphan_heading", "micro_heading", "decorative")


def keyword_rescue(queries: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Chunks whose keyword list holds a spelling of the section the query cites.

    ``queries(query_id, section)``; each spelling contributes up to eight chunks in
    id order, earlier spellings first.  The cut does not depend on the query, so every
    keyword is cut once, before any query meets it: a rank filter Spark applies in each task
    before the shuffle, even for a keyword on a third of the corpus.
    """
    variants = queries.select(
        "query_id", F.posexplode(tx.section_variants("section")).alias("_v", "_kw")
    )
    tagged = chunks.select("chunk_id", "score", F.explode(F.array_distinct("keywords")).alias("_kw"))
    in_keyword = F.row_number().over(Window.partitionBy("_kw").orderBy("chunk_id"))
    tagged = tagged.withColumn("_n", in_keyword).filter(F.col("_n") <= min(limit, KEYWORD_PER_VARIANT))
    overall = F.row_number().over(Window.partitionBy("query_id").orderBy("_v", "chunk_id"))
    return (
        tagged.join(variants, "_kw")
        .groupBy("query_id", "chunk_id")
        .agg(F.min("_v").alias("_v"), F.max("score").alias("score"))
        .withColumn("rank", overall.cast("bigint"))
        .filter(F.col("rank") <= limit)
        .select("query_id", "chunk_id", "rank",
                F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(KEYWORD_FLOOR)).alias("score"))
    )


def merge_hits(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two hit lists merged by chunk, the higher score kept (the first list wins ties)."""
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    payload = [c for c in both.columns if c not in ("query_id", "chunk_id", "_side")]
    order = F.struct(F.coalesce(F.col("score"), F.lit(0.0)), -F.col("_side"))
    return (
        both.groupBy("query_id", "chunk_id")
        .agg(F.max_by(F.struct(*payload), order).alias("_r"))
        .select("query_id", "chunk_id", "_r.*")
    )


def tier_limits(plans: DataFrame) -> DataFrame:
    """Result sizes per tier; input ``query_id, task, document_id, prefer_corpus[, limit]``.

    A document task with a pinned document searches only it; without one it skips
    the corpus; a corpus question skips the uploads.
    """
    task = F.coalesce("task", F.lit(""))
    doc_task, pinned = task.isin(*DOCUMENT_TASKS), F.coalesce(F.col("document_id"), F.lit("")) != ""
    scoped = doc_task & pinned
    corpus_only = F.coalesce(F.col("prefer_corpus"), F.lit(False)) & ~doc_task & ~pinned & (task != "mixed_qa")
    asked = F.col("limit") if "limit" in plans.columns else F.lit(None).cast("int")
    total = F.coalesce(F.nullif(asked, F.lit(0)), F.lit(RETRIEVAL_LIMIT))
    legal = (
        F.when(corpus_only, F.greatest(F.lit(LEGAL_LIMIT), F.least(total, F.lit(LEGAL_LIMIT + 2))))
        .when(doc_task, 0).otherwise(LEGAL_LIMIT)
    )
    conversation = F.when(corpus_only | scoped, 0).otherwise(CONVERSATION_LIMIT)
    matter = F.when(corpus_only | scoped, 0).when(doc_task, max(MATTER_LIMIT, 6)).otherwise(MATTER_LIMIT)
    return plans.select(
        "*",
        legal.cast("bigint").alias("legal_limit"),
        conversation.cast("bigint").alias("conversation_limit"),
        matter.cast("bigint").alias("matter_limit"),
        F.when(scoped, total).otherwise(0).cast("bigint").alias("document_limit"),
        total.cast("bigint").alias("total_limit"),
    )


def build_memories(exchanges: DataFrame) -> DataFrame:
    """Question/answer pairs as memory rows, blank sides skipped."""
    scope = (
        F.when(F.col("conversation_id").isNotNull(), "conversation")
        .when(F.col("matter_id").isNotNull(), "matter").otherwise("user")
    )
    body = F.concat(F.lit("Question:\n\n"), F.col("question"), F.lit("\n\nAnswer:\n\n"), F.col("answer"))
    return exchanges.filter((F.col("question") != "") & (F.col("answer") != "")).select(
        "exchange_id", "user_id", "matter_id", "conversation_id",
        scope.alias("scope"), F.lit("chat").alias("memory_type"), tx.strip(body).alias("text"),
    )


def exchanges_from_messages(messages: DataFrame) -> DataFrame:
    """Each assistant turn with the user turn right before it."""
    w = Window.partitionBy("conv_id", "_slice").orderBy("turn")
    return (
        sliced(messages, 1).withColumn("_role", F.lag("role").over(w)).withColumn("question", F.lag("text").over(w))
        .filter((F.col("_slice") == F.col("_own")) & (F.col("role") == "assistant") & (F.col("_role") == "user"))
        .select(
            F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("exchange_id"),
            "user_id", "matter_id", F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("conversation_id"),
            "question", F.col("text").alias("answer"),
        )
    )


LIST_TASKS = 256


def list_for_scope(docs: DataFrame, scopes: DataFrame) -> DataFrame:
    """Per scope: matter documents newest first, then conversation documents not yet listed.

    Scopes with the same owner, matter and conversation have the same list.  Lists are made and
    numbered once for all of them, so only the last join has as many rows as the result.  The rows
    of a list are many times the bytes shuffled for them: the number of tasks is set, not derived.
    """
    keys = F.collect_set(F.struct("user_id", "matter_id", "conversation_id"))
    keyed = scopes.groupBy("scope_id").agg(F.sort_array(keys).alias("_keys")).withColumn("_list", F.to_json("_keys"))
    opened = keyed.groupBy("_list").agg(F.first("_keys").alias("_keys")).select("_list", F.explode("_keys").alias("k")).select("_list", "k.*")

    def branch(scope: str, key: str, order: int) -> DataFrame:
        d = docs.filter(F.col("scope") == scope).select("document_id", "user_id", key, "created_at").repartition(LIST_TASKS, "user_id", key)
        s = opened.filter(F.col(key).isNotNull()).select("_list", "user_id", key)
        return d.join(s, ["user_id", key]).select(
            "_list", "document_id", "created_at", F.lit(order).alias("_branch")
        )

    place = F.row_number().over(
        Window.partitionBy("_list").orderBy("_branch", F.desc("created_at"), "document_id")
    )
    listed = (
        branch("matter", "matter_id", 0)
        .unionByName(branch("conversation", "conversation_id", 1))
        .repartition(LIST_TASKS, "_list")
        .groupBy("_list", "document_id")
        .agg(F.min("_branch").alias("_branch"), F.max("created_at").alias("created_at"))
        .select("_list", "document_id", place.cast("bigint").alias("position"))
    )
    return keyed.select("scope_id", "_list").join(listed, "_list").select("scope_id", "document_id", "position")


def enrich_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks completed from their documents; chunks of unknown documents only get the recovered id."""
    recovered = canonical_doc_id("document_id", F.coalesce("chunk_id", "id"))
    d = docs.select(
        F.lower("document_id").alias("_doc"),
        F.col("filename").alias("_filename"),
        derive_display_name("text", "filename").alias("_display"),
        derive_author("text").alias("_author"),
        F.col("matter_id").alias("_matter"),
    )
    found = F.col("_doc").isNotNull()
    return (
        chunks.withColumn("document_id", F.coalesce(recovered, F.col("document_id")))
        .join(d, F.col("document_id") == F.col("_doc"), "left")
        .withColumn("filename", F.coalesce(F.nullif("filename", F.lit("")), F.col("_filename"), F.col("filename")))
        .withColumn("display_name", F.when(found, F.col("_display")).otherwise(F.col("display_name")))
        .withColumn("author", F.coalesce("_author", "author"))
        .withColumn("matter_id", F.coalesce("matter_id", "_matter"))
        .select(*chunks.columns)
    )


def expand_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Short or incomplete children get their parent's text in front.

    The ids the hits name are found first, and only those chunks move.
    """
    named = hits.select(F.col("parent_chunk_id").alias("_pid")).filter("_pid IS NOT NULL").distinct()
    parents = chunks.select(
        F.col("chunk_id").alias("_pid"),
        tx.strip(F.coalesce(F.nullif("chunk_text", F.lit("")), F.col("text"), F.lit(""))).alias("_parent"),
    ).join(named, "_pid", "left_semi")
    child = tx.strip(F.coalesce(F.col("text"), F.lit("")))
    incomplete = (F.length(child) < SHORT_CHILD) | F.coalesce(
        F.col("validation_status").isin(*INCOMPLETE_STATUS), F.lit(False)
    )
    grow = incomplete & (F.col("_parent") != "") & ~F.contains(child, F.col("_parent"))
    merged = tx.strip(F.concat(F.col("_parent"), F.lit("\n\n"), child))
    return (
        hits.join(parents, F.col("parent_chunk_id") == F.col("_pid"), "left")
        .withColumn("expanded_text", F.when(F.col("_pid").isNotNull(), F.when(grow, merged).otherwise(child)))
        .withColumn("text", F.when(grow, merged).otherwise(F.col("text")))
        .select(*hits.columns, F.col("_parent").alias("parent_text"), "expanded_text")
    )


def retrieval_metadata(hits: DataFrame) -> DataFrame:
    def of(kind: str) -> Column:
        return F.count_if(F.col("source_type") == kind).alias(f"{kind}_chunks")

    return hits.groupBy("query_id").agg(
        F.count("*").alias("total_selected"), of("legal"), of("conversation"), of("matter"), of("web")
    )


def web_hits_to_chunks(hits: DataFrame, boost: bool = True) -> DataFrame:
    """Web results ``query_id, position, url, title, snippet, score, official`` as chunks."""
    snippet = F.coalesce(F.col("snippet"), F.lit(""))
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    title = F.coalesce(F.nullif(tx.strip("title"), F.lit("")), F.nullif(host, F.lit("")), F.lit("Web result"))
    score = F.greatest(F.col("score"), F.lit(WEB_FLOOR)) if boost else F.col("score")
    return hits.select(
        "query_id",
        F.concat(F.lit("web:"), F.col("position").cast("string"), F.lit(":"), F.col("url")).alias("chunk_id"),
        F.col("url").alias("document_id"), "url",
        F.coalesce(F.nullif(tx.strip(snippet), F.lit("")), F.col("title")).alias("text"),
        title.alias("title"), title.alias("filename"), title.alias("display_name"),
        F.lit("web").alias("source_type"),
        F.when(F.col("official"), "official_web").otherwise("web").alias("document_type"),
        F.nullif(F.substring(snippet, 1, 400), F.lit("")).alias("summary"),
        score.alias("score"), score.alias("relevance_score"),
    )


# --- private hits that are not about the question (C13) -----------------------

# Words that say nothing about the topic of a question.
COMMON_TERMS = """the and for what with from this that are is law legal please about under pakistan
pakistani does how why can any into who when where which have has was were been being will would should
could their they them your you his her its our""".split()
# Legal words too general to tie a passage to a question.
GENERIC_TERMS = """justice government independent establish established primary task newly identify court
order orders section sections article articles act statute provision provisions judgment judgement case
lawyer advocate petition appeal bail fir crpc cpc ppc""".split()
# Phrasings that point at an uploaded document.
UPLOAD_PATTERN = (
    r"\b(?:this|the|my|uploaded|attached)\s+(?:document|doc|file|article|paper|pdf|upload)\b|"
    r"\b(?:summarize|summary of|key (?:points|issues) in|according to (?:the )?(?:author|article|document)|"
    r"what does (?:the )?(?:author|article|document))\b|\bvoid orders\b"
)


def targets_uploads(question: Column | str) -> Column:
    return F.coalesce(F.lower(tx.as_col(question)).rlike(UPLOAD_PATTERN), F.lit(False))


def question_terms(question: Column | str) -> tuple[Column, Column]:
    """Topic words of a question, and those of them that are specific."""
    words = F.regexp_extract_all(F.lower(F.coalesce(tx.as_col(question), F.lit(""))), F.lit(r"[a-z0-9\-]{3,}"), F.lit(0))
    common, generic = tx.const_list(COMMON_TERMS), tx.const_list(GENERIC_TERMS)
    terms = F.filter(words, lambda w: ~F.array_contains(common, w))
    return terms, F.filter(terms, lambda w: ~F.array_contains(generic, w))


def matches_question(text: Column, score: Column, terms: Column, specific: Column) -> Column:
    """Enough of the question's words occur in the passage."""
    def found(words: Column) -> Column:
        return F.size(F.filter(words, lambda w: F.contains(text, w)))

    n, m = F.size(specific), F.size(terms)
    need_specific = F.greatest(F.lit(1), F.least(F.lit(2), F.floor((n + 1) / 2)))
    need_any = F.greatest(F.lit(2), F.floor((m + 2) / 3))
    return (
        F.when(text == "", False)
        .when(m == 0, score >= 0.70)
        .when(n > 0, found(specific) >= need_specific)
        .otherwise(found(terms) >= need_any)
    )


def suppress_unrelated_private(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Drop private hits that do not belong to the question.

    ``questions(query_id, question, needs_authority, document_id, document_task)``.
    The per-query facts are one small aggregate joined back, so no group of hits
    is ever collected.
    """
    terms, specific = question_terms("question")
    q = questions.select(
        "query_id", terms.alias("_terms"), specific.alias("_specific"),
        targets_uploads("question").alias("_about_uploads"),
        F.coalesce("needs_authority", F.lit(False)).alias("_authority"),
        (F.col("document_id").isNotNull() | F.coalesce("document_task", F.lit(False))).alias("_pinned"),
    )
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("text", "filename", "title", "display_name")]
    score = F.coalesce(F.nullif("relevance_score", F.lit(0.0)), F.col("score"), F.lit(0.0))
    private = F.coalesce(F.col("source_type"), F.lit("")).isin("conversation", "matter")
    marked = hits.withColumn("_x", F.lower(F.concat_ws(" ", *parts))).join(q, "query_id").select(
        *hits.columns, "_about_uploads", "_authority", "_pinned",
        private.alias("_private"),
        (private & matches_question(F.col("_x"), score, F.col("_terms"), F.col("_specific"))).alias("_match"),
    )
    facts = marked.groupBy("query_id").agg(
        F.bool_or(F.coalesce(F.col("source_type"), F.lit("legal")) == "legal").alias("_legal"),
        F.bool_or("_match").alias("_any_match"),
    )
    none_kept = ~F.col("_about_uploads") & ((F.col("_legal") & F.col("_authority")) | ~F.col("_any_match"))
    keep = (
        ~F.col("_private") | F.col("_pinned")
        | F.when(none_kept, False).otherwise(F.col("_match") | ~F.col("_any_match"))
    )
    return marked.join(facts, "query_id").filter(keep).select(*hits.columns)
