"""Families C, D and E: search, rerank, dedupe, select."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import identity as ident
from evidex.functions import text as tx
from evidex.operators import rank as r
from evidex.operators import retrieve as op
from evidex.operators import vectors as v
from evidex.plans.common import CHUNKS_CTE, DOCS_CTE, MESSAGES_CTE, QUOTED_SPACE, collapse, lit, strip, with_ctes
from evidex.plans.hits import HITS_CTE, MERGED_CTE, QUESTIONS_CTE, case, hits, merged_hits, questions
from evidex.plans.ingest import chunks
from evidex.sources import tables as t

# --- vectors ------------------------------------------------------------------
# Stored vectors carry tenant columns; some belong to the corpus, some to uploads.
VECTORS = {
    "chunk_id": "vec_id",
    "embedding": "embedding",
    "label": "label",
    "collection": "CASE WHEN vec_id % 2 = 0 THEN 'legal' ELSE 'private' END",
    "scope": "CASE WHEN vec_id % 2 = 0 THEN NULL WHEN vec_id % 3 = 0 THEN 'user' WHEN vec_id % 3 = 1 THEN 'matter' ELSE 'conversation' END",
    "user_id": "CASE WHEN vec_id % 2 = 1 THEN concat('u', vec_id % 5) END",
    "matter_id": "CASE WHEN vec_id % 2 = 1 THEN concat('m', vec_id % 7) END",
    "conversation_id": "CASE WHEN vec_id % 6 = 5 THEN concat('c', vec_id % 11) END",
    "document_id": "concat('d', CAST(floor(vec_id / 8) AS BIGINT))",
    "year": "CAST(2000 + vec_id % 4 AS BIGINT)",
    "court": "CASE WHEN vec_id % 3 = 0 THEN 'Supreme Court' WHEN vec_id % 3 = 1 THEN 'High Court' END",
}
# One question per label: the mean vector of the label, asked by some user.
SEARCHES = {
    "query_id": "label",
    "embedding": "embedding",
    "user_id": "concat('u', label % 5)",
    "matter_id": "CASE WHEN label % 4 > 0 THEN concat('m', label % 7) END",
    "conversation_id": "CASE WHEN label % 3 > 0 THEN concat('c', label % 11) END",
    "document_id": "CASE WHEN label % 5 = 4 THEN concat('d', label) END",
    "task": case("label % 6", ["legal_qa", None, "document_qa", "summarization", "document_qa", "mixed_qa"]),
    "prefer_corpus": "label % 4 = 1",
    "year": "CASE WHEN label % 4 = 3 THEN CAST(2001 AS BIGINT) END",
    "court": "CASE WHEN label % 4 = 1 THEN 'High Court' END",
    "limit": "CASE WHEN label % 7 = 5 THEN 12 END",
}


def vectors(spark, d):
    return t.project(t.load(spark, d, "embeddings"), VECTORS)


def searches(spark, d):
    """The mean vector of every label, averaged per coordinate."""
    long = t.load(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = long.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vector = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return t.project(mean.groupBy("label").agg(vector.alias("embedding")), SEARCHES)


def topk(spark, d):
    found = v.vector_topk(searches(spark, d), vectors(spark, d), 10)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def topk_filtered(spark, d):
    keep = (F.col("collection") == "legal") & (F.col("year") == 2002)
    found = v.vector_topk(searches(spark, d), vectors(spark, d), 10, keep)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def tiers(spark, d):
    limits = op.tier_limits(searches(spark, d))
    found = v.tiered_search(limits, vectors(spark, d))
    return found.select("query_id", "tier", "chunk_id", F.round("score", 6).alias("score"), "rank")


def memories(spark, d):
    rows = vectors(spark, d).filter("collection = 'private'")
    return v.memory_topk(searches(spark, d), rows, 5).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), "rank"
    )


def limits(spark, d):
    q = questions(spark, d).withColumn("limit", F.expr("CASE WHEN query_id % 7 = 5 THEN 12 END"))
    return op.tier_limits(q).select(
        "query_id", "legal_limit", "conversation_limit", "matter_limit", "document_limit", "total_limit"
    )


def rescue(spark, d):
    return op.keyword_rescue(questions(spark, d).select("query_id", "section"), hits(spark, d).filter("chunk_id IS NOT NULL"), 6)


def _two_lists(spark, d):
    first = hits(spark, d).filter("chunk_id IS NOT NULL").select("query_id", "chunk_id", "score", F.lit("vector").alias("found_by"))
    second = first.filter(F.col("score") < 0.8).select(
        "query_id", "chunk_id", F.round(1.0 - F.col("score"), 4).alias("score"), F.lit("keyword").alias("found_by")
    )
    return first, second


def merged_lists(spark, d):
    return op.merge_hits(*_two_lists(spark, d))


def memory_rows(spark, d):
    ex = op.exchanges_from_messages(t.messages(spark, d))
    return op.build_memories(ex).select("exchange_id", "user_id", "scope", F.md5("text").alias("text_md5"))


def _scopes(spark, d):
    return t.load(spark, d, "conversations").selectExpr(
        "conv_id AS scope_id", "concat('u', conv_id % 37) AS user_id",
        "CASE WHEN conv_id % 2 = 0 THEN concat('m', conv_id % 11) END AS matter_id",
        "CASE WHEN conv_id % 3 > 0 THEN concat('c', conv_id % 23) END AS conversation_id",
    ).distinct()


def scope_listing(spark, d):
    docs = t.docs(spark, d).withColumn("created_at", F.expr("(doc_id * 37) % 101"))
    return op.list_for_scope(docs, _scopes(spark, d))


def enriched(spark, d):
    cols = ["id", "chunk_id", "document_id", "filename", "display_name", "ordinal"]
    h = hits(spark, d).select(*cols).withColumns({"author": F.lit(None).cast("string"), "matter_id": F.lit(None).cast("string")})
    h = h.withColumn("filename", F.expr("CASE WHEN ordinal % 2 = 0 THEN filename END"))
    return op.enrich_chunks(h, t.docs(spark, d)).select("ordinal", "document_id", "filename", "display_name", "author", "matter_id")


def expanded(spark, d):
    child = hits(spark, d).select(
        "ordinal", F.expr("CASE WHEN ordinal % 3 = 0 THEN 'SOCIAL' WHEN ordinal % 3 = 1 THEN text ELSE concat(' ', heading) END").alias("text"),
        F.expr("CASE WHEN ordinal % 7 = 0 THEN 'orphan_heading' END").alias("validation_status"),
        F.expr("CASE WHEN chunk_index > 0 THEN concat(document_id, ':0') END").alias("parent_chunk_id"),
    )
    index = chunks(spark, d).select("chunk_id", "text", F.lit(None).cast("string").alias("chunk_text"))
    return op.expand_parents(child, index).select(
        "ordinal", F.md5("text").alias("text_md5"), F.md5("expanded_text").alias("expanded_md5")
    )


def metadata(spark, d):
    return op.retrieval_metadata(hits(spark, d))


def web_chunks(spark, d):
    web = t.load(spark, d, "pages").selectExpr(
        "CAST(floor(page_id / 5) AS BIGINT) AS query_id", "page_id % 5 AS position", "url",
        "CASE WHEN page_id % 4 = 0 THEN '  ' ELSE concat(' Page ', page_id) END AS title",
        "CASE WHEN page_id % 3 = 0 THEN '' ELSE html END AS snippet",
        "round(0.85 - CAST(page_id % 5 AS DOUBLE) * 0.09, 4) AS score", "page_id % 6 = 0 AS official",
    )
    return op.web_hits_to_chunks(web).select(
        "query_id", "chunk_id", F.md5("text").alias("text_md5"), "title", "document_type", F.md5("summary").alias("summary_md5"), "score"
    )


def private_suppression(spark, d):
    return op.suppress_unrelated_private(hits(spark, d), questions(spark, d)).select("query_id", "ordinal")


# --- D, E -------------------------------------------------------------------------
def section_ids(spark, d):
    raw = t.load(spark, d, "documents").select("doc_id", F.expr(RAW_SECTION).alias("raw"))
    return raw.select(
        "doc_id", tx.normalize_hyphens("raw").alias("hyphens"), tx.normalize_section_id("raw").alias("section_id"),
        F.array_join(tx.section_variants("raw"), "|").alias("variants"),
        F.array_join(tx.section_needles("raw"), "|").alias("needles"),
    )


RAW_SECTION = (
    "CASE WHEN doc_id % 8 = 0 THEN concat('Section ', doc_id % 500, '–c') WHEN doc_id % 8 = 1 THEN concat(doc_id % 500, 'C') "
    "WHEN doc_id % 8 = 2 THEN concat('article ', doc_id % 60, ' - a') WHEN doc_id % 8 = 3 THEN concat('sec. ', doc_id % 90) "
    "WHEN doc_id % 8 = 4 THEN concat('u/s ', doc_id % 900, '.') WHEN doc_id % 8 = 5 THEN concat('  ', doc_id % 300, '−b') "
    "WHEN doc_id % 8 = 6 THEN concat('rule ', doc_id % 9) ELSE '' END"
)


def tokens(spark, d):
    return t.docs(spark, d).select("document_id", F.array_join(F.sort_array(tx.rerank_tokens(F.expr(CITED_TEXT))), " ").alias("tokens"))


CITED_TEXT = "concat(text, ' 54C and 12-B, section 302 ', doc_id % 3000)"


def reranked(spark, d):
    q = questions(spark, d).withColumnRenamed("question", "query")
    return r.rerank(hits(spark, d), q).select("query_id", "ordinal", "relevance_score")


def references(spark, d):
    h = hits(spark, d).withColumn("source_reference", F.expr("CASE WHEN ordinal % 50 = 0 THEN 'given' END"))
    return h.select("ordinal", r.source_reference().alias("source_reference"))


def hit_defaults(spark, d):
    h = hits(spark, d).withColumns({
        "source": F.expr(case("ordinal % 7", ["legal_corpus", "conversation_document", "matter_document", "web", None, "other"])),
        "scope": F.expr(case("ordinal % 5", ["conversation", "matter"])),
        "source_reference": F.lit(None).cast("string"),
    })
    return r.enrich_hits(h).select("ordinal", "source_type", "chunk_id")


DOC_SPELLING = (
    "CASE WHEN doc_id % 6 = 0 THEN upper(h) WHEN doc_id % 6 = 1 THEN concat('{', substring(h, 1, 8), '-', substring(h, 9), '}') "
    "WHEN doc_id % 6 = 2 THEN concat('urn:uuid:', h) WHEN doc_id % 6 = 3 THEN concat(' Doc ', doc_id) WHEN doc_id % 6 = 4 THEN '  ' END"
)
CHUNK_SPELLING = (
    "CASE WHEN doc_id % 4 = 0 THEN concat(upper(h), ':', doc_id) WHEN doc_id % 4 = 1 THEN concat('Chunk-', doc_id) "
    "WHEN doc_id % 4 = 2 THEN NULL ELSE concat(h, 'x:1') END"
)
SPELLINGS = {
    "doc_id": "doc_id",
    "document_id": DOC_SPELLING,
    "chunk_id": CHUNK_SPELLING,
    "chunk_index": "CASE WHEN doc_id % 3 > 0 THEN doc_id % 9 END",
    "source_id": "CASE WHEN doc_id % 5 > 0 THEN concat('s', doc_id) END",
}


def identities(spark, d):
    base = t.load(spark, d, "documents").withColumn("h", F.md5(F.col("doc_id").cast("string")))
    rows = t.project(base, SPELLINGS)
    return rows.select(
        "doc_id", ident.canonical_doc_id("document_id", "chunk_id").alias("canonical_id"),
        ident.chunk_key("document_id", "chunk_id", "chunk_index", "source_id").alias("chunk_key"),
        ident.resource_key("document_id", "chunk_id", "source_id").alias("resource_key"),
    )


def exact_dedupe(spark, d):
    return r.dedupe_hits(merged_hits(spark, d)).select("query_id", "ordinal", "score")


def passage_similarity(spark, d):
    """Normal form of every chunk and its similarity to the next one of its document."""
    from pyspark.sql.window import Window

    n = tx.passage_norm("text")
    c = chunks(spark, d).select("document_id", "chunk_index", n.alias("n"))
    c = c.withColumn("next", F.lead("n").over(Window.partitionBy("document_id").orderBy("chunk_index")))
    return c.filter("next IS NOT NULL").select(
        "document_id", "chunk_index", F.md5("n").alias("norm_md5"),
        F.round(tx.jaccard(tx.passage_tokens(F.col("n")), tx.passage_tokens(F.col("next"))), 10).alias("jaccard"),
    )


def adjacent_duplicates(spark, d):
    wide = chunks(spark, d).withColumn("end_offset", F.expr("end_offset + CASE WHEN doc_id % 3 = 0 THEN 600 ELSE 0 END"))
    return r.duplicate_pairs(wide).withColumn("jaccard", F.round("jaccard", 10))


def near_duplicates(spark, d):
    return r.suppress_near_duplicates(r.dedupe_hits(merged_hits(spark, d))).select("query_id", "ordinal", "score")


def selection(spark, d):
    lims = op.tier_limits(questions(spark, d))
    return r.select_evidence(merged_hits(spark, d), lims).select("query_id", "ordinal", "source_type", "position")


def duplicate_removal(spark, d):
    return r.remove_duplicate_evidence(r.dedupe_hits(merged_hits(spark, d))).select("query_id", "ordinal", "removed_count")


def flagship(spark, d):
    """Chunk, search, rerank, dedupe and number: the sources of every question."""
    from evidex.operators.resources import number_sources

    search = searches(spark, d)
    vectors = t.load(spark, d, "embeddings")
    given = vectors.agg(F.max("vec_id")).first()[0] + 1
    every = chunks(spark, d).withColumn("vec_id", (F.col("doc_id") + 31 * F.col("chunk_index")) % given)
    index = every.join(vectors, "vec_id").withColumn("year", F.expr("2000 + doc_id % 4"))
    found = v.vector_topk(search, index, 20, F.col("year") >= 2001)
    payload = t.project(every, HIT_OF_CHUNK)
    hits_ = found.drop("rank").join(payload, "chunk_id").withColumn("sections", F.array().cast("array<string>"))
    hits_ = hits_.withColumn("keywords", F.array("lang"))
    asked = search.join(questions(spark, d).select("query_id", "question", "section"), "query_id").selectExpr(
        "query_id", "question AS query", "section", "court", "CAST(NULL AS STRING) AS year", "false AS document_task"
    )
    ranked = r.rerank(hits_, asked)
    return number_sources(r.dedupe_hits(ranked)).select(
        "query_id", "number", "chunk_id", "document_id", "relevance_score", "excerpt"
    )


HIT_OF_CHUNK = {
    "chunk_id": "chunk_id", "id": "point_id", "document_id": "document_id", "chunk_index": "chunk_index", "text": "text",
    "lang": "lang", "filename": "concat(source, '-', doc_id, '.txt')", "display_name": "CAST(NULL AS STRING)",
    "source_type": "'legal'", "court": "CAST(NULL AS STRING)", "year": "CAST(NULL AS BIGINT)", "law_name": "CAST(NULL AS STRING)",
    "title": "CAST(NULL AS STRING)", "heading": "CAST(NULL AS STRING)", "summary": "CAST(NULL AS STRING)",
    "relevance_score": "CAST(NULL AS DOUBLE)", "start_offset": "start_offset", "end_offset": "end_offset",
    "ordinal": "doc_id * 100000 + chunk_index",
}

QUERIES = {
    "vector_topk": topk,
    "vector_topk_filtered": topk_filtered,
    "tiered_search": tiers,
    "memory_search": memories,
    "tier_limits": limits,
    "keyword_rescue": rescue,
    "merge_hit_lists": merged_lists,
    "memory_rows": memory_rows,
    "scope_listing": scope_listing,
    "enrich_chunks": enriched,
    "expand_parents": expanded,
    "retrieval_metadata": metadata,
    "web_hits_to_chunks": web_chunks,
    "suppress_unrelated_private": private_suppression,
    "section_ids": section_ids,
    "rerank_tokens": tokens,
    "rerank": reranked,
    "source_references": references,
    "hit_defaults": hit_defaults,
    "document_identity": identities,
    "dedupe_exact": exact_dedupe,
    "passage_similarity": passage_similarity,
    "adjacent_duplicates": adjacent_duplicates,
    "suppress_near_duplicates": near_duplicates,
    "select_evidence": selection,
    "remove_duplicate_evidence": duplicate_removal,
    "ask_with_sources": flagship,
}

SEARCHES_SQL = {('"limit"' if k == 'limit' else k): e for k, e in SEARCHES.items()}

# --- oracle ---------------------------------------------------------------------
VECTORS_CTE = f"""vectors AS ({t.select_sql(VECTORS, 'embeddings')}),
means AS (SELECT label, list(x ORDER BY i) AS embedding FROM (
   SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
searches AS ({t.select_sql(SEARCHES_SQL, 'means')}),
scored AS (SELECT s.*, v.* EXCLUDE (embedding) RENAME (user_id AS v_user, matter_id AS v_matter, conversation_id AS v_conv,
     document_id AS v_doc, year AS v_year, court AS v_court),
   round(list_cosine_similarity(s.embedding, CAST(v.embedding AS DOUBLE[])), 9) AS sc FROM searches s, vectors v)"""


def _top(where: str, limit: str, tier: str) -> str:
    return f"""SELECT * FROM (SELECT query_id, '{tier}' AS tier, chunk_id, round(sc, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, chunk_id) AS rank, {limit} AS lim FROM planned WHERE {where}) WHERE rank <= lim"""


_LIMITS = """CASE WHEN corpus_only THEN greatest(6, least(total, 8)) WHEN doc_task THEN 0 ELSE 6 END AS legal_limit,
  CASE WHEN corpus_only OR scoped THEN 0 ELSE 2 END AS conversation_limit,
  CASE WHEN corpus_only OR scoped THEN 0 WHEN doc_task THEN 6 ELSE 2 END AS matter_limit,
  CASE WHEN scoped THEN total ELSE 0 END AS document_limit"""
_FLAGS = """coalesce(task IN ('summarization', 'document_qa'), false) AS doc_task,
  coalesce(task IN ('summarization', 'document_qa'), false) AND document_id IS NOT NULL AS scoped,
  prefer_corpus AND document_id IS NULL AND coalesce(task, '') NOT IN ('summarization', 'document_qa', 'mixed_qa') AS corpus_only"""
_PRIVATE = "collection = 'private' AND v_user = user_id AND "
_OPEN = "(scope = 'user' OR (scope = 'matter' AND v_matter = matter_id) OR (scope = 'conversation' AND v_conv = conversation_id))"

ORACLE = {
    "vector_topk": with_ctes(VECTORS_CTE) + """
SELECT query_id, chunk_id, round(sc, 6) AS score, rank FROM (SELECT query_id, chunk_id, sc,
  row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, chunk_id) AS rank FROM scored) WHERE rank <= 10""",
    "vector_topk_filtered": with_ctes(VECTORS_CTE) + """
SELECT query_id, chunk_id, round(sc, 6) AS score, rank FROM (SELECT query_id, chunk_id, sc,
  row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, chunk_id) AS rank FROM scored
  WHERE collection = 'legal' AND v_year = 2002) WHERE rank <= 10""",
    "tiered_search": with_ctes(VECTORS_CTE) + f"""
, flagged AS (SELECT *, {_FLAGS}, coalesce("limit", 10) AS total FROM scored),
planned AS (SELECT *, {_LIMITS} FROM flagged)
SELECT * EXCLUDE (lim) FROM (
{_top("collection = 'legal' AND (year IS NULL OR v_year = year) AND (court IS NULL OR v_court = court)", 'legal_limit', 'legal')}
UNION ALL {_top(_PRIVATE + "scope = 'conversation' AND v_conv = conversation_id", 'conversation_limit', 'conversation')}
UNION ALL {_top(_PRIVATE + "scope = 'matter' AND v_matter = matter_id", 'matter_limit', 'matter')}
UNION ALL {_top(_PRIVATE + "scope = 'conversation' AND v_matter = matter_id", 'CASE WHEN matter_limit > 0 THEN greatest(matter_limit, conversation_limit) ELSE 0 END', 'linked')}
UNION ALL {_top(_PRIVATE + "v_doc = document_id AND " + _OPEN, 'document_limit', 'document')})""",
    "memory_search": with_ctes(VECTORS_CTE) + f"""
SELECT query_id, chunk_id, round(sc, 6) AS score, rank FROM (SELECT query_id, chunk_id, sc,
  row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, chunk_id) AS rank FROM scored WHERE {_PRIVATE} {_OPEN}) WHERE rank <= 5""",
    "tier_limits": with_ctes(QUESTIONS_CTE) + f"""
SELECT query_id, CAST(legal_limit AS BIGINT) AS legal_limit, CAST(conversation_limit AS BIGINT) AS conversation_limit,
 CAST(matter_limit AS BIGINT) AS matter_limit, CAST(document_limit AS BIGINT) AS document_limit, CAST(total AS BIGINT) AS total_limit
FROM (SELECT query_id, total, {_LIMITS} FROM (SELECT *, {_FLAGS}, CASE WHEN query_id % 7 = 5 THEN 12 ELSE 10 END AS total FROM questions))""",
    "keyword_rescue": with_ctes(HITS_CTE, QUESTIONS_CTE) + """
, ids AS (SELECT query_id, CASE section WHEN '10a' THEN '10-a' ELSE lower(section) END AS nid FROM questions WHERE section IS NOT NULL),
v0 AS (SELECT query_id, replace(nid, '-', '') AS c, nid AS n, upper(nid) AS u FROM ids),
vs AS (SELECT query_id, ['section ' || u, 'Section ' || u, 'section ' || n, 'Section ' || n, 'section ' || c, 'Section ' || c,
   u, n, c, upper(c), 'Article ' || u, 'article ' || n] AS l FROM v0),
ve AS (SELECT query_id, unnest(l) AS kw, generate_subscripts(l, 1) AS pos FROM vs),
vd AS (SELECT query_id, kw, min(pos) AS pos FROM ve GROUP BY 1, 2),
tagged AS (SELECT chunk_id, score, unnest(list_distinct(keywords)) AS kw FROM hits WHERE chunk_id IS NOT NULL),
j AS (SELECT query_id, chunk_id, score, pos, row_number() OVER (PARTITION BY query_id, pos ORDER BY chunk_id) AS n FROM tagged JOIN vd USING (kw)),
f AS (SELECT query_id, chunk_id, min(pos) AS pos, max(score) AS score FROM j WHERE n <= 6 GROUP BY 1, 2)
SELECT query_id, chunk_id, rank, greatest(score, 0.72) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, chunk_id) AS rank FROM f) WHERE rank <= 6""",
    "merge_hit_lists": with_ctes(HITS_CTE) + """
SELECT query_id, chunk_id, greatest(score, CASE WHEN score < 0.8 THEN round(1 - score, 4) ELSE 0 END) AS score,
  CASE WHEN score < 0.8 AND round(1 - score, 4) > score THEN 'keyword' ELSE 'vector' END AS found_by
FROM hits WHERE chunk_id IS NOT NULL""",
    "memory_rows": with_ctes(MESSAGES_CTE) + f"""
SELECT a.conv_id || ':' || a.turn AS exchange_id, a.user_id, 'conversation' AS scope,
  md5({strip("'Question:' || chr(10) || chr(10) || q.text || chr(10) || chr(10) || 'Answer:' || chr(10) || chr(10) || a.text")}) AS text_md5
FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM messages) a
JOIN messages q ON q.conv_id = a.conv_id AND q.turn = a.before
WHERE a.role = 'assistant' AND q.role = 'user' AND q.text <> '' AND a.text <> ''""",
    "scope_listing": with_ctes(DOCS_CTE) + """
, scopes AS (SELECT DISTINCT conv_id AS scope_id, 'u' || (conv_id % 37) AS user_id,
   CASE WHEN conv_id % 2 = 0 THEN 'm' || (conv_id % 11) END AS matter_id, CASE WHEN conv_id % 3 > 0 THEN 'c' || (conv_id % 23) END AS conversation_id
   FROM conversations),
listed AS (SELECT scope_id, document_id, (doc_id * 37) % 101 AS created_at, CASE WHEN d.scope = 'matter' THEN 0 ELSE 1 END AS branch
  FROM docs d JOIN scopes s ON d.user_id = s.user_id AND ((d.scope = 'matter' AND d.matter_id = s.matter_id)
    OR (d.scope = 'conversation' AND d.conversation_id = s.conversation_id)))
SELECT scope_id, document_id, row_number() OVER (PARTITION BY scope_id ORDER BY branch, created_at DESC, document_id) AS position FROM listed""",
    "retrieval_metadata": with_ctes(HITS_CTE) + """
SELECT query_id, count(*) AS total_selected, count(*) FILTER (source_type = 'legal') AS legal_chunks,
 count(*) FILTER (source_type = 'conversation') AS conversation_chunks, count(*) FILTER (source_type = 'matter') AS matter_chunks,
 count(*) FILTER (source_type = 'web') AS web_chunks FROM hits GROUP BY query_id""",
    "expand_parents": with_ctes(HITS_CTE) + f"""
, child AS (SELECT ordinal, CASE WHEN ordinal % 3 = 0 THEN 'SOCIAL' WHEN ordinal % 3 = 1 THEN text ELSE ' ' || heading END AS text,
   ordinal % 7 = 0 AS orphan, CASE WHEN chunk_index > 0 THEN document_id || ':0' END AS pid FROM hits),
j AS (SELECT c.*, coalesce({strip('c.text')}, '') AS ct, p.text AS parent FROM child c
  LEFT JOIN (SELECT document_id || ':' || chunk_index AS chunk_id, text FROM chunks) p ON c.pid = p.chunk_id),
g AS (SELECT *, parent IS NOT NULL AND (length(ct) < 120 OR orphan) AND NOT contains(ct, parent) AS grow,
   {strip("parent || chr(10) || chr(10) || ct")} AS merged FROM j)
SELECT ordinal, md5(CASE WHEN grow THEN merged ELSE text END) AS text_md5,
  md5(CASE WHEN grow THEN merged WHEN parent IS NOT NULL THEN ct END) AS expanded_md5 FROM g""",
    "web_hits_to_chunks": f"""
SELECT CAST(floor(page_id / 5) AS BIGINT) AS query_id, 'web:' || (page_id % 5) || ':' || url AS chunk_id,
  md5(CASE WHEN page_id % 3 = 0 OR {strip('html')} = '' THEN CASE WHEN page_id % 4 = 0 THEN '  ' ELSE ' Page ' || page_id END ELSE {strip('html')} END) AS text_md5,
  CASE WHEN page_id % 4 = 0 THEN regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) ELSE 'Page ' || page_id END AS title,
  CASE WHEN page_id % 6 = 0 THEN 'official_web' ELSE 'web' END AS document_type,
  CASE WHEN page_id % 3 > 0 AND html <> '' THEN md5(substring(html, 1, 400)) END AS summary_md5,
  greatest(0.55, round(0.85 - CAST(page_id % 5 AS DOUBLE) * 0.09, 4)) AS score FROM pages""",
    "dedupe_exact": with_ctes(MERGED_CTE) + """
, k AS (SELECT *, CASE WHEN chunk_id IS NOT NULL THEN 'c' || coalesce(document_id, '') || chunk_id
   WHEN document_id IS NOT NULL THEN 'd' || document_id || ':' || chunk_index ELSE 'i' || id END AS key FROM merged)
SELECT query_id, ordinal, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, ordinal) AS n FROM k) WHERE n = 1""",
    "hit_defaults": with_ctes(HITS_CTE) + f"""
SELECT ordinal, coalesce(chunk_id, id) AS chunk_id, coalesce(source_type, CASE
  WHEN s IN ('legal_corpus') THEN 'legal' WHEN sc = 'conversation' OR s = 'conversation_document' THEN 'conversation'
  WHEN sc = 'matter' OR s = 'matter_document' THEN 'matter' WHEN s = 'web' THEN 'web' ELSE 'legal' END) AS source_type
FROM (SELECT *, {case("ordinal % 7", ["legal_corpus", "conversation_document", "matter_document", "web", None, "other"])} AS s,
  {case("ordinal % 5", ["conversation", "matter"])} AS sc FROM hits)""",
    "source_references": with_ctes(HITS_CTE) + """
SELECT ordinal, CASE WHEN ordinal % 50 = 0 THEN 'given' ELSE nullif(concat_ws(', ', coalesce(display_name, filename),
  CASE WHEN len(sections) > 0 THEN 'Section ' || array_to_string(sections, ', ') WHEN section IS NOT NULL THEN 'Section ' || section END,
  court, CAST(year AS VARCHAR), CASE WHEN page_number <> 0 THEN 'page ' || page_number END, url), '') END AS source_reference FROM hits""",
    "document_identity": f"""
WITH s AS ({t.select_sql(SPELLINGS, "(SELECT *, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents)")}),
c AS (SELECT s.*, md5(CAST(doc_id AS VARCHAR)) AS h FROM s),
i AS (SELECT *, CASE WHEN doc_id % 6 IN (0, 1, 2) THEN CAST(CAST(h AS UUID) AS VARCHAR) WHEN doc_id % 6 = 3 THEN 'doc ' || doc_id
   WHEN doc_id % 4 = 0 THEN CAST(CAST(h AS UUID) AS VARCHAR) END AS canonical_id FROM c)
SELECT doc_id, canonical_id, CASE WHEN canonical_id IS NOT NULL AND chunk_id IS NOT NULL THEN 'doc:' || canonical_id || ':chunk:' || lower(chunk_id)
   WHEN canonical_id IS NOT NULL AND chunk_index IS NOT NULL THEN 'doc:' || canonical_id || ':index:' || chunk_index
   WHEN chunk_id IS NOT NULL THEN 'chunk:' || lower(chunk_id) WHEN source_id IS NOT NULL THEN 'source:' || source_id ELSE 'unknown' END AS chunk_key,
 CASE WHEN canonical_id IS NOT NULL THEN 'doc:' || canonical_id WHEN chunk_id IS NOT NULL THEN 'legal-chunk:' || lower(chunk_id)
   WHEN source_id IS NOT NULL THEN 'source:' || source_id ELSE 'unknown' END AS resource_key FROM i""",
}

_NORM = collapse("replace(replace(replace(lower({}), '‑', '-'), '–', '-'), '—', '-')")


def norm(x: str) -> str:
    return _NORM.replace("{}", x)


ADJACENT_CTE = f"""{CHUNKS_CTE},
normed AS (SELECT document_id, doc_id, chunk_index, start_offset, start_offset + length(text)
   + CASE WHEN doc_id % 3 = 0 THEN 600 ELSE 0 END AS end_offset, {norm('text')} AS n FROM chunks),
tok AS (SELECT *, list_distinct(string_split(n, ' ')) AS tk FROM normed),
pair AS (SELECT a.document_id, a.chunk_index, b.chunk_index AS bi, a.n, b.n AS bn, a.start_offset AS s1, a.end_offset AS e1,
   b.start_offset AS s2, b.end_offset AS e2,
   CAST(len(list_intersect(a.tk, b.tk)) AS DOUBLE) / len(list_distinct(list_concat(a.tk, b.tk))) AS jac
   FROM tok a JOIN tok b ON a.document_id = b.document_id AND b.chunk_index > a.chunk_index)"""
ORACLE["passage_similarity"] = with_ctes(ADJACENT_CTE) + """
SELECT document_id, chunk_index, md5(n) AS norm_md5, round(jac, 10) AS jaccard FROM pair WHERE bi = chunk_index + 1"""
ORACLE["adjacent_duplicates"] = with_ctes(ADJACENT_CTE) + """
, o AS (SELECT *, CASE WHEN length(n) <= length(bn) THEN n ELSE bn END AS sh, CASE WHEN length(n) <= length(bn) THEN bn ELSE n END AS lo,
   least(e1, e2) - greatest(s1, s2) AS shared, least(e1 - s1, e2 - s2) AS span FROM pair)
SELECT document_id, chunk_index AS left_index, bi AS right_index, round(jac, 10) AS jaccard FROM o
WHERE (shared > 0 AND span > 0 AND CAST(shared AS DOUBLE) / span >= 0.55) OR n = bn
 OR (length(sh) < 60 AND contains(lo, sh))
 OR (length(sh) >= 60 AND jac >= CASE WHEN contains(lo, substring(sh, 1, 180)) THEN 0.82 ELSE 0.9 END)"""


def toks(x: str) -> str:
    """Rerank tokens of already normalised lower-case text."""
    nums = f"regexp_extract_all({x}, '\\b\\d{{1,4}}[a-z]?\\b')"
    return (
        f"list_distinct(list_concat(list_concat(regexp_extract_all({x}, '[a-z0-9]{{3,}}'), {nums}), "
        f"list_transform({nums}, lambda n: regexp_replace(n, '^(\\d+)([a-z])$', '\\1-\\2'))))"
    )


def hyphens(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[{tx.SPACE}{tx.DASHES}]+', '-', 'g')"


ORACLE["rerank_tokens"] = with_ctes(DOCS_CTE) + f"""
SELECT document_id, array_to_string(list_sort({toks('x')}), ' ') AS tokens FROM (
  SELECT document_id, lower({hyphens(CITED_TEXT)}) AS x FROM docs)"""
ORACLE["section_ids"] = f"""
WITH a AS (SELECT doc_id, {RAW_SECTION} AS raw FROM documents),
b AS (SELECT doc_id, {hyphens('raw')} AS h, CASE WHEN doc_id % 8 = 0 THEN (doc_id % 500) || '-c' WHEN doc_id % 8 = 1 THEN (doc_id % 500) || '-c'
  WHEN doc_id % 8 = 2 THEN (doc_id % 60) || '-a' WHEN doc_id % 8 = 3 THEN '' || (doc_id % 90) WHEN doc_id % 8 = 4 THEN '' || (doc_id % 900)
  WHEN doc_id % 8 = 5 THEN (doc_id % 300) || '-b' WHEN doc_id % 8 = 6 THEN 'rule-' || (doc_id % 9) ELSE '' END AS n FROM a),
c AS (SELECT *, replace(n, '-', '') AS c, CASE WHEN starts_with(n, 'rule') THEN n ELSE upper(n) END AS t FROM b),
e AS (SELECT *, ['section ' || t, 'Section ' || t, 'section ' || n, 'Section ' || n, 'section ' || c, 'Section ' || c,
   t, n, c, upper(c), 'Article ' || t, 'article ' || n] AS v,
   [n, c, 'section ' || n, 'section ' || c, replace(n, '-', chr(8209)), replace(n, '-', chr(8211)), 'section ' || replace(n, '-', chr(8209))] AS w FROM c)
SELECT doc_id, h AS hyphens, n AS section_id,
 CASE WHEN n = '' THEN '' ELSE array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '|') END AS variants,
 CASE WHEN n = '' THEN '' ELSE array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), '|') END AS needles FROM e"""
_BLOB = "concat_ws(' ', coalesce(text, ''), coalesce(array_to_string(keywords, ' '), ''), coalesce(array_to_string(sections, ' '), ''), coalesce(law_name, ''), coalesce(title, ''), coalesce(heading, ''), coalesce(summary, ''))"
_TOPIC = "[" + ", ".join(map(lit, r.TOPIC_STOPWORDS)) + "]"
RERANK_CTE = f"""{HITS_CTE},
{QUESTIONS_CTE},
qt AS (SELECT query_id, question, {toks(f"lower({hyphens('question')})")} AS qt, CASE WHEN section = '10a' THEN '10a' ELSE lower(section) END AS qs,
   lower(court) AS qc, year AS qy, document_task AS dt FROM questions),
blobs AS (SELECT h.query_id, h.ordinal, score, source_type, court, year, sections, lower({hyphens(_BLOB)}) AS b FROM hits h),
rr AS (SELECT blobs.*, qt, dt, len(list_intersect(qt, {toks('b')})) AS ov,
   coalesce(contains(b, qs) OR contains(replace(b, '-', ''), replace(qs, '-', '')), false) AS sec,
   coalesce(contains(lower(court), qc), false) AS crt, coalesce(CAST(year AS VARCHAR) = qy, false) AS yr FROM blobs JOIN qt USING (query_id)),
ranked AS (SELECT query_id, ordinal, round(score + least(ov * 0.03, 0.18) + CASE WHEN sec THEN 0.15 ELSE 0 END + CASE WHEN crt THEN 0.12 ELSE 0 END
   + CASE WHEN yr THEN 0.08 ELSE 0 END + CASE WHEN len(list_filter(qt, lambda t: length(t) >= 5 AND contains(b, t))) > 0 THEN 0.05 ELSE 0 END
   + CASE WHEN len(list_filter(qt, lambda t: length(t) >= 4 AND NOT list_contains({_TOPIC}, t) AND contains(b, t))) > 0 THEN 0.14 ELSE 0 END
   + CASE coalesce(source_type, 'legal') WHEN 'legal' THEN CASE WHEN dt THEN 0 ELSE 0.2 END WHEN 'conversation' THEN CASE WHEN dt THEN 0.15 ELSE 0.08 END
       WHEN 'matter' THEN CASE WHEN dt THEN 0.18 ELSE 0.12 END WHEN 'web' THEN CASE WHEN dt THEN 0 ELSE 0.02 END ELSE 0 END, 6) AS relevance_score FROM rr)"""
ORACLE["rerank"] = with_ctes(RERANK_CTE) + "SELECT query_id, ordinal, relevance_score FROM ranked"
_COMMON = "[" + ", ".join(map(lit, op.COMMON_TERMS)) + "]"
_GENERIC = "[" + ", ".join(map(lit, op.GENERIC_TERMS)) + "]"
_TERMS = f"list_filter(regexp_extract_all(lower(question), '[a-z0-9\\-]{{3,}}'), lambda w: NOT list_contains({_COMMON}, w))"
ORACLE["suppress_unrelated_private"] = with_ctes(HITS_CTE, QUESTIONS_CTE) + f"""
, qq AS (SELECT query_id, needs_authority, document_id IS NOT NULL OR document_task AS pinned, {_TERMS} AS terms,
   regexp_matches(lower(question), '{op.UPLOAD_PATTERN}') AS up FROM questions),
q2 AS (SELECT *, list_filter(terms, lambda w: NOT list_contains({_GENERIC}, w)) AS sp FROM qq),
mk AS (SELECT h.query_id, ordinal, needs_authority, pinned, up, coalesce(source_type, 'legal') = 'legal' AS legal,
   coalesce(source_type IN ('conversation', 'matter'), false) AS priv, terms, sp, score,
   lower(concat_ws(' ', text, filename, title, display_name)) AS x FROM hits h JOIN q2 USING (query_id)),
mm AS (SELECT *, priv AND CASE WHEN len(terms) = 0 THEN score >= 0.7
   WHEN len(sp) > 0 THEN len(list_filter(sp, lambda w: contains(x, w))) >= greatest(1, least(2, (len(sp) + 1) // 2))
   ELSE len(list_filter(terms, lambda w: contains(x, w))) >= greatest(2, (len(terms) + 2) // 3) END AS ok FROM mk),
ff AS (SELECT *, bool_or(legal) OVER (PARTITION BY query_id) AS has_legal, bool_or(ok) OVER (PARTITION BY query_id) AS any_ok FROM mm)
SELECT query_id, ordinal FROM ff WHERE NOT priv OR pinned OR CASE WHEN has_legal AND needs_authority AND NOT up THEN false
  WHEN NOT up AND NOT any_ok THEN false ELSE ok OR NOT any_ok END"""
