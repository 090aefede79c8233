"""Family A: documents to index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.functions import text as tx
from evidex.operators import ingest as op
from evidex.operators import stitch
from evidex.plans.common import CHUNKS_CTE, DOCS_CTE, QUOTED_SPACE, collapse, strip, with_ctes
from evidex.sources import tables as t

SPACE = tx.SPACE
# A titled form of every document: some open with a heading and a by-line.
TITLED = (
    "CASE WHEN doc_id % 4 = 0 THEN concat('NOTES ON ', upper(source), chr(10), 'By A. Writer of ', lang, chr(10), text) "
    "WHEN doc_id % 4 = 1 THEN concat(chr(10), '  Section ', doc_id, ' of the record', chr(10), text) "
    "WHEN doc_id % 4 = 2 THEN concat('A study of ', lang, chr(13), chr(10), chr(10), chr(9), 'by   B. Author ', chr(10), text) "
    "ELSE text END"
)


def titled_docs(spark: SparkSession, d: str) -> DataFrame:
    return t.load(spark, d, "documents").select(
        *[F.expr(e).alias(n) for n, e in t.DOCS.items() if n != "text"], F.expr(TITLED).alias("text")
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    cols = ["document_id", "user_id", "scope", "matter_id", "conversation_id", "lang", "source", "doc_id", "text"]
    return op.chunk_documents(t.docs(spark, d).select(*cols))


TITLED_CTE = "titled AS (SELECT {} , {} AS text FROM documents)".format(
    ", ".join(f"{e} AS {n}" for n, e in t.DOCS.items() if n != "text"), TITLED
)


def gate(spark, d):
    return op.gate_documents(t.docs(spark, d)).select("document_id", "filename", "accepted", "reason")


def processed(spark, d):
    return op.mark_processed(t.docs(spark, d)).select(
        "document_id", F.md5("extracted_text").alias("text_md5"), "processed", "vectorized"
    )


def display_names(spark, d):
    return titled_docs(spark, d).select(
        "document_id", op.derive_display_name("text", "filename").alias("display_name")
    )


def authors(spark, d):
    return titled_docs(spark, d).select("document_id", op.derive_author("text").alias("author"))


def previews(spark, d):
    return t.docs(spark, d).select(
        "document_id", op.preview("text").alias("text_preview"),
        op.character_count("text").alias("character_count"),
    )


def chunk_texts(spark, d):
    return chunks(spark, d).select("document_id", "chunk_index", "text")


def chunk_offsets(spark, d):
    return chunks(spark, d).select("document_id", "chunk_index", "start_offset", "end_offset")


def chunk_ids(spark, d):
    return chunks(spark, d).select("document_id", "chunk_index", "chunk_id", "point_id")


# The newly arriving version of some documents is their upper-cased text.
def _new_version(spark, d):
    return op.chunk_documents(
        t.docs(spark, d).filter(F.col("doc_id") % 3 == 0).select(
            "document_id", "user_id", "scope", "matter_id", "conversation_id", "lang", "source", "doc_id",
            F.replace("text", F.lit("e"), F.lit("E")).alias("text"),
        )
    )


def reindex(spark, d):
    return op.upsert_document_chunks(chunks(spark, d), _new_version(spark, d)).select(
        "document_id", "chunk_index", F.md5("text").alias("text_md5")
    )


def delete_chunks(spark, d):
    gone = t.docs(spark, d).filter(F.col("doc_id") % 5 == 1)
    return op.delete_document_chunks(chunks(spark, d), gone).select("document_id", "chunk_index")


def reassign_matter(spark, d):
    moved = t.docs(spark, d).filter(F.col("doc_id") % 6 == 2).select(
        "document_id", "user_id",
        F.expr("CASE WHEN doc_id % 12 = 2 THEN concat('moved', doc_id % 5) END").alias("matter_id"),
    )
    return op.set_matter(chunks(spark, d), moved).select("document_id", "chunk_index", "matter_id")


def merged_text(spark, d):
    return op.merge_by_index(chunks(spark, d)).select(
        "document_id", F.md5("text").alias("text_md5"), "chunk_count"
    )


def stitched_text(spark, d):
    return stitch.stitch_documents(chunks(spark, d))


def library_points(spark, d):
    """Chunks as stored points, with a summary parent for every fifth document."""
    c = chunks(spark, d)
    child = c.select(
        "document_id", "chunk_id", "chunk_index", "text", F.lit(None).cast("string").alias("chunk_text"),
        F.lit(None).cast("string").alias("content"), F.lit(False).alias("is_parent"),
        F.lit("child").alias("chunk_role"), F.col("chunk_index").alias("ordinal"),
        F.concat("source", F.lit("-"), "doc_id", F.lit(".txt")).alias("filename"),
        F.lit(None).cast("string").alias("title"), F.col("source").alias("law_name"),
        F.lit("statute").alias("document_type"), F.lit("").alias("year"),
        (F.col("doc_id") % 40 + 1980).cast("string").alias("publication_year"),
    )
    parent = child.filter((F.col("chunk_index") == 0) & F.col("document_id").rlike("[05]$")).select(
        "document_id", F.concat("document_id", F.lit(":parent")).alias("chunk_id"),
        F.lit(None).cast("bigint").alias("chunk_index"), F.lit("").alias("text"),
        F.substring("text", 1, 400).alias("chunk_text"), "content",
        F.lit(None).cast("boolean").alias("is_parent"), F.lit("Parent").alias("chunk_role"),
        F.lit(1_000_000).cast("bigint").alias("ordinal"), "filename", F.lit("Parent title").alias("title"),
        "law_name", F.lit("act").alias("document_type"), F.lit("n/a").alias("year"), "publication_year",
    )
    return child.unionByName(parent)


def library_text(spark, d):
    return stitch.best_document_text(library_points(spark, d))


def library_details(spark, d):
    points = library_points(spark, d)
    return op.library_detail(points, stitch.best_document_text(points))


def library_metadata(spark, d):
    """The metadata half of the detail row, over texts merged by index."""
    points = library_points(spark, d)
    return op.library_detail(points, op.merge_by_index(chunks(spark, d))).select(
        "document_id", "filename", "title", "law_name", "document_type", "year",
        F.md5("text_preview").alias("preview_md5"), "character_count", "chunk_count",
    )


def embedding_input(spark, d):
    src = t.docs(spark, d).select(
        "document_id",
        F.expr("CASE WHEN doc_id % 7 = 0 THEN concat('  search_document: ', text) "
               "WHEN doc_id % 11 = 0 THEN chr(10) ELSE text END").alias("text"),
    )
    return op.prepare_embedding_input(src).select("document_id", F.md5("embedding_input").alias("input_md5"))


def _mixed_vectors(spark, d):
    return t.load(spark, d, "embeddings").select(
        "vec_id", "label",
        F.expr("CASE WHEN vec_id % 9 = 0 THEN slice(embedding, 1, 60) WHEN vec_id % 31 = 0 THEN NULL "
               "ELSE embedding END").alias("embedding"),
    )


def bad_vectors(spark, d):
    return op.validate_vectors(_mixed_vectors(spark, d), 64).select("vec_id", "vector_size")


def index_report(spark, d):
    return op.verify_index(_mixed_vectors(spark, d), 64)


PAYLOAD = """concat('{"document_id":"', CASE WHEN doc_id % 2 = 0 THEN upper(md5(concat(doc_id, ''))) ELSE concat('D', doc_id) END,
 '","chunk_index":', doc_id % 9,
 CASE WHEN doc_id % 3 = 0 THEN concat(',"chunk_id":"c', doc_id, '"') ELSE '' END,
 CASE WHEN doc_id % 4 = 0 THEN ',"is_parent":true' WHEN doc_id % 4 = 1 THEN ',"is_parent":false' ELSE '' END,
 CASE WHEN doc_id % 10 = 7 THEN ',"embedded":false' ELSE '' END,
 CASE WHEN doc_id % 14 = 3 THEN ',"is_retrieval_valid":false' ELSE '' END,
 CASE WHEN doc_id % 2 = 0 THEN concat(',"text":"body ', doc_id, '"') ELSE concat(',"chunk_text":"old ', doc_id, '"') END,
 CASE WHEN doc_id % 5 = 0 THEN concat(',"filename":"', source, '.txt"') ELSE concat(',"source":{"filename":"s-', lang, '.txt","publication_year":', 1990 + doc_id % 30, '}') END,
 CASE WHEN doc_id % 6 = 0 THEN ',"publication_year":2001' ELSE ',"year":1999' END,
 CASE WHEN doc_id % 7 = 0 THEN ',"province":"north"' ELSE ',"jurisdiction":"south"' END,
 CASE WHEN doc_id % 8 = 1 THEN ',"scope":"matter","matter_id":"m1"' WHEN doc_id % 8 = 2 THEN ',"scope":"conversation","conversation_id":"c1"' ELSE '' END,
 CASE WHEN doc_id % 3 = 1 THEN concat(',"heading":"Part ', doc_id % 5, '","law_name":"Relief Act","document_type":"statute","category":"civil","sub_category":"land"') ELSE '' END,
 CASE WHEN doc_id % 5 = 2 THEN ',"practice_area":"property","summary":"in short","sections":["54-C","302"],"keywords":["bail"]' ELSE '' END,
 CASE WHEN doc_id % 7 = 3 THEN concat(',"parent_chunk_id":"c', doc_id - 1, '","validation_status":"orphan_heading","chunk_role":"child","section":"7-A"') ELSE '' END,
 CASE WHEN doc_id % 2 = 1 THEN concat(',"page_number":', doc_id % 40, ',"start_offset":', doc_id * 10, ',"end_offset":', doc_id * 10 + 9, ',"paragraph_index":', doc_id % 6) ELSE '' END,
 CASE WHEN doc_id % 9 = 4 THEN concat(',"user_id":"u', doc_id % 37, '"') ELSE '' END,
 '}')"""


def normalized_payloads(spark, d):
    points = t.load(spark, d, "documents").select(
        F.expr("concat('p', doc_id)").alias("point_id"), F.expr(PAYLOAD).alias("payload"),
        F.expr("CASE WHEN doc_id % 4 <> 3 THEN CAST(doc_id % 8 AS DOUBLE) / 8 END").alias("score"),
    )
    return op.normalize_payload(points)


def scopes(spark, d):
    return t.load(spark, d, "conversations").select(
        F.expr("concat('u', conv_id % 37)").alias("user_id"),
        F.expr("CASE WHEN turn % 2 = 0 THEN concat('m', conv_id % 11) END").alias("matter_id"),
        F.expr("concat('c', conv_id % 23)").alias("conversation_id"),
    ).distinct()


def ready_scopes(spark, d):
    return op.documents_ready(scopes(spark, d), op.mark_processed(t.docs(spark, d)))


QUERIES = {
    "gate_documents": gate,
    "mark_processed": processed,
    "display_names": display_names,
    "author_lines": authors,
    "text_previews": previews,
    "chunk_documents": chunk_texts,
    "chunk_offsets": chunk_offsets,
    "chunk_ids": chunk_ids,
    "index_replace_documents": reindex,
    "index_delete_documents": delete_chunks,
    "index_set_matter": reassign_matter,
    "merge_chunks_by_index": merged_text,
    "stitch_documents": stitched_text,
    "library_document_text": library_text,
    "library_document_detail": library_details,
    "library_document_metadata": library_metadata,
    "embedding_input": embedding_input,
    "vector_size_check": bad_vectors,
    "index_report": index_report,
    "normalize_payload": normalized_payloads,
    "documents_ready": ready_scopes,
}

_BASE = r"regexp_extract(filename, '([^/]+)/*$', 1)"
_SUFFIX = rf"lower(regexp_extract({_BASE}, '^.+(\.[^.]+)$', 1))"
_STEM = rf"regexp_replace({_BASE}, '^(.+)\.[^.]+$', '\1')"
_NL = op.NEWLINE
_LINES = (
    f"list_filter(list_transform(regexp_split_to_array(text, '[{_NL}]+'), lambda l: {strip('l')}), lambda l: l <> '')"
)


def _by(x: str) -> str:
    return f"regexp_matches({x}, '^[bB][yY][{SPACE}]+.')"



def _stitched(lists: str) -> str:
    """Windows of ``lists`` joined at the longest stretch that ends one and begins the next; others after a blank line."""
    return f""", first_said AS (SELECT document_id, list, body, min(place) AS place FROM ({lists}) GROUP BY ALL),
followed AS (SELECT *, lag(body) OVER (PARTITION BY document_id, list ORDER BY place) AS prior FROM first_said),
pieces AS (SELECT *, CASE WHEN prior IS NULL THEN 0 WHEN ends_with(prior, body) THEN length(body) WHEN starts_with(body, prior) THEN length(prior)
  ELSE coalesce(list_max(list_filter(range(24, least(length(prior), length(body), 8000) + 1), lambda k: right(prior, k) = left(body, k))), 0) END AS shared FROM followed),
stitched AS (SELECT document_id, list, {strip("string_agg(CASE WHEN prior IS NOT NULL AND shared = 0 THEN chr(10) || chr(10) ELSE '' END || substring(body, shared + 1), '' ORDER BY place)")} AS text
  FROM pieces GROUP BY document_id, list)
"""


# Children of a document alone, behind its parent, and the parent alone; a clean beginning and then length decide.
LIBRARY_CTE = _stitched(f"""
  SELECT document_id, 0 AS list, chunk_index AS place, text AS body FROM chunks
  UNION ALL SELECT document_id, 1, chunk_index, text FROM chunks WHERE doc_id % 5 = 0
  UNION ALL SELECT document_id, 1, -1, {strip("left(text, 400)")} FROM chunks WHERE chunk_index = 0 AND doc_id % 5 = 0""") + f""",
options AS (SELECT document_id, list, text, (SELECT count(*) FROM chunks c WHERE c.document_id = s.document_id) + list AS chunk_count FROM stitched s
  UNION ALL SELECT document_id, 2, {strip("left(text, 400)")}, 1 FROM chunks WHERE chunk_index = 0 AND doc_id % 5 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY
  regexp_matches(text, '^[\\p{{Lu}}\\p{{Lt}}]|^[''"“‘][\\p{{Lu}}\\p{{Lt}}]') DESC, regexp_matches(text, '^\\p{{Ll}}'), length(text) DESC, list) AS nth FROM options),
best AS (SELECT document_id, text, chunk_count FROM ranked WHERE nth = 1)
"""


ORACLE = {
    "gate_documents": with_ctes(DOCS_CTE) + f"""
SELECT document_id, filename, reason IS NULL AS accepted, reason FROM (
  SELECT document_id, filename, CASE
    WHEN filename = '' THEN 'filename_missing'
    WHEN byte_size > 26214400 THEN 'file_too_large'
    WHEN {_BASE} IN ('', '.', '..') THEN 'filename_missing'
    WHEN NOT ({_SUFFIX} IN ('.pdf', '.txt', '.md', '.csv')
      OR coalesce(mime_type, '') IN ('application/pdf', 'text/plain', 'text/markdown', 'text/csv'))
      THEN 'unsupported_type' END AS reason FROM docs)""",
    "mark_processed": with_ctes(DOCS_CTE) + f"""
SELECT document_id, CASE WHEN {strip('text')} <> '' THEN md5(text) END AS text_md5,
       {strip('text')} <> '' AS processed, {strip('text')} <> '' AS vectorized FROM docs""",
    "display_names": with_ctes(TITLED_CTE) + f"""
SELECT document_id, CASE
  WHEN len(ls) > 0 AND length(ls[1]) <= 120 AND NOT regexp_matches(lower(ls[1]), '^(section|chapter|page) ')
   AND ((len(ls) > 1 AND {_by('ls[2]')})
        OR (length(ls[1]) <= 80 AND ((upper(ls[1]) = ls[1] AND lower(ls[1]) <> ls[1]) OR right(ls[1], 1) <> '.')))
  THEN ls[1] ELSE {_STEM} END AS display_name
FROM (SELECT document_id, filename, {_LINES} AS ls FROM titled)""",
    "author_lines": with_ctes(TITLED_CTE) + f"""
SELECT document_id, list_filter({_LINES}, lambda l: {_by('l')})[1] AS author FROM titled""",
    "text_previews": with_ctes(DOCS_CTE) + f"""
SELECT document_id, CASE WHEN f = '' THEN NULL WHEN length(f) <= 500 THEN f
  ELSE rtrim(substring(f, 1, 499), {QUOTED_SPACE}) || '…' END AS text_preview, n AS character_count
FROM (SELECT document_id, {collapse('text')} AS f, CAST(length({strip('text')}) AS BIGINT) AS n FROM docs)""",
    "chunk_documents": with_ctes(CHUNKS_CTE) + "SELECT document_id, chunk_index, text FROM chunks",
    "chunk_offsets": with_ctes(CHUNKS_CTE) + """
SELECT document_id, chunk_index, start_offset, CAST(start_offset + length(text) AS BIGINT) AS end_offset FROM chunks""",
    "chunk_ids": with_ctes(CHUNKS_CTE) + """
SELECT document_id, chunk_index, document_id || ':' || chunk_index AS chunk_id,
  substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4)
  || '-' || substring(h, 21) AS point_id
FROM (SELECT *, md5(document_id || ':' || chunk_index) AS h FROM chunks)""",
    "index_replace_documents": with_ctes(CHUNKS_CTE) + f"""
SELECT document_id, chunk_index, md5(text) AS text_md5 FROM chunks WHERE doc_id % 3 <> 0
UNION ALL
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY s) - 1 AS BIGINT),
  md5({strip('raw')}) FROM (SELECT document_id, s, substring(replace(doc_text, 'e', 'E'), s + 1, 1200) AS raw
    FROM (SELECT document_id, text AS doc_text,
          unnest(range(0, CAST(length(text) AS BIGINT), 1000)) AS s FROM docs WHERE text <> '' AND doc_id % 3 = 0))
WHERE {strip('raw')} <> ''""",
    "index_delete_documents": with_ctes(CHUNKS_CTE) + "SELECT document_id, chunk_index FROM chunks WHERE doc_id % 5 <> 1",
    "index_set_matter": with_ctes(CHUNKS_CTE) + """
SELECT document_id, chunk_index, CASE WHEN doc_id % 12 = 2 THEN 'moved' || (doc_id % 5)
  WHEN doc_id % 6 = 2 THEN NULL ELSE matter_id END AS matter_id FROM chunks""",
    "merge_chunks_by_index": with_ctes(CHUNKS_CTE) + """
SELECT document_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index)) AS text_md5,
  count(*) AS chunk_count FROM chunks GROUP BY document_id""",
    "stitch_documents": with_ctes(CHUNKS_CTE) + _stitched("SELECT document_id, 0 AS list, chunk_index AS place, text AS body FROM chunks") + """
SELECT document_id, text, (SELECT count(*) FROM chunks c WHERE c.document_id = s.document_id) AS chunk_count FROM stitched s""",
    "library_document_text": with_ctes(CHUNKS_CTE) + LIBRARY_CTE + "SELECT document_id, text, chunk_count FROM best",
    "library_document_detail": with_ctes(CHUNKS_CTE) + LIBRARY_CTE + """
SELECT document_id, source || '-' || doc_id || '.txt' AS filename,
  CASE WHEN doc_id % 5 = 0 THEN 'Parent title' ELSE source || '-' || doc_id || '.txt' END AS title,
  source AS law_name, CASE WHEN doc_id % 5 = 0 THEN 'act' ELSE 'statute' END AS document_type,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 40 + 1980 AS BIGINT) END AS year,
  text, substring(text, 1, 500) AS text_preview, CAST(length(text) AS BIGINT) AS character_count, chunk_count
FROM best JOIN (SELECT DISTINCT document_id, source, doc_id FROM chunks) USING (document_id)""",
    "library_document_metadata": with_ctes(CHUNKS_CTE) + """
, merged AS (SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS body,
   count(*) AS chunk_count, any_value(source) AS source, any_value(doc_id) AS doc_id FROM chunks GROUP BY document_id)
SELECT document_id, source || '-' || doc_id || '.txt' AS filename,
  CASE WHEN doc_id % 5 = 0 THEN 'Parent title' ELSE source || '-' || doc_id || '.txt' END AS title,
  source AS law_name, CASE WHEN doc_id % 5 = 0 THEN 'act' ELSE 'statute' END AS document_type,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 40 + 1980 AS BIGINT) END AS year,
  md5(substring(body, 1, 500)) AS preview_md5, CAST(length(body) AS BIGINT) AS character_count, chunk_count
FROM merged""",
    "embedding_input": with_ctes(DOCS_CTE) + f"""
SELECT document_id, md5(CASE WHEN starts_with(b, 'search_document: ') THEN b ELSE 'search_document: ' || b END) AS input_md5
FROM (SELECT document_id, {strip('x')} AS b FROM (
  SELECT document_id, CASE WHEN doc_id % 7 = 0 THEN '  search_document: ' || text
    WHEN doc_id % 11 = 0 THEN chr(10) ELSE text END AS x FROM docs)) WHERE b <> ''""",
    "vector_size_check": """
SELECT vec_id, CAST(coalesce(len(v), 0) AS BIGINT) AS vector_size FROM (
  SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN embedding[1:60] WHEN vec_id % 31 = 0 THEN NULL ELSE embedding END AS v
  FROM embeddings) WHERE coalesce(len(v), 0) <> 64""",
    "index_report": """
SELECT count(*) AS points, min(len(v)) AS min_vector_size, max(len(v)) AS max_vector_size,
  bool_and(len(v) = 64) AS vector_size_ok, count(vec_id) AS filled_vec_id, count(label) AS filled_label FROM (
  SELECT vec_id, label, CASE WHEN vec_id % 9 = 0 THEN embedding[1:60] WHEN vec_id % 31 = 0 THEN NULL ELSE embedding END AS v
  FROM embeddings)""",
    "normalize_payload": f"""
WITH p AS (SELECT 'p' || doc_id AS point_id, CAST({PAYLOAD} AS JSON) AS j, CASE WHEN doc_id % 4 <> 3 THEN CAST(doc_id % 8 AS DOUBLE) / 8 END AS sc FROM documents)
SELECT coalesce(j->>'$.chunk_id', point_id) AS chunk_id, coalesce(j->>'$.chunk_id', point_id) AS id, coalesce(sc, 0.0) AS score,
  {', '.join(f"j->>'$.{c}' AS {c}" for c in op.PAYLOAD_TEXTS)},
  {', '.join(f"CAST(j->>'$.{c}' AS BIGINT) AS {c}" for c in op.PAYLOAD_NUMBERS)},
  coalesce(CAST(j->'$.sections' AS VARCHAR[]), []) AS sections, coalesce(CAST(j->'$.keywords' AS VARCHAR[]), []) AS keywords,
  CAST(j->>'$.embedded' AS BOOLEAN) AS embedded, j->>'$.user_id' AS user_id,
  CAST(coalesce(j->>'$.publication_year', j->>'$.source.publication_year', j->>'$.year') AS BIGINT) AS publication_year,
  CASE WHEN length(j->>'$.document_id') = 32 THEN CAST(CAST(lower(j->>'$.document_id') AS UUID) AS VARCHAR)
       ELSE lower(j->>'$.document_id') END AS document_id,
  CAST(j->>'$.chunk_index' AS BIGINT) AS chunk_index,
  coalesce(j->>'$.text', j->>'$.chunk_text', '') AS text,
  coalesce(j->>'$.filename', j->>'$.source.filename') AS filename,
  j->>'$.title' AS title, j->>'$.court' AS court,
  CAST(coalesce(j->>'$.publication_year', j->>'$.source.publication_year', j->>'$.year') AS BIGINT) AS year,
  coalesce(j->>'$.jurisdiction', j->>'$.province') AS jurisdiction,
  j->>'$.scope' AS scope, 'legal' AS source,
  CASE WHEN j->>'$.scope' IN ('conversation', 'matter') THEN j->>'$.scope' ELSE 'legal' END AS source_type,
  j->>'$.matter_id' AS matter_id, j->>'$.conversation_id' AS conversation_id
FROM p WHERE (j->>'$.is_parent') IS DISTINCT FROM 'true' AND (j->>'$.embedded') IS DISTINCT FROM 'false'
  AND (j->>'$.is_retrieval_valid') IS DISTINCT FROM 'false'""",
    "documents_ready": with_ctes(DOCS_CTE) + f"""
, scopes AS (SELECT DISTINCT 'u' || (conv_id % 37) AS user_id,
   CASE WHEN turn % 2 = 0 THEN 'm' || (conv_id % 11) END AS matter_id, 'c' || (conv_id % 23) AS conversation_id
   FROM conversations)
SELECT *, EXISTS (SELECT 1 FROM docs d WHERE d.user_id = s.user_id AND {strip('d.text')} <> '' AND (
   (d.scope = 'conversation' AND d.conversation_id = s.conversation_id)
   OR (d.scope IN ('matter', 'conversation') AND d.matter_id = s.matter_id))) AS ready FROM scopes s""",
}
