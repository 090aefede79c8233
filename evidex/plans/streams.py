"""Families P and Q: streams and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.operators import answers as a
from evidex.operators import evaluate as ev
from evidex.operators import grade as g
from evidex.operators import pack as p
from evidex.operators import question as q
from evidex.operators import resources as l
from evidex.plans import answers as pa
from evidex.plans import logs as pl
from evidex.plans import packing as pp
from evidex.plans import questions as pq
from evidex.plans.common import CHUNKS_CTE, strip, with_ctes
from evidex.plans.grading import CONCEPTS_CTE, _in
from evidex.plans.hits import HITS_CTE, QUESTIONS_CTE, case, hits, questions
from evidex.sources import tables as t
from evidex.sources.documents import read_documents
from evidex.streaming import eventlog, ingest, limiter, work


FILE_FOLDERS = 256
FILES_AT_ONCE = 32_768  # the driver lists them twice, at about a kilobyte each


def scanned_files(spark, d):
    """The documents written as one text file each, headed by its name, and read back as files.

    Files lie in folders of many: a folder for each would be a listing for each.  Spark lists
    files in the driver, so they are read some folders at a time, by tasks of many files each.
    """
    path = work.shared_dir(spark, "files")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    docs = t.load(spark, d, "documents").select(F.concat_ws("\n", F.coalesce(name, F.lit("")), F.coalesce("text", F.lit(""))).alias("value"))
    files = work.write_text_files(docs, path)
    folders = [f"{path}/{n}" for n in work.names(spark, path) if n.startswith("folder=")]
    rounds, rows = max(1, -(-files // FILES_AT_ONCE)), work.shared_dir(spark, "scanned")
    for some in (folders[k::rounds] for k in range(min(rounds, len(folders)))):
        _scanned(read_documents(spark, some)).coalesce(FILE_FOLDERS).write.mode("append").parquet(rows)
    return spark.read.schema(SCANNED).parquet(rows) if folders else spark.createDataFrame([], SCANNED)


SCANNED = "name string, mime string, text_md5 string, characters bigint, bytes bigint"


def _scanned(found):
    head = F.substring_index("text", "\n", 1)
    body = F.expr("substring(text, length(head) + 2)")
    return found.filter(F.endswith("path", F.lit(".txt"))).withColumn("head", head).withColumn("body", body).select(  # not the writer's own marks
        F.nullif("head", F.lit("")).alias("name"), "mime", F.md5("body").alias("text_md5"), F.length("body").cast("bigint").alias("characters"),
        (F.col("bytes") - F.octet_length("head") - 1).alias("bytes"),
    )


def ingested(spark, d):
    docs = t.project(work.table_stream(spark, d, "documents"), t.DOCS)
    chunks = ingest.chunk_stream(docs).select("document_id", "chunk_index", F.md5("text").alias("text_md5"), "start_offset")
    return work.run_to_files(chunks, work.shared_dir(spark, "ingest"))


VERSIONS = {
    "document_id": "concat('d', CAST(floor(doc_id / 2) AS BIGINT))", "user_id": "concat('u', CAST(floor(doc_id / 2) AS BIGINT) % 37)",
    "version": "doc_id", "text": "CASE WHEN doc_id % 14 = 1 THEN ' ' ELSE text END",
}


def indexed(spark, d):
    """Two versions of every document in one stream; the later one stays."""
    path = work.shared_dir(spark, "index")
    docs = t.project(work.table_stream(spark, d, "documents"), VERSIONS)
    ingest.maintain_index(docs, f"{path}/rows", f"{path}/_stream").awaitTermination()
    return ingest.current_index(spark, f"{path}/rows").select("document_id", "version", "chunk_index", F.md5("text").alias("text_md5"))


WINDOW, LIMIT = 6 * 3600, 2


def _hits(events):
    return events.selectExpr("concat('u', user_id) AS key", "event_id", "ts")


def limited(spark, d):
    return limiter.limit_hits(_hits(t.load(spark, d, "events")), LIMIT, WINDOW)


def limited_stream(spark, d):
    decided = limiter.limit_stream(_hits(work.table_stream(spark, d, "events")), LIMIT, WINDOW)
    return work.run_to_files(decided, work.shared_dir(spark, "limiter"), timers=True)


def logged(spark, d):
    rows = eventlog.log_rows(t.project(work.table_stream(spark, d, "events"), pl.REQUESTS))
    return work.run_to_files(rows, work.shared_dir(spark, "eventlog")).select(
        "id", "path", "bucket", "ip_address", "device_type", "request_body"
    )


# --- Q ----------------------------------------------------------------------------
# Expected answer mode of each opening when nothing is uploaded.
EXPECTED_MODES = (
    "legal_research", "legal_research", "legal_research", "legal_research", "drafting", "hearing_prep", "compare_provisions",
    "legal_research", "legal_research", "drafting", "playbook_review", "redline", "review_table", "legal_research", "legal_research",
    "general_chat", "legal_research", "legal_research", "legal_research", "legal_research", "legal_research", "general_chat",
    "general_chat", "legal_research", "general_chat", "legal_research", "legal_research", "general_chat", "general_chat", "general_chat",
    "legal_research", "drafting", "hearing_prep", "legal_research", "drafting", "general_chat",
)
CASES = {
    "conv_id": "conv_id", "turn": "turn", "expected_mode": case("(conv_id * 7 + turn) % 36", EXPECTED_MODES),
    "expected_authority": "(conv_id * 7 + turn) % 3 > 0",
}


def accuracy(spark, d):
    predictions = q.plan(pq.questions(spark, d)).select("conv_id", "turn", "answer_mode", "requires_authority")
    cases = t.project(t.load(spark, d, "conversations").filter("role = 'user'"), CASES)
    out = ev.planner_accuracy(predictions, cases, ["conv_id", "turn"])
    return out.withColumns({c: F.round(c, 10) for c in ("mode_accuracy", "authority_accuracy")})


def retrieval(spark, d):
    cases = questions(spark, d).select(
        "query_id", F.expr(case("query_id % 3", ["legal", "web", "matter"])).alias("expected_source_type"),
        g.question_concepts("question").alias("expected_topics"),
    )
    return ev.retrieval_check(hits(spark, d), cases).withColumn("topic_coverage", F.round("topic_coverage", 10))


def budget_violations(spark, d):
    return ev.over_budget(pp.packed(spark, d), p.budget_shares(pp.requests(spark, d)))


def resource_violations(spark, d):
    return ev.split_resources(l.build_resources(pp.answer_sources(spark, d)))


def citation_violations(spark, d):
    rows = pa.answers(spark, d)
    claims = a.ground_claims(rows, pp.selected(spark, d), pa.KEY)
    return ev.invented_citations(a.guard_answers(rows, claims, pa.KEY), claims, pa.KEY)


def resource_keys(spark, d):
    return ev.same_resource(pp.plain_sources(spark, d))


QUERIES = {
    "scan_files": scanned_files,
    "stream_ingest": ingested,
    "stream_index": indexed,
    "limit_hits": limited,
    "stream_limit_hits": limited_stream,
    "stream_event_log": logged,
    "planner_accuracy": accuracy,
    "retrieval_check": retrieval,
    "invariant_budget": budget_violations,
    "invariant_resources": resource_violations,
    "invariant_citations": citation_violations,
    "resource_identity": resource_keys,
}

_V = f"""v AS (SELECT * FROM (SELECT *, max(version) OVER (PARTITION BY document_id) AS newest FROM ({t.select_sql(VERSIONS, 'documents')})) WHERE version = newest),
vs AS (SELECT document_id, version, text AS doc_text, unnest(range(0, CAST(length(text) AS BIGINT), 1000)) AS s FROM v WHERE text <> ''),
vw AS (SELECT document_id, version, s, substring(doc_text, s + 1, 1200) AS raw FROM vs)"""
ORACLE = {
    "scan_files": """
SELECT 'd' || doc_id AS name, 'text/plain' AS mime, md5(text || chr(10)) AS text_md5, CAST(length(text) + 1 AS BIGINT) AS characters,
  CAST(strlen(text) + 1 AS BIGINT) AS bytes FROM documents""",
    "stream_ingest": with_ctes(CHUNKS_CTE) + r"""
, gate AS (SELECT document_id FROM docs WHERE filename <> '' AND byte_size <= 26214400
   AND regexp_extract(filename, '([^/]+)/*$', 1) NOT IN ('', '.', '..')
   AND (lower(regexp_extract(regexp_extract(filename, '([^/]+)/*$', 1), '^.+(\.[^.]+)$', 1)) IN ('.pdf', '.txt', '.md', '.csv') OR mime_type = 'text/plain'))
SELECT document_id, chunk_index, md5(text) AS text_md5, start_offset FROM chunks SEMI JOIN gate USING (document_id)""",
    "stream_index": with_ctes(_V) + f"""
SELECT document_id, version, CAST(row_number() OVER (PARTITION BY document_id ORDER BY s) - 1 AS BIGINT) AS chunk_index, md5({strip('raw')}) AS text_md5
FROM vw WHERE {strip('raw')} <> ''""",
    "stream_event_log": pl._R + f"""
SELECT id, path, CASE WHEN path LIKE '/api/v1/auth%' THEN 'auth' WHEN path LIKE '/api/v1/chat%' OR path LIKE '/api/v1/contracts%' THEN 'chat'
  WHEN path LIKE '%/upload%' OR path LIKE '/api/v1/documents%' THEN 'upload' ELSE 'default' END AS bucket,
  coalesce(trim(string_split(nullif(forwarded_for, ''), ',')[1]), real_ip, peer) AS ip_address,
  {pl.DEVICE} AS device_type,
  CASE WHEN path LIKE '%/chat%' THEN '{{"_omitted": "chat_body"}}' ELSE request_body END AS request_body
FROM requests WHERE path NOT IN ('/docs', '/openapi.json', '/redoc', '/health', '/ready')""",
    "resource_identity": with_ctes(HITS_CTE) + """
SELECT query_id, document_id, CAST(1 AS BIGINT) AS resource_keys FROM hits
WHERE document_id IS NOT NULL GROUP BY ALL""",
}

_TXT = "lower(coalesce(h.text, ''))"
ORACLE["retrieval_check"] = with_ctes(HITS_CTE, QUESTIONS_CTE, CONCEPTS_CTE) + f"""
, cs AS (SELECT query_id, {case("query_id % 3", ["legal", "web", "matter"])} AS est, concepts FROM concepts),
tp AS (SELECT query_id, unnest(concepts) AS topic FROM cs),
cov AS (SELECT tp.query_id, topic, bool_or({_in('topic', _TXT)}) AS ok FROM tp JOIN hits h USING (query_id) GROUP BY 1, 2),
tc AS (SELECT query_id, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS c FROM cov GROUP BY 1),
sf AS (SELECT cs.query_id, bool_or(coalesce(source_type, 'legal') = est) AS f FROM cs JOIN hits USING (query_id) GROUP BY 1)
SELECT cs.query_id, coalesce(f, false) AS source_found, round(coalesce(c, 0.0), 10) AS topic_coverage FROM cs LEFT JOIN sf USING (query_id) LEFT JOIN tc USING (query_id)"""
# The limiter is sequential per key: a recursive walk over each key's hits states it.
ORACLE["limit_hits"] = f"""
WITH RECURSIVE e AS (SELECT 'u' || user_id AS key, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk AS (
  SELECT key, n, event_id, [us] AS kept, true AS allowed FROM e WHERE n = 1
  UNION ALL
  SELECT key, n, event_id, CASE WHEN len(alive) < {LIMIT} THEN list_append(alive, us) ELSE alive END AS kept, len(alive) < {LIMIT} AS allowed
  FROM (SELECT e.key, e.n, e.event_id, e.us, list_filter(walk.kept, lambda x: x >= e.us - {WINDOW * 1_000_000}) AS alive
        FROM walk JOIN e ON e.key = walk.key AND e.n = walk.n + 1))
SELECT key, event_id, allowed FROM walk"""
ORACLE["stream_limit_hits"] = ORACLE["limit_hits"].replace(
    "SELECT key, event_id, allowed FROM walk", "SELECT key, event_id, CASE WHEN allowed THEN 'allow' ELSE 'deny' END AS decision FROM walk"
)
