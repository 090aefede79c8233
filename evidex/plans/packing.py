"""Families G and L: packing, history, usage, sources and resources."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import text as tx
from evidex.operators import pack as p
from evidex.operators import rank as r
from evidex.operators import resources as l
from evidex.operators import retrieve
from evidex.plans.common import DOCS_CTE, MESSAGES_CTE, collapse, lit, strip, with_ctes
from evidex.plans.grading import CLASS, _rank
from evidex.plans.hits import HITS_CTE, QUESTIONS_CTE, case, hits, merged_hits, questions
from evidex.rules.models import MODELS
from evidex.sources import tables as t
from evidex.staging import staged

SP, WD = tx.SPACE, tx.WORD


def estimates(spark, d):
    return t.docs(spark, d).select(
        "document_id", tx.estimate_tokens("text").alias("estimate"),
        tx.estimate_tokens("text", "whitespace").alias("words"), tx.estimate_tokens("text", "scaled").alias("scaled"),
    )


def scores(spark, d):
    return hits(spark, d).select("ordinal", F.round(p.packing_score(), 10).alias("packing_score"))


# A budget request per question, with windows from tight to wide.
REQUESTS = {
    "query_id": "query_id",
    "context_window": "1024 * (2 + query_id % 9) * (1 + query_id % 4)",
    "reserved_output_tokens": "256 + (query_id % 7) * 900",
    "system_tokens": "200 + query_id % 50",
    "duplicate_system_tokens": "CASE WHEN query_id % 3 = 0 THEN 200 + query_id % 50 ELSE 0 END",
    "query_tokens": "20 + query_id % 100",
    "evidence_tokens": "(query_id * 331) % 9000",
    "has_web": "query_id % 2 = 0",
    "prefer_web": "query_id % 5 = 0",
    "document_mode": "query_id % 9 IN (1, 4)",
}


def requests(spark, d):
    return t.project(questions(spark, d), REQUESTS)


def shares(spark, d):
    return p.budget_shares(requests(spark, d))


def selected(spark, d):
    """Evidence selected for every question, with its position; written once, a few hits a question."""
    lims = retrieve.tier_limits(questions(spark, d))
    return staged(r.select_evidence(merged_hits(spark, d), lims), "selected")


def packed(spark, d, evidence=None):
    return p.pack_evidence(evidence or selected(spark, d), p.budget_shares(requests(spark, d)))


def packed_evidence(spark, d):
    return packed(spark, d).select("query_id", "ordinal", "packed_tokens", "truncated", F.md5("packed_text").alias("text_md5"))


def summary(spark, d):
    evidence = selected(spark, d)
    return p.packing_summary(evidence, packed(spark, d, evidence))


def truncated(spark, d):
    return t.docs(spark, d).select(
        "document_id", F.md5(p.truncate_to_tokens("text", F.lit(60).cast("bigint"))).alias("text_md5")
    )


def dropped(spark, d):
    over = questions(spark, d).select("query_id", ((F.col("query_id") % 6) * 900).alias("overflow"))
    return p.drop_lowest(hits(spark, d), over, "estimate").select("query_id", "ordinal")


# Every third message mentions a legal issue.
CUED = {**t.MESSAGES, "text": "CASE WHEN (conv_id + turn) % 3 = 0 THEN concat(text, ' The bail under section 497 was refused.') ELSE text END"}
CUED_CTE = f"cued AS ({t.select_sql(CUED, 'conversations')})"


def cued(spark, d):
    return t.project(t.load(spark, d, "conversations"), CUED)


def recent(spark, d):
    return p.recent_history(t.messages(spark, d), 4).select("conv_id", "turn", "role")


def issues(spark, d):
    return p.active_issue(cued(spark, d))


def history_budgets(spark, d):
    return t.load(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).selectExpr(
        "conv_id", "CAST((conv_id % 6) * 90 AS BIGINT) AS history_budget",
        "CASE WHEN conv_id % 3 = 0 THEN 'Earlier the user asked about bail.' END AS summary",
    )


def history(spark, d):
    return p.compress_history(cued(spark, d), history_budgets(spark, d)).select(
        "conv_id", "turn", "role", F.md5("content").alias("content_md5"), "compressed", "summary", "active_context"
    )


def memory_summaries(spark, d):
    rows = t.load(spark, d, "conversations").selectExpr(
        "conv_id AS query_id", "concat(conv_id, '-', turn) AS memory_id", "text",
        "CAST((turn * 37 + conv_id) % 11 AS DOUBLE) / 10 AS score",
        "CASE WHEN (conv_id + turn) % 4 = 0 THEN 'chat' WHEN conv_id % 5 = 0 AND turn % 2 = 0 THEN 'legal_context' ELSE 'preference' END AS memory_type",
    )
    return p.memory_summary(rows).select("query_id", F.md5("summary").alias("summary_md5"))


MODEL_NAMES = ["gpt-4o-2024-08-06", "GPT-4o-mini", "deepseek-r1:32b-q4", "deepseek-r1:7b", "claude-sonnet-4-5-20250929",
               "mystery-model", "o4-mini-high", "gpt-4.1-nano", "minimax/minimax-m2.7:free"]
USAGE = {
    "conv_id": "conv_id",
    "turn": "turn",
    "model": case("(conv_id + turn) % 9", MODEL_NAMES),
    "context_window": "CASE WHEN conv_id % 4 = 0 THEN 1000 ELSE 32768 END",
    "available_input_tokens": "CASE WHEN conv_id % 4 = 0 THEN 300 ELSE 20000 END",
    "input_tokens": "CAST(length(text) AS BIGINT)",
    "output_tokens": "CAST(length(text) * 2 AS BIGINT)",
    "prompt_tokens": "CASE WHEN turn % 3 = 0 THEN CAST(length(text) + 7 AS BIGINT) END",
    "completion_tokens": "CASE WHEN turn % 2 = 0 THEN CAST(length(text) + 11 AS BIGINT) END",
    "reported_total": "CASE WHEN turn % 6 = 0 THEN CAST(length(text) * 3 AS BIGINT) END",
}


def usage(spark, d):
    return p.usage(t.project(t.load(spark, d, "conversations"), USAGE))


def costs(spark, d):
    return p.cost(t.project(t.load(spark, d, "conversations"), USAGE)).select(
        "conv_id", "turn", "price_model", F.round("estimated_cost", 10).alias("estimated_cost")
    )


def contexts(spark, d):
    rows = selected(spark, d).withColumns({"author": F.lit(None).cast("string"), "source_reference": r_reference()})
    return p.assemble_context(rows).select("query_id", F.md5("context").alias("context_md5"), F.length("context").cast("bigint").alias("size"))


def r_reference():
    return F.lit(None).cast("string")


def context_blocks(spark, d):
    """The context of all hits of a question in storage order."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("query_id").orderBy("ordinal")).cast("bigint")
    rows = hits(spark, d).withColumn("position", place).withColumns(
        {"author": F.lit(None).cast("string"), "source_reference": r_reference()}
    )
    return p.assemble_context(rows).select("query_id", F.md5("context").alias("context_md5"))


# --- L ---------------------------------------------------------------------------------

def plain_sources(spark, d):
    """Every hit of a question as a numbered source."""
    return l.build_sources(hits(spark, d).withColumn("source_reference", r_reference()))


USED = "CASE WHEN query_id % 3 > 0 THEN array(CAST(1 AS BIGINT), CAST(query_id % 4 AS BIGINT), CAST(999 AS BIGINT)) END"


def used(spark, d):
    return questions(spark, d).selectExpr("query_id", f"{USED} AS sources_used")


def sources(spark, d):
    return plain_sources(spark, d).select(
        "query_id", "number", "ordinal", F.md5("excerpt").alias("excerpt_md5"), "relevance", "document_name", "source_type"
    )


def shown(spark, d):
    return l.display_sources(plain_sources(spark, d), used(spark, d)).select("query_id", "number", "relevance")


def resource_cut(spark, d):
    hints = questions(spark, d).select("query_id", "section")
    return l.resource_places(plain_sources(spark, d), hints)


def answer_sources(spark, d):
    return l.build_sources(selected(spark, d).withColumn("source_reference", r_reference()))


def resources(spark, d):
    return l.build_resources(answer_sources(spark, d)).withColumn("excerpt", F.md5("excerpt"))


def percents(spark, d):
    from pyspark.sql.window import Window

    top = F.max("relevance").over(Window.partitionBy("query_id"))
    return plain_sources(spark, d).select(
        "query_id", "number", l.relevance_percent(F.col("relevance"), top).alias("relevance_percent")
    )


def citations(spark, d):
    cards = l.build_citations(answer_sources(spark, d), used(spark, d))
    return cards.withColumns({
        "sections": F.array_join("sections", "|"), "keywords": F.array_join("keywords", "|"), "excerpt": F.md5("excerpt"),
    })


def flat(spark, d):
    return l.flat_sources(hits(spark, d)).select("query_id", "ordinal", "score", F.md5("excerpt").alias("excerpt_md5"))


def inline(spark, d):
    return l.inline_citations(hits(spark, d))


def top5(spark, d):
    return l.top_sources(hits(spark, d)).select("query_id", "ordinal", "rank")


def used_counts(spark, d):
    return l.used_source_counts(used(spark, d).filter("sources_used IS NOT NULL"), plain_sources(spark, d))


QUERIES = {
    "token_estimates": estimates,
    "packing_scores": scores,
    "budget_shares": shares,
    "pack_evidence": packed_evidence,
    "packing_summary": summary,
    "truncate_to_tokens": truncated,
    "drop_lowest": dropped,
    "recent_history": recent,
    "active_issue": issues,
    "compress_history": history,
    "memory_summary": memory_summaries,
    "token_usage": usage,
    "model_cost": costs,
    "assemble_context": contexts,
    "context_layout": context_blocks,
    "numbered_sources": sources,
    "display_sources": shown,
    "resource_sources": resource_cut,
    "resources": resources,
    "relevance_percent": percents,
    "citation_cards": citations,
    "flat_sources": flat,
    "inline_citations": inline,
    "top_sources": top5,
    "used_source_counts": used_counts,
}

def pieces(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[{WD}]+|[^{WD}{SP}]'))"


def tok(n: str) -> str:
    return f"CAST(CASE WHEN {n} = 0 THEN 0 ELSE greatest(1, round_even({n} * CAST(1.35 AS DOUBLE), 0)) END AS BIGINT)"


def scaled(n: str) -> str:
    return f"greatest({tok(n)}, CAST(round_even({tok(n)} * CAST(1.2 AS DOUBLE), 0) AS BIGINT))"


_SC = "coalesce(relevance_score, score, 0)"
_PACK = f"""{_SC} * 0.45 + {_rank('a')} / 100.0 * 0.25 + CASE lower(coalesce(source_type, 'legal')) WHEN 'legal' THEN 1.0 WHEN 'matter' THEN 0.85
 WHEN 'conversation' THEN 0.8 WHEN 'web' THEN 0.45 ELSE 0.7 END * 0.2 + CASE WHEN length(text) >= 200 THEN 1.0 WHEN length(text) >= 80 THEN 0.7 ELSE 0.4 END * 0.1"""
PACKSCORE_CTE = f"packscore AS (SELECT *, {_PACK} AS ps FROM (SELECT *, {CLASS} AS a FROM hits))"
_DESC = sorted(MODELS, key=lambda m: -len(m[0]))
_MODEL = "CASE " + " ".join(f"WHEN starts_with(lower(model), {lit(m[0])}) THEN {lit(m[0])}" for m in _DESC) + " END"
_IN = "CASE m " + " ".join(f"WHEN {lit(m[0])} THEN CAST({m[4]} AS DOUBLE)" for m in MODELS) + " END"
_OUT = "CASE m " + " ".join(f"WHEN {lit(m[0])} THEN CAST({m[5]} AS DOUBLE)" for m in MODELS) + " END"
ISSUE = p.ISSUE_PATTERN
SOURCES_CTE = f"""src AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_SC} DESC, ordinal) AS number,
   round_even({_SC}, 4) AS relevance, coalesce(display_name, filename) AS document_name FROM hits)"""
_SECT = "coalesce(array_to_string(sections, ' '), '')"
_BLOB = "lower(regexp_replace(concat_ws(' ', coalesce(text, ''), coalesce(excerpt, ''), coalesce(section, ''), " + _SECT + \
    ", coalesce(law_name, ''), coalesce(filename, ''), coalesce(document_name, ''), coalesce(ref, '')), '[" + SP + tx.DASHES + "]+', '-', 'g'))"
_REF = """concat_ws(', ', coalesce(display_name, filename),
  CASE WHEN len(sections) > 0 THEN 'Section ' || array_to_string(sections, ', ') WHEN section IS NOT NULL THEN 'Section ' || section END,
  court, CAST(year AS VARCHAR), CASE WHEN page_number <> 0 THEN 'page ' || page_number END, url)"""


def excerpt(x: str, n: int = 800) -> str:
    f = collapse(x)
    return f"CASE WHEN length({f}) <= {n} THEN {f} ELSE rtrim(substring({f}, 1, {n - 1})) || '…' END"


ORACLE = {
    "token_estimates": with_ctes(DOCS_CTE) + f"""
SELECT document_id, {tok('n')} AS estimate, CAST(w AS BIGINT) AS words, {scaled('n')} AS scaled FROM (
  SELECT document_id, {pieces('text')} AS n, len(regexp_extract_all(text, '[^{SP}]+')) AS w FROM docs)""",
    "packing_scores": with_ctes(HITS_CTE, PACKSCORE_CTE) + "SELECT ordinal, round(ps, 10) AS packing_score FROM packscore",
    "budget_shares": with_ctes(QUESTIONS_CTE) + f"""
, rq AS ({t.select_sql(REQUESTS, 'questions')}),
a AS (SELECT *, greatest(256, least(reserved_output_tokens, 16384, context_window // 2)) AS r0 FROM rq),
b AS (SELECT *, CASE WHEN context_window - r0 - 512 < 512 THEN greatest(256, context_window // 4) ELSE r0 END AS res FROM a),
c AS (SELECT *, context_window - res - 512 AS avail, context_window - res - 512 - system_tokens - query_tokens AS lft FROM b),
e AS (SELECT *, greatest(0, least(duplicate_system_tokens, lft)) AS dup FROM c),
f AS (SELECT *, greatest(0, lft - dup - least(600, greatest(0, lft - dup))) AS rem FROM e),
g AS (SELECT *, CAST(floor(rem * CAST(0.05 AS DOUBLE)) AS BIGINT) AS p05, CAST(floor(rem * CAST(0.15 AS DOUBLE)) AS BIGINT) AS p15,
  CAST(floor(rem * CAST(0.20 AS DOUBLE)) AS BIGINT) AS p20, CAST(floor(rem * CAST(0.45 AS DOUBLE)) AS BIGINT) AS p45,
  CAST(floor(rem * CAST(0.25 AS DOUBLE)) AS BIGINT) AS p25, CAST(floor(rem * CAST(0.30 AS DOUBLE)) AS BIGINT) AS p30,
  CAST(floor(rem * CAST(0.10 AS DOUBLE)) AS BIGINT) AS p10, CAST(floor(rem * CAST(0.50 AS DOUBLE)) AS BIGINT) AS p50,
  CAST(floor(rem * CAST(0.18 AS DOUBLE)) AS BIGINT) AS p18, CAST(floor(rem * CAST(0.12 AS DOUBLE)) AS BIGINT) AS p12 FROM f),
h AS (SELECT *, CASE WHEN document_mode THEN CASE WHEN prefer_web AND has_web THEN p20 WHEN has_web THEN p05 ELSE 0 END
   ELSE CASE WHEN prefer_web AND has_web THEN p30 WHEN has_web THEN p10 ELSE 0 END END AS ws,
   CASE WHEN prefer_web AND has_web THEN p05 ELSE 0 END AS trim FROM g),
i AS (SELECT *, CASE WHEN document_mode THEN greatest(0, p15 - trim) ELSE greatest(0, p50 - ws) END AS ls,
   CASE WHEN document_mode THEN greatest(0, p45 - trim) ELSE p18 END AS ms, CASE WHEN document_mode THEN p25 ELSE p12 END AS cs FROM h),
j AS (SELECT *, least(ls, 8000) AS lb, least(ms, 6000) AS mb, least(cs, 4000) AS cb, least(ws, 1800) AS wb,
   greatest(0, least(rem - ls - ms - cs - ws, 2048)) AS hb FROM i),
k AS (SELECT *, evidence_tokens < (lb + mb + cb) * 0.4 AS light, lb + mb + cb - evidence_tokens AS un FROM j),
l AS (SELECT *, CASE WHEN light AND prefer_web AND has_web AND un > 0 THEN least(un // 2, greatest(0, least(1800, rem) - wb)) ELSE 0 END AS ex FROM k)
SELECT query_id, CAST(res AS BIGINT) AS reserved_output, CAST(avail AS BIGINT) AS available_input, CAST(rem AS BIGINT) AS remaining,
  CAST(lb AS BIGINT) AS legal_budget, CAST(mb AS BIGINT) AS matter_budget, CAST(cb AS BIGINT) AS conversation_budget,
  CAST(wb + ex AS BIGINT) AS web_budget, CAST(CASE WHEN light THEN least(2048, hb + greatest(0, (un - ex) // 2)) ELSE hb END AS BIGINT) AS history_budget,
  lft < 0 AS over_limit FROM l""",
    "drop_lowest": with_ctes(HITS_CTE, QUESTIONS_CTE, PACKSCORE_CTE) + f"""
, k AS (SELECT query_id, ordinal, (query_id % 6) * 900 AS overflow, ps, {tok(pieces('text'))} AS tk FROM packscore
   WHERE query_id IN (SELECT query_id FROM questions)),
s AS (SELECT *, coalesce(sum(tk) OVER (PARTITION BY query_id ORDER BY round(ps, 14), ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed,
   row_number() OVER (PARTITION BY query_id ORDER BY round(ps, 14) DESC, ordinal DESC) AS fromtop FROM k)
SELECT query_id, ordinal FROM s WHERE freed >= overflow OR fromtop = 1""",
    "recent_history": """
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4""",
    "active_issue": with_ctes(CUED_CTE) + f"""
, l8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM cued) WHERE n <= 8
   AND regexp_matches(text, '{ISSUE}')),
l2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS m FROM l8) WHERE m <= 2),
s AS (SELECT *, {collapse('text')} AS f FROM l2)
SELECT conv_id, 'Active legal context:' || chr(10) || string_agg(role || ': ' || CASE WHEN length(f) > 220 THEN substring(f, 1, 217) || '...' ELSE f END,
  chr(10) ORDER BY turn) AS active_context FROM s GROUP BY conv_id""",
    "memory_summary": f"""
WITH r AS (SELECT conv_id AS query_id, conv_id || '-' || turn AS mid, text, CAST((turn * 37 + conv_id) % 11 AS DOUBLE) / 10 AS score,
  (conv_id + turn) % 4 = 0 OR (conv_id % 5 = 0 AND turn % 2 = 0) AS pref FROM conversations),
c AS (SELECT * FROM (SELECT *, bool_or(pref) OVER (PARTITION BY query_id) AS anyp FROM r) WHERE pref OR NOT anyp),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mid) AS n FROM c) WHERE n <= 3)
SELECT query_id, md5('Conversation memory summary:' || chr(10) || '- ' || string_agg({strip('text')}, chr(10) || '- ' ORDER BY n) FILTER ({strip('text')} <> '')) AS summary_md5
FROM k GROUP BY query_id""",
    "token_usage": f"""
WITH u AS ({t.select_sql(USAGE, 'conversations')}),
v AS (SELECT *, prompt_tokens IS NOT NULL AS rep, coalesce(prompt_tokens, input_tokens) AS ti,
  CASE WHEN prompt_tokens IS NOT NULL THEN coalesce(completion_tokens, output_tokens) ELSE output_tokens END AS tout,
  CASE WHEN prompt_tokens IS NOT NULL THEN coalesce(reported_total, prompt_tokens + completion_tokens, input_tokens + output_tokens)
    ELSE input_tokens + output_tokens END AS tt FROM u),
w AS (SELECT *, round_even(100.0 * CAST(tt AS DOUBLE) / context_window, 2) AS pct FROM v)
SELECT conv_id, turn, model, context_window, available_input_tokens, ti AS input_tokens, tout AS output_tokens, tt AS total_tokens,
  greatest(0, available_input_tokens - ti) AS remaining_input_tokens, pct AS usage_percent, pct >= 80 AS warning,
  ti > available_input_tokens AS over_limit, CASE WHEN rep THEN 'provider' ELSE 'estimate' END AS usage_source FROM w""",
    "model_cost": f"""
WITH u AS ({t.select_sql(USAGE, 'conversations')}), v AS (SELECT *, {_MODEL} AS m FROM u)
SELECT conv_id, turn, m AS price_model, round(input_tokens / 1e6 * {_IN} + output_tokens / 1e6 * {_OUT}, 10) AS estimated_cost FROM v""",
    "numbered_sources": with_ctes(HITS_CTE, SOURCES_CTE) + f"""
SELECT query_id, number, ordinal, md5({excerpt('text')}) AS excerpt_md5, relevance, document_name, coalesce(source_type, 'legal') AS source_type FROM src""",
    "display_sources": with_ctes(HITS_CTE, QUESTIONS_CTE, SOURCES_CTE) + """
, m AS (SELECT s.query_id, number, relevance, q.query_id IS NOT NULL AND q.query_id % 3 > 0 AND number IN (1, q.query_id % 4) AS cited
   FROM src s LEFT JOIN questions q USING (query_id)),
n AS (SELECT *, bool_or(cited) OVER (PARTITION BY query_id) AS anyc, max(relevance) OVER (PARTITION BY query_id) AS top,
   row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, number) AS rk FROM m)
SELECT query_id, number, relevance FROM n WHERE CASE WHEN anyc THEN cited WHEN top <= 0 THEN rk <= 2
  ELSE relevance >= greatest(top * 0.72, top - 0.18) AND rk <= 3 END""",
    "resource_sources": with_ctes(HITS_CTE, QUESTIONS_CTE, SOURCES_CTE) + f"""
, ex AS (SELECT *, {excerpt('text')} AS excerpt, {_REF} AS ref FROM src),
bl AS (SELECT ex.query_id, number, relevance, source_type, coalesce(lower(document_id), filename) AS doc, {_BLOB} AS b FROM ex),
pool AS (SELECT bl.*, coalesce(contains(b, n) OR contains(replace(b, '-', ''), replace(n, '-', '')), false) AS ok FROM bl LEFT JOIN
   (SELECT query_id, CASE section WHEN '10a' THEN '10-a' ELSE lower(section) END AS n FROM questions) USING (query_id)
   WHERE coalesce(source_type, 'legal') <> 'web'),
p2 AS (SELECT * FROM (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS anyok FROM pool) WHERE ok OR NOT anyok),
dd AS (SELECT query_id, doc, max(relevance) AS best, min(number) AS fst FROM p2 GROUP BY 1, 2),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, fst) AS rk, max(best) OVER (PARTITION BY query_id) AS top FROM dd),
kd AS (SELECT * FROM dr WHERE rk <= 3 AND best >= greatest(top * 0.9, top - 0.1))
SELECT query_id, number, row_number() OVER (PARTITION BY query_id ORDER BY rk, relevance DESC, number) AS position FROM p2 JOIN kd USING (query_id, doc)""",
    "relevance_percent": with_ctes(HITS_CTE, SOURCES_CTE) + """
SELECT query_id, number, CAST(round_even(relevance / max(relevance) OVER (PARTITION BY query_id) * 100, 0) AS BIGINT) AS relevance_percent FROM src""",
    "flat_sources": with_ctes(HITS_CTE) + f"""
, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, concat_ws('|', filename, coalesce(title, ''), coalesce(law_name, ''), coalesce(sections_csv, ''))
   ORDER BY score DESC, ordinal) AS n FROM hits)
SELECT query_id, ordinal, score, md5(substring({strip('text')}, 1, 800)) AS excerpt_md5 FROM k WHERE n = 1""",
    "inline_citations": with_ctes(HITS_CTE) + """
, k AS (SELECT query_id, concat_ws(' | ', coalesce(title, law_name, filename), CASE WHEN len(sections) > 0 THEN 'Sections: ' || array_to_string(sections, ', ') END,
   court, CAST(year AS VARCHAR)) AS label, min(ordinal) AS pos FROM hits GROUP BY ALL)
SELECT query_id, string_agg(label, '; ' ORDER BY pos) AS citations FROM k GROUP BY query_id""",
    "top_sources": with_ctes(HITS_CTE) + """
SELECT query_id, ordinal, rank FROM (SELECT query_id, ordinal, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS rank FROM hits) WHERE rank <= 5""",
    "used_source_counts": with_ctes(HITS_CTE, QUESTIONS_CTE, SOURCES_CTE) + """
, u AS (SELECT query_id, unnest([1, query_id % 4, 999]) AS number FROM questions WHERE query_id % 3 > 0),
j AS (SELECT u.query_id, coalesce(source_type, 'legal') AS st, src.number AS hit FROM u LEFT JOIN src USING (query_id, number))
SELECT query_id, count(*) FILTER (hit IS NOT NULL AND st = 'legal') AS legal_used, count(*) FILTER (st = 'conversation') AS conversation_used,
  count(*) FILTER (st = 'matter') AS matter_used, count(*) FILTER (st = 'web') AS web_used FROM j GROUP BY query_id""",
    "truncate_to_tokens": with_ctes(DOCS_CTE) + f"""

, sp AS (SELECT document_id, text, {pieces('text')} AS total,
   string_split_regex(regexp_replace({strip('text')}, '([.!?])[{SP}]+', '\\1' || chr(1), 'g'), chr(1)) AS ss,
   list_filter(string_split_regex({strip('text')}, '[{SP}]+'), lambda x: x <> '') AS wd FROM docs),
sc AS (SELECT document_id, unnest(ss) AS part, generate_subscripts(ss, 1) AS i FROM sp),
wc AS (SELECT document_id, unnest(wd) AS part, generate_subscripts(wd, 1) AS i FROM sp),
ns AS (SELECT document_id, count(*) FILTER ({scaled('c')} <= 60) AS ns FROM
   (SELECT document_id, CAST(sum({pieces('part')}) OVER (PARTITION BY document_id ORDER BY i) AS BIGINT) AS c FROM sc) GROUP BY 1),
nw AS (SELECT document_id, count(*) FILTER ({scaled('c')} <= 60) AS nw FROM
   (SELECT document_id, CAST(sum({pieces('part')}) OVER (PARTITION BY document_id ORDER BY i) AS BIGINT) AS c FROM wc) GROUP BY 1)
SELECT document_id, md5(CASE WHEN text = '' THEN NULL WHEN {scaled('total')} <= 60 THEN text WHEN ns > 0 THEN {strip("array_to_string(ss[1:ns], ' ')")}
  WHEN nw > 0 THEN array_to_string(wd[1:nw], ' ') END) AS text_md5 FROM sp LEFT JOIN ns USING (document_id) LEFT JOIN nw USING (document_id)""",
}
_NAME = "coalesce(display_name, filename)"
_BLOCK = f"""chr(10) || '[Source ' || position || ']' || chr(10) || 'Type: ' || coalesce(source_type, 'legal') || chr(10) || concat_ws(' | ',
  'Document: ' || {_NAME}, CASE WHEN filename <> {_NAME} THEN 'Filename: ' || filename END, 'Document ID: ' || document_id, 'URL: ' || url,
  'Chunk ID: ' || chunk_id, CASE WHEN page_number <> 0 THEN 'Page: ' || page_number END) || chr(10) || chr(10) || 'Relevant text:' || chr(10) || chr(10)
  || regexp_replace(text, '(?im)^[ \\t]*(?:ignore (?:all |previous |prior )?(?:instructions|rules).*|you are now .{{0,80}}|reveal (?:your )?(?:system )?prompt.*|developer mode.*|do not follow (?:your )?(?:rules|guidelines).*)', '[instruction omitted from evidence]', 'g') || chr(10)"""
_TITLES = "CASE tier " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in p.CONTEXT_TITLES.items()) + " END"
ORACLE["context_layout"] = with_ctes(HITS_CTE) + f"""
, pos AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ordinal) AS position FROM hits),
bk AS (SELECT query_id, position, coalesce(source_type, 'legal') AS tier, {_BLOCK} AS b FROM pos),
se AS (SELECT query_id, tier, CASE tier WHEN 'legal' THEN 0 WHEN 'conversation' THEN 1 WHEN 'matter' THEN 2 ELSE 3 END AS o,
   {_TITLES} || chr(10) || chr(10) || string_agg(b, chr(10) ORDER BY position) AS s FROM bk GROUP BY 1, 2)
SELECT query_id, md5({lit(p.CONTEXT_HEADER)} || string_agg(s, chr(10) || chr(10) ORDER BY o)) AS context_md5 FROM se GROUP BY 1"""
