"""Family F: grading evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions.authority import attribution, authority_rank, classify_authority
from evidex.operators import grade as g
from evidex.plans.common import lit, with_ctes
from evidex.plans.hits import HITS_CTE, QUESTIONS_CTE, hits, questions
from evidex.rules import authority as ra
from evidex.rules import evidence as re


def authority(spark, d):
    return hits(spark, d).withColumn("authority_type", classify_authority()).select(
        "ordinal", "authority_type", authority_rank("authority_type").alias("authority_rank")
    )


def attributions(spark, d):
    return hits(spark, d).select(
        "ordinal", attribution(classify_authority()).alias("attribution")
    )


def concepts(spark, d):
    return questions(spark, d).select(
        "query_id", F.array_join(g.question_concepts("question"), "|").alias("concepts")
    )


def coverage(spark, d):
    return g.concept_coverage(hits(spark, d), questions(spark, d)).select(
        "query_id", F.array_join("covered", "|").alias("covered"), F.array_join("missing", "|").alias("missing"),
        F.round("coverage", 10).alias("coverage"),
    )


def relevance(spark, d):
    return g.evidence_relevance(hits(spark, d), questions(spark, d)).select(
        "query_id", F.round("evidence_relevance", 10).alias("evidence_relevance")
    )


def sources(spark, d):
    m = g.source_measures(hits(spark, d)).join(questions(spark, d).select("query_id", "needs_authority"), "query_id")
    return m.select(
        "query_id", F.round(g.authority_strength(F.col("needs_authority")), 10).alias("authority_strength"),
        F.round("source_quality", 10).alias("source_quality"),
    )


def conflicts(spark, d):
    return g.evidence_conflicts(hits(spark, d))


def strength(spark, d):
    return g.assess(hits(spark, d), questions(spark, d)).select("query_id", "overall_strength", "has_conflicts")


def strength_without_question(spark, d):
    modes = questions(spark, d).select("query_id", "needs_authority", "document_mode")
    return g.simple_strength(hits(spark, d), modes).select("query_id", "strength")


def items(spark, d):
    return g.evidence_items(hits(spark, d), questions(spark, d)).select(
        "query_id", "ordinal", "authority_type", F.round("support_strength", 10).alias("support_strength"),
        "role", "position",
    )


def bundles(spark, d):
    return g.bundle_metadata(g.evidence_items(hits(spark, d), questions(spark, d))).withColumn(
        "authority_types", F.array_join("authority_types", "|")
    )


def needs_authority(spark, d):
    return questions(spark, d).select(
        "query_id", g.requires_authority("question", "task", F.col("document_mode")).alias("requires_authority")
    )


QUERIES = {
    "authority_class": authority,
    "authority_attribution": attributions,
    "question_concepts": concepts,
    "concept_coverage": coverage,
    "evidence_relevance": relevance,
    "authority_strength": sources,
    "evidence_conflicts": conflicts,
    "evidence_strength": strength,
    "evidence_strength_simple": strength_without_question,
    "evidence_items": items,
    "evidence_bundles": bundles,
    "requires_authority": needs_authority,
}


def _any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def _l(c: str) -> str:
    return f"lower(trim(coalesce({c}, '')))"


_TITLE = "lower(coalesce(display_name, '') || ' ' || coalesce(filename, ''))"
_S, _D, _W, _C = _l("source_type"), _l("document_type"), _l("law_name"), _l("court")
CLASS = f"""CASE
 WHEN {_S} = 'conversation' THEN CASE WHEN {_any(_TITLE, ra.COMMENTARY_WORDS)} THEN 'article_commentary' ELSE 'conversation_document' END
 WHEN {_S} = 'matter' THEN CASE WHEN {_any(_TITLE, ra.COMMENTARY_WORDS)} THEN 'article_commentary' ELSE 'matter_document' END
 WHEN contains({_W}, 'constitution') OR contains({_D}, 'constitution') THEN 'constitution'
 WHEN {_any(_D, ra.STATUTE_WORDS)} OR {_any(_W, ra.STATUTE_WORDS)} THEN 'statute'
 WHEN {_any(_D, ra.RULE_WORDS)} OR {_any(_W, ra.RULE_WORDS)} THEN 'rules'
 WHEN contains({_C}, 'supreme court') OR {_C} IN ('sc', 'supreme') THEN 'supreme_court'
 WHEN contains({_C}, 'high court') OR contains({_W}, 'high court') THEN 'high_court'
 WHEN {_any(_C, ra.TRIBUNAL_WORDS)} OR {_any(_D, ra.TRIBUNAL_WORDS)} THEN 'tribunal'
 WHEN {_S} = 'web' THEN CASE WHEN {_D} = 'official_web' OR {_any(_TITLE, ra.OFFICIAL_SITE_WORDS)} THEN 'web_official' ELSE 'web_search' END
 WHEN {_S} = 'legal' THEN CASE WHEN {_any(_D, ra.JUDGMENT_WORDS)} THEN 'official_legal' ELSE 'legal_corpus' END
 ELSE 'unknown' END"""


def _rank(x: str) -> str:
    return f"CAST(CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {v[0]}" for k, v in ra.AUTHORITIES.items()) + " END AS BIGINT)"


def _phrase(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {lit(v[1])}" for k, v in ra.AUTHORITIES.items()) + " END"


_WORDS = "[" + ", ".join(map(lit, re.CONCEPTS)) + "]"
_STOP = "[" + ", ".join(map(lit, re.QUESTION_STOPWORDS)) + "]"
# Ordered distinct: keep a value only at its first place in the list.
_ORDERED = "list_filter(cs, lambda c, i: list_position(cs, c) = i)"
CONCEPTS_CTE = f"""
cited AS (SELECT *, list_concat(
    list_transform(regexp_extract_all(question, '(?i)\\b(?:section|article|u/s)\\s+([0-9A-Za-z\\-]+)', 1), lambda s: 'section ' || lower(s)),
    list_filter({_WORDS}, lambda w: contains(lower(question), w))) AS cs FROM questions),
concepts AS (SELECT *, {_ORDERED} AS concepts,
    list_filter(regexp_extract_all(lower(question), '[a-z0-9\\-]+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w)) AS terms
  FROM cited)"""


def _in(concept: str, text: str) -> str:
    return (
        f"(contains({text}, {concept}) OR (starts_with({concept}, 'section ') AND "
        f"contains(replace({text}, '-', ''), replace(substring({concept}, 9), '-', ''))))"
    )


_SCORE = "coalesce(nullif(relevance_score, 0), score, 0)"
_CORPUS = "lower(concat_ws(' ', coalesce(text, ''), array_to_string(sections, ' '), law_name))"
COVERAGE_CTE = f"""{CONCEPTS_CTE},
pairs AS (SELECT c.query_id, u.concept, bool_or({_in('u.concept', _CORPUS.replace('text', 'h.text').replace('law_name', 'h.law_name'))}) AS covered
  FROM (SELECT query_id, unnest(concepts) AS concept FROM concepts) u JOIN hits h ON h.query_id = u.query_id
  JOIN concepts c ON c.query_id = u.query_id GROUP BY 1, 2),
got AS (SELECT query_id, list(concept) FILTER (covered) AS found FROM pairs GROUP BY 1),
coverage AS (SELECT c.query_id, c.concepts,
    list_filter(c.concepts, lambda x: list_contains(coalesce(g.found, []), x)) AS covered,
    list_filter(c.concepts, lambda x: NOT list_contains(coalesce(g.found, []), x)) AS missing,
    EXISTS (SELECT 1 FROM hits h WHERE h.query_id = c.query_id) AS any_hit
  FROM concepts c LEFT JOIN got g USING (query_id)),
cov AS (SELECT *, CASE WHEN len(concepts) > 0 THEN CAST(len(covered) AS DOUBLE) / len(concepts)
    WHEN any_hit THEN 1.0 ELSE 0.0 END AS ratio FROM coverage)"""
_T = "lower(coalesce(text, ''))"
RELEVANCE_CTE = f"""
rel AS (SELECT query_id, CASE WHEN any_value(len(terms) = 0 AND len(concepts) = 0) THEN least(1.0, max({_SCORE}))
    ELSE coalesce(avg(CASE WHEN {_T} <> '' THEN least(1.0, 0.65 * (len(list_filter(terms, lambda w: contains({_T}, w)))
      + 2 * len(list_filter(concepts, lambda c: {_in('c', _T)}))) / CAST(greatest(len(terms), 1) + greatest(len(concepts), 1) AS DOUBLE)
      + 0.35 * {_SCORE}) END), 0) END AS relevance
  FROM hits JOIN concepts USING (query_id) GROUP BY query_id)"""
_LEGAL = "coalesce(source_type, 'legal') = 'legal'"
MEASURES_CTE = f"""
m AS (SELECT query_id, count(*) AS hits, count(*) FILTER ({_LEGAL}) AS legal_hits,
    count(*) FILTER (source_type = 'web') AS web_hits,
    max({_SCORE}) FILTER ({_LEGAL}) AS legal_top, max({_SCORE}) FILTER (NOT {_LEGAL}) AS private_top,
    max({_SCORE}) FILTER (source_type = 'web') AS web_top,
    least(1.0, avg({_SCORE}) * 0.75 + count(DISTINCT coalesce(source_type, '')) / 4.0 * 0.25) AS quality
  FROM hits GROUP BY query_id)"""
_STRENGTH = """CASE WHEN needs_authority THEN CASE WHEN legal_hits > 0 THEN least(1.0, 0.55 + 0.45 * legal_top)
   WHEN hits > 0 THEN least(0.35, private_top * 0.35) ELSE 0.0 END
   ELSE least(1.0, greatest(coalesce(legal_top, 0), coalesce(private_top, 0))) END"""


def _clash(column: str) -> str:
    return "(" + " OR ".join(
        f"(bool_or(contains({column}, {lit(a)})) AND bool_or(contains({column}, {lit(b)})))" for a, b in re.OPPOSING
    ) + ")"


CONFLICT_CTE = f"""
filled AS (SELECT query_id, lower(text) AS t, source_type,
   unnest(list_concat(['*'], list_transform(regexp_extract_all(text, '(?i)\\b(?:section|sec\\.?|u/s|article)\\s+([0-9A-Za-z\\-]+)', 1), lambda s: lower(s)))) AS grp
   FROM hits WHERE coalesce(text, '') <> ''),
groups AS (SELECT query_id, grp, count(*) AS n, {_clash('t')} AS clash FROM filled
   WHERE grp <> '*' OR {_LEGAL} GROUP BY 1, 2),
conflict AS (SELECT query_id, coalesce(bool_or(n >= 2 AND clash) AND max(n) FILTER (grp = '*') >= 2, false) AS has_conflicts
   FROM (SELECT query_id, grp, n, clash FROM groups UNION ALL SELECT DISTINCT query_id, '-', 0, false FROM hits) GROUP BY 1)"""

_BASE = with_ctes(HITS_CTE, QUESTIONS_CTE)
ORACLE = {
    "authority_class": with_ctes(HITS_CTE)
    + f"SELECT ordinal, a AS authority_type, {_rank('a')} AS authority_rank FROM (SELECT ordinal, {CLASS} AS a FROM hits)",
    "authority_attribution": with_ctes(HITS_CTE)
    + f"SELECT ordinal, {_phrase('a')} AS attribution FROM (SELECT ordinal, {CLASS} AS a FROM hits)",
    "question_concepts": with_ctes(QUESTIONS_CTE, CONCEPTS_CTE)
    + "SELECT query_id, array_to_string(concepts, '|') AS concepts FROM concepts",
    "concept_coverage": with_ctes(HITS_CTE, QUESTIONS_CTE, COVERAGE_CTE) + """
SELECT query_id, array_to_string(covered, '|') AS covered, array_to_string(missing, '|') AS missing,
  round(ratio, 10) AS coverage FROM cov""",
    "evidence_relevance": with_ctes(HITS_CTE, QUESTIONS_CTE, CONCEPTS_CTE, RELEVANCE_CTE)
    + "SELECT query_id, round(relevance, 10) AS evidence_relevance FROM rel",
    "authority_strength": with_ctes(HITS_CTE, QUESTIONS_CTE, MEASURES_CTE)
    + f"SELECT query_id, round({_STRENGTH}, 10) AS authority_strength, round(quality, 10) AS source_quality FROM m JOIN questions USING (query_id)",
    "evidence_conflicts": with_ctes(HITS_CTE, CONFLICT_CTE) + "SELECT query_id, has_conflicts FROM conflict",
    "evidence_strength": with_ctes(HITS_CTE, QUESTIONS_CTE, COVERAGE_CTE, RELEVANCE_CTE, MEASURES_CTE, CONFLICT_CTE) + f"""
, j AS (SELECT q.query_id, q.needs_authority, q.document_mode, q.prefer_web, c.concepts, c.ratio, coalesce(m.hits, 0) AS hits,
   coalesce(m.legal_hits, 0) AS legal_hits, coalesce(m.web_hits, 0) AS web_hits, legal_top, private_top,
   coalesce(private_top, 0) AS p, coalesce(web_top, 0) AS w, coalesce(quality, 0) AS quality,
   coalesce(relevance, 0) AS relevance, coalesce(has_conflicts, false) AS has_conflicts
   FROM questions q JOIN cov c USING (query_id) LEFT JOIN m USING (query_id) LEFT JOIN rel USING (query_id) LEFT JOIN conflict USING (query_id)),
k AS (SELECT *, 0.35 * ({_STRENGTH}) + 0.30 * relevance + 0.25 * ratio + 0.10 * quality AS comp FROM j)
SELECT query_id, has_conflicts, CASE WHEN hits = 0 THEN 'none'
 WHEN document_mode THEN CASE WHEN p >= 0.45 AND relevance >= 0.35 THEN 'strong' WHEN p >= 0.25 THEN 'partial'
   WHEN prefer_web AND w >= 0.4 THEN 'partial' ELSE 'none' END
 WHEN needs_authority AND legal_hits = 0 THEN CASE WHEN web_hits > 0 THEN
     CASE WHEN w >= 0.45 OR (prefer_web AND w >= 0.35) THEN 'partial' ELSE 'weak' END
   WHEN p >= 0.30 THEN 'weak' ELSE 'none' END
 WHEN needs_authority AND len(concepts) >= 2 AND ratio < 0.5 THEN
   CASE WHEN comp >= 0.55 THEN 'partial' WHEN comp >= 0.35 THEN 'weak' ELSE 'none' END
 WHEN needs_authority THEN CASE WHEN comp >= 0.7 THEN 'strong' WHEN comp >= 0.45 THEN 'partial' WHEN comp >= 0.25 THEN 'weak' ELSE 'none' END
 WHEN comp >= 0.6 THEN 'strong' WHEN comp >= 0.35 THEN 'partial' ELSE 'weak' END AS overall_strength FROM k""",
    "evidence_strength_simple": _BASE + f"""
SELECT query_id, CASE WHEN document_mode THEN CASE WHEN n = l THEN 'none' WHEN p >= 0.25 THEN 'strong' ELSE 'partial' END
 WHEN needs_authority THEN CASE WHEN l > 0 AND t >= 0.45 THEN 'strong' WHEN l > 0 THEN 'partial' WHEN n > 0 THEN 'weak' ELSE 'none' END
 WHEN l > 0 AND t >= 0.4 THEN 'strong' WHEN n > 0 THEN 'partial' ELSE 'none' END AS strength
FROM (SELECT q.query_id, q.document_mode, q.needs_authority, count(h.ordinal) AS n, count(h.ordinal) FILTER (h.source_type = 'legal') AS l,
  coalesce(max({_SCORE}) FILTER (h.source_type = 'legal'), 0) AS t,
  coalesce(max({_SCORE}) FILTER (h.source_type IS DISTINCT FROM 'legal'), 0) AS p
  FROM questions q LEFT JOIN hits h USING (query_id) GROUP BY ALL)""",
    "requires_authority": with_ctes(QUESTIONS_CTE) + f"""
SELECT query_id, NOT document_mode AND (coalesce(task IN ('legal_qa', 'case_search', 'statute_search', 'legal_research'), false)
  OR {_any('lower(question)', re.AUTHORITY_MARKERS)}) AS requires_authority FROM questions""",
}
ITEMS = with_ctes(HITS_CTE, QUESTIONS_CTE, CONCEPTS_CTE) + f""",
g AS (SELECT query_id, ordinal, {CLASS} AS authority_type, {_SCORE} AS rel, needs_authority, document_mode, concepts, {_T} AS t
   FROM hits JOIN (SELECT query_id, concepts, needs_authority, document_mode FROM concepts) USING (query_id)),
s AS (SELECT *, {_rank('authority_type')} AS rk FROM g),
u AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE least(1.0, rel * 0.45 + 0.40 * CASE WHEN len(concepts) > 0 THEN
   CAST(len(list_filter(concepts, lambda c: contains(t, c))) AS DOUBLE) / len(concepts) ELSE rel END + rk / 100.0 * 0.15) END AS sup FROM s),
items AS (SELECT query_id, ordinal, authority_type, round(sup, 10) AS support_strength, CASE
   WHEN sup >= 0.62 AND rel >= 0.35 THEN CASE WHEN needs_authority AND NOT document_mode AND rk < 50 AND sup < 0.75 THEN 'weak' ELSE 'supporting' END
   WHEN sup >= 0.4 THEN 'relevant' WHEN rel >= 0.25 THEN 'weak' ELSE 'retrieved' END AS role,
   row_number() OVER (PARTITION BY query_id ORDER BY round(sup, 12) DESC, rk DESC, rel DESC, ordinal) AS position FROM u)
"""
ORACLE["evidence_items"] = ITEMS + "SELECT * FROM items"
ORACLE["evidence_bundles"] = ITEMS + """
SELECT query_id, count(*) AS evidence_count, count(*) FILTER (role IN ('supporting', 'relevant')) AS supporting_count,
  CAST(0 AS BIGINT) AS contradicting_count, string_agg(DISTINCT authority_type, '|' ORDER BY authority_type) AS authority_types
FROM items GROUP BY query_id"""
