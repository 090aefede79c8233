"""Family M: contract review tables, playbooks and redlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.operators import contracts as c
from evidex.plans.common import DOCS_CTE, collapse, lit, strip, with_ctes
from evidex.plans.hits import case
from evidex.rules import contracts as r
from evidex.sources import tables as t

# Extraction outputs as a model might return them, quoting words of the document.
QUOTE = "regexp_extract(text, '[A-Za-z]+( [A-Za-z]+){3,9}', 0)"
BODY = f"""concat('{{"fields": [{{"key": "Parties", "value": "Acme and ', source, '", "quote": "', {QUOTE}, '", "status": "found", "confidence": 0.9}}, ',
 '{{"key": "governing_law", "value": ', {case('doc_id % 4', ['"laws of Pakistan"', '"Delaware law"', 'null', '"local law"'])}, ', "quote": "made up words of law", "status": "found", "confidence": 1.7}}, ',
 '{{"key": "liability_cap", "value": ', {case('doc_id % 3', ['"liability shall be unlimited"', '"capped at fees"', '"-"'])}, ', "status": "FOUND", "confidence": "high"}}, ',
 '{{"key": "dispute_resolution", "value": "arbitration abroad", "status": "odd"}}, {{"key": "indemnity", "status": "missing", "confidence": 0.8}}, ',
 '{{"key": "assignment", "value": "may freely assign", "status": "found"}}, {{"key": "payment", "value": ', doc_id, ', "status": "error"}}]}}')"""
FLAT = "concat('{\"term\": {\"value\": \"', doc_id, ' years\", \"status\": \"found\"}, \"renewal\": \"n/a\"}')"
OUTPUT = (
    f"CASE WHEN doc_id % 5 = 0 THEN concat('<think>{{not this}}</think>\n```json\n', {BODY}, '\n```') "
    f"WHEN doc_id % 5 = 1 THEN concat('Here you are: ', {BODY}, ' Done.') WHEN doc_id % 5 = 2 THEN {FLAT} "
    f"WHEN doc_id % 5 = 3 THEN 'no json at all' ELSE {BODY} END"
)


def outputs(spark, d):
    return t.load(spark, d, "documents").select("doc_id", F.expr(OUTPUT).alias("output"))


def field_sets(spark, d):
    rows = t.load(spark, d, "conversations").selectExpr(
        "concat(conv_id, ':', turn) AS request_id",
        "CASE WHEN conv_id % 3 = 0 THEN array('Term ', role, 'payment') WHEN conv_id % 3 = 1 THEN array(role) END AS keys",
        "CASE WHEN turn % 2 = 0 THEN transform(sequence(0, 9), i -> named_struct('key', concat(' Q', i % 9), 'label', "
        "CASE WHEN i % 2 = 0 THEN concat('L', i) ELSE '' END, 'question', concat('Why ', i, '? '))) END AS extra",
    )
    return c.resolve_fields(rows)


def parsed(spark, d):
    return c.parse_outputs(outputs(spark, d))


def cards(spark, d):
    return c.clause_cards(parsed(spark, d), t.docs(spark, d))


def card_table(spark, d):
    return cards(spark, d).drop("position", "label")


def _documents(spark, d):
    return t.docs(spark, d).withColumn("created_at", F.expr("(doc_id * 37) % 101"))


def _scopes(spark, d):
    """Matters and conversations as review scopes; users see the matters they own documents in."""
    return t.docs(spark, d).filter("matter_id IS NOT NULL OR conversation_id IS NOT NULL").selectExpr(
        "concat(user_id, '/', coalesce(matter_id, '-'), '/', coalesce(conversation_id, '-')) AS scope_id", "user_id", "matter_id", "conversation_id",
    ).distinct()


def reviews(spark, d):
    return c.review_table(cards(spark, d), _documents(spark, d), _scopes(spark, d))


def findings(spark, d):
    return c.evaluate_playbook(cards(spark, d)).select("doc_id", "key", "verdict", "reason", "severity", "required")


def summaries(spark, d):
    return c.playbook_summary(c.evaluate_playbook(cards(spark, d)))


# Two versions of every document: untouched, with a clause added, or with words changed in some paragraphs.
LEFT = "replace(text, '\n', '\n\n')"
RIGHT = (
    f"CASE WHEN doc_id % 4 = 0 THEN {LEFT} WHEN doc_id % 4 = 1 THEN concat({LEFT}, '\n\nThe term is two years.') "
    f"WHEN doc_id % 4 = 2 THEN concat('Preamble.\n\n', {LEFT}) ELSE replace({LEFT}, 'tion.\n', 'xion.\n') END"
)


def versions(spark, d):
    return t.load(spark, d, "documents").selectExpr("doc_id AS pair_id", f"{LEFT} AS left_text", f"{RIGHT} AS right_text")


def redlines(spark, d):
    return c.document_hunks(versions(spark, d)).select(
        "pair_id", "hunk_index", "label", F.md5("left").alias("left_md5"), F.md5("right").alias("right_md5"),
        F.size("spans").cast("bigint").alias("spans"), F.md5(c.spans_to_markdown("spans")).alias("markdown_md5"),
    )


def redline_flags(spark, d):
    return c.unchanged_pairs(versions(spark, d))


def playbook_redlines(spark, d):
    h = c.playbook_hunks(c.evaluate_playbook(cards(spark, d)))
    return h.select("doc_id", "key", "left", F.md5("right").alias("right_md5"), c.spans_to_html("spans").alias("html"))


SPANS = "array(struct('equal' AS op, 'The <b> ' AS text), struct('delete' AS op, concat(source, ' & ', lang) AS text), struct('insert' AS op, concat(doc_id, '\n') AS text))"


def rendered(spark, d):
    rows = t.load(spark, d, "documents").select("doc_id", F.expr(SPANS).alias("spans"))
    return rows.select("doc_id", c.spans_to_markdown("spans").alias("markdown"), c.spans_to_html("spans").alias("html"))


def pairs(spark, d):
    scopes = _scopes(spark, d).join(
        t.docs(spark, d).filter("doc_id % 3 = 0").groupBy("user_id").agg(F.max("document_id").alias("pinned_id")), "user_id", "left"
    )
    return c.choose_pairs(_documents(spark, d), scopes)


QUERIES = {
    "clause_fields": field_sets,
    "parse_extractions": parsed,
    "clause_cards": card_table,
    "review_table": reviews,
    "playbook_findings": findings,
    "playbook_summary": summaries,
    "redline_documents": redlines,
    "redline_unchanged": redline_flags,
    "redline_playbook": playbook_redlines,
    "render_spans": rendered,
    "redline_pairs": pairs,
}

_ALL = "[" + ", ".join(f"{{'key': {lit(k)}, 'label': {lit(l)}, 'question': {lit(q)}}}" for k, l, q in r.FIELDS) + "]"
_KEYS = "[" + ", ".join(lit(f[0]) for f in r.FIELDS) + "]"
_GRID = "(VALUES " + ", ".join(f"({i}, {lit(f[0])})" for i, f in enumerate(r.FIELDS)) + ") g(pos, key)"
_EMPTY = "(" + ", ".join(lit(v) for v in r.EMPTY_VALUES) + ")"
# The rows the outputs hold, stated directly.
_FULL = "doc_id % 5 IN (0, 1, 4)"
PARSED_CTE = f"""
q AS (SELECT doc_id, text, source, {QUOTE} AS quote FROM documents),
parsed AS (
  SELECT doc_id, 'parties' AS key, 'Acme and ' || source AS value, quote, 'found' AS status, 0.9 AS confidence FROM q WHERE {_FULL}
  UNION ALL SELECT doc_id, 'governing_law', {case('doc_id % 4', ['laws of Pakistan', 'Delaware law', None, 'local law'])}, 'made up words of law', 'found', 1.7 FROM q WHERE {_FULL}
  UNION ALL SELECT doc_id, 'liability_cap', {case('doc_id % 3', ['liability shall be unlimited', 'capped at fees', '-'])}, NULL, 'FOUND', NULL FROM q WHERE {_FULL}
  UNION ALL SELECT doc_id, 'dispute_resolution', 'arbitration abroad', NULL, 'odd', NULL FROM q WHERE {_FULL}
  UNION ALL SELECT doc_id, 'indemnity', NULL, NULL, 'missing', 0.8 FROM q WHERE {_FULL}
  UNION ALL SELECT doc_id, 'assignment', 'may freely assign', NULL, 'found', NULL FROM q WHERE {_FULL}
  UNION ALL SELECT doc_id, 'payment', CAST(doc_id AS VARCHAR), NULL, 'error', NULL FROM q WHERE {_FULL}
  UNION ALL SELECT doc_id, 'term', doc_id || ' years', NULL, 'found', NULL FROM q WHERE doc_id % 5 = 2
  UNION ALL SELECT doc_id, 'renewal', 'n/a', NULL, NULL, NULL FROM q WHERE doc_id % 5 = 2)"""
CARDS_CTE = f"""{PARSED_CTE},
flat AS (SELECT doc_id, lower({collapse('text')}) AS t FROM documents),
base AS (SELECT f.doc_id, g.pos, g.key, f.t, p.key IS NOT NULL AS has, p.confidence, lower(coalesce(p.status, '')) AS st,
   CASE WHEN lower(trim(p.value)) NOT IN {_EMPTY} THEN trim(p.value) END AS value, CASE WHEN p.quote <> '' THEN p.quote END AS qt
   FROM flat f, {_GRID} LEFT JOIN parsed p ON p.doc_id = f.doc_id AND p.key = g.key),
grounded AS (SELECT *, coalesce(t <> '' AND CASE WHEN length(qt) < 12 THEN contains(t, lower(qt)) ELSE contains(t, lower(qt))
     OR (len(string_split(qt, ' ')) >= 6 AND contains(t, lower(array_to_string(string_split(qt, ' ')[1:6], ' ')))) END, false) AS ok FROM base),
stat AS (SELECT *, CASE WHEN ok THEN qt END AS quote, CASE WHEN NOT has THEN 'unclear' WHEN value IS NULL AND NOT ok THEN 'missing'
     WHEN st NOT IN ('found', 'missing', 'unclear', 'error') THEN 'unclear' WHEN st = 'found' AND value IS NULL THEN 'unclear' ELSE st END AS status FROM grounded),
cards AS (SELECT doc_id, pos, key, status, value, quote, ok AS quote_grounded, CAST(CASE WHEN NOT has THEN 0 WHEN status = 'missing' THEN least(0.4, coalesce(confidence, 0.5))
     ELSE greatest(0, least(1, coalesce(confidence, 0.5))) END AS DOUBLE) AS confidence FROM stat)"""


def _says(words) -> str:
    return "(" + " OR ".join(f"contains(hay, {lit(w)})" for w in words) + ")" if words else "false"


def _rule_case(field: str) -> str:
    return "CASE key " + " ".join(f"WHEN {lit(x['key'])} THEN {_says(x.get(field, []))}" for x in r.PLAYBOOK) + " END"


def _attr(field: str) -> str:
    return "CASE key " + " ".join(f"WHEN {lit(x['key'])} THEN {lit(str(x.get(field, '')))}" for x in r.PLAYBOOK) + " END"


_OTHER = "key IN (" + ", ".join(lit(x["key"]) for x in r.PLAYBOOK if x.get("accept") or x.get("fallback")) + ")"
FINDINGS_CTE = f"""{CARDS_CTE},
hay AS (SELECT *, {collapse("lower(replace(coalesce(value, '') || ' ' || coalesce(quote, ''), '’', ''''))")} AS hay FROM cards),
outc AS (SELECT *, CASE WHEN status = 'error' THEN 'no_card' WHEN status = 'unclear' AND value IS NULL THEN 'unclear'
   WHEN status = 'missing' AND value IS NULL THEN CASE WHEN {_attr('required')} = 'True' THEN 'missing' ELSE 'absent' END
   WHEN {_rule_case('reject')} THEN 'rejected' WHEN {_rule_case('accept')} THEN 'preferred' WHEN {_rule_case('fallback')} THEN 'fallback'
   WHEN {_OTHER} THEN 'other' ELSE 'present' END AS oc FROM hay),
verd AS (SELECT *, CASE oc WHEN 'no_card' THEN 'unclear' WHEN 'unclear' THEN 'unclear' WHEN 'missing' THEN 'missing' WHEN 'absent' THEN 'not_applicable'
   WHEN 'rejected' THEN 'off_playbook' WHEN 'preferred' THEN 'pass' WHEN 'fallback' THEN 'fallback' WHEN 'other' THEN 'off_playbook' ELSE 'pass' END AS verdict,
   CASE oc {' '.join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in r.REASONS.items())} END AS why, {_attr('notes')} AS notes FROM outc),
findings AS (SELECT doc_id, key, verdict, CASE WHEN verdict IN ('off_playbook', 'missing') AND notes <> '' THEN why || ' ' || notes ELSE why END AS reason,
   {_attr('severity')} AS severity, {_attr('required')} = 'True' AS required FROM verd)"""
SCOPES_CTE = f"""{DOCS_CTE},
listing AS (SELECT *, (doc_id * 37) % 101 AS created_at FROM docs WHERE {strip('text')} <> ''),
scopes AS (SELECT DISTINCT user_id || '/' || coalesce(matter_id, '-') || '/' || coalesce(conversation_id, '-') AS scope_id, user_id, matter_id, conversation_id
   FROM docs WHERE matter_id IS NOT NULL OR conversation_id IS NOT NULL),
listed AS (SELECT s.scope_id, s.user_id AS owner, d.document_id, d.doc_id, row_number() OVER (PARTITION BY s.scope_id ORDER BY CASE WHEN d.scope = 'matter' THEN 0 ELSE 1 END, created_at DESC, d.document_id) AS position,
   count(*) OVER (PARTITION BY s.scope_id) AS n FROM scopes s JOIN listing d ON d.user_id = s.user_id
   AND ((d.scope = 'matter' AND d.matter_id = s.matter_id) OR (d.scope = 'conversation' AND d.conversation_id = s.conversation_id)))"""

ORACLE = {
    "clause_fields": f"""
WITH rq AS (SELECT conv_id || ':' || turn AS request_id, conv_id, turn, role FROM conversations),
dflt AS (SELECT {_ALL} AS fs),
picked AS (SELECT rq.*, fs, list_filter(list_transform(CASE WHEN conv_id % 3 = 0 THEN ['term', lower(role), 'payment'] WHEN conv_id % 3 = 1 THEN [lower(role)] ELSE [] END,
   lambda k: list_filter(fs, lambda f: f.key = k)[1]), lambda f: f IS NOT NULL) AS known FROM rq, dflt),
base AS (SELECT *, CASE WHEN len(known) > 0 THEN known ELSE fs END AS b FROM picked),
ext AS (SELECT *, CASE WHEN turn % 2 = 0 THEN list_transform(range(0, 8), lambda i: {{'key': 'q' || i, 'label': CASE WHEN i % 2 = 0 THEN 'L' || i ELSE 'Why ' || i || '?' END,
   'question': 'Why ' || i || '?'}}) ELSE [] END AS e FROM base),
al AS (SELECT request_id, list_concat(b, e) AS a FROM ext),
un AS (SELECT request_id, unnest(a) AS f, generate_subscripts(a, 1) - 1 AS position FROM al)
SELECT request_id, CAST(position AS BIGINT) AS position, f.key AS key, f.label AS label, f.question AS question FROM un""",
    "parse_extractions": f"WITH {PARSED_CTE} SELECT doc_id, key, value, quote, status, CAST(confidence AS DOUBLE) AS confidence FROM parsed",
    "clause_cards": f"WITH {CARDS_CTE} SELECT doc_id, key, status, value, quote, quote_grounded, confidence FROM cards",
    "playbook_findings": f"WITH {FINDINGS_CTE} SELECT doc_id, key, verdict, reason, severity, required FROM findings",
    "playbook_summary": f"""WITH {FINDINGS_CTE} SELECT doc_id, count(*) FILTER (verdict = 'pass') AS pass_count, count(*) FILTER (verdict = 'fallback') AS fallback_count,
  count(*) FILTER (verdict = 'missing') AS missing_count, count(*) FILTER (verdict = 'off_playbook') AS off_playbook_count, count(*) FILTER (verdict = 'unclear') AS unclear_count,
  count(*) FILTER (severity = 'blocker' AND verdict IN ('missing', 'off_playbook', 'unclear')) AS blocker_count FROM findings GROUP BY doc_id""",
    "review_table": f"""WITH {CARDS_CTE}, {SCOPES_CTE},
pv AS (SELECT doc_id, {', '.join(f"max(value) FILTER (key = {lit(f[0])}) AS {f[0]}" for f in r.FIELDS)} FROM cards GROUP BY doc_id)
SELECT scope_id, document_id, position, n AS document_count, n > 20 AS truncated_documents, {', '.join(f[0] for f in r.FIELDS)}
FROM listed LEFT JOIN pv USING (doc_id) WHERE position <= 20""",
    "redline_pairs": f"""WITH {SCOPES_CTE},
pin AS (SELECT user_id, max(document_id) AS pinned FROM docs WHERE doc_id % 3 = 0 GROUP BY 1),
rk AS (SELECT scope_id, document_id, row_number() OVER (PARTITION BY scope_id ORDER BY coalesce(document_id = pinned, false) DESC, position) AS k
   FROM listed LEFT JOIN pin ON owner = pin.user_id)
SELECT scope_id, max(document_id) FILTER (k = 1) AS left_id, max(document_id) FILTER (k = 2) AS right_id FROM rk WHERE k <= 2 GROUP BY 1""",
    "redline_unchanged": """
WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS pair_id, doc_id, replace(text, chr(10), chr(10) || chr(10)) AS l FROM documents)
SELECT pair_id, doc_id % 4 = 0 OR (doc_id % 4 = 3 AND NOT contains(l, 'tion.' || chr(10))) AS unchanged FROM p""",
    "render_spans": """
SELECT doc_id, 'The <b> ~~' || source || ' & ' || lang || '~~**' || doc_id || ' **' AS markdown,
  'The &lt;b&gt; <del class="redline-del">' || source || ' &amp; ' || lang || '</del><ins class="redline-ins">' || doc_id || chr(10) || '</ins>' AS html FROM documents""",
}
