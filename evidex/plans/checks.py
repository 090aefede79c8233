"""Further oracle SQL: question plans, screening, languages, claims and history."""

from __future__ import annotations

from evidex.functions import text as tx
from evidex.operators import language as lang
from evidex.operators import question as q
from evidex.plans import answers as pa
from evidex.plans import questions as pq
from evidex.plans import streams as ps
from evidex.plans.common import DOCS_CTE, QUOTED_SPACE, collapse, lit, strip, with_ctes
from evidex.plans.hits import HITS_CTE, case
from evidex.plans.ingest import _LINES, _STEM, _by
from evidex.operators.pack import CONTEXT_HEADER
from evidex.plans.packing import _BLOCK, _REF, _TITLES, CUED_CTE, ISSUE, excerpt, pieces, scaled
from evidex.plans.walks import SELECTED
from evidex.rules import answers as ra
from evidex.rules import language as rl
from evidex.rules import questions as rq
from evidex.rules import safety as rs
from evidex.sources import tables as t

ORACLE: dict = {}
QUERIES: dict = {}


def _any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def _list(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def m(x: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({x}, '(?{flags})" + pattern.replace("'", "''") + "')"


def distinct(x: str) -> str:
    """Ordered distinct ignoring case and outer blanks."""
    keys = f"list_transform({x}, lambda v: lower({strip('v')}))"
    return f"list_filter({x}, lambda v, i: {strip('v')} <> '' AND list_position({keys}, lower({strip('v')})) = i)"


# --- enriched chunks ------------------------------------------------------------------
ORACLE["enrich_chunks"] = with_ctes(HITS_CTE) + f"""
, dd AS (SELECT document_id AS did, filename AS fname, matter_id, {_LINES} AS ls, {_STEM} AS stem FROM docs)
, nm AS (SELECT *, CASE WHEN len(ls) > 0 AND length(ls[1]) <= 120 AND NOT regexp_matches(lower(ls[1]), '^(section|chapter|page) ')
   AND ((len(ls) > 1 AND {_by('ls[2]')}) OR (length(ls[1]) <= 80 AND ((upper(ls[1]) = ls[1] AND lower(ls[1]) <> ls[1]) OR right(ls[1], 1) <> '.')))
   THEN ls[1] ELSE stem END AS dname, list_filter(ls, lambda l: {_by('l')})[1] AS au FROM dd)
SELECT ordinal, document_id, CASE WHEN ordinal % 2 = 0 THEN filename ELSE fname END AS filename,
  CASE WHEN did IS NOT NULL THEN dname ELSE display_name END AS display_name, au AS author, matter_id
FROM hits LEFT JOIN nm ON hits.document_id = nm.did"""

# --- question plans -----------------------------------------------------------------------
_MODE = "CASE task2 " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in rq.ANSWER_MODES.items()) + \
    " ELSE CASE WHEN has_uploads THEN 'general_legal_qa' ELSE 'general_chat' END END"
PLANS_CTE = f"""{pq.ROUTE_CTE},
p1 AS (SELECT *, document_id IS NOT NULL AS pinned, coalesce({pq._ACTION}, {pq._PROMPT}) AS act FROM routed),
p2 AS (SELECT *, CASE WHEN pinned AND act IS NULL AND task NOT IN ('summarization', 'document_qa', 'mixed_qa', 'contract_review', 'review_table', 'playbook_review', 'redline')
   THEN 'document_qa' ELSE task END AS task2 FROM p1),
p3 AS (SELECT *, {_MODE} AS mode FROM p2),
p4 AS (SELECT *, lower(flat) AS l, len(regexp_extract_all(flat, '[^{tx.SPACE}]+')) AS w, len(regexp_extract_all(question, '[^{tx.SPACE}]+')) AS qw FROM p3),
p5 AS (SELECT *, len(list_distinct(regexp_extract_all(l, '{rq.COMPLEXITY_SECTION}', 1))) + len(list_filter({_list(rq.COMPLEXITY_CONCEPTS)}, lambda x: contains(l, x))) AS k,
   {_any('l', rq.RESEARCH_MARKERS)} AS res FROM p4),
plans AS (SELECT *, CASE WHEN pinned AND mode IN ('document_qa', 'summarization') THEN 'document_scoped' WHEN mode = 'mixed_legal_analysis' THEN 'mixed_doc_and_law'
   WHEN mode IN ('document_qa', 'summarization') THEN 'private_docs_first' WHEN mode IN ('general_chat', 'review_table', 'playbook_review', 'redline') THEN 'none' ELSE 'legal_first' END AS strategy,
   mode IN ('legal_research', 'mixed_legal_analysis', 'general_legal_qa', 'hearing_prep', 'compare_provisions') AS authority,
   pinned AND mode IN ('document_qa', 'summarization', 'review_table', 'playbook_review', 'redline') AS scoped,
   CASE WHEN mode = 'mixed_legal_analysis' OR {_any('l', rq.COMPLEX_MARKERS)} THEN 'complex'
     WHEN has_history AND qw <= 12 AND w <= 12 AND {_any('l', rq.FOLLOW_UP_PHRASES)} THEN 'research' WHEN regexp_matches(l, '{pq._SIMPLE}') THEN 'simple'
     WHEN mode IN ('document_qa', 'summarization') AND NOT res AND w <= 14 THEN 'simple' WHEN k >= 3 THEN 'complex' WHEN res OR (k >= 2 AND contains(l, '?')) THEN 'research'
     WHEN task2 IN ({', '.join(lit(x) for x in rq.COMPLEX_TASKS)}) THEN 'complex' WHEN w <= 10 AND k <= 1 THEN 'simple' ELSE 'research' END AS cx FROM p5)"""
_FIELDS = pq.ORACLE["question_plan_fields"]
_FIELDS = _FIELDS[_FIELDS.index("SELECT conv_id, turn, CASE WHEN"):].replace("SELECT conv_id, turn,", "").replace(" FROM e", "")
ORACLE["question_plans"] = with_ctes(PLANS_CTE) + f"""
, e AS (SELECT *, {pq.ENT} AS ent, {pq.STA} AS sta FROM plans)
SELECT conv_id, turn, task2 AS task, mode AS answer_mode, strategy AS retrieval_strategy, cx AS complexity, authority AS requires_authority, scoped AS document_scoped,
  {_FIELDS} FROM e"""
ORACLE["planner_accuracy"] = with_ctes(PLANS_CTE) + f"""
, cs AS ({t.select_sql(ps.CASES, 'conversations')} WHERE role = 'user'),
j AS (SELECT expected_mode, CAST(mode IS NOT DISTINCT FROM expected_mode AS INT) AS a, CAST(authority = expected_authority AS INT) AS b FROM cs JOIN plans USING (conv_id, turn))
SELECT CASE WHEN grouping(expected_mode) = 1 THEN 'all' ELSE expected_mode END AS mode, count(*) AS cases, round(avg(a), 10) AS mode_accuracy, round(avg(b), 10) AS authority_accuracy
FROM j GROUP BY ROLLUP (expected_mode)"""

# --- rewriting ---------------------------------------------------------------------------
_EXPANDED = "flat"
for _short, _full in rq.ABBREVIATIONS:
    _EXPANDED = f"regexp_replace({_EXPANDED}, '(?i)\\b{_short}\\b', {lit(_full)}, 'g')"
_EXTRA = (
    "list_concat(list_concat(" + distinct(
        "list_filter(list_transform(list_concat(regexp_extract_all(x, 'دفعہ\\s*([0-9A-Za-z\\-]+)', 1), regexp_extract_all(x, '(?i)\\bdafaa?\\s+([0-9A-Za-z\\-]+)', 1)), "
        "lambda s: 'section ' || s), lambda s: NOT contains(lower(x), lower(s)))"
    ) + ", CASE WHEN contains(x, 'ضمانت') AND NOT contains(lower(x), 'bail') THEN ['bail'] ELSE [] END), "
    "CASE WHEN regexp_matches(x, '(?i)\\bzamaan?at\\b') AND NOT contains(lower(x), 'bail') THEN ['bail'] ELSE [] END)"
)
_KEYWORDS = "CASE task " + " ".join(f"WHEN {lit(k)} THEN ' ' || {lit(v)}" for k, v in rq.TASK_KEYWORDS.items()) + " ELSE '' END"
ORACLE["rewrite_questions"] = with_ctes(pq.ROUTE_CTE) + f"""
, ex AS (SELECT conv_id, turn, task, {_EXPANDED} AS x FROM routed), ad AS (SELECT *, {_EXTRA} AS extra FROM ex)
SELECT conv_id, turn, md5(x || CASE WHEN len(extra) > 0 THEN ' ' || array_to_string(extra, ' ') ELSE '' END || {_KEYWORDS}) AS query_md5 FROM ad"""

# --- screening ----------------------------------------------------------------------------
_HOW = r"\bhow (?:to|do i|can i|would i|could i) (?:kill|murder|poison|shoot|stab|strangle)"
_CRIME_REST = rs.CRIME_HELP[rs.CRIME_HELP.index("case)\\b") + len("case)\\b|"):]
_LEGAL = (
    "(" + m("x", r"\b(?:" + "|".join(rs.LEGAL_WORDS) + r")(?:es|s)?\b") + " OR " + _any("x", rs.LEGAL_PHRASES) + " OR "
    + m("x", rs.CITED_SECTION.replace("دفعہ", "law")) + " OR " + m("x", rs.CITED_CASE) + " OR " + m("x", rs.CONCEPT_QUESTION) + ")"
)
_MSG = f"""lower({collapse("regexp_replace(text, '[" + chr(0x200b) + chr(0x200c) + chr(0x200d) + chr(0xfeff) + "]', '', 'g')")})"""
for _word in tx.SPELLED_OUT:
    _MSG = f"regexp_replace({_MSG}, '{tx.spelled_out_pattern(_word)}', '{_word}', 'g')"


def _with(name: str, old: str) -> str:
    return old.replace("regexp_matches(x", f"regexp_matches({name}").replace("contains(x", f"contains({name}")


FACTS_CTE = f"""{pq.ASKED_CTE},
f0 AS (SELECT *, {_MSG} AS x FROM asked),
f1 AS (SELECT *, {collapse("regexp_replace(x, '(?i)" + rs.OVERRIDE.replace("'", "''") + "', ' ', 'g')")} AS bare, {m('x', rs.LEGAL_CODE)} AS lc FROM f0),
facts AS (SELECT *, ({_any('x', rs.URDU_CODE)} AND NOT lc) OR (({m('x', rs.CODE_REQUEST)} OR {m('x', rs.LANGUAGE_CODE_REQUEST)}) AND NOT (lc AND NOT {m('x', rs.PROGRAMMING_LANGUAGE)})) AS code,
   {_any('x', rs.URDU_CRIME)} OR {m("regexp_replace(x, '(?i)" + _HOW + " (?:a |the )?case', 'z', 'g')", _HOW + r"\b")} OR {m('x', _CRIME_REST)} AS crime,
   {_LEGAL} AS legal, {m('x', rs.FOLLOW_UP)} AS follow, {m('x', rs.OFF_TOPIC)} AS off, {_any('x', rs.URDU_OFF_TOPIC)} AS offu, bare <> x AS over,
   bare <> '' AND {_with('bare', _LEGAL)} AS barelegal, {m('x', rs.GREETING)} AS greet,
   {m('x', r"\b(?:" + "|".join(rs.FACT_WORDS) + r")(?:es|s)?\b")} OR {_any('x', rs.FACT_PHRASES)} OR {m('x', rs.FOLLOW_UP)} AS fact,
   x <> '' AND length(x) <= 160 AND {m('x', rs.POINTING)} AND (len(string_split(x, ' ')) <= 14 OR {m('x', rs.POINTING_VERBS)}) AS pointing FROM f1)"""


def _verdict(crime: str, legal: str) -> str:
    return f"""CASE WHEN x = '' THEN 'allow#empty' WHEN code THEN 'block_code#programming or source-code request'
   WHEN crime THEN 'block_illegal#operational crime or evasion request'
   WHEN {crime} AND (follow OR x IN ({', '.join(lit(w) for w in rs.SHORT_REPLIES)})) THEN 'block_illegal#multi-turn operational crime request'
   WHEN offu OR (off AND NOT legal) THEN 'block_irrelevant#off-topic non-legal request'
   WHEN over AND NOT barelegal THEN 'block_jailbreak#instruction-override with no legal question'
   WHEN greet THEN 'allow#greeting or identity' WHEN legal THEN 'allow#legal or case-relevant question'
   WHEN has_uploads AND fact THEN 'allow#case or matter context'
   WHEN {legal} AND (follow OR pointing OR (length(x) <= 120 AND NOT code)) THEN 'allow#legal conversation follow-up'
   ELSE 'block_irrelevant#no legal or case signal' END"""


_SCREENED = "SELECT conv_id, turn, starts_with(v, 'allow') AS allowed, split_part(v, '#', 1) AS decision, split_part(v, '#', 2) AS reason FROM"
ORACLE["screen_messages"] = with_ctes(FACTS_CTE) + f"{_SCREENED} (SELECT *, {_verdict('false', 'false')} AS v FROM facts WHERE role = 'user')"
_HISTORY = f"""
, hist AS (SELECT *, coalesce(last_value(CASE WHEN role = 'user' THEN crime END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), false) AS pc,
   coalesce(bool_or(x <> '' AND legal) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), false) AS pl FROM facts),
judged AS (SELECT *, {_verdict('pc', 'pl')} AS v FROM hist WHERE role = 'user')"""
ORACLE["screen_conversations"] = with_ctes(FACTS_CTE) + f"{_HISTORY}\n{_SCREENED} judged"
ORACLE["safety_report"] = with_ctes(FACTS_CTE) + f"""{_HISTORY}
SELECT user_id, split_part(v, '#', 1) AS decision, split_part(v, '#', 2) AS reason, count(*) AS messages FROM judged GROUP BY ALL"""

# --- titles -----------------------------------------------------------------------------------
_PREFIX = "(?i)^(?:" + "|".join(rq.TITLE_PREFIXES) + ")"
_TERM = "CASE lower(regexp_replace(w, '[,.;:!?]$', '')) " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in rq.TITLE_TERMS.items()) + \
    " ELSE regexp_replace(w, '[,.;:!?]$', '') END || regexp_extract(w, '[,.;:!?]$')"
ORACLE["conversation_titles"] = with_ctes(pq.USERS_CTE) + f"""
, t1 AS (SELECT conv_id, turn, question, {strip("regexp_replace(flat, '" + _PREFIX + "', '')")} AS b FROM u),
t2 AS (SELECT *, list_filter(list_transform(string_split(b, ' '), lambda w: {_TERM}), lambda w: NOT list_contains({_list(rq.TITLE_STOPWORDS)}, lower(w))) AS ws FROM t1),
t3 AS (SELECT *, {collapse("regexp_replace(array_to_string(ws, ' '), '[^" + tx.WORD + tx.SPACE + "/\\-]', '', 'g')")} AS c FROM t2),
t4 AS (SELECT *, array_to_string(list_transform(regexp_extract_all(c, '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: CASE WHEN starts_with(w, 'ß') THEN 'Ss' ELSE upper(substring(w, 1, 1)) END || lower(substring(w, 2))), '') AS ti FROM t3),
t5 AS (SELECT *, substring(ti, 1, 60) AS cut, regexp_replace(substring(ti, 1, 60), ' [^ ]*$', '') AS word, {strip('question')} AS p FROM t4)
SELECT conv_id, turn, CASE WHEN ti = '' THEN 'New Conversation' WHEN length(ti) <= 60 THEN ti
   ELSE rtrim(CASE WHEN contains(cut, ' ') AND length(word) > 20 THEN word ELSE cut END, {QUOTED_SPACE}) || '...' END AS title,
  CASE WHEN p = '' THEN 'New Conversation' WHEN length(p) > 60 THEN substring(p, 1, 57) || '...' ELSE p END AS plain_title FROM t5"""

# --- languages -----------------------------------------------------------------------------------
_LEX = "(VALUES " + ", ".join(f"({lit(w)}, {lit(k)}, {ur}::DOUBLE, {pa_}::DOUBLE)" for w, (k, ur, pa_) in sorted(lang._lexicon().items())) + ") lex(w, kind, lur, lpa)"
_OV = "CASE " + " ".join(f"WHEN {m('body', p_)} THEN {i + 1}" for i, (p_, _, _) in enumerate(rl.OVERRIDES)) + " ELSE 0 END"
_REST = "CASE ov " + " ".join(
    f"""WHEN {i + 1} THEN trim(regexp_replace(regexp_replace(body, '(?i){p_}', ' ', 'g'), '[{tx.SPACE}]+', ' ', 'g'), ' :,-')""" for i, (p_, _, _) in enumerate(rl.OVERRIDES)
) + " ELSE body END"
_PHRASE = "CASE ov " + " ".join(f"WHEN {i + 1} THEN regexp_extract(body, '(?i){p_}')" for i, (p_, _, _) in enumerate(rl.OVERRIDES)) + " END"
_OLANG = "CASE ov " + " ".join(f"WHEN {i + 1} THEN {lit(l_)}" for i, (_, l_, _) in enumerate(rl.OVERRIDES)) + " END"
_OSTYLE = "CASE ov " + " ".join(f"WHEN {i + 1} THEN {lit(s_)}" for i, (_, _, s_) in enumerate(rl.OVERRIDES) if s_) + " END"


def _style(x: str) -> str:
    return (
        f"CASE {x} WHEN 'en-PK' THEN 'english' WHEN 'mixed' THEN 'mixed' WHEN 'pa-PK' THEN CASE WHEN scr = 'arabic' THEN 'punjabi_shahmukhi' ELSE 'punjabi_roman' END "
        "ELSE CASE WHEN scr IN ('arabic', 'mixed') THEN 'urdu_script' ELSE 'roman_urdu' END END"
    )


def languages(source: str, key: str) -> str:
    """CTEs ending in ``detected`` over ``source(key, text)``."""
    return f"""
d0 AS (SELECT {key}, {strip('text')} AS body FROM {source}),
d1 AS (SELECT *, {_OV} AS ov, CASE WHEN regexp_matches(body, '[{rl.ARABIC}]') AND regexp_matches(body, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(body, '[{rl.ARABIC}]') THEN 'arabic'
   WHEN regexp_matches(body, '[A-Za-z]') THEN 'latin' ELSE 'unknown' END AS scr FROM d0),
d2 AS (SELECT *, regexp_replace(regexp_replace({_REST}, '(?i){rl.CITATION}', ' ', 'g'), '(?i){rl.SECTION_REFERENCE}', ' ', 'g') AS cl FROM d1),
tk AS (SELECT {key}, unnest(regexp_extract_all(lower(cl), '[a-z]+')) AS w, generate_subscripts(regexp_extract_all(lower(cl), '[a-z]+'), 1) AS i FROM d2),
tw AS (SELECT tk.*, kind, CASE WHEN kind = 'legal' THEN 0 ELSE coalesce(lur, 0) END AS ur, CASE WHEN kind = 'legal' THEN 0 ELSE coalesce(lpa, 0) END AS pa FROM tk LEFT JOIN {_LEX} USING (w)),
ts AS (SELECT *, sum(ur + pa) OVER (PARTITION BY {key} ORDER BY i) AS seen FROM tw),
sc AS (SELECT {key}, sum(ur) AS ur, sum(pa) AS pa, sum(CASE WHEN kind = 'content' THEN 1.6 ELSE 0 END) AS co,
   sum(CASE WHEN kind = 'legal' THEN 0 WHEN kind = 'content' THEN 1.6 WHEN kind = 'function' THEN 0.7 WHEN kind = 'shared' THEN CASE WHEN seen > 0 THEN 0 ELSE 0.7 END
     WHEN length(w) >= 4 THEN 0.35 ELSE 0 END) AS en FROM ts GROUP BY ALL),
ar AS (SELECT {key}, len(regexp_extract_all(cl, '[{rl.ARABIC}]+')) AS na, {_any(f"array_to_string(regexp_extract_all(cl, '[{rl.ARABIC}]+'), ' ')", rl.PUNJABI_MARKERS)} AS pm FROM d2),
al AS (SELECT d2.*, CAST(coalesce(en, 0) AS DOUBLE) AS en, CAST(coalesce(co, 0) AS DOUBLE) AS co,
   coalesce(ur, 0) + CASE WHEN na > 0 AND NOT pm THEN 2.5 + 0.9 * na ELSE 0 END AS ur, coalesce(pa, 0) + CASE WHEN na > 0 AND pm THEN 3.0 + 0.8 * na ELSE 0 END AS pa
   FROM d2 LEFT JOIN sc USING ({key}) LEFT JOIN ar USING ({key})),
lc AS (SELECT *, greatest(ur, pa) AS lo, CASE WHEN pa > ur THEN 'pa-PK' ELSE 'ur-PK' END AS ll FROM al),
dc AS (SELECT *, lo >= 2 AND (round(co, 9) >= 1.5 OR (scr = 'mixed' AND round(en, 9) >= 2)) AS mx, lo >= 1.5 AND round(lo - en, 9) >= 0.4 AS st, round(en, 9) >= 1.2 AND round(en - lo, 9) > 0 AS eg,
   lo > 0 AND round(lo - en, 9) >= 0 AS wk FROM lc),
dl AS (SELECT *, CASE WHEN body = '' THEN 'en-PK' WHEN mx THEN 'mixed' WHEN st THEN ll WHEN eg THEN 'en-PK' WHEN scr = 'arabic' OR wk THEN ll ELSE 'en-PK' END AS language,
   round(CASE WHEN body = '' THEN 0.2 WHEN mx THEN least(0.88, 0.55 + (lo + en) / 20) WHEN st THEN least(0.96, 0.62 + (lo - en) / 8 + least(lo, 6) / 16)
     WHEN eg THEN least(0.95, 0.6 + (en - lo) / 8) WHEN scr = 'arabic' THEN 0.8 WHEN wk THEN 0.55 ELSE 0.5 END, 6) AS confidence FROM dc),
dr AS (SELECT *, CASE WHEN language = 'mixed' AND ov = 0 THEN CASE WHEN pa >= ur AND pa >= en AND pa > 0 THEN 'pa-PK' WHEN ur >= pa AND ur >= en AND ur > 0 THEN 'ur-PK'
     WHEN scr IN ('arabic', 'mixed') AND ur + pa >= en THEN CASE WHEN ur >= pa THEN 'ur-PK' ELSE 'pa-PK' END ELSE 'en-PK' END ELSE coalesce({_OLANG}, language) END AS rl FROM dl),
detected AS (SELECT *, CASE WHEN language = 'mixed' AND ov = 0 THEN 'mixed' ELSE coalesce({_OSTYLE}, {_style('rl')}) END AS rst FROM dr)"""


ORACLE["message_languages"] = with_ctes(pq.ASKED_CTE, "keyed AS (SELECT conv_id * 1000 + turn AS id, text FROM asked)", languages("keyed", "id")) + f"""
SELECT id // 1000 AS conv_id, id % 1000 AS turn, language, confidence, scr AS script, {_style('language')} AS style, rl AS response_language, rst AS response_style,
  ov > 0 AS explicit_override, {_PHRASE} AS override_phrase FROM detected"""
ORACLE["document_languages"] = with_ctes(languages("documents", "doc_id")) + """
SELECT language, scr AS script, count(*) AS texts, round(avg(confidence), 10) AS mean_confidence FROM detected GROUP BY ALL"""

# --- conversation context -----------------------------------------------------------------------
_CASES = f"list_transform(regexp_extract_all(text, '(?i){rq.CASE_PATTERN}'), lambda s: {strip('s')})"
_SECTIONS = f"regexp_extract_all(text, '(?i){rq.CONTEXT_SECTION}', 1)"
_FRAME = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)"
_RECENT = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"
CONTEXT_CTE = f"""{pq.ASKED_CTE},
c0 AS (SELECT *, {strip('text')} AS body, list_concat(list_transform({_SECTIONS}, lambda s: 'Section ' || s), list_transform(regexp_extract_all(text, '{rq.CONTEXT_STATUTE}'), lambda s: {strip('s')})) AS st,
   {_CASES} AS cs, list_transform(regexp_extract_all(text, '(?i){rq.CONTEXT_DOCUMENT}'), lambda s: {strip('s')}) AS dc,
   nullif(regexp_extract(text, '(?i){rq.CONTEXT_ISSUE}', 1), '') || coalesce(' relating to Section ' || {_SECTIONS}[1], '') AS iss,
   list_transform(regexp_extract_all(text, '(?i){rq.TOPIC_PATTERN}'), lambda s: {strip('s')}) AS tp FROM asked),
c1 AS (SELECT *, flatten(list(st) {_FRAME}) AS sts, flatten(list(cs) {_FRAME}) AS css, flatten(list(dc) {_FRAME}) AS dcs, first_value(iss IGNORE NULLS) {_FRAME} AS issue,
   last_value(CASE WHEN role = 'user' AND length(body) > 20 AND contains(text, '?') THEN substring(body, 1, 180) END IGNORE NULLS) {_RECENT} AS unresolved,
   flatten(list_reverse(list(tp) {_RECENT})) AS tps, last_value(CASE WHEN role = 'user' THEN body END IGNORE NULLS) {_RECENT} AS lu,
   last_value(CASE WHEN role = 'assistant' THEN body END IGNORE NULLS) {_RECENT} AS la FROM c0),
c2 AS (SELECT *, {distinct('sts')} AS statutes, {distinct('css')} AS cases, {distinct('dcs')} AS documents, coalesce({distinct('tps')}[1:3], []) AS mentions FROM c1 WHERE role = 'user'),
c3 AS (SELECT *, list_concat(list_concat(list_concat(CASE WHEN issue IS NULL THEN [] ELSE [issue] END, statutes[1:2]), cases[1:1]), documents[1:1]) AS bits FROM c2),
ctx AS (SELECT *, coalesce(nullif(array_to_string(({distinct('bits')})[1:4], ', '), ''), nullif(array_to_string(mentions, ', '), ''),
   CASE WHEN length(lu) > 8 THEN rtrim(substring(lu, 1, 160), {QUOTED_SPACE}) END, CASE WHEN length(la) > 40 THEN rtrim(substring(la, 1, 160), {QUOTED_SPACE}) END) AS topic FROM c3)"""
ORACLE["active_context"] = with_ctes(CONTEXT_CTE) + """
SELECT conv_id, turn, array_to_string(statutes, '|') AS statutes, array_to_string(cases, '|') AS cases, array_to_string(documents, '|') AS documents, issue, topic,
  md5(unresolved) AS unresolved_md5 FROM ctx"""
ORACLE["resolve_followups"] = with_ctes(CONTEXT_CTE) + f"""
, r0 AS (SELECT *, {collapse('text')} AS q FROM ctx), r1 AS (SELECT *, trim(lower(q), '?.! ') AS l, len(regexp_extract_all(trim(lower(q), '?.! '), '[^{tx.SPACE}]+')) AS w FROM r0),
r2 AS (SELECT *, {m('q', rq.FOLLOW_UP_OPENING)} OR regexp_matches(l, '^(?:and|but|also) ') OR (w <= 8 AND {m('l', rq.TOPIC_PATTERN)}) OR (w <= 12 AND {m('l', rq.POINTING_WORDS)}) AS fu FROM r1),
r3 AS (SELECT *, q = '' OR {m('q', rq.EXPLICIT_INTENT)} OR NOT fu OR topic IS NULL AS alone, topic || ' under Pakistan law' AS tail FROM r2)
SELECT conv_id, turn, NOT alone AS follow_up, topic, md5(CASE WHEN q = '' THEN text WHEN alone THEN q
  WHEN regexp_matches(l, '^can (?:it|this|that) ') THEN 'Can ' || trim(regexp_replace(l, '^can (?:it|this|that)\\s+', ''), '?.! ') || ' relating to ' || tail
  WHEN starts_with(l, 'what about') THEN trim(regexp_replace(l, '^what about\\s+', ''), '?.! ') || ' relating to ' || tail
  WHEN {m('l', rq.EXPLAIN_OPENING)} THEN 'Explain ' || tail ELSE trim(q, '?.! ') || ' in the context of ' || tail END) AS resolved_md5 FROM r3"""

# --- history --------------------------------------------------------------------------------------
_LEFT = "greatest(0, length(body) - c)"
ORACLE["compress_history"] = f"""
WITH RECURSIVE {CUED_CTE},
hb AS (SELECT conv_id, CAST((conv_id % 6) * 90 AS BIGINT) AS hb, CASE WHEN conv_id % 3 = 0 THEN 'Earlier the user asked about bail.' END AS summary FROM cued GROUP BY 1),
rec AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM cued),
fl AS (SELECT *, {collapse('text')} AS f FROM rec WHERE n <= 10),
bd AS (SELECT *, CASE WHEN regexp_matches(f, '{ISSUE}') THEN substring(f, greatest(1, strpos(f, regexp_extract(f, '{ISSUE}')) - 40), 280) ELSE substring(f, 1, 280) END AS body FROM fl),
fm AS (SELECT *, {scaled(pieces('text'))} AS tk, CASE WHEN role = 'assistant' THEN list_transform(list_filter(list_transform([0, 40, 80, 120, 160, 200, 240, 280],
   lambda c: substring(body, 1, {_LEFT})), lambda s: s <> ''), lambda s: '[compressed] ' || s) ELSE [] END AS forms FROM bd),
it AS (SELECT *, list_transform(forms, lambda s: {scaled(pieces('s'))}) AS ft FROM fm),
ai AS (SELECT conv_id, 'Active legal context:' || chr(10) || string_agg(role || ': ' || CASE WHEN length(f) > 220 THEN substring(f, 1, 217) || '...' ELSE f END, chr(10) ORDER BY turn) AS ac
   FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM (SELECT *, {collapse('text')} AS f FROM rec WHERE n <= 8 AND regexp_matches(text, '{ISSUE}'))) WHERE k <= 2 GROUP BY 1),
b1 AS (SELECT hb.*, ac, coalesce({scaled(pieces('summary'))}, 0) AS sz, coalesce({scaled(pieces('ac'))}, 0) AS az FROM hb LEFT JOIN ai USING (conv_id)),
b2 AS (SELECT *, summary IS NOT NULL AND sz <= greatest(32, hb // 4) AS sok FROM b1),
b3 AS (SELECT *, hb - CASE WHEN sok THEN sz ELSE 0 END AS l1 FROM b2),
b4 AS (SELECT *, ac IS NOT NULL AND az <= greatest(24, l1 // 5) AS aok FROM b3),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, CAST(l1 - CASE WHEN aok THEN az ELSE 0 END AS BIGINT) AS room, CAST(-9 AS BIGINT) AS pick FROM b4 WHERE hb > 0
  UNION ALL
  SELECT conv_id, n, room - CASE WHEN pick = -1 THEN tk + 2 WHEN pick > 0 THEN ft[pick] + 2 ELSE 0 END, pick FROM (
    SELECT l.conv_id, l.n, w.room, l.tk, l.ft, CASE WHEN l.tk + 2 <= w.room THEN -1
      WHEN w.room >= 24 AND len(list_filter(l.ft, lambda x: x > w.room)) < len(l.ft) THEN len(list_filter(l.ft, lambda x: x > w.room)) + 1 ELSE -9 END AS pick
    FROM walk w JOIN it l ON l.conv_id = w.conv_id AND l.n = w.n + 1))
SELECT it.conv_id, turn, role, md5(CASE WHEN pick = -1 THEN text ELSE forms[pick] END) AS content_md5, pick > 0 AS compressed,
  CASE WHEN sok THEN summary END AS summary, CASE WHEN aok THEN ac END AS active_context
FROM walk JOIN it ON it.conv_id = walk.conv_id AND it.n = walk.n JOIN b4 ON b4.conv_id = it.conv_id WHERE pick <> -9"""

# --- answers ------------------------------------------------------------------------------------------
_GOOD = "list_filter(list_transform(regexp_extract_all(mk, '\\d+'), lambda d: CAST(d AS BIGINT)), lambda n: n >= 1 AND n <= source_count)"
_NEWMARK = f"CASE WHEN len({_GOOD}) = 0 THEN '' ELSE '[' || array_to_string(list_transform({_GOOD}, lambda n: 'Source ' || n), ', ') || ']' END"
ORACLE["repair_citations"] = with_ctes(pa.CITED_CTE) + f"""
, mk AS (SELECT conv_id, turn, source_count, unnest(regexp_extract_all(answer, '{ra.MARKER}')) AS mk, generate_subscripts(regexp_extract_all(answer, '{ra.MARKER}'), 1) AS i FROM cited),
nm AS (SELECT conv_id, turn, list({_NEWMARK} ORDER BY i) AS new FROM mk GROUP BY 1, 2),
wv AS (SELECT c.*, array_to_string(list_transform(string_split_regex(answer, '{ra.MARKER}'), lambda p, i: p || coalesce(new[i], '')), '') AS woven,
   len(list_filter(nums, lambda n: n < 1 OR n > source_count)) > 0 AS broken FROM cited c LEFT JOIN nm USING (conv_id, turn))
SELECT conv_id, turn, md5(CASE WHEN broken THEN {strip("regexp_replace(regexp_replace(woven, '[" + tx.SPACE + "]{2,}', ' ', 'g'), ' \\.', '.', 'g')")} ELSE answer END) AS answer_md5,
  array_to_string(list_filter(nums, lambda n: n >= 1 AND n <= source_count), ',') AS valid,
  CASE WHEN broken THEN 'repaired' WHEN len(nums) = 0 THEN 'none' ELSE 'valid' END AS citation_status FROM wv"""
_SENTENCES = f"list_transform(string_split_regex(regexp_replace({strip('answer')}, '([.!?])[{tx.SPACE}]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')})"
_QUOTE = ra.QUOTE.replace("'", "''")
CLAIMS_CTE = f"""{pa.ANSWERS_CTE},
cl0 AS (SELECT *, list_concat(list_concat(list_concat(list_transform(regexp_extract_all(answer, '(?i){ra.SECTION}'), lambda s: {strip('s')}),
   list_transform(regexp_extract_all(answer, '(?i){ra.CASE}'), lambda s: {strip('s')})), list_transform(regexp_extract_all(answer, '{_QUOTE}'), lambda s: {strip('substring(s, 2, length(s) - 2)')})),
   list_filter({_SENTENCES}, lambda s: length(s) >= 25 AND {m('s', ra.ASSERTION)} AND NOT regexp_matches(lower(s), '^(note:|i don''t have enough)'))[1:8]) AS every FROM answers),
cl1 AS (SELECT *, {distinct('every')} AS cs FROM cl0),
claims AS (SELECT conv_id, turn, query_id, document_mode, unnest(cs) AS claim, generate_subscripts(cs, 1) - 1 AS claim_index FROM cl1)"""
ORACLE["extract_claims"] = with_ctes(CLAIMS_CTE) + "SELECT conv_id, turn, CAST(claim_index AS INT) AS claim_index, claim FROM claims"
_NUMBER = f"nullif(lower(coalesce(nullif(regexp_extract(claim, '(?i){ra.SECTION}', 1), ''), regexp_extract(claim, '(?i){ra.SECTION}', 2))), '')"
_DWORDS = f"list_distinct(list_filter(regexp_extract_all(lower(claim), '[a-z0-9\\-]+'), lambda w: length(w) > 3 AND NOT list_contains({_list(ra.PARAPHRASE_IGNORED)}, w)))"
GROUNDED_CTE = f"""{CLAIMS_CTE},
corp AS (SELECT query_id, lower(string_agg(concat_ws(' ', coalesce(text, ''), array_to_string(sections, ' '), law_name, section), ' ' ORDER BY ordinal)) AS c FROM shown GROUP BY 1),
g0 AS (SELECT cl.*, coalesce(c, '') AS c, {collapse('lower(claim)')} AS f, {_NUMBER} AS num, {collapse("lower(regexp_extract(claim, '(?i)" + ra.CASE + "'))")} AS cite FROM claims cl LEFT JOIN corp USING (query_id)),
g1 AS (SELECT *, string_split(f, ' ') AS ws, coalesce(contains(c, num), false) AS secok FROM g0),
g2 AS (SELECT *, length(f) >= 20 AND len(ws) >= 4 AS lng FROM g1),
g3 AS (SELECT *, contains(c, f) OR secok OR (lng AND contains(c, array_to_string(ws[1:8], ' '))) AS sup, lng AND contains(c, array_to_string(ws[1:6], ' ')) AS opn,
   regexp_matches(claim, '{_QUOTE}') AS isq, len(list_filter({_list(ra.RELATIONS)}, lambda k: contains(lower(claim), k) AND NOT contains(c, k))) > 0 AS mis,
   (contains(lower(claim), 'not a clog') AND contains(c, 'clog on') AND NOT contains(c, 'not a clog'))
     OR (contains(lower(claim), 'does not restrict') AND (contains(c, 'restrict') OR contains(c, 'bar')) AND NOT contains(c, 'does not restrict')) AS con,
   {m('claim', ra.HOLDING)} AS hol, {m('claim', ra.ASSERTION)} AS ass, {_DWORDS} AS dw FROM g2),
grounded AS (SELECT conv_id, turn, query_id, claim_index, claim, CASE WHEN document_mode THEN CASE WHEN CASE WHEN isq THEN sup
     WHEN length(claim) >= 40 AND contains(claim, ' ') THEN sup OR (len(dw) > 0 AND len(list_filter(dw, lambda w: contains(c, w))) >= greatest(2, len(dw) // 2))
     WHEN num IS NOT NULL THEN sup ELSE true END THEN 'supported' ELSE 'unsupported' END
   WHEN cite <> '' THEN CASE WHEN contains(c, cite) THEN 'supported' ELSE 'unsupported' END WHEN isq THEN CASE WHEN sup THEN 'supported' ELSE 'unsupported' END
   WHEN con THEN 'contradicted' WHEN num IS NOT NULL THEN CASE WHEN NOT secok THEN 'unsupported' WHEN mis OR NOT sup THEN 'partial' ELSE 'supported' END
   WHEN hol THEN CASE WHEN sup THEN 'supported' ELSE 'unsupported' END WHEN mis AND ass THEN CASE WHEN sup THEN 'partial' ELSE 'unsupported' END
   WHEN sup THEN 'supported' WHEN opn THEN 'partial' WHEN ass THEN 'unsupported' ELSE 'partial' END AS status FROM g3)"""
ORACLE["ground_claims"] = f"{SELECTED},\n{GROUNDED_CTE}\nSELECT conv_id, turn, query_id, claim_index, claim, status FROM grounded"
ORACLE["join_fragments"] = """
WITH f AS (SELECT conv_id, turn, regexp_extract_all(text, '(?s).{1,5}') AS ps FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, md5(array_to_string(list_transform(ps, lambda p, i: CASE WHEN i > 1 AND ((regexp_matches(right(ps[i - 1], 1), '^\\p{Ll}$') AND regexp_matches(left(p, 1), '^\\p{Lu}$'))
  OR (regexp_matches(right(ps[i - 1], 1), '^[)\\]"''%]$') AND regexp_matches(left(p, 1), '^[\\p{L}\\p{N}]$'))) THEN ' ' || p ELSE p END), '')) AS text_md5 FROM f"""
ORACLE["result_links"] = """
SELECT page_id, CAST(0 AS BIGINT) AS position, 'https://www.supremecourt.gov.pk/case/' || page_id AS url, 'Case ' || page_id || ' & more' AS title,
  'On bail <' || page_id || '>' AS snippet, CAST(0.85 AS DOUBLE) AS score, true AS official FROM pages
UNION ALL SELECT page_id, 1, url, url, 'second', CAST(0.78 AS DOUBLE), false FROM pages"""

# --- guarded answers, contexts, citation cards ---------------------------------------------------------
ORACLE["guard_answers"] = f"""{SELECTED},
{GROUNDED_CTE},
ga AS (SELECT conv_id, turn, count(*) FILTER (status IN ('unsupported', 'contradicted')) AS u, count(*) FILTER (status = 'partial') AS p, count(*) FILTER (status = 'supported') AS s,
   count(*) FILTER (status = 'contradicted') AS x, list(claim ORDER BY claim_index) FILTER (status IN ('unsupported', 'contradicted') AND {m('claim', ra.CASE)}
     AND (length(claim) < 80 OR {m('claim', '^(?:' + ra.CASE + ')$')})) AS inv FROM grounded GROUP BY 1, 2),
gj AS (SELECT a.conv_id, a.turn, answer, document_mode, evidence_strength, coalesce(u, 0) AS u, coalesce(p, 0) AS p, coalesce(s, 0) AS s, coalesce(x, 0) AS x, coalesce(inv, []) AS inv
   FROM answers a LEFT JOIN ga USING (conv_id, turn)),
gs AS (SELECT *, CASE WHEN document_mode THEN CASE WHEN u > 0 THEN 'partial' ELSE 'strong' END WHEN u > 0 AND s = 0 AND p = 0 THEN 'insufficient'
   WHEN u > 0 OR p > 0 THEN 'partial' WHEN evidence_strength = 'weak' THEN 'partial' ELSE 'strong' END AS st FROM gj)
SELECT conv_id, turn, st AS grounding_status, s AS supported, p AS partial, u AS unsupported, x AS contradicted,
  md5({strip("CASE WHEN NOT document_mode AND st <> 'strong' AND u > 0 THEN list_reduce(list_prepend(answer, inv), lambda t, c: replace(t, c, '" + ra.UNVERIFIED + "')) ELSE answer END")}) AS answer_md5
FROM gs"""
ORACLE["assemble_context"] = f"""{SELECTED},
bk AS (SELECT query_id, position, coalesce(source_type, 'legal') AS tier, {_BLOCK} AS b FROM shown),
se AS (SELECT query_id, tier, CASE tier WHEN 'legal' THEN 0 WHEN 'conversation' THEN 1 WHEN 'matter' THEN 2 ELSE 3 END AS o,
   {_TITLES} || chr(10) || chr(10) || string_agg(b, chr(10) ORDER BY position) AS s FROM bk GROUP BY 1, 2),
cx AS (SELECT query_id, {lit(CONTEXT_HEADER)} || string_agg(s, chr(10) || chr(10) ORDER BY o) AS c FROM se GROUP BY 1)
SELECT query_id, md5(c) AS context_md5, CAST(length(c) AS BIGINT) AS size FROM cx"""


def _first(x: str) -> str:
    return f"(list({x} ORDER BY number) FILTER (CAST({x} AS VARCHAR) <> ''))[1]"


ORACLE["citation_cards"] = f"""{SELECTED},
cs AS (SELECT *, position AS number, round_even(coalesce(score, 0), 4) AS rs, {_REF} AS ref, coalesce(chunk_id, id) AS cid, coalesce(source_type, 'legal') AS st,
   {excerpt('text')} AS ex, CASE WHEN document_id IS NOT NULL THEN 'doc:' || document_id || ':' || chunk_index
     WHEN law_name IS NOT NULL AND len(sections) > 0 THEN 'law:' || law_name || ':' || sections_csv ELSE 'chunk:' || id END AS ck FROM shown),
us AS (SELECT *, query_id % 3 > 0 AND number IN (1, query_id % 4) AS cited FROM cs),
ca AS (SELECT * FROM (SELECT *, bool_or(cited) OVER (PARTITION BY query_id) AS anyc FROM us) WHERE cited OR NOT anyc),
le AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, ck ORDER BY number) = 1 THEN coalesce(display_name, title) ELSE title END AS ti FROM ca),
gr AS (SELECT query_id, (list(cid ORDER BY rs DESC, number))[1] AS citation_id, {_first('ti')} AS title,
   {', '.join(f"{_first(c)} AS {c}" for c in ('document_id', 'filename', 'heading', 'law_name', 'document_type', 'court', 'year', 'summary', 'display_name'))},
   {_first('st')} AS source_type, (list(cid ORDER BY number))[1] AS chunk_id, (list(page_number ORDER BY number))[1] AS page, (list(ref ORDER BY number))[1] AS source_reference,
   count(*) AS n, flatten(list(coalesce(sections, []) ORDER BY number)) AS ss, flatten(list(coalesce(keywords, []) ORDER BY number)) AS ks,
   list(ex ORDER BY number) AS exs, max(rs) AS score FROM le GROUP BY query_id, ck),
gx AS (SELECT *, list_filter(exs, lambda e, i: list_position(exs, e) = i) AS parts FROM gr),
gy AS (SELECT *, CASE WHEN len(parts) = 1 THEN parts[1] ELSE array_to_string(parts, ' … ') END AS joined FROM gx)
SELECT query_id, citation_id, title, document_id, filename, heading, law_name, document_type, court, year, summary, source_type, display_name, chunk_id, page, source_reference,
  array_to_string(CASE WHEN n > 1 THEN {distinct('ss')} ELSE ss END, '|') AS sections, array_to_string(CASE WHEN n > 1 THEN ({distinct('ks')})[1:12] ELSE ks END, '|') AS keywords,
  md5(CASE WHEN len(parts) = 1 THEN joined ELSE {excerpt('joined')} END) AS excerpt, score FROM gy"""
