"""Oracle SQL of the greedy passes: recursive walks over each list in order."""

from __future__ import annotations

from evidex.functions import text as tx
from evidex.plans.common import strip, with_ctes
from evidex.plans.grading import CLASS, _rank
from evidex.plans.hits import MERGED_CTE, QUESTIONS_CTE
from evidex.plans.packing import ORACLE as _PACKING
from evidex.plans.packing import _PACK, pieces, scaled
from evidex.plans.retrieval import _FLAGS, _LIMITS, norm

_SC = "coalesce(relevance_score, score, 0)"
_KEY = """CASE WHEN chunk_id IS NOT NULL THEN 'c' || coalesce(document_id, '') || chunk_id
   WHEN document_id IS NOT NULL THEN 'd' || document_id || ':' || chunk_index ELSE 'i' || id END"""
# Documents of hits whose own id is missing are unknown: their chunk ids hold no UUID.
ITEM = "struct_pack(doc := document_id, file := lower(filename), s := start_offset, e := end_offset, n := nrm, t := list_distinct(string_split(nrm, ' ')))"


def near(y: str, x: str) -> str:
    shorter = f"CASE WHEN length({y}.n) <= length({x}.n) THEN {y}.n ELSE {x}.n END"
    longer = f"CASE WHEN length({y}.n) <= length({x}.n) THEN {x}.n ELSE {y}.n END"
    jaccard = f"CAST(len(list_intersect({y}.t, {x}.t)) AS DOUBLE) / len(list_distinct(list_concat({y}.t, {x}.t)))"
    return (
        f"CASE WHEN {y}.n = '' OR {x}.n = '' THEN false WHEN {y}.n = {x}.n THEN true "
        f"WHEN least(length({y}.n), length({x}.n)) < 60 THEN contains({longer}, {shorter}) "
        f"WHEN contains({longer}, substring({shorter}, 1, 180)) THEN {jaccard} >= 0.82 ELSE {jaccard} >= 0.9 END"
    )


def offsets(y: str, x: str) -> str:
    return (
        f"({y}.e > {y}.s AND {x}.e > {x}.s AND least({y}.e, {x}.e) > greatest({y}.s, {x}.s) AND "
        f"CAST(least({y}.e, {x}.e) - greatest({y}.s, {x}.s) AS DOUBLE) / least({y}.e - {y}.s, {x}.e - {x}.s) >= 0.55)"
    )


def repeats(y: str, x: str) -> str:
    return f"((coalesce({y}.doc = {x}.doc, false) OR {y}.file = {x}.file) AND ({offsets(y, x)} OR {near(y, x)}))"


def walk(name: str, source: str, test: str, columns: str) -> str:
    """``source(grp, n, it, columns)`` walked in order of n; ``ok`` says whether the item is kept."""
    listed = ", ".join(f"l.{c}" for c in columns.split(", "))
    return f"""
{name} AS (SELECT grp, n, {columns}, [it] AS kept, true AS ok FROM {source} WHERE n = 1
  UNION ALL
  SELECT grp, n, {columns}, CASE WHEN dup THEN kept ELSE list_append(kept, it) END, NOT dup FROM (
    SELECT l.grp, l.n, l.it, {listed}, w.kept, len(list_filter(w.kept, lambda y: {test})) > 0 AS dup
    FROM {name} w JOIN {source} l ON l.grp = w.grp AND l.n = w.n + 1))"""


_BEST = f"""
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, {_KEY} ORDER BY score DESC, ordinal) AS k FROM merged) WHERE k = 1),
cut AS (SELECT *, {norm('text')} AS nrm FROM best)"""
_HEAD = f"WITH RECURSIVE {MERGED_CTE},{_BEST},"

ORACLE = {}
ORACLE["suppress_near_duplicates"] = f"""{_HEAD}
lst AS (SELECT query_id || filename AS grp, row_number() OVER (PARTITION BY query_id, filename ORDER BY {_SC} DESC, ordinal) AS n, {ITEM} AS it, query_id, ordinal, score FROM cut),
{walk('walk', 'lst', repeats('y', 'l.it'), 'query_id, ordinal, score')}
SELECT query_id, ordinal, score FROM walk WHERE ok"""

_OWN = "coalesce(y.own = l.it.own, false)"
_PACKKEY = """CASE WHEN document_id IS NOT NULL THEN 'c:' || document_id || ':' || coalesce(chunk_id, id)
   ELSE 'i:' || coalesce(CAST(chunk_index AS VARCHAR), '') || md5(substring(coalesce(text, ''), 1, 240)) END"""
_KEYED = ITEM.replace("struct_pack(", f"struct_pack(key := {_PACKKEY}, own := document_id, ")


def dedupe_walks(source: str) -> str:
    """Both passes of the packing-time dedupe over ``source``; ends in ``survivors(query_id, ordinal, removed_count)``."""
    return f"""
la AS (SELECT query_id AS grp, row_number() OVER (PARTITION BY query_id ORDER BY ordinal) AS n, {_KEYED} AS it, ordinal, {_SC} AS sc FROM {source}),
{walk('wa', 'la', f"y.key = l.it.key OR ({_OWN} AND {near('y', 'l.it')})", 'ordinal, sc')},
lb AS (SELECT wa.grp, row_number() OVER (PARTITION BY wa.grp ORDER BY wa.sc DESC, wa.ordinal) AS n, la.it, wa.ordinal FROM wa JOIN la USING (grp, n) WHERE wa.ok),
{walk('wb', 'lb', repeats('y', 'l.it'), 'ordinal')},
survivors AS (SELECT grp AS query_id, ordinal, (SELECT count(*) FROM la WHERE la.grp = wb.grp)
   - count(*) OVER (PARTITION BY grp) AS removed_count FROM wb WHERE ok)"""


# Over whole lists, each document or file is walked on its own: no other hits meet.
ORACLE["remove_duplicate_evidence"] = f"""{_HEAD}
la AS (SELECT query_id || coalesce(document_id, {_PACKKEY}) AS grp, row_number() OVER (PARTITION BY query_id, coalesce(document_id, {_PACKKEY}) ORDER BY ordinal) AS n,
  {_KEYED} AS it, query_id, filename, ordinal, {_SC} AS sc FROM cut),
{walk('wa', 'la', f"y.key = l.it.key OR ({_OWN} AND {near('y', 'l.it')})", 'query_id, filename, ordinal, sc')},
lb AS (SELECT wa.query_id || wa.filename AS grp, row_number() OVER (PARTITION BY wa.query_id, wa.filename ORDER BY wa.sc DESC, wa.ordinal) AS n, la.it, wa.query_id, wa.ordinal
  FROM wa JOIN la USING (grp, n) WHERE wa.ok),
{walk('wb', 'lb', repeats('y', 'l.it'), 'query_id, ordinal')}
SELECT query_id, ordinal, (SELECT count(*) FROM la WHERE la.query_id = wb.query_id) - count(*) OVER (PARTITION BY query_id) AS removed_count FROM wb WHERE ok"""

_CAP = "CASE tier WHEN 'legal' THEN legal_limit WHEN 'conversation' THEN conversation_limit WHEN 'matter' THEN matter_limit ELSE CASE WHEN least(4, total - legal_limit) > 0 THEN least(4, total - legal_limit) ELSE 3 END END"
SELECTED = f"""WITH RECURSIVE {MERGED_CTE},
{QUESTIONS_CTE},
lims AS (SELECT query_id, total, {_LIMITS} FROM (SELECT *, {_FLAGS}, 10 AS total FROM questions)),
tiered AS (SELECT m.*, CASE WHEN source_type IN ('conversation', 'matter', 'web') THEN source_type ELSE 'legal' END AS tier, {_KEY} AS key,
   total, legal_limit, conversation_limit, matter_limit FROM merged m JOIN lims USING (query_id)),
capped AS (SELECT *, {_CAP} AS cap, row_number() OVER (PARTITION BY query_id, tier ORDER BY {_SC} DESC, ordinal) AS place FROM tiered),
inner_best AS (SELECT *, {norm('text')} AS nrm FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tier, key ORDER BY {_SC} DESC, ordinal) AS k
   FROM capped WHERE place <= 2 * cap) WHERE k = 1),
l1 AS (SELECT query_id || tier AS grp, row_number() OVER (PARTITION BY query_id, tier ORDER BY {_SC} DESC, ordinal) AS n, {ITEM} AS it, ordinal, tier FROM inner_best),
{walk('w1', 'l1', repeats('y', 'l.it'), 'ordinal, tier')},
kept1 AS (SELECT * FROM (SELECT w1.ordinal, w1.tier, row_number() OVER (PARTITION BY grp ORDER BY n) AS place2 FROM w1 WHERE ok) JOIN inner_best USING (ordinal, tier) WHERE place2 <= cap),
ordered AS (SELECT *, CASE tier WHEN 'legal' THEN 0 WHEN 'conversation' THEN 1 WHEN 'matter' THEN 2 ELSE 3 END AS o FROM kept1),
uniq AS (SELECT * FROM (SELECT *, min(o) OVER (PARTITION BY query_id, key) AS first_o, row_number() OVER (PARTITION BY query_id, key ORDER BY {_SC} DESC, o, ordinal) AS kk FROM ordered) WHERE kk = 1),
l2 AS (SELECT query_id AS grp, row_number() OVER (PARTITION BY query_id ORDER BY {_SC} DESC, o, ordinal) AS n, {ITEM} AS it, ordinal FROM uniq),
{walk('w2', 'l2', repeats('y', 'l.it'), 'ordinal')},
shown AS (SELECT * FROM (SELECT u.*, row_number() OVER (PARTITION BY query_id ORDER BY first_o, {_SC} DESC, u.ordinal) AS position FROM uniq u JOIN w2 ON w2.grp = query_id AND w2.ordinal = u.ordinal WHERE ok)
   WHERE position <= total)"""
ORACLE["select_evidence"] = f"{SELECTED}\nSELECT query_id, ordinal, source_type, position FROM shown"

# Packing: the state is the room left per kind and the documents seen.
_SENT = f"string_split_regex(regexp_replace({strip('text')}, '([.!?])[{tx.SPACE}]+', '\\1' || chr(1), 'g'), chr(1))"
_WORD = f"list_filter(string_split_regex({strip('text')}, '[{tx.SPACE}]+'), lambda x: x <> '')"


def running(parts: str) -> str:
    counts = f"list_transform({parts}, lambda p: {pieces('p')})"
    return f"list_transform(range(1, len({parts}) + 1), lambda i: CAST(list_sum({counts}[1:i]) AS BIGINT))"


def _fitting(cum: str) -> str:
    return f"len(list_filter({cum}, lambda c: {scaled('c')} <= room[slot]))"


_BUDGETS = _PACKING["budget_shares"].removeprefix("WITH ")
_BUDGETS = _BUDGETS[_BUDGETS.index(", rq AS") + 2:]
_BUDGET_CTES, _BUDGET_SELECT = _BUDGETS[: _BUDGETS.rindex("\nSELECT")], _BUDGETS[_BUDGETS.rindex("\nSELECT") + 1:]
PACKED = f"""{SELECTED},
{dedupe_walks('shown')},
{_BUDGET_CTES},
budgets AS ({_BUDGET_SELECT}),
cand AS (SELECT *, {_PACK} AS ps, {_SENT} AS ss, {_WORD} AS ws FROM (SELECT sh.*, sv.removed_count, {CLASS} AS a FROM shown sh JOIN survivors sv ON sv.query_id = sh.query_id AND sv.ordinal = sh.ordinal)),
lp AS (SELECT query_id AS grp, row_number() OVER (PARTITION BY query_id ORDER BY ps DESC, ordinal) AS n, ordinal, removed_count, ps, document_id AS doc, text, ss, ws,
   {scaled(pieces('text'))} AS tk, {running('ss')} AS sc, {running('ws')} AS wc,
   CASE lower(coalesce(source_type, 'legal')) WHEN 'conversation' THEN 2 WHEN 'matter' THEN 3 WHEN 'web' THEN 4 ELSE 1 END AS slot FROM cand),
wp AS (
  SELECT query_id AS grp, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS ordinal, [legal_budget, conversation_budget, matter_budget, web_budget] AS room, CAST([] AS VARCHAR[]) AS docs,
    false AS ok, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS ns, CAST(0 AS BIGINT) AS nw, false AS whole FROM budgets
  UNION ALL
  SELECT grp, n, ordinal, CASE WHEN take THEN list_transform(room, lambda v, i: CASE WHEN i = slot THEN v - spent ELSE v END) ELSE room END,
    CASE WHEN take AND doc IS NOT NULL THEN list_append(docs, doc) ELSE docs END, take, spent, ns, nw, whole
  FROM (SELECT *, room[slot] > 0 AND (whole OR (((doc IS NOT NULL AND NOT list_contains(docs, doc) AND ps >= 0.55) OR tk <= room[slot] * 1.5) AND (ns > 0 OR nw > 0))) AS take,
      CASE WHEN whole THEN tk WHEN ns > 0 THEN {scaled('sc[ns]')} WHEN nw > 0 THEN {scaled('wc[nw]')} ELSE 0 END AS spent
    FROM (SELECT l.*, w.room, w.docs, l.tk <= w.room[l.slot] AS whole, {_fitting('l.sc').replace('room[slot]', 'w.room[l.slot]')} AS ns, {_fitting('l.wc').replace('room[slot]', 'w.room[l.slot]')} AS nw
      FROM wp w JOIN lp l ON l.grp = w.grp AND l.n = w.n + 1))),
packed AS (SELECT wp.grp AS query_id, wp.ordinal, wp.used AS packed_tokens, NOT wp.whole AS truncated, lp.removed_count, lp.doc, lp.ordinal AS o,
   CASE WHEN wp.whole THEN text WHEN ns > 0 THEN {strip("array_to_string(ss[1:ns], ' ')")} ELSE array_to_string(ws[1:nw], ' ') END AS packed_text
   FROM wp JOIN lp ON lp.grp = wp.grp AND lp.n = wp.n WHERE ok)"""
ORACLE["pack_evidence"] = f"{PACKED}\nSELECT query_id, ordinal, packed_tokens, truncated, md5(packed_text) AS text_md5 FROM packed"
ORACLE["packing_summary"] = f"""{PACKED}
SELECT s.query_id, coalesce(d, 0) AS documents_retained, coalesce(c, 0) AS chunks_retained, coalesce(r, 0) AS duplicates_removed, coalesce(tr, 0) AS truncated_chunks,
  CAST(coalesce(tok, 0) AS BIGINT) AS evidence_tokens, s.total - coalesce(c, 0) AS chunks_dropped
FROM (SELECT query_id, count(*) AS total FROM shown GROUP BY 1) s LEFT JOIN (
  SELECT query_id, count(DISTINCT coalesce(doc, 'anon' || o)) AS d, count(*) AS c, max(removed_count) AS r, count(*) FILTER (truncated) AS tr, sum(packed_tokens) AS tok
  FROM packed GROUP BY 1) p USING (query_id)"""
ORACLE["invariant_budget"] = f"""{PACKED}
SELECT * FROM (SELECT u.query_id, kind, used, CASE kind WHEN 'conversation' THEN conversation_budget WHEN 'matter' THEN matter_budget
    WHEN 'web' THEN web_budget ELSE legal_budget END AS budget
  FROM (SELECT p.query_id, CASE slot WHEN 2 THEN 'conversation' WHEN 3 THEN 'matter' WHEN 4 THEN 'web' ELSE 'legal' END AS kind, CAST(sum(packed_tokens) AS BIGINT) AS used
    FROM packed p JOIN lp ON lp.grp = p.query_id AND lp.ordinal = p.ordinal GROUP BY ALL) u JOIN budgets USING (query_id)) WHERE used > budget"""
ORACLE["invariant_resources"] = f"""{SELECTED}
SELECT query_id, document_id, count(DISTINCT 'doc:' || document_id) AS resources FROM shown WHERE document_id IS NOT NULL
GROUP BY ALL HAVING count(DISTINCT 'doc:' || document_id) > 1"""
QUERIES: dict = {}
