"""Family K: checking and cleaning answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.operators import answers as a
from evidex.plans.common import strip, with_ctes
from evidex.plans.hits import case
from evidex.plans.packing import selected
from evidex.rules import answers as r
from evidex.sources import tables as t

# Endings and openings that give the given assistant turns citations, claims and notices.
TAILS = (
    "Section 302 PPC provides the punishment for murder [Source 1].", "See [Source 99] and [Sources 1, 2].",
    "The court held this in PLD 2011 SC 554 [Source 2, Source 3 and 40].",
    "The statute says \"an injunction shall not be granted when an equally good remedy exists\" here.",
    "See PLD 2099 SC 999 for the holding of the court.", "The law is that a clog on judicial discretion is prohibited by article 10-A.",
    "This does not restrict bail under section 497.\n\nSources:\n- [Source 1]\n- [Source 2]", "It is limited (Sources 1 and 2) by law[Source 4].",
    "A nswe r: Close rel ati ve s of a murder victi m ha ve rights.", "The judgment established a bindingRule in 1999AD .",
)
HEADS = (
    "", "<think>plan the answer\nstep two</think>", r.PREAMBLES[0] + "\n\n", "<think>short</think>", r.OPEN_PREAMBLE + " (section 9). Please verify.\n\n",
    "note: retrieved authorities may reflect  conflicting positions. The analysis below identifies uncertainty where present. Ok\n\n",
    "REASONING NOTES:\nthe text", "draft <think>never closed",
)
ANSWERS = {
    "conv_id": "conv_id", "turn": "turn", "query_id": "conv_id",
    "answer": f"concat(text, ' ', {case('(conv_id + turn) % 10', TAILS)})",
    "raw": f"concat({case('(conv_id * 3 + turn) % 8', HEADS)}, text)",
    "source_count": "CAST(conv_id % 5 AS BIGINT)",
    "document_mode": "conv_id % 4 = 1",
    "evidence_strength": "CASE WHEN conv_id % 3 = 0 THEN 'weak' ELSE 'strong' END",
}
ANSWERS_CTE = f"answers AS ({t.select_sql(ANSWERS, 'conversations')} WHERE role = 'assistant')"
KEY = ["conv_id", "turn"]


def answers(spark, d):
    return t.project(t.load(spark, d, "conversations").filter("role = 'assistant'"), ANSWERS)


def _lists(df, *names):
    return df.withColumns({n: F.array_join(F.transform(n, lambda x: x.cast("string")), ",") for n in names})


def numbers(spark, d):
    rows = answers(spark, d).select(*KEY, F.array_sort(a.citation_numbers("answer")).alias("numbers"))
    return _lists(rows, "numbers")


def validated(spark, d):
    rows = a.validate_citations(answers(spark, d)).select(*KEY, "valid", "invalid", "unused", "citation_status")
    return _lists(rows, "valid", "invalid", "unused")


def repaired(spark, d):
    rows = a.repair_citations(answers(spark, d)).select(*KEY, F.md5("answer").alias("answer_md5"), "valid", "citation_status")
    return _lists(rows, "valid")


def claims(spark, d):
    return answers(spark, d).select(*KEY, F.posexplode(a.extract_claims("answer")).alias("claim_index", "claim"))


def grounded(spark, d):
    return a.ground_claims(answers(spark, d), selected(spark, d), KEY)


def guarded(spark, d):
    rows = answers(spark, d)
    out = a.guard_answers(rows, a.ground_claims(rows, selected(spark, d), KEY), KEY)
    return out.select(*KEY, "grounding_status", "supported", "partial", "unsupported", "contradicted", F.md5("answer").alias("answer_md5"))


def without_preambles(spark, d):
    return answers(spark, d).select(*KEY, F.md5(a.strip_preambles("raw")).alias("text_md5"))


def displayed(spark, d):
    return answers(spark, d).select(*KEY, F.md5(a.clean_for_display("answer")).alias("text_md5"))


def repaired_words(spark, d):
    from evidex.functions.words import repair_fragmented_words

    return answers(spark, d).select(*KEY, F.md5(repair_fragmented_words("answer")).alias("text_md5"))


def without_reasoning(spark, d):
    return answers(spark, d).select(*KEY, F.md5(a.strip_reasoning("raw")).alias("text_md5"))


def joined(spark, d):
    text = t.load(spark, d, "conversations").filter("role = 'assistant'")
    pieces = text.select(*KEY, F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s).{1,5}"), F.lit(0))).alias("seq", "fragment"))
    return a.join_fragments(pieces, KEY).select(*KEY, F.md5("text").alias("text_md5"))


QUERIES = {
    "citation_numbers": numbers,
    "validate_citations": validated,
    "repair_citations": repaired,
    "extract_claims": claims,
    "ground_claims": grounded,
    "guard_answers": guarded,
    "strip_preambles": without_preambles,
    "clean_answers": displayed,
    "repair_words": repaired_words,
    "strip_reasoning": without_reasoning,
    "join_fragments": joined,
}

_NUMS = (
    "list_sort(list_distinct(list_transform(regexp_extract_all(array_to_string(regexp_extract_all(answer, "
    f"'{r.MARKER}'), ' '), '\\d+'), lambda x: CAST(x AS BIGINT))))"
)


def _csv(x: str) -> str:
    return f"array_to_string({x}, ',')"


CITED_CTE = f"""{ANSWERS_CTE},
cited AS (SELECT *, {_NUMS} AS nums FROM answers)"""
_HEAD = "(?:^|\\n)\\s*(?:EVIDENCE ANALYSIS|INTERNAL ANALYSIS|REASONING NOTES?)\\s*:?\\s*\\n"
ORACLE = {
    "citation_numbers": with_ctes(CITED_CTE) + f"SELECT conv_id, turn, {_csv('nums')} AS numbers FROM cited",
    "validate_citations": with_ctes(CITED_CTE) + f"""
, v AS (SELECT *, list_filter(nums, lambda n: n >= 1 AND n <= source_count) AS ok, list_filter(nums, lambda n: n < 1 OR n > source_count) AS bad FROM cited)
SELECT conv_id, turn, {_csv('ok')} AS valid, {_csv('bad')} AS invalid,
  {_csv('list_filter(range(1, source_count + 1), lambda n: NOT list_contains(ok, n))')} AS unused,
  CASE WHEN len(nums) = 0 THEN 'none' WHEN len(bad) > 0 THEN 'partial' ELSE 'valid' END AS citation_status FROM v""",
    "strip_reasoning": with_ctes(ANSWERS_CTE) + f"""
, s1 AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(raw, '(?i)<think>[^\\n]*?</think>', ' ', 'g'),
   '(?is)<think>.*?</think>', chr(10), 'g'), '(?is)<think>.*', '') AS x FROM answers),
s2 AS (SELECT *, regexp_extract(x, '(?is){_HEAD}(.*)', 1) AS after FROM s1),
s3 AS (SELECT conv_id, turn, CASE WHEN {strip('after')} <> '' THEN after ELSE x END AS y FROM s2)
SELECT conv_id, turn, md5(trim(regexp_replace(y, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))) AS text_md5 FROM s3""",
}
