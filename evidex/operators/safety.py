"""Screening, redaction and safety reports (family J)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidex.functions import text as tx
from evidex.functions.slices import sliced
from evidex.functions.text import contains_any
from evidex.rules import safety as r

# Unicode-aware word boundaries and white space, case ignored.
_FLAGS = "(?iU)"


def _matches(text: Column, pattern: str) -> Column:
    return text.rlike(_FLAGS + pattern)


def _words(text: Column, words: list[str]) -> Column:
    """Any of the words, also with an English plural ending."""
    escaped = "|".join(re.escape(w) for w in words)
    return text.rlike(rf"{_FLAGS}\b(?:{escaped})(?:es|s)?\b")


def is_code_request(text: Column) -> Column:
    legal_code = _matches(text, r.LEGAL_CODE)
    asks = _matches(text, r.CODE_REQUEST) | _matches(text, r.LANGUAGE_CODE_REQUEST)
    urdu = contains_any(text, r.URDU_CODE) & ~legal_code
    return urdu | (asks & ~(legal_code & ~_matches(text, r.PROGRAMMING_LANGUAGE)))


def is_crime_help(text: Column) -> Column:
    return contains_any(text, r.URDU_CRIME) | _matches(text, r.CRIME_HELP)


def looks_legal(text: Column) -> Column:
    return (
        _words(text, r.LEGAL_WORDS) | contains_any(text, r.LEGAL_PHRASES) | _matches(text, r.CITED_SECTION)
        | _matches(text, r.CITED_CASE) | _matches(text, r.CONCEPT_QUESTION)
    )


def is_follow_up(text: Column) -> Column:
    return _matches(text, r.FOLLOW_UP)


def looks_like_case_fact(text: Column) -> Column:
    return _words(text, r.FACT_WORDS) | contains_any(text, r.FACT_PHRASES) | is_follow_up(text)


def is_pointing(text: Column) -> Column:
    """A short reply about the previous turn, such as "what is this"."""
    few = F.size(F.split(text, " ")) <= 14
    return (
        (text != "") & (F.length(text) <= 160) & _matches(text, r.POINTING)
        & (few | _matches(text, r.POINTING_VERBS))
    )


def without_override(text: Column) -> Column:
    return tx.collapse(F.regexp_replace(text, _FLAGS + r.OVERRIDE, " "))


# One row of facts per message; the cascade over them is a second projection, which
# keeps each generated method below the JVM's size limit.
def message_facts(messages: DataFrame, text_col: str = "text") -> DataFrame:
    t = F.col("norm")
    bare = F.col("bare")
    return (
        messages.withColumn("norm", tx.normalize_message(text_col))
        .withColumn("bare", without_override(t))
        .withColumns({
            "f_code": is_code_request(t), "f_crime": is_crime_help(t), "f_legal": looks_legal(t),
            "f_follow": is_follow_up(t), "f_fact": looks_like_case_fact(t), "f_pointing": is_pointing(t),
            "f_off_topic": _matches(t, r.OFF_TOPIC), "f_off_topic_urdu": contains_any(t, r.URDU_OFF_TOPIC),
            "f_override": bare != t, "f_bare_legal": (bare != "") & looks_legal(bare),
            "f_greeting": _matches(t, r.GREETING),
        })
    )


ALLOW, CODE, CRIME = "allow", "block_code", "block_illegal"
IRRELEVANT, JAILBREAK = "block_irrelevant", "block_jailbreak"


def _decide(prior_crime: Column, legal_history: Column, in_case: Column) -> Column:
    """Ordered screening rules over the facts of a message and of its history."""
    short_follow = F.col("f_follow") | F.col("norm").isin(*r.SHORT_REPLIES)
    off_topic = F.col("f_off_topic_urdu") | (F.col("f_off_topic") & ~F.col("f_legal"))
    reply = F.col("f_follow") | F.col("f_pointing") | ((F.length("norm") <= 120) & ~F.col("f_code"))
    rules = [
        (F.col("norm") == "", ALLOW, "empty"),
        (F.col("f_code"), CODE, "programming or source-code request"),
        (F.col("f_crime"), CRIME, "operational crime or evasion request"),
        (prior_crime & short_follow, CRIME, "multi-turn operational crime request"),
        (off_topic, IRRELEVANT, "off-topic non-legal request"),
        (F.col("f_override") & ~F.col("f_bare_legal"), JAILBREAK, "instruction-override with no legal question"),
        (F.col("f_greeting"), ALLOW, "greeting or identity"),
        (F.col("f_legal"), ALLOW, "legal or case-relevant question"),
        (in_case & F.col("f_fact"), ALLOW, "case or matter context"),
        (legal_history & reply, ALLOW, "legal conversation follow-up"),
    ]
    verdict = F.struct(F.lit(IRRELEVANT).alias("decision"), F.lit("no legal or case signal").alias("reason"))
    for test, decision, reason in reversed(rules):
        verdict = F.when(test, F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))).otherwise(verdict)
    return verdict


def _judged(facts: DataFrame, columns: list[str], *args: Column) -> DataFrame:
    return (
        facts.withColumn("_v", _decide(*args))
        .select(*columns, (F.col("_v.decision") == ALLOW).alias("allowed"),
                F.col("_v.decision").alias("decision"), F.col("_v.reason").alias("reason"))
    )


def screen(messages: DataFrame, in_case: Column | None = None, text_col: str = "text") -> DataFrame:
    """Screen messages on their own, without history."""
    no = F.lit(False)
    case = in_case if in_case is not None else no
    return _judged(message_facts(messages, text_col), messages.columns, no, no, case)


CRIME_LOOKBACK, LEGAL_LOOKBACK = 6, 12


def screen_conversations(messages: DataFrame, in_case: Column | None = None) -> DataFrame:
    """Screen the user turns of conversations with the rules that look back.

    Looking back reaches twelve turns, so a conversation is cut into slices of
    consecutive turns, each preceded by a copy of the last twelve of the slice
    before; a conversation of any length spreads over many tasks.
    """
    facts = message_facts(messages).withColumn("_case", in_case if in_case is not None else F.lit(False))
    w = Window.partitionBy("conv_id", "_slice").orderBy("turn")
    last_user = F.last(F.when(F.col("role") == "user", F.col("f_crime")), ignorenulls=True)
    seen_legal = F.bool_or((F.col("norm") != "") & F.col("f_legal"))
    with_history = (
        sliced(facts, LEGAL_LOOKBACK).withColumn("_crime", F.coalesce(last_user.over(w.rowsBetween(-CRIME_LOOKBACK, -1)), F.lit(False)))
        .withColumn("_legal", F.coalesce(seen_legal.over(w.rowsBetween(-LEGAL_LOOKBACK, -1)), F.lit(False)))
        .filter((F.col("_slice") == F.col("_own")) & (F.col("role") == "user"))
    )
    return _judged(with_history, messages.columns, F.col("_crime"), F.col("_legal"), F.col("_case"))


def screen_output(answers: DataFrame, text_col: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text_col), F.lit(""))
    code = t.rlike("(?i)" + r.FENCED_CODE_OUTPUT) | t.rlike(r.CODE_LINE_OUTPUT)
    secret = t.rlike("(?i)" + r.SECRET_OUTPUT)
    decision = F.when(code, CODE).when(secret, JAILBREAK).otherwise(ALLOW)
    reason = (
        F.when(code, "model emitted programming code").when(secret, "model emitted secret-like material")
        .otherwise("output clean")
    )
    return answers.select("*", (decision == ALLOW).alias("allowed"), decision.alias("decision"), reason.alias("reason"))


def redact_injections(text: Column | str) -> Column:
    """Lines that read like instructions are replaced inside evidence text."""
    return F.regexp_replace(tx.as_col(text), "(?imd)" + r.INJECTION_LINE, r.INJECTION_NOTICE)


# --- log redaction ----------------------------------------------------------------

def is_sensitive(key: Column) -> Column:
    return key.rlike(r.SENSITIVE_KEYS)


def redact_map(headers: Column | str) -> Column:
    """Flat maps such as request headers."""
    return F.transform_values(tx.as_col(headers), lambda k, v: F.when(is_sensitive(k), F.lit(r.REDACTED)).otherwise(v))


_SENSITIVE = re.compile(r.SENSITIVE_KEYS)


def _redacted(value):
    if isinstance(value, dict):
        return {k: r.REDACTED if _SENSITIVE.search(k) else _redacted(v) for k, v in value.items()}
    return [_redacted(v) for v in value] if isinstance(value, list) else value


def _redacted_text(text):
    if text is None:
        return None
    try:
        return json.dumps(_redacted(json.loads(text)), ensure_ascii=False)
    except ValueError:
        return text


def _redact_series(payloads: pd.Series) -> pd.Series:
    return payloads.map(_redacted_text)


def redact_json(payload: Column | str) -> Column:
    """JSON text of any depth.  Only rows naming a sensitive key travel to Python; the rest stay as they are."""
    p = tx.as_col(payload)
    suspect = p.rlike(r.SENSITIVE_KEYS)
    redact = F.pandas_udf(_redact_series, "string")
    return F.when(suspect, redact(F.when(suspect, p))).otherwise(p)


def escaped_length(text: Column) -> Column:
    """Characters of a JSON text written with ASCII only: six for another character, twelve beyond the first plane."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[^\x00-\x7F]")) * 5 + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]")) * 6


def escaped(text: Column) -> Column:
    """JSON text with every character beyond ASCII as ``\\uXXXX``."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def one(c: Column) -> Column:
        n = F.ascii(c)
        pair = F.concat(unit(F.floor((n - 0x10000) / 0x400) + 0xD800), unit((n - 0x10000) % 0x400 + 0xDC00))
        return F.when(n < 128, c).when(n < 0x10000, unit(n)).otherwise(pair)

    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def truncate_payload(payload: Column | str, max_bytes: int) -> Column:
    """JSON longer than the limit, as written with ASCII only, becomes a marker with a preview of that form."""
    p = tx.as_col(payload)
    preview = F.substring(escaped(F.substring(p, 1, max_bytes)), 1, max_bytes)
    marker = F.to_json(F.struct(F.lit(True).alias("_truncated"), preview.alias("preview")))
    return F.when(escaped_length(p) <= max_bytes, p).otherwise(marker)


def safety_report(screened: DataFrame, *by: str) -> DataFrame:
    """Decisions counted by reason and the given keys."""
    return screened.groupBy(*by, "decision", "reason").agg(F.count("*").alias("messages"))
