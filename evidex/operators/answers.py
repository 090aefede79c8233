"""Checking and cleaning model answers (family K)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions import text as tx
from evidex.functions.fold import let, unique_values
from evidex.functions.text import contains_any
from evidex.functions.words import repair_fragmented_words
from evidex.operators.pack import SENTENCE_END
from evidex.rules import answers as r

_I = "(?iU)"
_NO_NUMBERS = "array<bigint>"


# --- citations -------------------------------------------------------------------

def _numbers(marker: Column) -> Column:
    return F.transform(F.regexp_extract_all(marker, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("bigint"))


def _markers(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit(r.MARKER), F.lit(0))


def citation_numbers(answer: Column | str) -> Column:
    """Every cited source number, in order, distinct."""
    text = F.coalesce(tx.as_col(answer), F.lit(""))
    return F.array_distinct(F.flatten(F.transform(_markers(text), _numbers)))


def _known(n: Column, count: Column) -> Column:
    return (n >= 1) & (n <= count)


def validate_citations(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """``valid``, ``invalid`` and ``unused`` source numbers and a status."""
    cited, count = F.col("_cited"), F.col("source_count")
    every = F.when(count > 0, F.sequence(F.lit(1).cast("bigint"), F.greatest(count, F.lit(1)).cast("bigint"))).otherwise(
        F.array().cast(_NO_NUMBERS)
    )
    valid = F.array_sort(F.filter(cited, lambda n: _known(n, count)))
    status = F.when(F.size(cited) == 0, "none").when(F.size("invalid") > 0, "partial").otherwise("valid")
    return (
        answers.withColumn("_cited", citation_numbers(answer_col))
        .withColumn("valid", valid)
        .withColumn("invalid", F.array_sort(F.filter(cited, lambda n: ~_known(n, count))))
        .withColumn("unused", F.array_except(every, F.col("valid")))
        .withColumn("citation_status", status).drop("_cited")
    )


def repair_citations(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """Answers with unknown source numbers get their markers rewritten; others stay as they are."""
    text, count = F.coalesce(F.col(answer_col), F.lit("")), F.col("source_count")

    def rewritten(marker: Column) -> Column:
        named = F.transform(F.filter(_numbers(marker), lambda n: _known(n, count)),
                            lambda n: F.concat(F.lit("Source "), n.cast("string")))
        return F.when(F.size(named) == 0, "").otherwise(F.concat(F.lit("["), F.array_join(named, ", "), F.lit("]")))

    between, found = F.split(text, r.MARKER), F.transform(_markers(text), rewritten)
    woven = F.array_join(F.zip_with(between, found, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    tidy = F.regexp_replace(F.regexp_replace(woven, rf"[{tx.SPACE}]{{2,}}", " "), r" \.", ".")
    broken = F.size(F.filter(citation_numbers(answer_col), lambda n: ~_known(n, count))) > 0
    fixed = answers.withColumn("_broken", broken).withColumn(
        answer_col, F.when(F.col("_broken"), tx.strip(tidy)).otherwise(F.col(answer_col))
    )
    return (
        validate_citations(fixed, answer_col)
        .withColumn("citation_status", F.when(F.col("_broken"), "repaired").otherwise(F.col("citation_status")))
        .drop("_broken")
    )


# --- claims -------------------------------------------------------------------------

MATERIAL_CHARS, MATERIAL_SENTENCES = 25, 8


def _every(pattern: str, text: Column, flags: str = _I, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group))


def extract_claims(answer: Column | str) -> Column:
    """Cited sections, cases, long quotes and material sentences, distinct in that order."""
    text = F.coalesce(tx.as_col(answer), F.lit(""))
    quotes = F.transform(_every(r.QUOTE, text, ""), lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
    sentences = F.transform(F.split(tx.strip(text), SENTENCE_END), lambda s: tx.strip(s))
    material = F.slice(
        F.filter(
            sentences,
            lambda s: (F.length(s) >= MATERIAL_CHARS) & s.rlike(_I + r.ASSERTION)
            & ~F.lower(s).rlike("^(?:" + "|".join(map(re.escape, r.NOT_CLAIMS)) + ")"),
        ), 1, MATERIAL_SENTENCES,
    )
    named = F.transform(F.concat(_every(r.SECTION, text), _every(r.CASE, text), quotes), lambda c: tx.strip(c))
    return unique_values(F.concat(named, material))


def section_number(claim: Column) -> Column:
    first = F.regexp_extract(claim, _I + r.SECTION, 1)
    return F.lower(F.nullif(F.concat(first, F.when(first == "", F.regexp_extract(claim, _I + r.SECTION, 2)).otherwise("")), F.lit("")))


def _opening(words: Column, n: int) -> Column:
    return F.array_join(F.slice(words, 1, n), " ")


def claim_facts(claim: Column, corpus: Column) -> Column:
    """Tests of one claim against the evidence text of its question."""
    flat = tx.collapse(F.lower(claim))
    words = F.split(flat, " ")
    number = section_number(claim)
    long = (F.length(flat) >= 20) & (F.size(words) >= 4)
    section_known = F.coalesce(F.contains(corpus, number), F.lit(False))
    lower = F.lower(claim)
    case = tx.collapse(F.lower(F.regexp_extract(claim, _I + r.CASE, 0)))
    clog = F.contains(lower, F.lit("not a clog")) & F.contains(corpus, F.lit("clog on")) & ~F.contains(corpus, F.lit("not a clog"))
    restrict = (
        F.contains(lower, F.lit("does not restrict")) & contains_any(corpus, ("restrict", "bar"))
        & ~F.contains(corpus, F.lit("does not restrict"))
    )
    missing = F.exists(tx.const_list(r.RELATIONS), lambda k: F.contains(lower, k) & ~F.contains(corpus, k))
    return F.struct(
        (F.contains(corpus, flat) | section_known | (long & F.contains(corpus, _opening(words, 8)))).alias("supported"),
        (long & F.contains(corpus, _opening(words, 6))).alias("opening"),
        (case != "").alias("is_case"), F.contains(corpus, case).alias("case_known"),
        claim.rlike(r.QUOTE).alias("is_quote"), (clog | restrict).alias("contradicted"), missing.alias("missing"),
        number.isNotNull().alias("has_section"), section_known.alias("section_known"),
        claim.rlike(_I + r.HOLDING).alias("holding"), claim.rlike(_I + r.ASSERTION).alias("assertion"),
    )


def assess_claim(claim: Column, corpus: Column) -> Column:
    """supported, partial, unsupported or contradicted."""
    def verdict(f: Column) -> Column:
        plain = F.when(f["supported"], "supported").otherwise("unsupported")
        return (
            F.when(f["is_case"], F.when(f["case_known"], "supported").otherwise("unsupported"))
            .when(f["is_quote"], plain)
            .when(f["contradicted"], "contradicted")
            .when(f["has_section"],
                  F.when(~f["section_known"], "unsupported").when(f["missing"] | ~f["supported"], "partial").otherwise("supported"))
            .when(f["holding"], plain)
            .when(f["missing"] & f["assertion"], F.when(f["supported"], "partial").otherwise("unsupported"))
            .when(f["supported"], "supported")
            .when(f["opening"], "partial")
            .when(f["assertion"], "unsupported")
            .otherwise("partial")
        )

    return let(claim_facts(claim, corpus), verdict)


def assess_document_claim(claim: Column, corpus: Column) -> Column:
    """Document mode: paraphrases count when enough of their words occur."""
    words = F.array_distinct(F.filter(
        _every(r"[a-z0-9\-]+", F.lower(claim), ""),
        lambda w: (F.length(w) > 3) & ~F.array_contains(tx.const_list(r.PARAPHRASE_IGNORED), w),
    ))
    hits = F.size(F.filter(words, lambda w: F.contains(corpus, w)))
    enough = (F.size(words) > 0) & (hits >= F.greatest(F.lit(2), F.floor(F.size(words) / 2)))

    def verdict(f: Column) -> Column:
        ok = (
            F.when(f["is_quote"], f["supported"])
            .when((F.length(claim) >= 40) & F.contains(claim, F.lit(" ")), f["supported"] | enough)
            .when(f["has_section"], f["supported"]).otherwise(True)
        )
        return F.when(ok, "supported").otherwise("unsupported")

    return let(claim_facts(claim, corpus), verdict)


def evidence_text(hits: DataFrame) -> DataFrame:
    """Lower-case text of everything retrieved for a question (a list the limits bound)."""
    own = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.concat_ws(" ", "sections"), F.col("law_name"), F.col("section"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", own.alias("t")))), lambda s: s["t"])
    return hits.groupBy("query_id").agg(F.lower(F.array_join(parts, " ")).alias("corpus"))


def ground_claims(answers: DataFrame, hits: DataFrame, key: list[str]) -> DataFrame:
    """One row per claim with its status; ``answers`` needs ``query_id, answer, document_mode``."""
    claims = answers.select(*key, "query_id", "document_mode", F.posexplode(extract_claims("answer")).alias("claim_index", "claim"))
    corpus = F.coalesce("corpus", F.lit(""))
    status = F.when(F.col("document_mode"), assess_document_claim(F.col("claim"), corpus)).otherwise(
        assess_claim(F.col("claim"), corpus)
    )
    return claims.join(evidence_text(hits), "query_id", "left").select(
        *key, "query_id", F.col("claim_index").cast("bigint").alias("claim_index"), "claim", status.alias("status")
    )


def guard_answers(answers: DataFrame, claims: DataFrame, key: list[str]) -> DataFrame:
    """Grounding status per answer, unsupported case citations scrubbed, old notices removed.

    ``answers`` needs ``answer, document_mode, evidence_strength``.  Claims are a handful
    per answer, so the scrub list collected per answer stays small.
    """
    bad = F.col("status").isin("unsupported", "contradicted")
    invented = bad & F.col("claim").rlike(_I + r.CASE) & (
        (F.length("claim") < 80) | F.col("claim").rlike(f"{_I}^(?:{r.CASE})$")
    )
    counts = claims.groupBy(*key).agg(
        F.count_if(bad).alias("unsupported"), F.count_if(F.col("status") == "partial").alias("partial"),
        F.count_if(F.col("status") == "supported").alias("supported"),
        F.count_if(F.col("status") == "contradicted").alias("contradicted"),
        F.transform(
            F.sort_array(F.collect_list(F.when(invented, F.struct("claim_index", "claim")))), lambda s: s["claim"]
        ).alias("_invented"),
    )
    u, p, s = (F.coalesce(c, F.lit(0)) for c in ("unsupported", "partial", "supported"))
    grounded = (
        F.when(F.col("document_mode"), F.when(u > 0, "partial").otherwise("strong"))
        .when((u > 0) & (s == 0) & (p == 0), "insufficient").when((u > 0) | (p > 0), "partial")
        .when(F.col("evidence_strength") == "weak", "partial").otherwise("strong")
    )
    scrub = ~F.col("document_mode") & (F.col("grounding_status") != "strong") & (u > 0)
    cleaned = F.aggregate(
        F.coalesce("_invented", F.array().cast("array<string>")), F.col("answer"),
        lambda text, claim: F.replace(text, claim, F.lit(r.UNVERIFIED)),
    )
    return (
        answers.join(counts, key, "left").fillna(0, ["unsupported", "partial", "supported", "contradicted"])
        .withColumn("grounding_status", F.when(tx.is_blank("answer"), "insufficient").otherwise(grounded))
        .withColumn("answer", tx.strip(strip_preambles(F.when(scrub, cleaned).otherwise(F.col("answer")))))
        .drop("_invented")
    )


# --- cleaning -----------------------------------------------------------------------

def _preamble_pattern() -> str:
    """All known notices, as often as they repeat at the start of the text.

    A closed notice may be followed by a few more words before its blank line; the open
    one runs to the next blank line.
    """
    closed = []
    for notice in r.PREAMBLES:
        slack = max(80, len(notice) + 2 + 40) - len(notice)
        words = r"(?:(?!\n\n)\s)+".join(re.escape(w) for w in notice.split())
        closed.append(rf"{words}(?:(?!\n\n)[\s\S]){{0,{slack}}}\n\n\s*")
    tail = r"(?:(?:(?!\n\n)[\s\S])*+\n\n|(?![\s\S]*\n\n))\s*"
    return rf"(?iU)^\s*(?:{'|'.join(closed)}|{re.escape(r.OPEN_PREAMBLE)}{tail})+"


def strip_preambles(answer: Column | str) -> Column:
    text = F.coalesce(tx.as_col(answer), F.lit(""))
    return F.when(tx.is_blank(text), text).otherwise(tx.lstrip(F.regexp_replace(text, _preamble_pattern(), "")))


def remove_markers(answer: Column | str) -> Column:
    """Source lists and markers removed, missing blanks between joined words restored."""
    text = tx.strip(F.coalesce(tx.as_col(answer), F.lit("")))
    for pattern in r.DISPLAY_PATTERNS:
        text = F.regexp_replace(text, "(?Ud)" + pattern, "")
    text = F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2")
    return F.regexp_replace(text, r"([A-Za-z])(\p{Nd})", "$1 $2")


def tidy_spacing(text: Column) -> Column:
    text = F.regexp_replace(text, r"[ \t]{2,}", " ")
    text = F.regexp_replace(text, rf"[{tx.SPACE}]+([.,;:])", "$1")
    return tx.strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def clean_for_display(answer: Column | str) -> Column:
    return tidy_spacing(repair_fragmented_words(remove_markers(answer)))


def strip_reasoning(text: Column | str) -> Column:
    """Hidden reasoning and internal headings removed, inner layout kept."""
    t = F.coalesce(tx.as_col(text), F.lit(""))
    block = f"(?is){r.THINK_OPEN}(?:(?!{r.THINK_CLOSE}).)*+{r.THINK_CLOSE}"
    flat_block = rf"(?i){r.THINK_OPEN}(?:(?!{r.THINK_CLOSE})[^\n])*+{r.THINK_CLOSE}"
    t = F.regexp_replace(F.regexp_replace(t, flat_block, " "), block, "\n")
    t = F.regexp_replace(t, f"(?is){r.THINK_OPEN}.*", "")
    parts = F.split(t, "(?U)" + r.ANALYSIS_HEADER, 2)
    rest = F.get(parts, F.lit(1))
    t = F.when((F.size(parts) == 2) & ~tx.is_blank(rest), rest).otherwise(t)
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"), F.lit("\n"))


def join_fragments(fragments: DataFrame, key: list[str]) -> DataFrame:
    """Streamed fragments ``(key..., seq, fragment)`` joined in order.

    A blank goes in only between finished words: lower case before upper case, or a
    closing mark before a letter or digit.  One answer is one group.
    """
    ordered = F.filter(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "fragment"))), lambda s: s["fragment"]), lambda f: f != ""
    )

    def spaced(f: Column, i: Column) -> Column:
        before, first = F.right(F.get("_parts", i - 1), F.lit(1)), F.left(f, F.lit(1))
        finished = before.rlike(r"^\p{Ll}$") & first.rlike(r"^\p{Lu}$")
        closed = before.rlike("^[)\\]\"'%]$") & first.rlike(r"^[\p{L}\p{N}]$")
        return F.when((i > 0) & (finished | closed), F.concat(F.lit(" "), f)).otherwise(f)

    return (
        fragments.filter(F.col("fragment").isNotNull()).groupBy(*key).agg(ordered.alias("_parts"))
        .select(*key, F.array_join(F.transform("_parts", spaced), "").alias("text"))
    )
