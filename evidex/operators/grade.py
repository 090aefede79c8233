"""Grading the evidence found for each question (family F).

Hits stay rows; every measure is a partial aggregate per ``query_id``, so the
texts of a query are never concatenated or collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidex.functions import text as tx
from evidex.functions.authority import authority_rank, classify_authority
from evidex.functions.text import contains_any
from evidex.functions.slices import positions
from evidex.rules import evidence as r

_CITED = rf"(?i){tx.BOUNDARY_BEFORE}(?:section|article|u/s)[{tx.SPACE}]+([0-9A-Za-z\-]+)"
_CITED_WIDE = rf"(?i){tx.BOUNDARY_BEFORE}(?:section|sec\.?|u/s|article)[{tx.SPACE}]+([0-9A-Za-z\-]+)"


def score() -> Column:
    """Relevance if it is set and not zero, else the retrieval score."""
    return F.coalesce(F.nullif("relevance_score", F.lit(0.0)), F.col("score"), F.lit(0.0))


def question_concepts(question: Column | str) -> Column:
    """Cited sections, then concept words, in order of first appearance in the lists."""
    q = tx.as_col(question)
    cited = F.transform(
        F.regexp_extract_all(q, F.lit(_CITED), F.lit(1)), lambda s: F.concat(F.lit("section "), F.lower(s))
    )
    words = F.filter(tx.const_list(r.CONCEPTS), lambda w: F.contains(F.lower(q), w))
    return F.array_distinct(F.concat(cited, words))


def question_terms(question: Column | str) -> Column:
    words = F.regexp_extract_all(F.lower(tx.as_col(question)), F.lit(r"[a-z0-9\-]+"), F.lit(0))
    stop = tx.const_list(r.QUESTION_STOPWORDS)
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def concept_in(concept: Column, text: Column) -> Column:
    """A concept occurs as written, or as a section number ignoring hyphens.

    The wordings "sec. 54", "article 54" and so on all contain the bare number, so
    the hyphen-free containment covers them.
    """
    number = F.replace(F.regexp_extract(concept, "^section (.*)$", 1), F.lit("-"), F.lit(""))
    bare = F.replace(text, F.lit("-"), F.lit(""))
    return F.contains(text, concept) | (
        F.startswith(concept, F.lit("section ")) & F.contains(bare, number)
    )


def _corpus_text() -> Column:
    """Everything of one hit a concept may be found in."""
    return F.lower(
        F.concat_ws(" ", F.coalesce("text", F.lit("")), F.concat_ws(" ", "sections"), F.col("law_name"))
    )


def concept_coverage(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question the concepts its evidence covers, those it misses and the ratio."""
    q = questions.select("query_id", question_concepts("question").alias("concepts"))
    found = (
        hits.withColumn("_t", _corpus_text()).join(q.filter(F.size("concepts") > 0), "query_id")
        .select("query_id", F.explode(F.filter("concepts", lambda c: concept_in(c, F.col("_t")))).alias("concept"))
        .groupBy("query_id").agg(F.collect_set("concept").alias("found"))
    )
    present = hits.select("query_id").distinct().withColumn("has_hits", F.lit(True))
    empty = F.array().cast("array<string>")
    joined = q.join(found, "query_id", "left").join(present, "query_id", "left").withColumn(
        "found", F.coalesce("found", empty)
    )
    covered = F.filter("concepts", lambda c: F.array_contains("found", c))
    n = F.size("concepts")
    ratio = F.when(n > 0, F.size(covered) / n).when(F.col("has_hits"), 1.0).otherwise(0.0)
    return joined.select(
        "query_id", "concepts", covered.alias("covered"),
        F.filter("concepts", lambda c: ~F.array_contains("found", c)).alias("missing"), ratio.alias("coverage"),
    )


def _with_question(hits: DataFrame, questions: DataFrame) -> DataFrame:
    q = questions.select(
        "query_id", question_concepts("question").alias("_concepts"), question_terms("question").alias("_terms")
    )
    # Lower-cased once here; the tests below look into it for every term.
    return hits.withColumn("_t", F.lower(F.coalesce("text", F.lit("")))).join(q, "query_id")


def evidence_relevance(hits: DataFrame, questions: DataFrame) -> DataFrame:
    text, terms, concepts = F.col("_t"), F.col("_terms"), F.col("_concepts")
    hit_terms = F.size(F.filter(terms, lambda t: F.contains(text, t)))
    hit_concepts = F.size(F.filter(concepts, lambda c: concept_in(c, text)))
    room = F.greatest(F.size(terms), F.lit(1)) + F.greatest(F.size(concepts), F.lit(1))
    overlap = (hit_terms + 2 * hit_concepts) / room
    one = F.when(text != "", F.least(F.lit(1.0), overlap * F.lit(0.65) + score() * F.lit(0.35)))
    silent = (F.size(terms) == 0) & (F.size(concepts) == 0)
    return (
        _with_question(hits, questions).groupBy("query_id")
        .agg(F.avg(one).alias("_mean"), F.least(F.lit(1.0), F.max(score())).alias("_top"), F.any_value(silent).alias("_silent"))
        .select("query_id", F.when(F.col("_silent"), F.col("_top")).otherwise(F.coalesce("_mean", F.lit(0.0))).alias("evidence_relevance"))
    )


def is_legal() -> Column:
    return F.coalesce("source_type", F.lit("legal")) == "legal"


def source_measures(hits: DataFrame) -> DataFrame:
    """One aggregate per query with everything the strength rules need from scores and tiers."""
    s = score()
    legal, web = is_legal(), F.col("source_type") == "web"
    kinds = F.size(F.collect_set(F.coalesce("source_type", F.lit(""))))
    return hits.groupBy("query_id").agg(
        F.count("*").alias("hits"),
        F.count_if(legal).alias("legal_hits"),
        F.count_if(web).alias("web_hits"),
        F.max(F.when(legal, s)).alias("legal_top"),
        F.max(F.when(~legal, s)).alias("private_top"),
        F.max(F.when(web, s)).alias("web_top"),
        F.least(F.lit(1.0), F.avg(s) * F.lit(0.75) + kinds / 4 * F.lit(0.25)).alias("source_quality"),
    )


def authority_strength(needs_authority: Column) -> Column:
    legal, private = F.col("legal_top"), F.col("private_top")
    strict = (
        F.when(F.col("legal_hits") > 0, F.least(F.lit(1.0), F.lit(0.55) + legal * F.lit(0.45)))
        .when(F.col("hits") > 0, F.least(F.lit(0.35), private * F.lit(0.35))).otherwise(0.0)
    )
    loose = F.least(F.lit(1.0), F.greatest(F.coalesce(legal, F.lit(0.0)), F.coalesce(private, F.lit(0.0))))
    return F.when(needs_authority, strict).otherwise(loose)


def evidence_conflicts(hits: DataFrame) -> DataFrame:
    """Per query, whether its texts contain both sides of an opposing pair.

    Checked over the corpus hits, and over the hits citing a common section; a
    group of one hit never counts.
    """
    text = F.lower("text")
    sides = [w for pair in r.OPPOSING for w in pair]
    flags = [F.bool_or(F.contains(F.col("_t"), F.lit(w))).alias(f"_w{i}") for i, w in enumerate(sides)]
    clash = reduce(lambda a, b: a | b, [F.col(f"_w{i}") & F.col(f"_w{i + 1}") for i in range(0, len(sides), 2)])
    filled = hits.filter(F.coalesce("text", F.lit("")) != "").withColumn("_t", text)
    corpus = filled.filter(is_legal()).groupBy("query_id").agg(F.count("*").alias("_n"), *flags)
    cited = filled.withColumn(
        "_section", F.explode(F.transform(F.regexp_extract_all("text", F.lit(_CITED_WIDE), F.lit(1)), lambda s: F.lower(s)))
    )
    # A text citing a section twice counts twice, as in a list of mentions.
    by_section = cited.groupBy("query_id", "_section").agg(F.count("*").alias("_n"), *flags)
    verdict = (clash & (F.col("_n") >= 2)).alias("_clash")
    legal_count = filled.filter(is_legal()).groupBy("query_id").agg(F.count("*").alias("_legal"))
    found = (
        corpus.select("query_id", verdict).unionByName(by_section.select("query_id", verdict))
        .groupBy("query_id").agg(F.bool_or("_clash").alias("_clash"))
    )
    return (
        hits.select("query_id").distinct()
        .join(legal_count, "query_id", "left").join(found, "query_id", "left")
        .select("query_id", F.coalesce((F.col("_legal") >= 2) & F.col("_clash"), F.lit(False)).alias("has_conflicts"))
    )


def overall_strength() -> Column:
    """none / weak / partial / strong from the measures of a query and its mode columns."""
    composite = (
        F.col("authority_strength") * F.lit(0.35) + F.col("evidence_relevance") * F.lit(0.30)
        + F.col("coverage") * F.lit(0.25) + F.col("source_quality") * F.lit(0.10)
    )
    private, web = F.coalesce("private_top", F.lit(0.0)), F.coalesce("web_top", F.lit(0.0))

    def ladder(*steps: tuple[float, str], last: str) -> Column:
        out = F.lit(last)
        for least, name in reversed(steps):
            out = F.when(composite >= least, name).otherwise(out)
        return out

    document = (
        F.when((private >= 0.45) & (F.col("evidence_relevance") >= 0.35), "strong")
        .when(private >= 0.25, "partial")
        .when(F.col("prefer_web") & (web >= 0.40), "partial").otherwise("none")
    )
    uncited = (
        F.when(F.col("web_hits") > 0,
               F.when((web >= 0.45) | (F.col("prefer_web") & (web >= 0.35)), "partial").otherwise("weak"))
        .when(private >= 0.30, "weak").otherwise("none")
    )
    thin = (F.size("concepts") >= 2) & (F.col("coverage") < 0.50)
    authority = (
        F.when(F.col("legal_hits") == 0, uncited)
        .when(thin, ladder((0.55, "partial"), (0.35, "weak"), last="none"))
        .otherwise(ladder((0.70, "strong"), (0.45, "partial"), (0.25, "weak"), last="none"))
    )
    return (
        F.when(F.col("hits") == 0, "none")
        .when(F.col("document_mode"), document)
        .when(F.col("needs_authority"), authority)
        .otherwise(ladder((0.60, "strong"), (0.35, "partial"), last="weak"))
    )


def assess(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per question; ``questions(query_id, question, needs_authority, document_mode, prefer_web)``."""
    measures = source_measures(hits)
    out = (
        questions.select("query_id", "needs_authority", "document_mode", "prefer_web")
        .join(concept_coverage(hits, questions), "query_id")
        .join(measures, "query_id", "left")
        .join(evidence_relevance(hits, questions), "query_id", "left")
        .join(evidence_conflicts(hits), "query_id", "left")
        .fillna(0, ["hits", "legal_hits", "web_hits", "evidence_relevance", "source_quality"])
        .fillna(False, ["has_conflicts"])
        .withColumn("authority_strength", authority_strength(F.col("needs_authority")))
    )
    return out.withColumn("overall_strength", overall_strength())


def simple_strength(hits: DataFrame, modes: DataFrame) -> DataFrame:
    """Strength without a question text: ``modes(query_id, needs_authority, document_mode)``."""
    m = modes.join(source_measures(hits.withColumn("source_type", F.coalesce("source_type", F.lit("?")))), "query_id", "left")
    n, legal_n = F.coalesce("hits", F.lit(0)), F.coalesce("legal_hits", F.lit(0))
    legal, private = F.coalesce("legal_top", F.lit(0.0)), F.coalesce("private_top", F.lit(0.0))
    verdict = (
        F.when(F.col("document_mode"),
               F.when(n == legal_n, "none").when(private >= 0.25, "strong").otherwise("partial"))
        .when(F.col("needs_authority"),
              F.when(legal_n > 0, F.when(legal >= 0.45, "strong").otherwise("partial"))
              .when(n > 0, "weak").otherwise("none"))
        .when((legal_n > 0) & (legal >= 0.40), "strong")
        .when(n > 0, "partial").otherwise("none")
    )
    return m.select(*modes.columns, verdict.alias("strength"))


STRENGTH_STEPS = 500  # buckets of support a query's items are numbered in


def evidence_items(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Every hit with authority, support strength, role and its place in the bundle."""
    text, concepts = F.col("_t"), F.col("_concepts")
    covered = F.size(F.filter(concepts, lambda c: F.contains(text, c)))
    share = F.when(F.size(concepts) > 0, covered / F.size(concepts)).otherwise(F.col("relevance"))
    support = F.when(text == "", 0.0).otherwise(
        F.least(F.lit(1.0), F.col("relevance") * F.lit(0.45) + share * F.lit(0.40)
                + F.col("authority_rank") / F.lit(100.0) * F.lit(0.15))
    )
    strict = F.col("needs_authority") & ~F.col("document_mode")
    role = (
        F.when((F.col("support_strength") >= 0.62) & (F.col("relevance") >= 0.35),
               F.when(strict & (F.col("authority_rank") < 50) & (F.col("support_strength") < 0.75), "weak").otherwise("supporting"))
        .when(F.col("support_strength") >= 0.40, "relevant")
        .when(F.col("relevance") >= 0.25, "weak")
        .otherwise("retrieved")
    )
    strength = F.bround("support_strength", 12)
    order = [F.desc(strength), F.desc("authority_rank"), F.desc("relevance"), F.asc("ordinal")]
    items = (
        _with_question(hits, questions)
        .join(questions.select("query_id", "needs_authority", "document_mode"), "query_id")
        .withColumn("relevance", score())
        .withColumn("authority_type", classify_authority())
        .withColumn("authority_rank", authority_rank("authority_type"))
        .withColumn("support_strength", support)
        .withColumn("role", role)
        .select(*hits.columns, "authority_type", "authority_rank", "relevance", "support_strength", "role")
    )
    return positions(items, ["query_id"], F.floor(strength * STRENGTH_STEPS).cast("bigint"), order)


def bundle_metadata(items: DataFrame) -> DataFrame:
    return items.groupBy("query_id").agg(
        F.count("*").alias("evidence_count"),
        F.count_if(F.col("role").isin("supporting", "relevant")).alias("supporting_count"),
        F.count_if(F.col("role") == "contradicting").alias("contradicting_count"),
        F.array_sort(F.collect_set("authority_type")).alias("authority_types"),
    )


def requires_authority(question: Column | str, task: Column | str, document_mode: Column) -> Column:
    marked = contains_any(F.lower(tx.as_col(question)), r.AUTHORITY_MARKERS)
    return ~document_mode & (F.coalesce(tx.as_col(task).isin(*r.AUTHORITY_TASKS), F.lit(False)) | marked)
