"""Authority class, rank and attribution of a piece of evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidex.functions.text import as_col, const_map, contains_any, strip
from evidex.rules import authority as r


def classify_authority(source_type="source_type", document_type="document_type", law_name="law_name",
                       court="court", filename="filename", display_name="display_name") -> Column:
    def clean(c) -> Column:
        return F.lower(strip(F.coalesce(as_col(c), F.lit(""))))

    source, kind, law, bench = map(clean, (source_type, document_type, law_name, court))
    file = F.lower(F.coalesce(as_col(filename), F.lit("")))
    title = F.concat(F.lower(F.coalesce(as_col(display_name), F.lit(""))), F.lit(" "), file)
    commentary = contains_any(title, r.COMMENTARY_WORDS)
    either = F.concat(kind, F.lit("\n"), law)
    official = (F.lower(F.coalesce(as_col(document_type), F.lit(""))) == "official_web") | contains_any(
        title, r.OFFICIAL_SITE_WORDS
    )
    return (
        F.when(source.isin("conversation", "matter") & commentary, "article_commentary")
        .when(source == "conversation", "conversation_document")
        .when(source == "matter", "matter_document")
        .when(F.contains(either, F.lit("constitution")), "constitution")
        .when(contains_any(either, r.STATUTE_WORDS), "statute")
        .when(contains_any(either, r.RULE_WORDS), "rules")
        .when(F.contains(bench, F.lit("supreme court")) | bench.isin("sc", "supreme"), "supreme_court")
        .when(F.contains(bench, F.lit("high court")) | F.contains(law, F.lit("high court")), "high_court")
        .when(contains_any(bench, r.TRIBUNAL_WORDS) | contains_any(kind, r.TRIBUNAL_WORDS), "tribunal")
        .when((source == "web") & official, "web_official")
        .when(source == "web", "web_search")
        .when((source == "legal") & contains_any(kind, r.JUDGMENT_WORDS), "official_legal")
        .when(source == "legal", "legal_corpus")
        .otherwise("unknown")
    )


def _lookup(authority: Column | str, position: int) -> Column:
    return F.element_at(const_map({k: str(v[position]) for k, v in r.AUTHORITIES.items()}), as_col(authority))


def authority_rank(authority: Column | str) -> Column:
    return _lookup(authority, 0).cast("bigint")


def attribution(authority: Column | str) -> Column:
    return _lookup(authority, 1)
