"""Links, snippets and hosts of web pages (family O)."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions import text as tx

# Hosts of official sources.
OFFICIAL_HOSTS = (
    "pakistancode.gov.pk", "punjablaws.gov.pk", "sindhlaws.gov.pk", "na.gov.pk", "senate.gov.pk",
    "supremecourt.gov.pk", "lhc.gov.pk", "shc.gov.pk", "ihc.gov.pk", "phc.gov.pk", "bhc.gov.pk",
    "federalshariatcourt.gov.pk", "molaw.gov.pk", "pakistan.gov.pk",
)
# Result links and snippets of a result page; plain anchors and paragraphs of any page.
RESULT_LINK = r"(?is)<a[^>]*class=\"[^\"]*result__a[^\"]*\"[^>]*href=\"([^\"]+)\"[^>]*>(.*?)</a>"
RESULT_SNIPPET = (
    r"(?is)<a[^>]*class=\"[^\"]*result__snippet[^\"]*\"[^>]*>(.*?)</a>"
    r"|<(?:td|div)[^>]*class=\"[^\"]*result-snippet[^\"]*\"[^>]*>(.*?)</(?:td|div)>"
)
PAGE_LINK = r"(?is)<a[^>]*href=\"([^\"]+)\"[^>]*>(.*?)</a>"
PAGE_SNIPPET = r"(?is)<p[^>]*>(.*?)</p>|<li[^>]*>(.*?)</li>"
OWN_HOST = "https://duckduckgo.com"
TOP_SCORE, SCORE_STEP, LOW_SCORE, SNIPPET_CHARS = 0.85, 0.07, 0.2, 2000


def _unescape_series(texts: pd.Series) -> pd.Series:
    return texts.map(unescape, na_action="ignore")


def unescape_html(text: Column) -> Column:
    """Entities decoded; text without an ampersand stays in the JVM."""
    has = F.contains(text, F.lit("&"))
    return F.when(has, F.pandas_udf(_unescape_series, "string")(F.when(has, text))).otherwise(text)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def _decode(value: Column, plus_is_blank: bool) -> Column:
    raw = value if plus_is_blank else F.replace(value, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(raw), value)


def unwrap_redirect(href: Column | str) -> Column:
    """The target of a redirect link, and a scheme for protocol-relative links."""
    h = F.coalesce(tx.as_col(href), F.lit(""))
    target = F.regexp_extract(h, r"[?&]uddg=([^&#]+)", 1)
    full = F.when(F.startswith(h, F.lit("//")), F.concat(F.lit("https:"), h)).otherwise(h)
    return F.when(target != "", _decode(_decode(target, True), False)).otherwise(full)


def host(url: Column | str) -> Column:
    name = F.lower(F.regexp_extract(tx.as_col(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))
    return F.regexp_replace(name, r"^www\.", "")


def is_official(url: Column | str) -> Column:
    """The host is one of the official hosts or below one of them."""
    hosts = "|".join(h.replace(".", r"\.") for h in OFFICIAL_HOSTS)
    return host(url).rlike(rf"^(?:.*\.)?(?:{hosts})$")


def localize_query(query: Column | str) -> Column:
    q = tx.as_col(query)
    return F.when(F.contains(F.lower(q), F.lit("pakistan")), q).otherwise(F.concat(q, F.lit(" Pakistan law")))


def extract_links(pages: DataFrame, link: str = RESULT_LINK, snippet: str = RESULT_SNIPPET, limit: int | None = None) -> DataFrame:
    """Links of each page in order, distinct by target, with title, snippet, score and official flag.

    The first place of a repeated link counts for its score and snippet.  Repeats
    collapse in a combinable aggregate.
    """
    html = F.coalesce("html", F.lit(""))
    snippets = F.zip_with(
        F.regexp_extract_all(html, F.lit(snippet), F.lit(1)), F.regexp_extract_all(html, F.lit(snippet), F.lit(2)),
        lambda a, b: F.when(a != "", a).otherwise(b),
    )
    rows = pages.select(
        "page_id", F.regexp_extract_all(html, F.lit(link), F.lit(1)).alias("_h"),
        F.regexp_extract_all(html, F.lit(link), F.lit(2)).alias("_t"), snippets.alias("_s"),
    ).select("page_id", F.posexplode(F.arrays_zip("_h", "_t")).alias("position", "l"), "_s")
    raw = rows.select(
        "page_id", "position", unescape_html(F.col("l._h")).alias("href"), unescape_html(strip_tags(F.col("l._t"))).alias("title"),
        unescape_html(strip_tags(F.coalesce(F.get("_s", F.col("position")), F.lit("")))).alias("snippet"),
    )
    found = (
        raw.withColumn("url", unwrap_redirect("href"))
        .filter((F.col("url") != "") & ~F.startswith("url", F.lit(OWN_HOST)))
        .groupBy("page_id", "url").agg(F.min_by(F.struct("title", "snippet"), "position").alias("r"), F.min("position").alias("position"))
    )
    if limit is not None:
        from pyspark.sql.window import Window

        place = F.row_number().over(Window.partitionBy("page_id").orderBy("position"))
        found = found.withColumn("_n", place).filter(F.col("_n") <= limit).drop("_n")
    title = tx.collapse(F.col("r.title"))
    return found.select(
        "page_id", F.col("position").cast("bigint").alias("position"), "url",
        F.when(title != "", title).otherwise(F.col("url")).alias("title"),
        F.substring(tx.collapse(F.col("r.snippet")), 1, SNIPPET_CHARS).alias("snippet"),
        F.greatest(F.lit(LOW_SCORE), F.lit(TOP_SCORE) - F.col("position") * F.lit(SCORE_STEP)).alias("score"),
        is_official("url").alias("official"),
    )
