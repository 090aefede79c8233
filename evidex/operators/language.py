"""Language, script and reply style of messages (family I)."""

from __future__ import annotations

import json
from functools import cache
from itertools import count
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions import text as tx
from evidex.functions.fold import let
from evidex.functions.text import contains_any
from evidex.rules import language as r

_I = "(?iU)"
EN, UR, PA, MIXED = "en-PK", "ur-PK", "pa-PK", "mixed"


def script(text: Column | str) -> Column:
    t = F.coalesce(tx.as_col(text), F.lit(""))
    arabic, latin = t.rlike(f"[{r.ARABIC}]"), t.rlike("[A-Za-z]")
    return F.when(arabic & latin, "mixed").when(arabic, "arabic").when(latin, "latin").otherwise("unknown")


def _lexicon() -> dict[str, tuple[str, float, float]]:
    """word -> (english class, urdu weight, punjabi weight)."""
    urdu, punjabi = r.ROMAN_URDU, r.ROMAN_PUNJABI
    out = {}
    for word in {*r.ENGLISH_CONTENT, *r.ENGLISH_FUNCTION, *urdu, *punjabi, *r.LEGAL_TERMS}:
        kind = (
            "legal" if word in r.LEGAL_TERMS else "content" if word in r.ENGLISH_CONTENT
            else "shared" if word in r.AMBIGUOUS and word in r.ENGLISH_FUNCTION
            else "function" if word in r.ENGLISH_FUNCTION else ""
        )
        out[word] = (kind, urdu.get(word, 0.0), punjabi.get(word, 0.0))
    return out


@cache
def _table() -> list[dict | None]:
    """The lexicon as a table without collisions: a word lies at its CRC-32 modulo the size (a map is searched word by word)."""
    words = _lexicon()
    size = next(n for n in count(1 << 12) if len({crc32(w.encode()) % n for w in words}) == len(words))
    table: list[dict | None] = [None] * size
    for w, (kind, ur, pa) in words.items():
        table[crc32(w.encode()) % size] = {"w": w, "kind": kind, "ur": ur, "pa": pa}
    return table


def override(text: Column | str) -> Column:
    """First explicit wish: ``struct<language, style, phrase, rest>``; ``rest`` lacks the phrase."""
    t = tx.as_col(text)
    kind = "struct<language:string,style:string,phrase:string,rest:string>"
    out = F.struct(F.lit(None).alias("language"), F.lit(None).alias("style"), F.lit(None).alias("phrase"), t.alias("rest")).cast(kind)
    named = t.rlike(f"{_I}(?=[uepا])(?:{'|'.join(r.OVERRIDE_NAMES)})")
    none = out
    for pattern, language, style in reversed(r.OVERRIDES):
        rest = F.trim(F.regexp_replace(F.regexp_replace(t, _I + pattern, " "), rf"[{tx.SPACE}]+", " "), F.lit(" :,-"))
        found = F.struct(
            F.lit(language).alias("language"), F.lit(style).alias("style"),
            F.regexp_extract(t, _I + pattern, 0).alias("phrase"), rest.alias("rest"),
        ).cast(kind)
        out = F.when(t.rlike(_I + pattern), found).otherwise(out)
    # Every wish names a language; a text that names none is not searched a dozen times.
    return F.when(named, out).otherwise(none)


def scores(text: Column) -> Column:
    """``struct<en, ur, pa, content>``: lexicon weights summed over the words in order."""
    # The letters a reference begins with turn most places away before its alternatives are tried.
    cleaned = F.regexp_replace(F.regexp_replace(text, _I + "(?=[psmyc])" + r.CITATION, " "), _I + "(?=[sau])" + r.SECTION_REFERENCE, " ")
    return let(cleaned, _weights)


def _weights(cleaned: Column) -> Column:
    words = F.transform(F.regexp_extract_all(cleaned, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.lower(w))
    arabic = F.regexp_extract_all(cleaned, F.lit(f"[{r.ARABIC}]+"), F.lit(0))
    table = _table()
    slots = F.from_json(F.lit(json.dumps(table)), "array<struct<w:string,kind:string,ur:double,pa:double>>")

    def entry(w: Column) -> Column:
        slot = F.get(slots, F.pmod(F.crc32(w), F.lit(len(table))).cast("int"))
        return F.when(slot["w"] == w, slot)

    known = F.transform(words, lambda w: F.struct(F.length(w).alias("n"), entry(w).alias("e")))

    def step(acc: Column, w: Column) -> Column:
        e, kind = w["e"], w["e"]["kind"]
        ur, pa = acc["ur"] + F.coalesce(e["ur"], F.lit(0.0)), acc["pa"] + F.coalesce(e["pa"], F.lit(0.0))
        unknown = e.isNull() | (kind == "")
        english = (
            F.when(kind == "content", 1.6).when(kind == "function", 0.7)
            .when(kind == "shared", F.when((ur > 0) | (pa > 0), 0.0).otherwise(0.7))
            .when(unknown & (w["n"] >= 4), 0.35).otherwise(0.0)
        )
        scored = F.struct(
            (acc["en"] + english).alias("en"), ur.alias("ur"), pa.alias("pa"),
            (acc["content"] + F.when(kind == "content", 1.6).otherwise(0.0)).alias("content"),
        )
        return F.when(F.coalesce(kind == "legal", F.lit(False)), acc).otherwise(scored)

    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("en", "ur", "pa", "content")])
    roman = F.aggregate(known, zero, step)
    runs = let(arabic, lambda a: F.struct(F.size(a).alias("n"), contains_any(F.array_join(a, " "), r.PUNJABI_MARKERS).alias("punjabi")))

    def both(w: Column, a: Column) -> Column:
        n, punjabi = a["n"], a["punjabi"]
        return F.struct(
            w["en"].alias("en"),
            (w["ur"] + F.when((n > 0) & ~punjabi, F.lit(2.5) + F.lit(0.9) * n).otherwise(0.0)).alias("ur"),
            (w["pa"] + F.when((n > 0) & punjabi, F.lit(3.0) + F.lit(0.8) * n).otherwise(0.0)).alias("pa"),
            w["content"].alias("content"),
        )

    return let(roman, lambda w: let(runs, lambda a: both(w, a)))


def _style(language: Column, kind: Column) -> Column:
    return (
        F.when(language == EN, "english").when(language == MIXED, "mixed")
        .when(language == PA, F.when(kind == "arabic", "punjabi_shahmukhi").otherwise("punjabi_roman"))
        .otherwise(F.when(kind.isin("arabic", "mixed"), "urdu_script").otherwise("roman_urdu"))
    )


def detect(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Language, confidence, script and style of the text, and the language and style to reply in."""
    body = tx.strip(F.coalesce(F.col(text_col), F.lit("")))
    s, kind = F.col("_s"), F.col("script")
    en, ur, pa, content = s["en"], s["ur"], s["pa"], s["content"]
    local = F.greatest(ur, pa)
    local_name = F.when(pa > ur, PA).otherwise(UR)
    mixed = (local >= 2.0) & ((content >= 1.5) | ((kind == "mixed") & (en >= 2.0)))
    strong = (local >= 1.5) & (local >= en + 0.4)
    english = (en >= 1.2) & (en > local)
    weak = (local > 0) & (local >= en)
    blank = F.col("_body") == ""
    language = (
        F.when(blank, EN).when(mixed, MIXED).when(strong, local_name).when(english, EN)
        .when((kind == "arabic") | weak, local_name).otherwise(EN)
    )
    confidence = (
        F.when(blank, 0.2)
        .when(mixed, F.least(F.lit(0.88), F.lit(0.55) + (local + en) / 20))
        .when(strong, F.least(F.lit(0.96), F.lit(0.62) + (local - en) / 8 + F.least(local, F.lit(6.0)) / 16))
        .when(english, F.least(F.lit(0.95), F.lit(0.6) + (en - local) / 8))
        .when(kind == "arabic", 0.8).when(weak, 0.55).otherwise(0.5)
    )
    wish = F.col("_o")
    dominant = (
        F.when((pa >= ur) & (pa >= en) & (pa > 0), PA).when((ur >= pa) & (ur >= en) & (ur > 0), UR)
        .when(kind.isin("arabic", "mixed") & (ur + pa >= en), F.when(ur >= pa, UR).otherwise(PA)).otherwise(EN)
    )
    lang = F.col("language")
    as_mixed = (lang == MIXED) & wish["language"].isNull()
    reply = F.when(as_mixed, dominant).otherwise(F.coalesce(wish["language"], lang))
    reply_style = F.when(as_mixed, "mixed").otherwise(F.coalesce(wish["style"], _style(F.col("response_language"), kind)))
    return (
        df.withColumn("_body", body).withColumn("_o", override("_body")).withColumn("script", script("_body"))
        .withColumn("_s", scores(wish["rest"]))
        .withColumn("language", language).withColumn("confidence", F.bround(confidence, 6))
        .withColumn("style", _style(lang, kind))
        .withColumn("response_language", reply).withColumn("response_style", reply_style)
        .withColumn("explicit_override", wish["language"].isNotNull()).withColumn("override_phrase", wish["phrase"])
        .select(*df.columns, "language", "confidence", "script", "style", "response_language", "response_style",
                "explicit_override", "override_phrase")
    )


def language_profile(detected: DataFrame) -> DataFrame:
    return detected.groupBy("language", "script").agg(
        F.count("*").alias("texts"), F.avg("confidence").alias("mean_confidence")
    )
