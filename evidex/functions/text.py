"""Text kernel: column expressions every other module builds on.

Everything here is a pure ``Column -> Column`` function, so it stays inside
whole-stage code generation and can be pushed next to the scan.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidex.functions.fold import let

# The characters Unicode treats as white space when trimming.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex class body, valid in Java and RE2 alike.
SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
# Dash forms that mean "hyphen" in section numbers.
DASHES = r"\x{ad}\x{2010}\x{2011}\x{2012}\x{2013}\x{2014}\x{2212}\-"

# One white-space character, or one of it and the dashes: printable ASCII is turned away before the long class is tried.
JAVA_SPACE = rf"[[^!-~]&&[{SPACE}]]"
JAVA_DASH_OR_SPACE = rf"[[^!-,.-~]&&[{SPACE}{DASHES}]]"

BOUNDARY_BEFORE = rf"(?<![{WORD}])"
BOUNDARY_AFTER = rf"(?![{WORD}])"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def const_list(words) -> Column:
    """A constant array as one literal, however long: plans stay small."""
    return F.split(F.lit("\n".join(words)), "\n")


def const_map(pairs: dict, value_type: str = "string") -> Column:
    """A constant map as one literal."""
    return F.from_json(F.lit(json.dumps(pairs)), f"map<string,{value_type}>")


def contains_any(value: Column, words) -> Column:
    """Whether any of the words occurs as written."""
    return value.rlike("|".join(re.escape(w) for w in words))


def strip(c: Column | str) -> Column:
    """Trim every Unicode white-space character, not only blanks."""
    return F.trim(as_col(c), F.lit(SPACE_CHARS))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(as_col(c), F.lit(SPACE_CHARS))


def lstrip(c: Column | str) -> Column:
    return F.ltrim(as_col(c), F.lit(SPACE_CHARS))


def is_blank(c: Column | str) -> Column:
    """True for null, empty and all-white-space text."""
    return F.coalesce(strip(c), F.lit("")) == ""


def collapse(c: Column | str) -> Column:
    """Runs of white space become one blank, ends trimmed."""
    return F.regexp_replace(strip(c), rf"{JAVA_SPACE}+", " ")


def normalize_hyphens(c: Column | str) -> Column:
    """Dash forms and white-space runs become a single ``-``."""
    return F.regexp_replace(F.coalesce(as_col(c), F.lit("")), rf"{JAVA_DASH_OR_SPACE}+", "-")


def normalize_section_id(c: Column | str) -> Column:
    """``54C``, ``54 - c`` and ``Section 54-C`` all become ``54-c``."""
    lowered = F.lower(normalize_hyphens(c))
    bare = F.regexp_replace(lowered, rf"^-*(?:section|sec\.?|u/s|article)[{SPACE}\-]*", "")
    bare = F.ltrim(F.trim(bare, F.lit(" .:")), F.lit("-"))
    return F.regexp_replace(bare, r"^(\d+)([a-z])$", "$1-$2")


def _titled(nid: Column) -> Column:
    """``54-c`` shown as ``54-C``; other shapes unchanged."""
    return F.when(nid.rlike(r"^\d+-[a-z]$"), F.upper(nid)).otherwise(nid)


def section_variants(c: Column | str) -> Column:
    """Case-sensitive spellings under which a keyword list may store a section."""
    nid = normalize_section_id(c)
    compact = F.replace(nid, F.lit("-"), F.lit(""))
    titled = F.when(F.contains(nid, F.lit("-")), _titled(nid)).otherwise(F.upper(nid))
    shapes = [
        ("section ", titled), ("Section ", titled),
        ("section ", nid), ("Section ", nid),
        ("section ", compact), ("Section ", compact),
        ("", titled), ("", nid), ("", compact), ("", F.upper(compact)),
        ("Article ", titled), ("article ", nid),
    ]
    built = F.array_distinct(F.array(*[F.concat(F.lit(p), v) for p, v in shapes]))
    return F.when(nid == "", F.array().cast("array<string>")).otherwise(built)


def section_needles(c: Column | str) -> Column:
    """Spellings to look for inside running text, distinct ignoring case."""
    nid = normalize_section_id(c)
    compact = F.replace(nid, F.lit("-"), F.lit(""))
    titled = _titled(nid)

    def dashed(value: Column, dash: str) -> Column:
        return F.replace(value, F.lit("-"), F.lit(dash))

    nb, en = "‑", "–"
    base = F.array(
        nid, compact, titled,
        F.concat(F.lit("section "), nid),
        F.concat(F.lit("section "), compact),
        F.concat(F.lit("section "), titled),
        dashed(nid, nb), dashed(nid, en), dashed(titled, nb),
        F.concat(F.lit("section "), dashed(nid, nb)),
        F.concat(F.lit("section "), dashed(titled, nb)),
    )
    # The lower-cased spelling always precedes its titled twin, so keeping first
    # occurrences case-insensitively equals lower-casing and taking distinct.
    distinct = F.array_distinct(F.transform(base, lambda x: F.lower(x)))
    return F.when(nid == "", F.array().cast("array<string>")).otherwise(distinct)


def rerank_tokens(c: Column | str, normalized: bool = False) -> Column:
    """Words of three or more ASCII letters/digits, plus statute numbers.

    ``normalized`` texts are lower-cased with hyphens unified already.
    """
    text = as_col(c) if normalized else F.lower(normalize_hyphens(c))
    words = F.regexp_extract_all(text, F.lit(r"[a-z0-9]{3,}"), F.lit(0))
    numbers = F.regexp_extract_all(
        text, F.lit(rf"(?=\d){BOUNDARY_BEFORE}\d{{1,4}}[a-z]?{BOUNDARY_AFTER}"), F.lit(0)
    )
    both = let(numbers, lambda found: F.concat(found, F.transform(
        found, lambda n: F.regexp_replace(n, r"^(\d+)([a-z])$", "$1-$2")
    )))
    return F.array_distinct(F.concat(words, both))


def passage_norm(c: Column | str) -> Column:
    """Lower-case, dash forms unified, white space collapsed: passage equality key."""
    lowered = F.translate(F.lower(F.coalesce(as_col(c), F.lit(""))), "‑–—", "---")
    return collapse(lowered)


def passage_tokens(normalized: Column) -> Column:
    """Distinct tokens of an already normalised passage (empty text has none)."""
    return F.filter(F.array_distinct(F.split(normalized, " ")), lambda t: t != "")


def jaccard(left_tokens: Column, right_tokens: Column) -> Column:
    """Share of common tokens; both lists hold distinct tokens, so their union is counted, not built."""
    both = F.size(left_tokens) + F.size(right_tokens)
    ratio = let(F.size(F.array_intersect(left_tokens, right_tokens)), lambda shared: shared / (both - shared))
    return F.when((F.size(left_tokens) == 0) | (F.size(right_tokens) == 0), F.lit(0.0)).otherwise(ratio)


def token_pieces(c: Column | str) -> Column:
    return F.regexp_count(
        F.coalesce(as_col(c), F.lit("")), F.lit(rf"[{WORD}]+|[^{WORD}{SPACE}]")
    )


def raw_tokens(pieces: Column) -> Column:
    """Tokens for a number of pieces: none for none, else at least 1, as 1.35 rounds to 1.

    The number is named once: branches of an expression are not shared, so the text of a number
    named four times is read four times.
    """
    return F.bround(pieces * F.lit(1.35), 0).cast("bigint")


def scaled_tokens(raw: Column, factor: float = 1.2) -> Column:
    """Tokens with the safety factor, never fewer than without."""
    return F.bround(raw * F.lit(max(factor, 1.0)), 0).cast("bigint")


def estimate_tokens(c: Column | str, mode: str = "estimate", factor: float = 1.2) -> Column:
    """Token estimate: ``estimate``, ``whitespace`` or ``scaled`` (safety factor)."""
    text = F.coalesce(as_col(c), F.lit(""))
    if mode == "whitespace":
        return F.regexp_count(text, F.lit(rf"[^{SPACE}]+")).cast("bigint")
    raw = raw_tokens(token_pieces(text))
    if mode == "estimate":
        return raw
    if mode == "scaled":
        return scaled_tokens(raw, factor)
    raise ValueError(f"unknown token mode: {mode}")


# Characters of no width that can hide a word.
ZERO_WIDTH = r"[\x{200b}\x{200c}\x{200d}\x{feff}]"
# Words repaired when spelled out with separators.
SPELLED_OUT = ("kill", "murder", "bomb")


def normalize_message(c: Column | str) -> Column:
    """Screening form: no zero-width characters, one blank between words, lower case."""
    bare = F.regexp_replace(F.coalesce(as_col(c), F.lit("")), ZERO_WIDTH, "")
    text = F.lower(collapse(bare))
    for word in SPELLED_OUT:
        text = F.regexp_replace(text, spelled_out_pattern(word), word)
    return text


def spelled_out_pattern(word: str) -> str:
    return rf"[{SPACE}.\-_]*".join(word)
