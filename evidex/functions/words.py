"""Repair of words that streaming split with blanks ("rel ati ve s")."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidex.functions.fold import let
from evidex.functions.text import as_col
from evidex.rules.answers import KNOWN_HALVES, WHOLE_WORDS

MAX_PASSES = 4

# A word stands between blanks and may carry marks behind it.
LETTER, CAPITAL, SMALL = r"\p{L}", r"\p{Lu}", r"\p{Ll}"
_BEGIN, _END = r"(?<!\S)", r"(?=[^\p{L}\s]*+(?:\s|$))"


def _word(kind: str, least: int, most: int | str = "") -> str:
    """A word of so many letters that can be part of a split one: no whole word, unless a single capital."""
    single = f"(?={CAPITAL}(?!{LETTER}))"
    whole = f"(?!(?i:{'|'.join(WHOLE_WORDS)})(?!{LETTER}))"
    return f"(?:{single}|{whole}){kind}{{{least},{most}}}{_END}"


def _pattern() -> str:
    """What is one word: three crumbs or more, or two halves.

    Crumbs have at most four letters, and at most one of them, the first or the second, has
    four.  A row of crumbs may end in "on", or in a single letter when it is long enough or
    when a capital and three letters lead ("A nswe r").  Two words are halves when they are
    known ones, when both are tiny, when a short word meets a lower-case ending of two
    letters, or when a capital meets three or four lower-case letters.
    """
    crumb, letter, on = _word(LETTER, 2, 3), _word(LETTER, 1, 1), f"(?i:on){_END}"
    lead = f"(?:{_word(LETTER, 1, 3)} {_word(LETTER, 2, 4)}|{_word(LETTER, 4, 4)} {crumb})"
    row = f"{lead}(?>(?: {crumb})++(?: {on}| {letter})?+| {on})"
    spelled = f"{_word(CAPITAL, 1, 1)} {_word(LETTER, 3, 4)} {letter}"
    known = "|".join(f"(?=(?i:{a} {b})(?!{LETTER})){_word(LETTER, 1)} {_word(LETTER, 1)}" for a, b in KNOWN_HALVES)
    tiny = f"{_word(LETTER, 1, 2)} {_word(LETTER, 1, 3)}"
    ending = f"{_word(LETTER, 3, 5)} {_word(SMALL, 1, 2)}"
    capital = f"{_word(CAPITAL, 1, 1)} {_word(SMALL, 3, 4)}"
    return f"{_BEGIN}(?:{row}|{spelled}|{known}|{tiny}|{ending}|{capital})"


def _one_pass(text: Column, pattern: str) -> Column:
    """Every match loses its blanks."""
    def joined(found: Column) -> Column:
        rest = F.split(text, pattern, -1)
        parts = F.zip_with(rest, found, lambda r, f: F.concat(r, F.coalesce(F.replace(f, F.lit(" "), F.lit("")), F.lit(""))))
        return F.when(F.size(found) == 0, text).otherwise(F.array_join(parts, ""))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), joined)


def repair_fragmented_words(text: Column | str) -> Column:
    """Split words joined; a pass over repaired text may find more, four passes are made."""
    pattern, repaired = _pattern(), as_col(text)
    for _ in range(MAX_PASSES):
        repaired = let(repaired, lambda t: _one_pass(t, pattern))
    return repaired
