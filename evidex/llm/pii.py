"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Everything is a projection of SQL functions beside the scan: no shuffle and no Python.
Positions come from the lengths of what lies between the matches of a pattern.  The
patterns are possessive and anchored at the start of a run, so a long run of digits or
letters costs one pass and no recursion, with the matches of the plain patterns.  An IBAN is
looked for at every head (country and check digits): the pattern takes the run behind the
head, and the part of it that ends between groups and passes mod 97 is the value.

Words count within ``CONTEXT`` code points of a span, whatever lies between.  Where only a
word makes a match a span, the matches of a list share it: each within that reach of the next.

Defined results: a null or empty text has no spans and an empty list; repeated rows are
answered each; columns of the input other than those named pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import unused, whole_text

CONTEXT = 48  # code points of the text looked at on either side, other matches among them
ACCEPT = 0.5
HEAD = 4  # characters of an IBAN's country and check digits; no match is shorter
LONGEST = 64  # characters of the run behind the head, spaces counted
BLOCK = 256  # matches whose lengths are summed together

# The kinds in the order of the result.
# kind: pattern, text a match cannot do without, score before context, words that raise the score
KINDS = {
    "email": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@", 0.9, "mail|contact|write|address|correo|courriel",
    ),
    "ip": (
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        ".", 0.7, "ip|host|server|login|client|network",
    ),
    "card": (
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
        None, 0.8, "card|visa|credit|debit|karte|carte|tarjeta|payment",
    ),
    "phone": (
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "+", 0.8, "phone|call|tel|mobile|fax|anruf|llama",
    ),
    "iban": (
        r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))[A-Z]{2}[0-9]{2}",
        None, 0.9, "iban|account|bank|konto|compte|cuenta",
    ),
    "ssn": (
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "-", 0.3, "ssn|social|security|tax|insurance",
    ),
}
# Characters of an IBAN by country, from the registry.
IBAN_SIZES = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 "
    "GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 "
    "MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 "
    "TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
)
BASE = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Every second digit from the right doubled, nines cast out, the sum a multiple of ten."""
    digits = F.split(F.reverse(_digits(value)), "")
    sums = F.transform(
        digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5))
    )
    return F.aggregate(sums, F.lit(0).cast("bigint"), lambda a, x: a + x) % 10 == 0


def _mod97(value: Column) -> Column:
    """Country and check digits moved to the end, letters as 10 to 35, the remainder by 97 is 1."""
    packed = F.regexp_replace(value, " ", "")
    turned = F.split(F.concat(packed.substr(F.lit(5), F.length(packed)), packed.substr(1, 4)), "")

    def step(a: Column, c: Column) -> Column:
        letter = c >= "A"
        return F.when(letter, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(turned, F.lit(0).cast("bigint"), lambda a, c: step(a, c).cast("bigint")) == 1


def _iban(run: Column) -> Column:
    """The part of ``run`` from its start to the end of a group that is an IBAN, or null.

    The part of the country's length goes before the longest one; where the country is not
    in the registry any part will do, the longest first.
    """
    packed = lambda p: F.length(F.regexp_replace(p, " ", ""))
    at = F.position(run.substr(1, 2), F.lit(IBAN_SIZES))
    usual = F.when(at > 0, F.lit(IBAN_SIZES).substr(at + 2, F.lit(2)).cast("int"))
    parts = F.transform(
        F.array(F.split(run, " ")), lambda w: F.transform(F.sequence(F.lit(1), F.size(w)), lambda k: F.array_join(F.slice(w, F.lit(1), k), " "))
    )[0]
    fits = F.filter(parts, lambda p: p.rlike("^[A-Z0-9 ]+$") & packed(p).between(15, 34))
    ordered = F.transform(F.array(fits), lambda f: F.concat(
        F.filter(f, lambda p: packed(p) == usual), F.when(usual.isNull() | (F.size(f) == 0), F.reverse(f)).otherwise(F.slice(f, -1, 1))
    ))[0]
    return F.get(F.filter(ordered, _mod97), F.lit(0))


def _octets(value: Column) -> Column:
    """Four numbers of at most 255, however many zeros lead them."""
    return F.forall(
        F.split(value, r"\."),
        lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).try_cast("bigint") <= 255),
    )


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return _octets(value)
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return value.isNotNull()
    return F.lit(True)


def _starts(sizes: Column) -> Column:
    """Sums of the elements before each element; whole blocks are summed once."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0).cast("bigint"), lambda a, x: a + x),
    )
    add = lambda a, x: a + x
    return F.transform(
        F.array(blocks),
        lambda whole: F.transform(
            sizes,
            lambda _, i: F.aggregate(F.slice(whole, F.lit(1), F.floor(i / BLOCK).cast("int")), F.lit(0).cast("bigint"), add)
            + F.aggregate(F.slice(sizes, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), i % BLOCK), F.lit(0).cast("bigint"), add),
        ),
    )[0]


def _before(heads: Column, gaps: Column) -> Column:
    """The last ``CONTEXT`` code points of the text before each match, across the matches before it."""
    pieces = F.transform(heads, lambda h, i: F.right(F.concat(F.right(gaps[i], F.lit(CONTEXT)), h), F.lit(CONTEXT)))
    near = lambda p, i: F.slice(p, F.greatest(i - CONTEXT // HEAD, F.lit(0)) + 1, F.least(i, F.lit(CONTEXT // HEAD)))
    return F.transform(F.array(pieces), lambda p: F.transform(
        heads, lambda _, i: F.right(F.concat(F.array_join(near(p, i), ""), F.right(gaps[i], F.lit(CONTEXT))), F.lit(CONTEXT))
    ))[0]


def _after(heads: Column, gaps: Column, reach: int) -> Column:
    """The first ``reach`` code points of the text after each match, across the matches after it."""
    pieces = F.transform(heads, lambda h, i: F.left(F.concat(h, F.left(gaps[i + 1], F.lit(reach))), F.lit(reach)))
    return F.transform(F.array(pieces), lambda p: F.transform(
        heads, lambda _, i: F.left(F.concat(F.left(gaps[i + 1], F.lit(reach)), F.array_join(F.slice(p, i + 2, F.lit(reach // HEAD)), "")), F.lit(reach))
    ))[0]


def _shared(near: Column, gaps: Column) -> Column:
    """``near`` for every match from which steps of at most ``CONTEXT`` code points between matches lead to one that has it."""
    marks = F.array_join(F.transform(near, lambda c, i: F.concat(
        F.when((i > 0) & (F.length(gaps[i]) > CONTEXT), F.lit("|")).otherwise(F.lit("")), F.when(c, F.lit("c")).otherwise(F.lit("n"))
    )), "")
    lists = F.transform(F.split(marks, "[|]"), lambda m: F.when(m.contains("c"), F.translate(m, "n", "c")).otherwise(m))
    return F.transform(F.split(F.array_join(lists, ""), ""), lambda c: c == "c")


def _spans(text: Column, kind: str) -> Column:
    pattern, needs, score, words = KINDS[kind]
    none = F.array().cast(SPAN)

    value = _iban if kind == "iban" else lambda h: h
    width = (lambda h: F.lit(HEAD)) if kind == "iban" else F.length  # of what lies between two gaps

    def located(hits: Column) -> Column:
        return F.transform(
            F.array(F.struct(F.split(text, pattern, -1).alias("gaps"), F.transform(hits, value).alias("values"))),
            lambda x: F.transform(
                F.array(F.struct(
                    _starts(F.transform(hits, lambda h, i: (F.length(x["gaps"][i]) + width(h)).cast("bigint"))).alias("before"),
                    said(hits, x["gaps"], x["values"]).alias("said"),
                )),
                lambda y: F.filter(
                    F.transform(x["values"], lambda v, i: F.struct(
                        F.lit(kind).alias("kind"),
                        (y["before"][i] + F.length(x["gaps"][i])).cast("bigint").alias("start"),
                        (y["before"][i] + F.length(x["gaps"][i]) + F.length(v)).cast("bigint").alias("end"),
                        F.when(y["said"][i], F.lit(min(1.0, score + 0.3))).otherwise(F.lit(score)).alias("score"),
                        v.alias("value"),
                    )),
                    lambda s: (s["score"] >= ACCEPT) & _valid(kind, s["value"]),
                ),
            )[0],
        )[0]

    def said(hits: Column, gaps: Column, values: Column) -> Column:
        """Whether a word of the kind is near each match; where that decides, a list shares it."""
        heads = F.transform(hits, lambda h: F.left(h, F.lit(HEAD))) if kind == "iban" else hits
        sides = F.struct(_before(heads, gaps).alias("l"), _after(heads, gaps, CONTEXT + (LONGEST if kind == "iban" else 0)).alias("r"))
        near = F.transform(F.array(sides), lambda c: F.transform(values, lambda v, i: F.coalesce(
            F.lower(F.concat_ws(" ", c["l"][i], c["r"][i].substr(F.length(v) - width(hits[i]) + 1, F.lit(CONTEXT)))).rlike(rf"\b(?:{words})"), F.lit(False)
        )))[0]
        return near if score >= ACCEPT else F.transform(F.array(near), lambda n: _shared(n, gaps))[0]

    possible = text.contains(needs) if needs else text.rlike("[0-9]{2}" if kind == "iban" else "[0-9][0-9 -]{11}")
    hits = F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(int(kind == "iban")))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array(hits), lambda h: F.when(F.size(h) > 0, located(h)).otherwise(none))[0]


def find(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with the list of spans (kind, start, end, score, value), by kind and then place."""
    found = F.concat(*[_spans(whole_text(text), kind) for kind in KINDS])
    return docs.withColumn(into, found)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The texts with every accepted span replaced by its kind in brackets; other columns as they are.

    Where spans overlap, the one that starts first (then the longer one) is replaced.
    A null text stays null.
    """
    body, spans = unused(docs, "_text"), unused(docs, "_pii")
    marked = find(docs.withColumn(body, whole_text(text)), body, spans)
    order = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("stop"), s["kind"].alias("kind"))))
    kept = F.aggregate(
        order, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(
            (-s["stop"]).alias("at"),
            F.concat(a["parts"], F.array(
                F.col(body).substr((a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")),
            )).alias("parts"),
        )),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.col(body).substr((a["at"] + 1).cast("int"), F.length(body))),
    )
    new = F.when(F.size(spans) > 0, kept).otherwise(F.col(text))
    return marked.select(*[new.alias(c) if c == text else F.col(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """Counts and lists of spans per document, as the query reports them."""
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(listed(F.filter("pii", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        listed(F.col("pii")).alias("spans"),
    )
