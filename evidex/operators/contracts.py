"""Contract review: fields, clause cards, playbook verdicts, redlines (family M)."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidex.functions import text as tx
from evidex.functions.fold import let
from evidex.operators.retrieve import list_for_scope
from evidex.rules import contracts as r

FIELD = "array<struct<key:string,label:string,question:string>>"


def default_fields() -> Column:
    rows = [dict(zip(("key", "label", "question"), f)) for f in r.FIELDS]
    return F.from_json(F.lit(json.dumps(rows)), FIELD)


def resolve_fields(requests: DataFrame) -> DataFrame:
    """Fields of each request: known keys in the order asked (else all defaults), then custom ones.

    ``requests(request_id, keys array<string>, extra array<struct<key,label,question>>)``.
    """
    defaults = default_fields()
    by_key = F.map_from_entries(F.transform(defaults, lambda f: F.struct(f["key"], f)))
    asked = F.transform(F.coalesce("keys", F.array().cast("array<string>")), lambda k: F.element_at(by_key, F.lower(tx.strip(k))))
    known = F.filter(asked, lambda f: f.isNotNull())
    base = F.when(F.size(known) > 0, known).otherwise(defaults)

    def text(value: Column, limit: int) -> Column:
        return F.substring(tx.strip(value), 1, limit)

    def filled(value: Column) -> Column:
        return F.nullif(value, F.lit(""))

    cleaned = F.transform(
        F.coalesce("extra", F.array().cast(FIELD)),
        lambda x: F.struct(
            F.substring(F.lower(tx.strip(F.coalesce(x["key"], F.lit("")))), 1, 64).alias("key"),
            text(F.coalesce(filled(x["label"]), filled(x["question"]), F.lower(tx.strip(x["key"]))), 80).alias("label"),
            text(F.coalesce(filled(x["question"]), filled(x["label"]), F.lower(tx.strip(x["key"]))), 240).alias("question"),
        ),
    )
    rows = requests.withColumn("_base", base).withColumn("_extra", cleaned)
    keys, taken = F.transform("_extra", lambda x: x["key"]), F.transform("_base", lambda x: x["key"])
    fresh = F.filter(
        "_extra", lambda x, i: (x["key"] != "") & ~F.array_contains(taken, x["key"]) & (F.array_position(keys, x["key"]) == i + 1)
    )
    chosen = F.concat("_base", F.slice(fresh, 1, r.MAX_CUSTOM_FIELDS))
    return rows.select("request_id", F.posexplode(chosen).alias("position", "f")).select(
        "request_id", F.col("position").cast("bigint").alias("position"), "f.key", "f.label", "f.question"
    )


# --- extraction outputs --------------------------------------------------------------

def _variant_text(value: Column, path: str) -> Column:
    """A member of a variant as text; truth values are spelled True and False."""
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    text = F.try_variant_get(value, path, "string")
    return F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


def _clause(members: Column, name: Column | None = None) -> Column:
    """One extracted row; ``name`` is the member it stood under, unless it names its key itself."""
    own = F.when(~F.coalesce(F.try_variant_get(members, "$.key", "string"), F.lit("")).isin("0", "false"), _variant_text(members, "$.key"))
    if name is not None:
        has_key = F.try_variant_get(members, "$.key", "variant").isNotNull()
        own = F.when(has_key, own).otherwise(name)
    return F.struct(
        F.lower(tx.strip(F.coalesce(own, F.lit("")))).alias("key"),
        *[_variant_text(members, f"$.{c}").alias(c) for c in ("value", "quote", "status")],
        F.try_variant_get(members, "$.confidence", "double").alias("confidence"),
    )


def _members(value: Column) -> Column:
    """The members of a variant object; null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def parse_outputs(outputs: DataFrame) -> DataFrame:
    """Rows ``doc_id, key, value, quote, status, confidence`` from messy model output.

    The object is the one in a code fence or, without one that parses, the one at the first
    brace outside of reasoning; what follows it does not matter.  Its ``fields`` are the rows; an
    object without such a list holds one row per member.  Of rows of one key the last counts.
    Nested values stay JSON text, numbers are as Spark writes them, and an object that names
    a member twice is not read.  No row, no object or null text: no rows.
    """
    body = F.regexp_replace("output", r.REASONING, "")
    whole = outputs.select("doc_id", body.alias("_body"))
    fenced = F.try_parse_json(F.nullif(F.regexp_extract("_body", r.FENCED_OBJECT, 1), F.lit("")))
    opened = F.when(F.instr("_body", "{") > 0, F.try_parse_json(F.expr("substring(_body, instr(_body, '{'))")))
    found = whole.select("doc_id", F.coalesce(fenced, opened).alias("_found"))
    listed = F.try_variant_get("_found", "$.fields", "array<variant>")
    single = F.filter(F.map_entries(_members(F.col("_found"))), lambda e: e["key"] != "fields")
    rows = F.when(
        listed.isNotNull(), F.transform(F.filter(listed, lambda x: _members(x).isNotNull()), lambda x: _clause(x))
    ).otherwise(F.transform(single, lambda e: F.when(_members(e["value"]).isNotNull(), _clause(e["value"], e["key"])).otherwise(
        F.struct(
            F.lower(tx.strip(e["key"])).alias("key"), _variant_text(e["value"], "$").alias("value"), F.lit(None).cast("string").alias("quote"),
            F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("confidence"),
        )
    )))
    held = found.select("doc_id", rows.alias("_rows"))
    keys = F.reverse(F.transform("_rows", lambda x: x["key"]))
    last = held.withColumn("_keys", keys).select("doc_id", F.explode(F.filter(
        "_rows", lambda x, i: (x["key"] != "") & (F.array_position("_keys", x["key"]) == F.size("_keys") - i)
    )).alias("r"))
    return last.select("doc_id", "r.*")


QUOTE_CHARS = 400


def _clean(value: Column) -> Column:
    text = tx.strip(value)
    return F.when(~F.lower(text).isin(*r.EMPTY_VALUES), text)


def quote_in_document(quote: Column, document: Column) -> Column:
    """The quote, or its first six words, occurs in the document (``document`` already flattened)."""
    needle = F.lower(tx.collapse(quote))
    words = F.split(needle, " ")
    opening = F.array_join(F.slice(words, 1, 6), " ")
    return F.when(F.length(needle) < 12, F.contains(document, needle)).otherwise(
        F.contains(document, needle) | ((F.size(words) >= 6) & F.contains(document, opening))
    )


def clause_cards(rows: DataFrame, documents: DataFrame, fields: Column | None = None) -> DataFrame:
    """One card per document and field, quotes grounded in the document's text.

    The few rows of a document are grouped and meet its text once; the cards are built
    inside the row and exploded without the text, which is shuffled once, not per field.
    """
    wanted = fields if fields is not None else default_fields()
    flat = F.lower(tx.collapse(F.coalesce("text", F.lit(""))))
    extracted = rows.groupBy("doc_id").agg(
        F.collect_list(F.struct("key", "value", "quote", "status", "confidence")).alias("_rows")
    )
    joined = documents.select("doc_id", flat.alias("_text")).join(extracted, "doc_id", "left")

    def cleaned(row: Column) -> Column:
        quote = _clean(row["quote"])
        cut = F.when(F.length(quote) > QUOTE_CHARS, F.concat(tx.rstrip(F.substring(quote, 1, QUOTE_CHARS)), F.lit("…")))
        asked = F.lower(tx.strip(F.coalesce(row["status"], F.lit(""))))
        return F.struct(
            row.isNotNull().alias("has"), _clean(row["value"]).alias("value"), F.coalesce(cut, quote).alias("quote"),
            F.when(asked.isin(*r.STATUSES), asked).otherwise("unclear").alias("status"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(row["confidence"], F.lit(0.5)))).alias("sure"),
        )

    def judged(field: Column, position: Column, c: Column) -> Column:
        grounded = F.coalesce((F.col("_text") != "") & quote_in_document(c["quote"], F.col("_text")), F.lit(False))

        def finished(ok: Column) -> Column:
            status = (
                F.when(~c["has"], "unclear").when(c["value"].isNull() & ~ok, "missing")
                .when((c["status"] == "found") & c["value"].isNull(), "unclear").otherwise(c["status"])
            )
            return F.struct(
                field["key"].alias("key"), field["label"].alias("label"), status.alias("status"), c["value"].alias("value"),
                F.when(ok, c["quote"]).alias("quote"), ok.alias("quote_grounded"),
                F.when(~c["has"], 0.0).when(status == "missing", F.least(c["sure"], F.lit(0.4))).otherwise(c["sure"]).alias("confidence"),
                position.cast("bigint").alias("position"),
            )

        return let(grounded, finished)

    def card(field: Column, position: Column) -> Column:
        row = F.get(F.filter("_rows", lambda x: x["key"] == field["key"]), F.lit(0))
        return let(cleaned(row), lambda c: judged(field, position, c))

    return joined.select("doc_id", F.explode(F.transform(wanted, card)).alias("c")).select("doc_id", "c.*")


def review_table(cards: DataFrame, documents: DataFrame, scopes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per scope the newest twenty readable documents, one column per field.

    ``documents(document_id, doc_id, user_id, scope, ..., created_at, text)``.
    """
    keys = keys or [f[0] for f in r.FIELDS]
    readable = documents.filter(~tx.is_blank("text"))
    w = Window.partitionBy("scope_id")
    listed = (
        list_for_scope(readable, scopes)
        .withColumn("document_count", F.count("*").over(w)).filter(F.col("position") <= r.REVIEW_DOCUMENTS)
        .withColumn("truncated_documents", F.col("document_count") > r.REVIEW_DOCUMENTS)
    )
    # Each document has one card per key, so pivoting before the join keeps one row per document.
    values = cards.groupBy("doc_id").pivot("key", keys).agg(F.first("value"))
    return (
        listed.join(readable.select("document_id", "doc_id"), "document_id").join(values, "doc_id", "left")
        .select("scope_id", "document_id", "position", "document_count", "truncated_documents", *keys)
    )


# --- playbook -----------------------------------------------------------------------------

RULE = (
    "array<struct<key:string,required:boolean,severity:string,notes:string,suggested:string,accept:array<string>,"
    "fallback:array<string>,reject:array<string>>>"
)


def playbook_rules(rules=None) -> Column:
    filled = [{"notes": "", "accept": [], "fallback": [], "reject": [], **rule} for rule in (rules or r.PLAYBOOK)]
    return F.from_json(F.lit(json.dumps(filled)), RULE)


def evaluate_playbook(cards: DataFrame, rules: Column | None = None) -> DataFrame:
    """Verdict, reason and suggestion per document and rule."""
    per_rule = cards.select("doc_id").distinct().select("doc_id", F.posexplode(rules if rules is not None else playbook_rules()).alias("position", "rule"))
    joined = per_rule.withColumn("key", F.col("rule.key")).join(
        cards.select("doc_id", "key", "label", "status", "value", "quote"), ["doc_id", "key"], "left"
    )
    said = F.concat_ws(" ", F.coalesce("value", F.lit("")), F.coalesce("quote", F.lit("")))
    haystack = tx.collapse(F.lower(F.replace(said, F.lit("’"), F.lit("'"))))
    rule, status, value = F.col("rule"), F.col("status"), F.coalesce("value", F.lit(""))

    def says(phrases: Column) -> Column:
        return F.exists(phrases, lambda p: F.contains(F.col("_said"), p))

    absent = status.isin("missing", "unclear") & (value == "")
    outcome = (
        F.when(status.isNull() | (status == "error"), "no_card")
        .when(absent & (status == "unclear"), "unclear")
        .when(absent, F.when(rule["required"], "missing").otherwise("absent"))
        .when(says(rule["reject"]), "rejected").when(says(rule["accept"]), "preferred")
        .when(says(rule["fallback"]), "fallback")
        .when((F.size(rule["accept"]) > 0) | (F.size(rule["fallback"]) > 0), "other").otherwise("present")
    )
    verdicts = {
        "no_card": "unclear", "unclear": "unclear", "missing": "missing", "absent": "not_applicable",
        "rejected": "off_playbook", "preferred": "pass", "fallback": "fallback", "other": "off_playbook", "present": "pass",
    }
    reason = F.element_at(tx.const_map(r.REASONS), F.col("_outcome"))
    noted = F.col("verdict").isin("off_playbook", "missing") & (rule["notes"] != "")
    return (
        joined.withColumn("_said", haystack).withColumn("_outcome", outcome)
        .withColumn("verdict", F.element_at(tx.const_map(verdicts), F.col("_outcome")))
        .withColumn("reason", F.when(noted, F.concat_ws(" ", reason, rule["notes"])).otherwise(reason))
        .select("doc_id", "key", "label", "verdict", "reason", rule["severity"].alias("severity"), rule["required"].alias("required"),
                "value", "quote", rule["suggested"].alias("suggested_language"), F.col("position").cast("bigint").alias("position"))
    )


def playbook_summary(findings: DataFrame) -> DataFrame:
    def n(*verdicts: str) -> Column:
        return F.count_if(F.col("verdict").isin(*verdicts))

    blockers = F.count_if((F.col("severity") == "blocker") & F.col("verdict").isin("missing", "off_playbook", "unclear"))
    return findings.groupBy("doc_id").agg(
        n("pass").alias("pass_count"), n("fallback").alias("fallback_count"), n("missing").alias("missing_count"),
        n("off_playbook").alias("off_playbook_count"), n("unclear").alias("unclear_count"), blockers.alias("blocker_count"),
    )


# --- redlines -------------------------------------------------------------------------------

SPANS = "array<struct<op:string,text:string>>"
SIDES = "array<struct<left:array<string>,right:array<string>>>"


def _rising(values: list[int]) -> list[int]:
    """Places of a longest rising run through ``values``."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before[i] = at[k - 1] if k else -1
        tops[k:k + 1], at[k:k + 1] = [v], [i]
    run, i = [], at[-1] if at else -1
    while i >= 0:
        run.append(i)
        i = before[i]
    return run[::-1]


def _anchors(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Pairs of places that stay together: what occurs once on either side, in an order both share."""
    said, heard = Counter(left), Counter(right)
    here = {t: i for i, t in enumerate(left) if said[t] == 1}
    there = {t: i for i, t in enumerate(right) if heard[t] == 1}
    shared = [(i, there[t]) for t, i in here.items() if t in there]
    return [shared[i] for i in _rising([j for _, j in shared])]


def _gaps(left: list[str], right: list[str]) -> Iterator[tuple[bool, list[str], list[str]]]:
    """The two lists cut into equal and different stretches, in order.

    Equal ends are taken off, anchors split what is left, and each part between anchors is
    treated the same way; a part without anchors differs as a whole.
    """
    todo = [(0, len(left), 0, len(right), False)]
    while todo:
        i, j, k, n, same = todo.pop()
        if same or i == j or k == n:
            if i < j or k < n:
                yield same, left[i:j], right[k:n]
            continue
        head = 0
        while head < min(j - i, n - k) and left[i + head] == right[k + head]:
            head += 1
        tail = 0
        while tail < min(j - i, n - k) - head and left[j - 1 - tail] == right[n - 1 - tail]:
            tail += 1
        parts = [(i, i + head, k, k + head, True)]
        inner = (i + head, j - tail, k + head, n - tail)
        anchors = _anchors(left[inner[0]:inner[1]], right[inner[2]:inner[3]]) if inner[0] < inner[1] and inner[2] < inner[3] else []
        if anchors:
            a, b = inner[0], inner[2]
            for x, y in anchors:
                x, y = inner[0] + x, inner[2] + y
                parts += [(a, x, b, y, False), (x, x + 1, y, y + 1, True)]
                a, b = x + 1, y + 1
            parts.append((a, inner[1], b, inner[3], False))
        elif inner[0] < inner[1] or inner[2] < inner[3]:
            if inner[0] < inner[1] and inner[2] < inner[3]:
                # nothing to hold on to: both sides as they are, one after the other
                parts += [(inner[0], inner[1], inner[2], inner[2], False), (inner[1], inner[1], inner[2], inner[3], False)]
            else:
                parts.append((*inner, False))
        parts.append((j - tail, j, n - tail, n, True))
        todo += reversed(parts)


def _merged(left: list[str], right: list[str]) -> Iterator[tuple[bool, list[str], list[str]]]:
    """Neighbouring stretches of one kind as one."""
    for same, group in groupby(_gaps(left, right), key=lambda g: g[0]):
        parts = list(group)
        yield same, [t for p in parts for t in p[1]], [t for p in parts for t in p[2]]


def _changed_parts(left: pd.Series, right: pd.Series) -> pd.Series:
    """The stretches of paragraphs in which two documents differ."""
    return pd.Series([
        None if a is None else [{"left": old, "right": new} for same, old, new in _merged(list(a), list(b)) if not same]
        for a, b in zip(left, right)
    ])


def _word_changes(left: pd.Series, right: pd.Series) -> pd.Series:
    """Words and blanks of two texts as equal, deleted and inserted spans."""
    out = []
    for a, b in zip(left, right):
        spans = []
        for same, old, new in _merged(re.findall(r"\s+|\S+", a or ""), re.findall(r"\s+|\S+", b or "")):
            spans += [("equal", old)] if same else [("delete", old), ("insert", new)]
        out.append([{"op": op, "text": "".join(words)} for op, words in spans if words])
    return pd.Series(out)


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(tx.strip(F.coalesce(text, F.lit(""))), r"\n\s*\n"),
                        lambda p: tx.strip(F.regexp_replace(p, r"[ \t]+", " ")))
    return F.filter(parts, lambda p: p != "")


def _paragraph_pairs(pairs: DataFrame) -> DataFrame:
    def body(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    split = pairs.select(
        F.col("pair_id").cast("string").alias("pair_id"), body("left_text").alias("_l"), body("right_text").alias("_r"),
    ).select("pair_id", "_l", "_r", paragraphs(F.col("_l")).alias("left"), paragraphs(F.col("_r")).alias("right"))
    single = (F.size("left") <= 1) & (F.size("right") <= 1)
    # A single paragraph is compared as written, its blanks included.
    return split.withColumn("left", F.when(single, F.array("_l")).otherwise(F.col("left"))).withColumn(
        "right", F.when(single, F.array("_r")).otherwise(F.col("right"))
    )


def document_hunks(pairs: DataFrame) -> DataFrame:
    """Redline of ``pairs(pair_id, left_text, right_text)``.

    The texts are read and split once.  Pairs whose paragraphs agree give one ``Document`` hunk
    of equal text, and Python sees nothing of them.  Of the others only the paragraphs between common ones go on, each stretch a
    row of its own, and their words are aligned there.  The time grows with the text, up to
    the sorting of words that occur once.
    """
    same = F.col("left") == F.col("right")
    single = (F.size("left") <= 1) & (F.size("right") <= 1)
    split = _paragraph_pairs(pairs).withColumn("_kind", F.when(same, "equal").when(single, "single").otherwise("many"))
    many = F.col("_kind") == "many"
    side = lambda c: F.when(many, F.col(c))
    parts = split.withColumn("_changed", F.pandas_udf(_changed_parts, SIDES)(side("left"), side("right")))
    whole = F.array(F.struct(F.array("_l").alias("left"), F.array("_r").alias("right"))).cast(SIDES)
    hunks = parts.select("pair_id", "_kind", F.posexplode(F.when(many, F.col("_changed")).otherwise(whole)).alias("hunk_index", "_part"))
    joined = lambda c: F.array_join(F.col(f"_part.{c}"), "\n\n").alias(c)
    hunks = hunks.select(
        "pair_id", "_kind", F.col("hunk_index").cast("bigint").alias("hunk_index"),
        F.when(many, F.concat(F.lit("Change "), F.col("hunk_index") + 1)).otherwise("Document").alias("label"),
        joined("left"), joined("right"),
    )
    differs = F.col("_kind") != "equal"
    words = F.pandas_udf(_word_changes, SPANS)(F.when(differs, F.col("left")), F.when(differs, F.col("right")))
    as_it_is = F.filter(F.array(F.struct(F.lit("equal").alias("op"), F.col("left").alias("text"))), lambda s: s["text"] != "")
    return hunks.withColumn("_words", words).withColumn("spans", F.when(differs, F.col("_words")).otherwise(as_it_is)).drop("_kind", "_words")


def unchanged_pairs(pairs: DataFrame) -> DataFrame:
    """Whether a redline would show no change; needs no alignment."""
    return _paragraph_pairs(pairs).select("pair_id", (F.col("left") == F.col("right")).alias("unchanged"))


def playbook_hunks(findings: DataFrame) -> DataFrame:
    """Actionable findings with the word changes from the current to the suggested language."""
    current = tx.strip(F.coalesce(F.nullif("quote", F.lit("")), F.col("value"), F.lit("")))
    return (
        findings.filter(F.col("verdict").isin("missing", "off_playbook", "fallback", "unclear") & ~tx.is_blank("suggested_language"))
        .withColumn("left", current).withColumn("right", tx.strip("suggested_language"))
        .withColumn("spans", F.pandas_udf(_word_changes, SPANS)("left", "right"))
        .select("doc_id", "key", "label", "left", "right", "spans")
    )


def _render(spans: Column, piece, delete: tuple[str, str], insert: tuple[str, str]) -> Column:
    def one(s: Column) -> Column:
        text = piece(s["text"])
        return (
            F.when(s["op"] == "delete", F.concat(F.lit(delete[0]), text, F.lit(delete[1])))
            .when(s["op"] == "insert", F.concat(F.lit(insert[0]), text, F.lit(insert[1]))).otherwise(text)
        )

    return F.array_join(F.transform(spans, one), "")


def spans_to_markdown(spans: Column | str) -> Column:
    return tx.strip(_render(tx.as_col(spans), lambda t: F.replace(t, F.lit("\n"), F.lit(" ")), ("~~", "~~"), ("**", "**")))


def spans_to_html(spans: Column | str) -> Column:
    def escaped(t: Column) -> Column:
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            t = F.replace(t, F.lit(char), F.lit(entity))
        return t

    return _render(tx.as_col(spans), escaped, ('<del class="redline-del">', "</del>"), ('<ins class="redline-ins">', "</ins>"))


def choose_pairs(documents: DataFrame, scopes: DataFrame) -> DataFrame:
    """The two documents to compare per scope: a pinned one first, then the listing order.

    ``scopes(scope_id, user_id, matter_id, conversation_id, pinned_id)``.
    """
    ready = documents.filter(~tx.is_blank("text"))
    listed = list_for_scope(ready, scopes).join(scopes.select("scope_id", "pinned_id"), "scope_id")
    pinned = F.coalesce(F.col("document_id") == F.col("pinned_id"), F.lit(False))
    place = F.row_number().over(Window.partitionBy("scope_id").orderBy(F.desc("_pinned"), "position"))
    first_two = listed.withColumn("_pinned", pinned).withColumn("_n", place).filter(F.col("_n") <= 2)
    return first_two.groupBy("scope_id").agg(
        F.max(F.when(F.col("_n") == 1, F.col("document_id"))).alias("left_id"),
        F.max(F.when(F.col("_n") == 2, F.col("document_id"))).alias("right_id"),
    )
