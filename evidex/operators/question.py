"""Understanding questions: routing, plans, rewriting, conversation context (family H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidex.functions import text as tx
from evidex.functions.text import contains_any
from evidex.functions.fold import let, unique_values
from evidex.functions.slices import sliced
from evidex.rules import questions as r

_I = "(?iU)"
_U = "(?U)"


def normalized(question: Column | str) -> Column:
    return tx.collapse(F.lower(F.coalesce(tx.as_col(question), F.lit(""))))


def one_line(question: Column | str) -> Column:
    return tx.collapse(F.coalesce(tx.as_col(question), F.lit("")))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"[^{tx.SPACE}]+"))


def _lookup(pairs: dict, key: Column) -> Column:
    return F.element_at(tx.const_map({k: str(v) for k, v in pairs.items()}), key)


# --- fixed actions ----------------------------------------------------------------

def prompt_stem(prompt: str) -> str:
    """A canned prompt up to its closing request for more details."""
    text = " ".join(prompt.lower().split())
    for tail in r.PROMPT_TAILS:
        head, found, _ = text.partition(tail)
        if found:
            text = head
            break
    return text.rstrip("., ")


def match_action(value: Column | str) -> Column:
    """Slug of the action named by slug, id, title or alias; null if none."""
    text = tx.strip(F.coalesce(tx.as_col(value), F.lit("")))
    slug = F.translate(F.lower(text), "- ", "__")
    titles = {title.lower(): s for _, s, title, *_ in r.ACTIONS} | r.ACTION_ALIASES
    by_id = {str(i): s for i, s, *_ in r.ACTIONS}
    bare = F.regexp_replace(slug, "^0+(?=[0-9])", "")
    return F.coalesce(
        F.when(slug.isin(*[a[1] for a in r.ACTIONS]), slug), _lookup(by_id, bare), _lookup(titles, normalized(value))
    )


def match_message_action(message: Column | str) -> Column:
    """Also the canned prompts: whole, without their closing request, or their opening."""
    text = normalized(message)
    bare = F.rtrim(text, F.lit("., "))
    out = F.lit(None).cast("string")
    for _, slug, _, _, _, prompt in reversed(r.ACTIONS):
        stem = prompt_stem(prompt)
        hit = (text == " ".join(prompt.lower().split())) | (bare == stem)
        if len(stem) >= 40:
            hit = hit | F.startswith(text, F.lit(stem[:48]))
        out = F.when(hit, slug).otherwise(out)
    return F.coalesce(match_action(message), out)


# --- routing --------------------------------------------------------------------------

def _has(name: str) -> Column:
    return contains_any(F.col("_q"), r.ROUTE_PHRASES[name])


def route(questions: DataFrame) -> DataFrame:
    """Task, confidence, reason and web wish; ``questions(question, has_uploads[, quick_action])``.

    The phrase tests are one projection, the cascade over them a second.
    """
    forced = match_action("question")
    if "quick_action" in questions.columns:
        forced = F.coalesce(match_action("quick_action"), forced)
    q = F.col("_q")
    facts = questions.withColumn("_q", normalized("question")).withColumn("_action", forced).withColumns(
        {f"_{name}": _has(name) for name in r.ROUTE_PHRASES}
    )
    statute = F.col("_statute") | q.rlike(_U + r.STATUTE_PATTERN)
    mixed = F.col("_mixed") | (F.col("_mixed_subject") & F.col("_mixed_law"))
    cited_upload = q.rlike(_U + r.UPLOAD_SECTION_PATTERN) & contains_any(q, r.UPLOAD_SECTION_WORDS)
    content = ~F.col("_general_law") & (F.col("_upload_content") | cited_upload)
    legal = F.col("_legal") | q.rlike("^(?:" + "|".join(r.QUESTION_OPENERS) + ")")
    uploads, web = F.col("has_uploads"), F.col("_web")
    action_task = {s: task for _, s, _, task, _, _ in r.ACTIONS}
    action_web = {s: w for _, s, _, _, w, _ in r.ACTIONS}
    rules = [
        (F.col("_review_table"), "review_table", 0.98, "review table", web),
        (F.col("_playbook"), "playbook_review", 0.98, "playbook review", web),
        (F.col("_redline"), "redline", 0.98, "redline", web),
        (uploads & F.col("_summary"), "summarization", 0.99, "uploaded document summary", web),
        (uploads & mixed, "mixed_qa", 0.96, "mixed document and legal authority", web),
        (uploads & F.col("_document"), "document_qa", 0.99, "document question", web),
        (uploads & content, "document_qa", 0.95, "matter document content analysis", web),
        (F.col("_hearing"), "hearing_prep", 0.98, "hearing preparation", web),
        (F.col("_compare"), "compare_provisions", 0.97, "compare provisions", F.lit(True)),
        (F.col("_notice"), "legal_notice", 0.98, "legal notice keywords", web),
        (F.col("_plaint"), "plaint", 0.98, "plaint keywords", web),
        (F.col("_draft") & ~uploads, "document_draft", 0.96, "document drafting", web),
        (F.col("_contract"), "contract_review", 0.97, "contract keywords", web),
        (F.col("_case_analysis"), "case_analysis", 0.96, "case analysis keywords", web),
        (F.col("_case_search"), "case_search", 0.95, "case law search", web),
        (statute, "statute_search", 0.94, "statute lookup", web),
        (legal, "legal_qa", 0.90, "general legal question", web),
        (web, "legal_qa", 0.80, "explicit internet search", F.lit(True)),
    ]

    def outcome(task: Column, confidence: float, reason: Column, wants: Column) -> Column:
        return F.struct(task.alias("task"), F.lit(confidence).alias("confidence"), reason.alias("reason"), wants.alias("web_search"))

    verdict = outcome(F.lit("general_chat"), 0.70, F.lit("fallback"), F.lit(False))
    for test, task, confidence, reason, wants in reversed(rules):
        verdict = F.when(test, outcome(F.lit(task), confidence, F.lit(reason), wants)).otherwise(verdict)
    action = F.col("_action")
    verdict = F.when(
        action.isNotNull(),
        outcome(_lookup(action_task, action), 0.99, F.concat(F.lit("quick action "), action), web | (_lookup(action_web, action) == "True")),
    ).otherwise(verdict)
    return facts.withColumn("_v", verdict).select(*questions.columns, "_v.*")


# --- complexity and plan -----------------------------------------------------------------

def complexity(question: Column, task: Column, mixed: Column, document: Column, follow_up: Column) -> Column:
    def level(lower: Column) -> Column:
        words = word_count(lower)
        sections = F.transform(F.regexp_extract_all(lower, F.lit(_I + r.COMPLEXITY_SECTION), F.lit(1)), lambda s: F.lower(s))
        named = F.filter(tx.const_list(r.COMPLEXITY_CONCEPTS), lambda w: F.contains(lower, w))
        concepts = F.size(F.array_distinct(sections)) + F.size(named)
        research = contains_any(lower, r.RESEARCH_MARKERS)
        return (
            F.when(mixed | contains_any(lower, r.COMPLEX_MARKERS), "complex")
            .when(follow_up & (words <= 12) & contains_any(lower, r.FOLLOW_UP_PHRASES), "research")
            .when(lower.rlike(_I + "|".join(r.SIMPLE_PATTERNS)), "simple")
            .when(document & ~research & (words <= 14), "simple")
            .when(concepts >= 3, "complex")
            .when(research | ((concepts >= 2) & F.contains(lower, F.lit("?"))), "research")
            .when(F.coalesce(task.isin(*r.COMPLEX_TASKS), F.lit(False)), "complex")
            .when((words <= 10) & (concepts <= 1), "simple")
            .otherwise("research")
        )

    return let(F.lower(one_line(question)), level)


def plan(questions: DataFrame) -> DataFrame:
    """Answer plan per question; needs ``question, has_uploads, document_id, has_history``."""
    q = F.col("question")
    lower = F.lower(q)
    pinned = F.coalesce(F.col("document_id"), F.lit("")) != ""
    routed = route(questions).withColumn("action", match_message_action("question"))
    task = F.when(pinned & F.col("action").isNull() & ~F.col("task").isin(*r.PINNABLE_TASKS), "document_qa").otherwise(F.col("task"))
    mode = F.coalesce(
        _lookup(r.ANSWER_MODES, F.col("task")), F.when(F.col("has_uploads"), "general_legal_qa").otherwise("general_chat")
    )
    m = F.col("answer_mode")
    strategy = (
        F.when(pinned & m.isin("document_qa", "summarization"), "document_scoped")
        .when(m == "mixed_legal_analysis", "mixed_doc_and_law")
        .when(m.isin("document_qa", "summarization"), "private_docs_first")
        .when(m.isin("general_chat", "review_table", "playbook_review", "redline"), "none")
        .otherwise("legal_first")
    )
    area = F.lit(None).cast("string")
    for name, words in reversed(r.AREAS.items()):
        area = F.when(contains_any(lower, words), name).otherwise(area)
    place = F.lit("pakistan")
    for name in reversed(r.JURISDICTIONS):
        place = F.when(F.contains(lower, F.lit(name)), name).otherwise(place)
    sections = F.regexp_extract_all(q, F.lit(_I + r.SECTION_PATTERN), F.lit(1))
    named = F.filter(tx.const_list(r.ENTITY_WORDS), lambda w: F.contains(lower, w))
    bail = tx.const_list(r.ENTITY_WORDS[-3:])
    entities = F.array_distinct(F.concat(
        F.transform(sections, lambda s: F.concat(F.lit("section "), s)),
        F.transform(named, lambda w: F.when(F.array_contains(bail, w), "bail").otherwise(w)),
    ))
    statutes = F.filter(
        F.array(*[F.when(F.contains(lower, F.lit(k)), v) for k, v in r.STATUTES]), lambda s: s.isNotNull()
    )
    electricity = lower.rlike(_U + r"\b54[\s\-]?c\b") & ~F.contains(lower, F.lit(r.STATUTES[0][0]))
    statutes = F.when(electricity, F.concat(statutes, F.array(F.lit(r.STATUTES[0][1])))).otherwise(statutes)
    follow_up = F.col("has_history") & (word_count(q) <= 12)
    return (
        routed.withColumn("task", task).withColumn("answer_mode", mode)
        .withColumn("retrieval_strategy", strategy)
        .withColumn("complexity", complexity(q, F.col("task"), m == "mixed_legal_analysis", m.isin("document_qa", "summarization"), follow_up))
        .withColumns({
            "requires_authority": m.isin(*r.AUTHORITY_MODES), "document_scoped": pinned & m.isin(*r.UPLOAD_MODES),
            "legal_area": area, "jurisdiction": place, "sections": sections,
            "cases": F.regexp_extract_all(q, F.lit(_I + r.CASE_PATTERN), F.lit(0)),
            "courts": F.transform(F.regexp_extract_all(q, F.lit(_I + r.COURT_PATTERN), F.lit(0)), lambda c: F.lower(c)),
            "entities": entities, "statutes": statutes,
        })
    )


# --- rewriting --------------------------------------------------------------------------

def expand_abbreviations(query: Column) -> Column:
    for short, full in r.ABBREVIATIONS:
        query = F.regexp_replace(query, rf"{_I}\b{short}\b", full)
    return query


def multilingual_anchors(query: Column) -> Column:
    """English anchors appended for Urdu section and bail words."""
    urdu = F.regexp_extract_all(query, F.lit(r"دفعہ\s*([0-9A-Za-z\-]+)"), F.lit(1))
    roman = F.regexp_extract_all(query, F.lit(_I + r"\bdafaa?\s+([0-9A-Za-z\-]+)"), F.lit(1))
    lower = F.lower(query)
    terms = F.transform(F.concat(urdu, roman), lambda s: F.concat(F.lit("section "), s))
    missing = unique_values(F.filter(terms, lambda s: ~F.contains(lower, F.lower(s))))
    no_bail = ~F.contains(lower, F.lit("bail"))
    extras = F.concat(
        missing,
        F.when(F.contains(query, F.lit("ضمانت")) & no_bail, F.array(F.lit("bail"))).otherwise(F.array().cast("array<string>")),
        F.when(query.rlike(_I + r"\bzamaan?at\b") & no_bail, F.array(F.lit("bail"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(F.size(extras) > 0, F.concat(query, F.lit(" "), F.array_join(extras, " "))).otherwise(query)


def rewrite(query: Column, task: Column) -> Column:
    """Abbreviations spelled out, anchors and the task's keywords appended."""
    base = multilingual_anchors(expand_abbreviations(one_line(query)))
    return F.concat_ws(" ", base, _lookup(r.TASK_KEYWORDS, task))


def extract_filters(query: Column) -> Column:
    """``struct<year, court, section>`` named in the question."""
    lower = F.lower(query)
    year = F.nullif(F.regexp_extract(query, _U + r"\b(19\d{2}|20\d{2})\b", 1), F.lit(""))
    court = F.lit(None).cast("string")
    for name in reversed(r.FILTER_COURTS):
        court = F.when(F.contains(lower, F.lit(name)), name).otherwise(court)
    cited = F.nullif(F.regexp_extract(lower, _U + r"(?:section|sec\.?|u/s|dafaa?)\s*([0-9A-Za-z\-]+)", 1), F.lit(""))
    urdu = F.nullif(F.regexp_extract(query, r"دفعہ\s*([0-9A-Za-z\-]+)", 1), F.lit(""))
    bare = F.when(
        lower.rlike(_U + r"\bsection\b|\bsec\.?\b|\bu/s\b"),
        F.nullif(F.regexp_extract(lower, _U + r"\b(\d{1,4}[\s\-]?[a-z])\b", 1), F.lit("")),
    )
    return F.struct(
        year.alias("year"), court.alias("court"), F.nullif(tx.normalize_section_id(F.coalesce(cited, urdu, bare)), F.lit("")).alias("section")
    )


def legal_terms(query: Column) -> Column:
    lower = F.lower(query)
    found = F.filter(tx.const_list(r.LEGAL_TERMS), lambda w: F.contains(lower, w))
    bail = F.contains(query, F.lit("ضمانت")) & ~F.array_contains(found, "bail")
    found = F.when(bail, F.concat(found, F.array(F.lit("bail")))).otherwise(found)
    return F.when(F.contains(query, F.lit("دفعہ")), F.concat(found, F.array(F.lit("section")))).otherwise(found)


# --- conversation context --------------------------------------------------------------------

CONTEXT_MESSAGES, RECENT_MESSAGES = 10, 6


def active_context(messages: DataFrame) -> DataFrame:
    """Context of every user turn: statutes, cases, documents, issue, unresolved question and topic.

    Each message is parsed once; the context of a turn joins the parsed pieces of the ten
    messages before it and its own.
    """
    t = F.coalesce(F.col("text"), F.lit(""))

    def every(pattern: str, group: int, flags: str) -> Column:
        return F.regexp_extract_all(t, F.lit(flags + pattern), F.lit(group))

    section = every(r.CONTEXT_SECTION, 1, _I)
    statutes = F.concat(
        F.transform(section, lambda s: F.concat(F.lit("Section "), s)),
        F.transform(every(r.CONTEXT_STATUTE, 0, _U), lambda s: tx.strip(s)),
    )
    issue = F.nullif(F.regexp_extract(t, _I + r.CONTEXT_ISSUE, 1), F.lit(""))
    near = F.get(section, F.lit(0))
    issue = F.when(near.isNotNull(), F.concat(issue, F.lit(" relating to Section "), near)).otherwise(issue)
    asked = F.when(
        (F.col("role") == "user") & (F.length(tx.strip(t)) > 20) & F.contains(t, F.lit("?")), F.substring(tx.strip(t), 1, 180)
    )
    topics = F.transform(every(r.TOPIC_PATTERN, 0, _I), lambda s: tx.strip(s))
    parsed = messages.withColumns({
        "_statutes": statutes, "_cases": F.transform(every(r.CASE_PATTERN, 0, _I), lambda s: tx.strip(s)),
        "_documents": F.transform(every(r.CONTEXT_DOCUMENT, 0, _I), lambda s: tx.strip(s)),
        "_issue": issue, "_asked": asked, "_topics": topics,
        "_user": F.when(F.col("role") == "user", tx.strip(t)),
        "_assistant": F.when(F.col("role") == "assistant", tx.strip(t)),
    })
    order = Window.partitionBy("conv_id", "_slice").orderBy("turn")
    context, recent = order.rowsBetween(-CONTEXT_MESSAGES, 0), order.rowsBetween(-RECENT_MESSAGES, -1)

    def over_context(c: str) -> Column:
        return unique_values(F.flatten(F.collect_list(c).over(context)))

    built = (
        sliced(parsed, CONTEXT_MESSAGES)
        .withColumns({
            "statutes": over_context("_statutes"), "cases": over_context("_cases"), "documents": over_context("_documents"),
            "issue": F.first("_issue", ignorenulls=True).over(context),
            "unresolved": F.last("_asked", ignorenulls=True).over(recent),
            "_mentions": F.slice(unique_values(F.flatten(F.reverse(F.collect_list("_topics").over(recent)))), 1, 3),
            "_last_user": F.last("_user", ignorenulls=True).over(recent),
            "_last_assistant": F.last("_assistant", ignorenulls=True).over(recent),
        })
        .filter((F.col("_own") == F.col("_slice")) & (F.col("role") == "user"))
    )
    bits = F.concat(
        F.when(F.col("issue").isNotNull(), F.array("issue")).otherwise(F.array().cast("array<string>")),
        F.slice("statutes", 1, 2), F.slice("cases", 1, 1), F.slice("documents", 1, 1),
    )
    structured = F.nullif(F.array_join(F.slice(unique_values(bits), 1, 4), ", "), F.lit(""))
    said = F.when(F.length("_last_user") > 8, tx.rstrip(F.substring("_last_user", 1, 160)))
    answered = F.when(F.length("_last_assistant") > 40, tx.rstrip(F.substring("_last_assistant", 1, 160)))
    topic = F.coalesce(structured, F.nullif(F.array_join("_mentions", ", "), F.lit("")), said, answered)
    return built.withColumn("topic", topic).select(
        *messages.columns, "statutes", "cases", "documents", "issue", "unresolved", "topic"
    )


def is_follow_up(question: Column) -> Column:
    lower = F.trim(F.lower(question), F.lit("?.! "))
    words = word_count(lower)
    return (
        question.rlike(_I + r.FOLLOW_UP_OPENING) | lower.rlike("^(?:and|but|also) ")
        | ((words <= 8) & lower.rlike(_I + r.TOPIC_PATTERN)) | ((words <= 12) & lower.rlike(_U + r.POINTING_WORDS))
    )


def contextual_query(question: Column, topic: Column) -> Column:
    """A follow-up phrased as a question of its own."""
    lower = F.trim(F.lower(question), F.lit("?.! "))
    tail = F.concat(topic, F.lit(" under Pakistan law"))
    action = F.trim(F.regexp_replace(lower, r"^can (?:it|this|that)\s+", ""), F.lit("?.! "))
    subject = F.trim(F.regexp_replace(lower, r"^what about\s+", ""), F.lit("?.! "))
    return (
        F.when(lower.rlike("^can (?:it|this|that) "), F.concat(F.lit("Can "), action, F.lit(" relating to "), tail))
        .when(F.startswith(lower, F.lit("what about")), F.concat(subject, F.lit(" relating to "), tail))
        .when(lower.rlike(_U + r.EXPLAIN_OPENING), F.concat(F.lit("Explain "), tail))
        .otherwise(F.concat(F.trim(question, F.lit("?.! ")), F.lit(" in the context of "), tail))
    )


def resolve_followups(messages: DataFrame) -> DataFrame:
    """User turns with ``resolved``: follow-ups completed by the conversation's topic."""
    ctx = active_context(messages)
    q = one_line("text")
    stands_alone = (q == "") | q.rlike(_I + r.EXPLICIT_INTENT) | ~is_follow_up(q) | F.col("topic").isNull()
    resolved = F.when(q == "", F.col("text")).when(stands_alone, q).otherwise(contextual_query(q, F.col("topic")))
    return ctx.withColumn("resolved", resolved).withColumn("follow_up", ~stands_alone)


# --- titles ------------------------------------------------------------------------------------

TITLE_LENGTH = 60


def title_case(text: Column) -> Column:
    """Every run of letters starts with a capital, also after digits and hyphens."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))

    def titled(w: Column) -> Column:
        # An initial may become two letters; only the first of them stays upper case.
        first = F.upper(F.substring(w, 1, 1))
        return F.concat(F.substring(first, 1, 1), F.lower(F.substring(first, 2, 2)), F.lower(F.substring(w, 2, 2**30)))

    return F.array_join(F.transform(runs, titled), "")


def conversation_title(message: Column | str) -> Column:
    """Short sidebar title from the first message."""
    flat = one_line(message)
    prefixes = "|".join(r.TITLE_PREFIXES)
    bare = tx.strip(F.regexp_replace(flat, f"(?i)^(?:{prefixes})", ""))
    terms = tx.const_map(r.TITLE_TERMS)
    stop = tx.const_list(r.TITLE_STOPWORDS)

    def term(word: Column) -> Column:
        mark = F.regexp_extract(word, "[,.;:!?]$", 0)
        body = F.regexp_replace(word, "[,.;:!?]$", "")
        return F.concat(F.coalesce(F.element_at(terms, F.lower(body)), body), mark)

    words = F.filter(F.transform(F.split(bare, " "), term), lambda w: ~F.array_contains(stop, F.lower(w)))
    kept = F.regexp_replace(F.array_join(words, " "), rf"[^{tx.WORD}{tx.SPACE}/\-]", "")
    title = title_case(tx.collapse(kept))
    cut = F.substring(title, 1, TITLE_LENGTH)
    at_word = F.regexp_replace(cut, " [^ ]*$", "")
    short = F.when((F.length(at_word) > 20) & F.contains(cut, F.lit(" ")), at_word).otherwise(cut)
    return (
        F.when(title == "", F.lit("New Conversation"))
        .when(F.length(title) <= TITLE_LENGTH, title)
        .otherwise(F.concat(tx.rstrip(short), F.lit("...")))
    )


def plain_title(message: Column | str) -> Column:
    """The first message itself, cut to sixty characters."""
    text = tx.strip(F.coalesce(tx.as_col(message), F.lit("")))
    return (
        F.when(text == "", F.lit("New Conversation"))
        .when(F.length(text) > TITLE_LENGTH, F.concat(F.substring(text, 1, TITLE_LENGTH - 3), F.lit("...")))
        .otherwise(text)
    )
