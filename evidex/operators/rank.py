"""Reranking, exact and near-duplicate removal, tiered selection (families D and E)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidex.functions import text as tx
from evidex.functions.fold import let
from evidex.functions.identity import canonical_doc_id, hit_key
from evidex.staging import staged

# Weights added to the vector score.
TIER_BOOST = {"legal": 0.20, "conversation": 0.08, "matter": 0.12, "web": 0.02}
DOCUMENT_TIER_BOOST = {"legal": 0.0, "conversation": 0.15, "matter": 0.18, "web": 0.0}
TOKEN_WEIGHT, TOKEN_CAP = 0.03, 0.18
SECTION_WEIGHT, COURT_WEIGHT, YEAR_WEIGHT, LONG_TERM_WEIGHT, TOPIC_WEIGHT = 0.15, 0.12, 0.08, 0.05, 0.14
# Question words that never count as topic words.
TOPIC_STOPWORDS = """what when where which who whom whose why how does did do the and for with from that
this justice court section article pakistan pakistani primary task newly established independent
government""".split()


def hit_score() -> Column:
    return F.coalesce("relevance_score", "score", F.lit(0.0))


def _boost(source_type: Column, table: dict[str, float]) -> Column:
    cases = F.lit(0.0)
    for name, value in table.items():
        cases = F.when(source_type == name, F.lit(value)).otherwise(cases)
    return cases


def rerank(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits with ``relevance_score``; ``queries(query_id, query, section, court, year, document_task)``.

    Query tokens are computed once per query before the join, the rest is one projection.
    """
    q = queries.select(
        "query_id",
        tx.rerank_tokens("query").alias("_qt"),
        F.lower(tx.normalize_hyphens("section")).alias("_section"),
        F.lower("court").alias("_court"),
        F.col("year").cast("string").alias("_year"),
        F.coalesce("document_task", F.lit(False)).alias("_doc_task"),
    )
    empty = F.array().cast("array<string>")
    sections = F.coalesce("sections", empty)
    blob = F.concat_ws(
        " ", F.coalesce("text", F.lit("")), F.concat_ws(" ", F.coalesce("keywords", empty)),
        F.concat_ws(" ", sections), *[F.coalesce(c, F.lit("")) for c in ("law_name", "title", "heading", "summary")],
    )
    rows = hits.join(q, "query_id").withColumn("_blob", F.lower(tx.normalize_hyphens(blob))).withColumn(
        "_tokens", tx.rerank_tokens("_blob", normalized=True)
    )
    b = F.col("_blob")
    overlap = F.size(F.array_intersect("_qt", "_tokens"))
    listed = F.transform(sections, lambda s: F.lower(tx.normalize_hyphens(s)))
    compact = F.replace(F.col("_section"), F.lit("-"), F.lit(""))
    bare = F.replace(b, F.lit("-"), F.lit(""))
    section_hit = (F.col("_section") != "") & (
        F.array_contains(listed, F.col("_section"))
        | F.exists(listed, lambda s: F.replace(s, F.lit("-"), F.lit("")) == compact)
        | F.contains(b, F.col("_section")) | F.contains(bare, compact)
    )
    court_hit = (F.col("_court") != "") & F.contains(F.lower("court"), F.col("_court"))
    year_hit = F.col("_year") == F.col("year").cast("string")
    stop = tx.const_list(TOPIC_STOPWORDS)
    long_hit = F.exists("_qt", lambda t: (F.length(t) >= 5) & F.contains(b, t))
    topic_hit = F.exists("_qt", lambda t: (F.length(t) >= 4) & ~F.array_contains(stop, t) & F.contains(b, t))
    source = F.coalesce("source_type", F.lit("legal"))
    tier = F.when(F.col("_doc_task"), _boost(source, DOCUMENT_TIER_BOOST)).otherwise(_boost(source, TIER_BOOST))

    def weight(hit: Column, value: float) -> Column:
        return F.when(hit, F.lit(value)).otherwise(F.lit(0.0))

    score = (
        F.coalesce("score", F.lit(0.0)) + F.least(overlap * F.lit(TOKEN_WEIGHT), F.lit(TOKEN_CAP))
        + weight(section_hit, SECTION_WEIGHT) + weight(court_hit, COURT_WEIGHT) + weight(year_hit, YEAR_WEIGHT)
        + weight(long_hit, LONG_TERM_WEIGHT) + weight(topic_hit, TOPIC_WEIGHT) + tier
    )
    return rows.withColumn("relevance_score", F.bround(score, 6)).select(
        *[c for c in hits.columns if c != "relevance_score"], "relevance_score"
    )


def source_reference() -> Column:
    """Human-readable reference of a hit; null when nothing is known about it."""
    def filled(c: str) -> Column:
        return F.nullif(F.col(c).cast("string"), F.lit(""))

    name = F.coalesce(*[filled(c) for c in ("display_name", "filename", "title", "law_name", "document_type")])
    sections = F.when(F.size("sections") > 0, F.concat(F.lit("Section "), F.array_join("sections", ", ")))
    section = F.concat(F.lit("Section "), filled("section"))
    year = F.when(F.col("year") != 0, F.col("year").cast("string"))
    page = F.when(F.col("page_number") != 0, F.concat(F.lit("page "), F.col("page_number").cast("string")))
    built = F.concat_ws(", ", name, F.coalesce(sections, section), filled("court"), year, page, filled("url"))
    return F.coalesce(filled("source_reference"), F.nullif(built, F.lit("")))


def enrich_hits(hits: DataFrame) -> DataFrame:
    """Default source type, chunk id and reference."""
    inferred = (
        F.when(F.col("source").isin("legal_corpus", "legal"), "legal")
        .when((F.col("scope") == "conversation") | (F.col("source") == "conversation_document"), "conversation")
        .when((F.col("scope") == "matter") | (F.col("source") == "matter_document"), "matter")
        .when(F.col("source") == "web", "web")
        .otherwise("legal")
    )
    return hits.withColumns(
        {
            "source_type": F.coalesce("source_type", inferred),
            "chunk_id": F.coalesce("chunk_id", "id"),
            "source_reference": source_reference(),
        }
    )


# --- duplicates ---------------------------------------------------------------

NEAR_JACCARD, FAR_JACCARD = 0.82, 0.90
SHORT_PASSAGE, PREFIX_CHARS = 60, 180
OFFSET_RATIO = 0.55


def offsets_overlap(ls: Column, le: Column, rs: Column, re: Column) -> Column:
    """The spans share at least 55 % of the shorter one."""
    shared = F.least(le, re) - F.greatest(ls, rs)
    shorter = F.least(le - ls, re - rs)
    return F.coalesce(
        (le > ls) & (re > rs) & (shared > 0) & (shared / F.nullif(shorter, F.lit(0)) >= OFFSET_RATIO), F.lit(False)
    )


PARITY_WORDS = 4


def parity(tokens: Column) -> Column:
    """256 bits of a token set, each the parity of the tokens hashed to it, as four numbers.

    Two sets differ in at least as many tokens as their parities differ in bits, whatever the hash.
    """
    zero = F.lit(0).cast("bigint")
    hashed = F.transform(tokens, lambda t: F.xxhash64(t))
    start = F.struct(*[zero.alias(f"p{i}") for i in range(PARITY_WORDS)])

    def step(acc: Column, h: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int"))
        word = F.call_function("shiftrightunsigned", h, F.lit(62))
        return F.struct(*[
            F.when(word == i, acc[f"p{i}"].bitwiseXOR(bit)).otherwise(acc[f"p{i}"]).alias(f"p{i}") for i in range(PARITY_WORDS)
        ])

    return F.aggregate(hashed, start, step)


def may_be_near(a_parity: Column, b_parity: Column, a_size: Column, b_size: Column) -> Column:
    """False only for sets whose Jaccard is below ``NEAR_JACCARD``: those differ in too many tokens."""
    differ = sum((F.bit_count(a_parity[f"p{i}"].bitwiseXOR(b_parity[f"p{i}"])) for i in range(PARITY_WORDS)), F.lit(0))
    return differ <= (a_size + b_size) * F.lit((1 - NEAR_JACCARD) / (1 + NEAR_JACCARD)) + F.lit(1e-6)


def near_duplicate(a: Column, b: Column, a_tokens: Column, b_tokens: Column, may: Column | None = None) -> Column:
    """Whether two normalised passages are the same passage seen through two windows.

    ``may`` (of ``may_be_near``) saves comparing the tokens of those that are not.
    """
    a_short = F.length(a) <= F.length(b)
    shorter = F.when(a_short, a).otherwise(b)
    longer = F.when(a_short, b).otherwise(a)
    prefix = F.substring(shorter, 1, PREFIX_CHARS)
    ratio = tx.jaccard(a_tokens, b_tokens)
    needed = F.when(F.contains(longer, prefix), NEAR_JACCARD).otherwise(FAR_JACCARD)
    return (
        F.when((a == "") | (b == ""), False)
        .when(a == b, True)
        .when(F.least(F.length(a), F.length(b)) < SHORT_PASSAGE, F.contains(longer, shorter))
        .when(F.lit(True) if may is None else may, ratio >= needed).otherwise(False)
    )


def duplicate_pairs(chunks: DataFrame) -> DataFrame:
    """Windows of a document that repeat each other, wherever in it they are.

    Normal forms and parities are made once for every window and written.  The windows of a
    document then meet in one join that looks at offsets, lengths and parities of a pair first
    and compares texts only of pairs these leave open, so no pair is left out and only pairs
    that repeat each other come out of the join.
    """
    passage = _passage(F.col("text"), F.lit(True))
    rows = chunks.select("document_id", "chunk_index", "start_offset", "end_offset", passage.alias("p")).select(
        "document_id", "chunk_index", "start_offset", "end_offset", F.col("p.n").alias("n"),
        F.length("p.n").alias("size"), F.size("p.t").alias("words"), F.col("p.p").alias("parity"),
    )
    rows = staged(rows, "passages")
    a, b = (rows.select("document_id", *[F.col(c).alias(f"{x}_{c}") for c in rows.columns[1:]]) for x in "ab")
    left, right = ({c: F.col(f"{x}_{c}") for c in rows.columns[1:]} for x in "ab")
    tokens = [tx.passage_tokens(side["n"]) for side in (left, right)]
    offsets = offsets_overlap(*(side[c] for side in (left, right) for c in ("start_offset", "end_offset")))
    may = may_be_near(left["parity"], right["parity"], left["words"], right["words"])
    open_pair = (F.least(left["size"], right["size"]) < SHORT_PASSAGE) | may
    near = open_pair & near_duplicate(left["n"], right["n"], *tokens, may)
    both = a.join(b, "document_id").filter((left["chunk_index"] < right["chunk_index"]) & (offsets | near))
    return both.select(
        "document_id", left["chunk_index"].alias("left_index"), right["chunk_index"].alias("right_index"),
        tx.jaccard(*tokens).alias("jaccard"),
    )


def hit_order(*extra: str) -> list[Column]:
    return [F.desc(hit_score()), *[F.asc(c) for c in extra], F.asc("ordinal")]


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """Exact copies removed, the best-scored (then first) copy kept.

    Written as an aggregate so copies collapse before the shuffle, however many
    copies of one hit there are.
    """
    key = hit_key("document_id", "chunk_id", "chunk_index", "id")
    others = [c for c in hits.columns if c != "query_id"]
    best = F.max_by(F.struct(*others), F.struct(hit_score(), -F.col("ordinal")))
    return (
        hits.groupBy("query_id", key.alias("_key")).agg(best.alias("_r")).select("query_id", "_r.*").select(*hits.columns)
    )


def _same_document(x: Column, y: Column) -> Column:
    by_id = F.coalesce(x["doc"] == y["doc"], F.lit(False))
    return by_id | F.coalesce((x["file"] == y["file"]) & (x["file"] != ""), F.lit(False))


def _passage(text: Column, many: Column) -> Column:
    """Normal form and tokens of a text; in long lists also the parity that spares comparing them."""
    return let(tx.passage_norm(text), lambda n: let(tx.passage_tokens(n), lambda t: F.struct(
        n.alias("n"), t.alias("t"), F.when(many, parity(t)).alias("p"),
    )))


def _item(at: Callable[[str], Column], key: Column, row: Column, many: Column) -> Column:
    """What the folds look at of a hit; ``row`` is the hit itself, ``at`` gives its columns."""
    return let(_passage(at("text"), many), lambda p: F.struct(
        key.alias("key"), canonical_doc_id(at("document_id"), F.coalesce(at("chunk_id"), at("id"))).alias("doc"),
        F.lower(tx.strip(at("filename"))).alias("file"),
        at("start_offset").cast("bigint").alias("s"), at("end_offset").cast("bigint").alias("e"),
        p["n"].alias("n"), p["t"].alias("t"), p["p"].alias("p"), row.alias("row"),
    ))


def _near(x: Column, y: Column) -> Column:
    """Near duplicates among items; ``y`` comes before ``x``."""
    may = F.coalesce(may_be_near(x["p"], y["p"], F.size(x["t"]), F.size(y["t"])), F.lit(True))
    return near_duplicate(y["n"], x["n"], y["t"], x["t"], may)


def _repeats(x: Column, y: Column) -> Column:
    return _same_document(x, y) & (offsets_overlap(y["s"], y["e"], x["s"], x["e"]) | _near(x, y))


def greedy(items: Column, repeats: Callable[[Column, Column], Column] = _repeats) -> Column:
    """Items kept in order: one that repeats an already kept item is dropped.

    The fold carries places only: whatever it carries is copied at every step, and hits with
    their texts and tokens would make that quadratic in bytes.
    """
    def fold(all_items: Column) -> Column:
        def step(kept: Column, i: Column) -> Column:
            again = F.exists(kept, lambda k: repeats(F.get(all_items, i), F.get(all_items, k)))
            return F.when(again, kept).otherwise(F.concat(kept, F.array(i)))

        places = F.aggregate(F.transform(all_items, lambda _, i: i), F.array().cast("array<int>"), step)
        return F.transform(places, lambda i: F.get(all_items, i))

    return let(items, fold)


def first_of_key(items: Column) -> Column:
    """The first item of every key."""
    keys = F.transform(items, lambda x: x["key"])
    return F.filter(items, lambda x, i: F.array_position(keys, x["key"]) == i + 1)


def _origin(hits: DataFrame) -> Column:
    """What two hits must share to be of the same document: the file, else the document.

    A document id belongs to one file name, as it does in the index; hits of it that come
    without the name are given it.
    """
    file = F.nullif(F.lower(tx.strip("filename")), F.lit(""))
    doc = canonical_doc_id("document_id", F.coalesce("chunk_id", "id"))
    by_doc = Window.partitionBy("query_id", doc)
    known = F.when(doc.isNotNull(), F.max(file).over(by_doc)).otherwise(file)
    alone = F.coalesce("chunk_id", "id", F.col("ordinal").cast("string"))
    return F.coalesce(F.concat(F.lit("f:"), known), F.concat(F.lit("d:"), doc), F.concat(F.lit("h:"), alone))


def suppress_near_duplicates(hits: DataFrame) -> DataFrame:
    """Greedy suppression: by score, a hit goes if it repeats a kept hit of the same document.

    Hits of different documents never meet, so each document's hits of a query are folded on
    their own, however many hits the query has; a group is no larger than a document has
    windows.  No pairs are emitted and no Python runs.
    """
    return _suppressed(hits.withColumn("_gone", F.lit(0).cast("bigint"))).select(*hits.columns)


def _suppressed(hits: DataFrame) -> DataFrame:
    order = F.struct((-hit_score()).alias("first"), F.col("ordinal").cast("bigint").alias("then"))
    return _survivors(hits, _origin(hits), order, F.lit(None).cast("string"), _repeats)


PARITY_FROM = 8


def _survivors(hits: DataFrame, group: Column, order: Column, key: Column, repeats: Callable[[Column, Column], Column]) -> DataFrame:
    """Hits of every group folded in order; ``_gone`` of the first that stays counts those that went, now or before.

    Only the hits move; their normal forms and tokens are made where they are folded, and a hit
    alone in its group has none made.
    """
    row = F.struct(order.alias("order"), key.alias("key"), F.struct(*hits.columns).alias("row"))
    lists = hits.select("query_id", group.alias("_group"), row.alias("_row")).groupBy("query_id", "_group").agg(
        F.sort_array(F.collect_list("_row")).alias("items")
    )
    many = F.size("items") >= PARITY_FROM
    folded = greedy(F.transform("items", lambda x: _item(lambda c: x["row"][c], x["key"], x["row"], many)), repeats)
    kept = F.when(F.size("items") > 1, F.transform(folded, lambda k: k["row"])).otherwise(F.transform("items", lambda x: x["row"]))
    before = F.aggregate("items", F.size("items").cast("bigint"), lambda n, x: n + x["row"]["_gone"])
    rows = lists.select(before.alias("_before"), kept.alias("_kept")).select(
        (F.col("_before") - F.size("_kept")).alias("_less"), F.posexplode("_kept").alias("_at", "k")
    )
    return rows.select(*[F.col(f"k.{c}") for c in hits.columns if c != "_gone"], F.when(F.col("_at") == 0, F.col("_less")).otherwise(0).alias("_gone"))


PRE_CUT_SALTS = 16


def select_evidence(hits: DataFrame, limits: DataFrame) -> DataFrame:
    """Tiered selection: per source type the best 2k, deduplicated, cut to k; then across tiers.

    ``limits(query_id, total_limit, legal_limit, conversation_limit, matter_limit)``.
    Output position follows legal, conversation, matter, web and the score within each.

    The first cut runs on salted parts of each query, so a query holding a large share
    of all hits is trimmed by many tasks; after it every list has at most 2k rows per
    tier and the folds work on those.
    """
    tier = F.when(F.col("source_type").isin("conversation", "matter", "web"), F.col("source_type")).otherwise("legal")
    spare = F.greatest(F.lit(0), F.least(F.lit(4), F.col("total_limit") - F.col("legal_limit")))
    cap = (
        F.when(F.col("_tier") == "legal", F.col("legal_limit"))
        .when(F.col("_tier") == "conversation", F.col("conversation_limit"))
        .when(F.col("_tier") == "matter", F.col("matter_limit"))
        .otherwise(F.when(spare > 0, spare).otherwise(3))
    )
    order = F.expr("CASE _tier WHEN 'legal' THEN 0 WHEN 'conversation' THEN 1 WHEN 'matter' THEN 2 ELSE 3 END")

    def cut(df: DataFrame, *by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*hit_order()))
        return df.withColumn("_n", place).filter(F.col("_n") <= F.col("_cap") * 2).drop("_n")

    rows = (
        hits.withColumn("_tier", tier).withColumn("_salt", F.pmod(F.xxhash64("ordinal"), F.lit(PRE_CUT_SALTS)))
        .join(limits.select("query_id", "total_limit", "legal_limit", "conversation_limit", "matter_limit"), "query_id")
        .withColumn("_cap", cap)
    )
    best = cut(cut(rows, "query_id", "_tier", "_salt"), "query_id", "_tier")
    key = hit_key("document_id", "chunk_id", "chunk_index", "id")
    item = let(_item(F.col, key, F.struct(*hits.columns), F.lit(False)), lambda x: F.struct(
        (-hit_score()).alias("neg"), F.col("ordinal").alias("ordinal"), *[x[c].alias(c) for c in ("key", "doc", "file", "s", "e", "n", "t", "p", "row")],
    ))
    tiered = (
        best.groupBy("query_id", "_tier", "_cap", "total_limit").agg(F.sort_array(F.collect_list(item)).alias("items"))
        .select("query_id", "total_limit", order.alias("_order"),
                F.slice(greedy(first_of_key(F.col("items"))), 1, F.col("_cap").cast("int")).alias("kept"))
    )
    # A copy found in several tiers is shown once, in its first tier, with its best score.
    ranked = F.sort_array(F.flatten(F.collect_list(F.transform("kept", lambda k: F.struct(
        k["neg"].alias("neg"), F.col("_order").alias("order"), k["ordinal"].alias("ordinal"), k["key"].alias("key"),
        k["doc"].alias("doc"), k["file"].alias("file"), k["s"].alias("s"), k["e"].alias("e"), k["n"].alias("n"),
        k["t"].alias("t"), k["p"].alias("p"), k["row"].alias("row"),
    )))))
    merged = tiered.groupBy("query_id", "total_limit").agg(ranked.alias("items")).withColumn(
        "kept", greedy(first_of_key(F.col("items")))
    )

    def first_tier(k: Column) -> Column:
        return F.array_min(F.transform(F.filter("items", lambda x: x["key"] == k["key"]), lambda x: x["order"]))

    shown = F.slice(
        F.sort_array(F.transform("kept", lambda k: F.struct(
            first_tier(k).alias("order"), k["neg"].alias("neg"), k["ordinal"].alias("ordinal"), k["row"].alias("row")
        ))), 1, F.col("total_limit").cast("int"),
    )
    return merged.select(F.posexplode(shown).alias("p", "k")).select("k.row.*", (F.col("p") + 1).cast("bigint").alias("position"))


def remove_duplicate_evidence(hits: DataFrame) -> DataFrame:
    """Packing-time dedupe; adds ``removed_count`` per query.

    Key: document and chunk, else document and offsets, else document, index and text.
    Earlier hits win here, then the greedy score pass runs.  The first pass meets hits of one
    document (or, without one, of one key), the second those of one document or file, so both
    fold per document; the hits a group loses are counted on one that stays.
    """
    doc, cid = F.nullif(F.col("document_id"), F.lit("")), F.nullif(F.coalesce("chunk_id", "id"), F.lit(""))
    text = F.md5(F.substring(F.coalesce("text", F.lit("")), 1, 240))
    key = (
        F.when(doc.isNotNull() & cid.isNotNull(), F.concat(F.lit("c:"), doc, F.lit(":"), cid))
        .when(F.col("document_id").isNotNull() & F.col("start_offset").isNotNull(),
              F.concat_ws(":", F.lit("o"), "document_id", F.col("start_offset").cast("string"), F.col("end_offset").cast("string")))
        .otherwise(F.concat_ws(":", F.lit("i"), F.coalesce("document_id", F.lit("")),
                               F.coalesce(F.col("chunk_index").cast("string"), F.lit("")), text))
    )

    def repeats(x: Column, y: Column) -> Column:
        own = F.nullif(x["row"]["document_id"], F.lit("")) == F.nullif(y["row"]["document_id"], F.lit(""))
        return (x["key"] == y["key"]) | (F.coalesce(own, F.lit(False)) & _near(x, y))

    ordinal = F.col("ordinal").cast("bigint")
    in_order = F.struct(ordinal.alias("first"), ordinal.alias("then"))
    unique = _survivors(hits.withColumn("_gone", F.lit(0).cast("bigint")), F.coalesce(doc, key), in_order, key, repeats)
    # Written once: the counts of a query are known when all its groups are folded.
    final = staged(_suppressed(unique), "unique-evidence")
    removed = final.groupBy("query_id").agg(F.sum("_gone").alias("removed_count"))
    return final.join(removed, "query_id").select(*hits.columns, "removed_count")
