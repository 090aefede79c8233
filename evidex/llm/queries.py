"""The queries of this package: each operator over its whole table, reported as its contract asks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from evidex.llm import (
    chat, content_sort, divergence, embedding_dedup, filter_audit, main_text, mixing, ngram_join, packing, pii, quality, topk, toxicity,
)
from evidex.llm.common import table

# Token shares by language; languages are the domains of the documents.
SHARES = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 65,536 padded words in 16 length buckets."""
    return packing.pack_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _scored(operator, spark: SparkSession, sf_dir: str, folds: int, held: int) -> DataFrame:
    """Scores of a classifier that learns from the labels outside one fold of the documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = F.crc32(F.col("doc_id").cast("string")) % folds == held
    model = operator.fit(docs, labels, ~out)
    scored = operator.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= operator.THRESHOLD).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(toxicity, spark, sf_dir, 4, 2)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts say a control string."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(quality, spark, sf_dir, 3, 1)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate for every document, so that the languages reach their shares of the tokens there are."""
    docs = table(spark, sf_dir, "documents")
    sample = mixing.labelled_sample(docs, table(spark, sf_dir, "labels"), F.col("lang"))
    mixed = mixing.mix(docs.select("doc_id", "text"), sample, SHARES)
    return mixed.select("doc_id", "n_tokens", *[F.col("shares")[d].alias(f"share_{d}") for d in SHARES], "rate", "copies")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.copies(table(spark, sf_dir, "documents"), keep="largest")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_join": op3_ngram_join,
    "op4_pii": op4_pii,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_chat": op6_chat,
    "op7_main_text": op7_main_text,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_topk": op10_topk,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_divergence": op12_divergence,
    "op13_filter_audit": op13_filter_audit,
}
# --- oracle SQL ------------------------------------------------------------------


def _components(nodes: str, links: str) -> str:
    """Least node reachable by ``links(a, b)``, by walking them."""
    return f"""
        walk AS (
            SELECT id AS start, id AS here FROM {nodes}
            UNION
            SELECT w.start, CASE WHEN l.a = w.here THEN l.b ELSE l.a END FROM walk w JOIN {links} l ON w.here = l.a OR w.here = l.b
        ), reach AS (SELECT start, min(here) AS label FROM walk GROUP BY start)"""


_SHINGLES = """
        docs AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
            FROM documents
        ), sets AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs
        ), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h, n) AS id, n FROM (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS h, count(*) AS n FROM sets GROUP BY doc_id)),
        named AS (SELECT DISTINCT id, n FROM classes),
        own AS (SELECT doc_id AS id, s FROM sets JOIN (SELECT DISTINCT id FROM classes) k ON k.id = sets.doc_id),
        links AS (
            SELECT p.a, p.b FROM (SELECT x.id AS a, y.id AS b, count(*) AS k FROM own x JOIN own y ON x.s = y.s AND x.id < y.id GROUP BY ALL) p
            JOIN named m ON m.id = p.a JOIN named o ON o.id = p.b WHERE 100 * k >= 80 * (m.n + o.n - k)
        )"""


def _spans_sql(kind: str) -> str:
    """Located matches of one kind: gaps and matches by turns, lengths summed."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    }
    digits = "regexp_replace(h, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(string_split(reverse({digits}), ''), lambda d, i: CASE WHEN i % 2 = 1 THEN CAST(d AS INT) ELSE CAST(d AS INT) * 2 % 10 + CAST(d AS INT) // 5 END)) % 10 = 0"
    packed = "replace(h, ' ', '')"
    mod97 = (
        f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substring({packed}, 5) || left({packed}, 4), ''), lambda c: CASE WHEN c >= 'A' THEN 100 + ascii(c) - 55 ELSE ascii(c) - 48 END)), "
        "lambda a, c: CASE WHEN c >= 100 THEN (a * 100 + c - 100) % 97 ELSE (a * 10 + c) % 97 END) = 1"
    )
    valid = {
        "email": "true", "ip": "len(list_filter(string_split(h, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || left(ltrim(p, '0'), 3) AS INT) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 9 AND 15", "iban": mod97,
        "ssn": "regexp_matches(lower(right(g, 48) || ' ' || left(after, 48)), '\\b(?:ssn|social|security|tax|insurance)')",
    }
    p = patterns[kind].replace("'", "''")
    order = list(patterns).index(kind)
    return f"""
            SELECT doc_id, {order} AS o, '{kind}' AS kind, s, s + length(h) AS e FROM (
                SELECT doc_id, h, g, after, coalesce(sum(length(g) + length(h)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(g) AS s FROM (
                    SELECT doc_id, r, unnest(hits) AS h, unnest(gaps[1:len(hits)]) AS g, unnest(gaps[2:]) AS after, unnest(range(len(hits))) AS i
                    FROM (SELECT doc_id, r, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS gaps FROM texts))) WHERE {valid[kind]}"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ANY = "### (?:System|User|Assistant|Other):|###\\||</turn>"
_ESCAPE = "regexp_replace({}, '(\\\\*)(" + _ANY + ")', '\\1\\1\\\\\\2', 'g')"

ORACLE: dict[str, str] = {
    "op3_ngram_join": f"""WITH RECURSIVE {_SHINGLES},{_components('(SELECT DISTINCT id FROM classes)', 'links')}
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(label, d.doc_id) AS component_id
        FROM documents d LEFT JOIN classes c USING (doc_id) LEFT JOIN reach r ON r.start = c.id""",
    "op4_pii": f"""WITH texts AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
        spans AS ({' UNION ALL '.join(map(_spans_sql, pii.KINDS))}),
        listed AS (
            SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)},
                string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS spans,
                string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (o < 4) AS base FROM spans GROUP BY doc_id)
        SELECT d.doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN listed l USING (doc_id)""",
    "op5_embedding_dedup": f"""WITH RECURSIVE v AS (
            SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id < y.id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95),{_components('v', 'links')},
        degree AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(reach.label, vec_id) AS component_id, coalesce(reach.label, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN degree ON degree.id = vec_id LEFT JOIN reach ON start = vec_id""",
    "op6_chat": rf"""WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, n, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(n, r)
        ), f AS (
            SELECT *, CASE role WHEN 'system' THEN '### System:' WHEN 'user' THEN '### User:' WHEN 'assistant' THEN '### Assistant:'
                ELSE '### Other:' || {_ESCAPE.format('role')} || '###|' END || {_ESCAPE.format('text')} || '</turn>' AS shown FROM t
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length(shown)) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id""",
    "op10_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op11_exact_dedup": f"""WITH t AS (SELECT doc_id, {_LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
            row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY t)""",
    "op12_divergence": rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS t FROM documents),
        said AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        terms AS (SELECT lang, term, count(*) AS n FROM said GROUP BY ALL HAVING count(DISTINCT r) >= 3),
        counts AS (SELECT lang, source, term, count(*) AS n FROM said GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM d),
        size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM terms GROUP BY lang),
        held AS (SELECT lang, source, sum(c.n) AS n FROM counts c JOIN terms USING (lang, term) GROUP BY ALL),
        cells AS (
            SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n,
                CAST(1 + 1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT // (coalesce(h.n, 0) + v) AS HUGEINT) AS p,
                CAST(1 + 1000000000 * (t.n + 1)::HUGEINT // (s.n + v) AS HUGEINT) AS q
            FROM groups g JOIN terms t USING (lang) JOIN size s USING (lang) LEFT JOIN held h USING (lang, source) LEFT JOIN counts c USING (lang, source, term)),
        apart AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM cells x JOIN cells y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL),
        found AS (
            SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
            FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN apart a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
            UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM cells WHERE n > 0 AND p > q),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM found)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op13_filter_audit": rf"""WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        lab AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
        tests AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                {{'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
                  'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)}} AS f
            FROM d LEFT JOIN lab USING (doc_id)),
        failed AS (
            SELECT part, good, toxic, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END) || (CASE WHEN f.C THEN 'C' ELSE '' END)
                || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS f FROM tests),
        orders AS (
            SELECT '' AS o UNION ALL SELECT o || l FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(o, l)),
        steps AS (SELECT o AS filter_order, s AS step, o[s] AS l, left(o, s - 1) AS before FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS s) WHERE length(o) = 5),
        cells AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
        seen AS (
            SELECT part, filter_order, step, l, n, good, toxic, f, contains(f, l) AS fails, regexp_matches(f, '[' || before || '-]') AS gone FROM cells, steps),
        counted AS (
            SELECT part, filter_order, step, l,
                CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS BIGINT) AS removed,
                CAST(coalesce(sum(n) FILTER (gone AND fails), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (f = l), 0) AS BIGINT) AS unique_fails,
                CAST(coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS BIGINT) AS toxic_lost
            FROM seen GROUP BY ALL)
        SELECT * EXCLUDE (l), CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley FROM counted""",
}
