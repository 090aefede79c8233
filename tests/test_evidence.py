import numpy as np
import pytest
from pyspark.sql import functions as F

from evidex.functions import identity
from evidex.functions import text as tx
from evidex.functions.authority import classify_authority
from evidex.operators import grade as g
from evidex.operators import rank as r
from evidex.operators import retrieve
from evidex.operators import vectors

HIT = ("query_id bigint, id string, chunk_id string, document_id string, chunk_index bigint, text string, filename string, "
       "source_type string, start_offset bigint, end_offset bigint, score double, relevance_score double, ordinal bigint")
UUID = "3F2504E0-4F89-11D3-9A0C-0305E82C3301"


def hit(n, text="", doc="d1", start=None, end=None, score=0.5, source="legal", file="f.txt", chunk=None, query=1):
    return (query, f"p{n}", chunk or f"c{n}", doc, n, text, file, source, start, end, score, None, n)


def test_uuid_spellings(rows):
    want = UUID.lower()
    spellings = [UUID, UUID.replace("-", ""), "{" + UUID + "}", "urn:uuid:" + UUID]
    df = rows([(s,) for s in spellings], "d string")
    assert {x["v"] for x in df.select(identity.normalize_document_id("d").alias("v")).collect()} == {want}
    df = rows([(None, f"{UUID}:7"), ("", "x"), ("Doc A", None)], "d string, c string")
    got = [x["v"] for x in df.select(identity.canonical_doc_id("d", "c").alias("v")).collect()]
    assert got == [want, None, "doc a"]


def test_same_filename_does_not_merge(rows):
    df = rows([("a", "f.txt"), ("b", "f.txt")], "d string, f string").withColumn("n", F.lit(None).cast("string"))
    assert df.select(identity.resource_key("d", "n", "n")).distinct().count() == 2


@pytest.mark.parametrize("left,right,same", [
    ("same text " * 10, "SAME  text " * 10, True),
    ("short piece", "a short piece of it", True),
    ("short piece", "another thing", False),
    (" ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(66)), True),
    (" ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(90)), False),
])
def test_near_duplicates(rows, left, right, same):
    df = rows([(left, right)], "a string, b string").select(tx.passage_norm("a").alias("a"), tx.passage_norm("b").alias("b"))
    a, b = F.col("a"), F.col("b")
    assert df.select(r.near_duplicate(a, b, tx.passage_tokens(a), tx.passage_tokens(b)).alias("v")).first()["v"] is same


def test_overlapping_passages_keep_the_better(rows):
    text = "The board refused the connection and the owner went to court. " * 5
    hits = rows([hit(0, text, start=0, end=300, score=0.91), hit(1, text[20:], start=20, end=300, score=0.89),
                 hit(2, "Quite another passage about the limits of the power.", start=900, end=960, score=0.2)], HIT)
    assert sorted(x["chunk_index"] for x in r.suppress_near_duplicates(hits).collect()) == [0, 2]


def greedy(hits):
    """Brute-force form of the suppression over one list."""
    import re

    def norm(t):
        return re.sub(r"\s+", " ", t.lower()).strip()

    def dup(a, b):
        if a["start_offset"] is not None and b["start_offset"] is not None:
            shared = min(a["end_offset"], b["end_offset"]) - max(a["start_offset"], b["start_offset"])
            span = min(a["end_offset"] - a["start_offset"], b["end_offset"] - b["start_offset"])
            if shared > 0 and shared / span >= 0.55:
                return True
        x, y = norm(a["text"]), norm(b["text"])
        if x == y:
            return True
        s, t = sorted((x, y), key=len)
        if len(s) < 60:
            return s in t
        u, v = set(x.split()), set(y.split())
        return len(u & v) / len(u | v) >= (0.82 if s[:180] in t else 0.90)

    kept = []
    for h in sorted(hits, key=lambda h: (-h["score"], h["ordinal"])):
        if not any(dup(k, h) for k in kept if k["document_id"] == h["document_id"] or k["filename"] == h["filename"]):
            kept.append(h)
    return sorted(k["ordinal"] for k in kept)


def test_suppression_agrees_with_brute_force(rows):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    data = []
    for n in range(60):
        start = int(rng.integers(0, 400))
        text = " ".join(rng.choice(words, size=int(rng.integers(3, 30))))
        if n % 5 == 0 and data:
            text = data[-1][5] + " tail"
        data.append(hit(n, text, doc=f"d{n % 3}", file=f"f{n % 4}", start=start, end=start + 50, score=float(rng.integers(1, 20)) / 20))
    hits = rows(data, HIT)
    want = greedy([x.asDict() for x in hits.collect()])
    assert sorted(x["ordinal"] for x in r.suppress_near_duplicates(hits).collect()) == want


def test_selection_follows_tier_limits(rows):
    passages = ["alpha beta", "gamma delta", "epsilon zeta", "eta theta"]
    data = [hit(i, f"{passages[i % 4]} number {i} of the list", doc=f"d{i}", file=f"f{i}", score=0.9 - i / 100,
                source=["legal", "conversation", "matter", "web"][i % 4]) for i in range(24)]
    limits = rows([(1, 6, 3, 1, 1)], "query_id bigint, total_limit bigint, legal_limit bigint, conversation_limit bigint, matter_limit bigint")
    got = [(x["source_type"], x["ordinal"]) for x in r.select_evidence(rows(data, HIT), limits).orderBy("position").collect()]
    assert got == [("legal", 0), ("legal", 4), ("legal", 8), ("conversation", 1), ("matter", 2), ("web", 3)]


def test_orphan_heading_gets_its_parent(rows):
    hits = rows([(1, "SOCIAL", "orphan_heading", "P")], "query_id bigint, text string, validation_status string, parent_chunk_id string")
    index = rows([("P", "The parent text explains it.", None)], "chunk_id string, text string, chunk_text string")
    assert retrieve.expand_parents(hits, index).first()["text"] == "The parent text explains it.\n\nSOCIAL"


def test_concepts_of_a_question(value):
    got = value(g.question_concepts, "Can section 54-C prevent an injunction in a double jeopardy situation?")
    assert got == ["section 54-c", "double jeopardy", "injunction"]


def test_conflicting_texts(rows):
    hits = rows([hit(0, "Relief shall not be granted."), hit(1, "The court may grant injunction.", doc="d2")], HIT)
    assert g.evidence_conflicts(hits).first()["has_conflicts"] is True


def test_official_web_is_an_authority(rows):
    df = rows([("web", "official_web")], "source_type string, document_type string").select(
        "*", *[F.lit(None).cast("string").alias(c) for c in ("law_name", "court", "filename", "display_name")])
    assert df.select(classify_authority().alias("a")).first()["a"] == "web_official"


def test_topk_is_exact_over_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    q, c = rng.normal(size=(23, 8)), rng.normal(size=(300, 8))
    c[10] = c[11]
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, embedding array<double>")
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "chunk_id bigint, embedding array<double>").repartition(5)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    got = {(x["query_id"], x["rank"]): x["chunk_id"] for x in vectors.vector_topk(queries, chunks, 4).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(q) @ unit(c).T, vectors.SCORE_DIGITS)
    for i in range(23):
        best = sorted(range(300), key=lambda j: (-scores[i, j], j))[:4]
        assert [got[i, k + 1] for k in range(4)] == best
    assert len(got) == 23 * 4


def test_private_hits_give_way_to_the_corpus(rows):
    schema = HIT + ", title string, display_name string"
    data = [hit(0, "law of bail", source="legal") + (None, None), hit(1, "a recipe", source="matter", doc="m") + (None, None)]
    asked = rows([(1, "What is the law of bail?", True, None, False)],
                 "query_id bigint, question string, needs_authority boolean, document_id string, document_task boolean")
    kept = retrieve.suppress_unrelated_private(rows(data, schema), asked).collect()
    assert [x["source_type"] for x in kept] == ["legal"]


def test_duplicate_windows_far_apart_are_found(rows):
    text = "The same long line is said here and again further down in this very document, word for word."
    data = [("d", i, i * 1000, i * 1000 + 100, text if i in (0, 3) else f"window {i} says something else entirely here") for i in range(5)]
    chunks = rows(data + [("e", 0, 0, 100, text)], "document_id string, chunk_index int, start_offset int, end_offset int, text string")
    assert [(p["left_index"], p["right_index"], p["jaccard"]) for p in r.duplicate_pairs(chunks).collect()] == [(0, 3, 1.0)]


def test_duplicate_windows_meet_in_one_join_without_token_rows(rows):
    chunks = rows([("d", 0, 0, 10, "a b"), ("d", 1, 5, 15, "a b")], "document_id string, chunk_index int, start_offset int, end_offset int, text string")
    plan = r.duplicate_pairs(chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "Generate" not in plan


def test_invariants_find_seeded_violations(rows):
    from evidex.operators import evaluate as ev

    packed = rows([(1, "legal", 60), (1, None, 50), (1, "web", 5), (2, "matter", 9)], "query_id int, source_type string, packed_tokens bigint")
    budgets = rows([(i, 100, 10, 10, 10) for i in (1, 2)], "query_id int, legal_budget bigint, conversation_budget bigint, matter_budget bigint, web_budget bigint")
    assert [tuple(x) for x in ev.over_budget(packed, budgets).collect()] == [(1, "legal", 110, 100)]
    resources = rows([(1, "d"), (1, "d"), (1, "e"), (2, "d"), (2, None), (2, None)], "query_id int, document_id string")
    assert [tuple(x) for x in ev.split_resources(resources).collect()] == [(1, "d", 2)]
    guarded = rows([("k", False, "partial", "As held in PLD 2099 SC 999."), ("l", True, "partial", "PLD 2099 SC 999.")],
                   "conv string, document_mode boolean, grounding_status string, answer string")
    claims = rows([("k", "unsupported", "PLD 2099 SC 999"), ("l", "unsupported", "PLD 2099 SC 999")], "conv string, status string, claim string")
    assert [tuple(x) for x in ev.invented_citations(guarded, claims, ["conv"]).collect()] == [("k", "PLD 2099 SC 999")]


def test_scopes_with_the_same_keys_share_one_numbering(rows):
    from evidex.operators import retrieve as op

    docs = rows(
        [("a", "u", "matter", "m", None, 1), ("b", "u", "matter", "m", None, 2), ("a", "u", "conversation", "m", "c", 3), ("d", "u", "conversation", None, "c", 9)],
        "document_id string, user_id string, scope string, matter_id string, conversation_id string, created_at int",
    )
    scopes = rows(
        [(1, "u", "m", "c"), (2, "u", "m", "c"), (3, "u", None, "c"), (4, "v", "m", "c"), (5, "u", "m", None)],
        "scope_id int, user_id string, matter_id string, conversation_id string",
    )
    listed = op.list_for_scope(docs, scopes)
    found = sorted(listed.collect(), key=lambda x: x["position"])
    got = {s: [x["document_id"] for x in found if x["scope_id"] == s] for s in range(1, 6)}
    assert got == {1: ["a", "b", "d"], 2: ["a", "b", "d"], 3: ["d", "a"], 4: [], 5: ["b", "a"]}
    # windows number lists, not scopes
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_list" in plan and "windowspecdefinition(scope_id" not in plan


def test_resource_places_search_the_sources_once(spark, rows):
    """The sources are scanned once before their places are written, however often the cuts read those."""
    from evidex.operators import resources as l
    from evidex.plans import packing as pp

    places = l.resource_places(pp.plain_sources(spark, "/root/testdata/sf0.001"), rows([(0, "54-C")], "query_id bigint, section string"))
    plan = places._jdf.queryExecution().optimizedPlan().toString()
    assert "resource-pool" in str(places.inputFiles()) and "Generate" not in plan


def test_parity_never_rejects_a_near_duplicate(rows):
    """Token sets that reach the limit are never turned away; most that share little are."""
    base = [f"w{i}" for i in range(200)]
    sets = [(k, base, base[k:] + [f"x{i}" for i in range(k)]) for k in range(0, 200, 4)]
    df = rows(sets, "k int, a array<string>, b array<string>")
    got = df.select("k", tx.jaccard(F.col("a"), F.col("b")).alias("j"), r.may_be_near(
        r.parity(F.col("a")), r.parity(F.col("b")), F.size("a"), F.size("b")).alias("may")).collect()
    assert all(x["may"] for x in got if x["j"] >= r.NEAR_JACCARD)
    assert not any(x["may"] for x in got if x["j"] < 0.4)


def test_evidence_is_folded_once(spark):
    """Removed hits are counted in the fold: the result reads written rows, not the hits again."""
    from evidex.plans import hits as h

    final = r.remove_duplicate_evidence(h.merged_hits(spark, "/root/testdata/sf0.001"))
    assert "Generate" not in final._jdf.queryExecution().optimizedPlan().toString()


def test_packing_reads_selected_evidence_once(spark):
    from evidex.plans import packing as pp

    assert "Generate chunk" not in str(pp.selected(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan())
    assert all("selected" in f for f in pp.selected(spark, "/root/testdata/sf0.001").inputFiles())


def test_truncation_reads_the_head_only(value):
    from evidex.operators import pack as p

    text = "One two three. " + "word " * 50_000
    assert value(lambda x: p._head(x, F.lit(5).cast("bigint")), text) == "One two three. word word word"
    assert value(lambda x: p.truncate_to_tokens(x, F.lit(6).cast("bigint")), text) == "One two three."
    assert value(lambda x: p.truncate_to_tokens(x, F.lit(60).cast("bigint")), "a  b.  c ") == "a  b.  c "
