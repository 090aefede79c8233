import random

import pytest
from pyspark.sql import functions as F

from evidex.functions.words import repair_fragmented_words
from evidex.operators import answers as a
from evidex.operators import contracts as c
from evidex.operators import logs as lg
from evidex.operators import pack as p
from evidex.operators import resources as res
from evidex.operators import web as w
from evidex.rules import answers as ra


def check(rows, text, count):
    return a.validate_citations(rows([(text, count)], "answer string, source_count int")).first()


def test_citations(rows):
    one = check(rows, "Murder is punished under Section 302 [Source 1].", 3)
    assert (one["valid"], one["unused"], one["citation_status"]) == ([1], [2, 3], "valid")
    bad = check(rows, "See [Source 99] and [Source 2].", 4)
    assert (bad["invalid"], bad["citation_status"]) == ([99], "partial")
    many = check(rows, "x [Sources 1, 2 and 3] y [Source 1, Source 4]", 4)
    assert many["valid"] == [1, 2, 3, 4]


def test_citation_repair(rows):
    df = rows([("Murder [Source 1] and fake [Source 99].", 2), ("fine [source 1]", 2)], "answer string, source_count int")
    got = [(x["answer"], x["citation_status"]) for x in a.repair_citations(df).collect()]
    assert got == [("Murder [Source 1] and fake.", "repaired"), ("fine [source 1]", "valid")]


def status(value, claim, corpus):
    return value(lambda x: a.assess_claim(x, F.lit(corpus.lower())), claim)


def test_grounding(value):
    assert status(value, "Section 302 provides punishment for murder.", "Section 302 PPC: punishment of murder") == "supported"
    assert status(value, "See PLD 2099 SC 999 for the holding.", "Section 302 PPC") == "unsupported"
    assert status(value, "Section 302 bars bail.", "Section 302 PPC") == "partial"
    assert status(value, "It is not a clog at all.", "this is a clog on discretion") == "contradicted"


def test_claims(value):
    text = 'Section 302 applies. See PLD 2011 SC 554. He wrote "an equally good remedy exists" there. The court refused it at last.'
    got = value(a.extract_claims, text)
    assert got[:3] == ["Section 302", "PLD 2011 SC 554", "an equally good remedy exists"] and got[-1] == "The court refused it at last."


def test_guard_scrubs_invented_cases(rows):
    schema = "k bigint, query_id bigint, answer string, document_mode boolean, evidence_strength string"
    answers = rows([(1, 1, "See PLD 2099 SC 999 for it.", False, "strong")], schema)
    hits = rows([(1, "Section 302 PPC", ["302"], None, None, 1)], "query_id bigint, text string, sections array<string>, law_name string, section string, ordinal bigint")
    out = a.guard_answers(answers, a.ground_claims(answers, hits, ["k"]), ["k"]).first()
    assert out["grounding_status"] == "insufficient" and ra.UNVERIFIED in out["answer"] and "PLD 2099" not in out["answer"]


def test_display_cleanup(value):
    assert value(a.clean_for_display, "The court held this [Source 1] and also noted [Source 2].") == "The court held this and also noted."
    assert value(a.clean_for_display, "It is so.\n\nSources:\n- [Source 1]\n- [Source 2]") == "It is so."


def test_word_repair(value):
    text = value(repair_fragmented_words, "A nswe r: … Close rel ati ve s of a murder victi m ha ve the right to file a petition")
    assert all(word in text for word in ("Answer", "relatives", "victim", "have", "to file a petition"))


@pytest.mark.parametrize("notice", ra.PREAMBLES)
def test_preambles(value, notice):
    assert value(a.strip_preambles, f"{notice}\n\n{notice}\n\nThe answer.\n\nMore.") == "The answer.\n\nMore."
    assert value(a.strip_preambles, "  The answer.") == "The answer."


def test_open_preamble(value):
    assert value(a.strip_preambles, ra.OPEN_PREAMBLE + " (x). Please verify.\n\nThe answer.") == "The answer."


def test_reasoning(value):
    assert value(a.strip_reasoning, "a <think>x</think>b<think>y\nz</think>c <think>open") == "a  b\nc "


def test_fragments(rows):
    parts = ["rel", "ati", "ves", "", "The", " next", "(a)", "b"]
    df = rows([(1, i, f) for i, f in enumerate(parts)], "k bigint, seq bigint, fragment string")
    assert a.join_fragments(df, ["k"]).first()["text"] == "relatives The next(a) b"


# --- contracts ------------------------------------------------------------------

def test_parse_outputs(rows):
    outputs = rows([("a", '<think>{"no": 1}</think>```json\n{"fields": [{"key": "parties", "value": "A and B"}]}\n```'),
                    ("b", 'Sure: {"term": {"value": "two years"}} as asked'), ("c", "nothing")], "doc_id string, output string")
    assert sorted((x["doc_id"], x["key"], x["value"]) for x in c.parse_outputs(outputs).collect()) == [
        ("a", "parties", "A and B"), ("b", "term", "two years")]


def test_parse_outputs_of_odd_shapes(rows):
    texts = {
        "cut": '{"fields": [{"key": "a"', "none": None, "empty": "", "brace": "a { b", "list": '[{"key": "a"}, {"key": "b"}]',
        "last": '{"fields": [{"key": " A ", "value": "1"}, 3, {"value": "no key"}, {"key": "a", "value": 2, "confidence": "0.5"}]}',
        "flat": '{"fields": "none", "x": {"key": "Y", "value": true, "confidence": "high"}, "z": null, "n": [1, "b"]}',
        "fence": '{broken ```JSON {"k": "v"} ``` {"other": 1}', "open": 'see ```json {"k": ``` but {"k": "w"}',
        "long": "{" + "x" * 100_000 + "<think>{}</think>",
    }
    got = c.parse_outputs(rows(list(texts.items()), "doc_id string, output string")).collect()
    assert sorted((x["doc_id"], x["key"], x["value"], x["confidence"]) for x in got) == [
        ("fence", "k", "v", None), ("flat", "n", '[1,"b"]', None), ("flat", "y", "True", None), ("flat", "z", None, None),
        ("last", "a", "2", 0.5), ("list", "key", "a", None),
    ]


def test_parsing_outputs_needs_no_python(rows):
    plan = c.parse_outputs(rows([("a", "{}")], "doc_id string, output string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_quotes_are_grounded(rows):
    df = rows([("laws of Pakistan",), ("governed by Delaware law",)], "q string")
    text = F.lit("this agreement is governed by the laws of pakistan.")
    assert [x["v"] for x in df.select(c.quote_in_document(F.col("q"), text).alias("v")).collect()] == [True, False]


def test_playbook(rows):
    def card(key, value, status="found"):
        return ("d", key, key, status, value, None)

    cards = rows([card("governing_law", "laws of Pakistan"), card("liability_cap", "unlimited liability"),
                  card("effective_date", None, "missing"), card("indemnity", None, "missing"), card("assignment", "may freely assign"),
                  card("dispute_resolution", "arbitration in Geneva")],
                 "doc_id string, key string, label string, status string, value string, quote string")
    got = {x["key"]: x["verdict"] for x in c.evaluate_playbook(cards).collect()}
    assert (got["governing_law"], got["liability_cap"], got["effective_date"]) == ("pass", "off_playbook", "missing")
    assert (got["indemnity"], got["assignment"], got["dispute_resolution"], got["parties"]) == ("not_applicable", "off_playbook", "fallback", "unclear")


def test_redlines_rebuild_both_texts():
    rng = random.Random(11)
    for _ in range(300):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 14))]
        b = [t for t in a if rng.random() < 0.7] + [rng.choice("xyza") for _ in range(rng.randint(0, 3))]
        cuts = list(c._merged(a, b))
        assert [t for _, old, _ in cuts for t in old] == a and [t for _, _, new in cuts for t in new] == b
        assert all(old == new for same, old, new in cuts if same) and all(x[0] != y[0] for x, y in zip(cuts, cuts[1:]))
    long = [str(i) for i in range(4000)]
    assert [x[0] for x in c._merged(long, long[:2000] + ["new"] + long[2000:])] == [True, False, True]


def test_redline(rows):
    left = "One stays.\n\nLiability is unlimited here.\n\nThree stays."
    pairs = rows([("p", left, left.replace("unlimited", "capped")), ("same", left, left.replace("One  ", "One "))],
                 "pair_id string, left_text string, right_text string")
    hunks = {x["pair_id"]: x for x in c.document_hunks(pairs).withColumn("md", c.spans_to_markdown("spans")).collect()}
    assert len(hunks) == 2 and "unlimited" in hunks["p"]["left"] and "capped" in hunks["p"]["right"]
    assert hunks["p"]["md"] == "Liability is ~~unlimited~~**capped** here."
    assert {x["pair_id"]: x["unchanged"] for x in c.unchanged_pairs(pairs).collect()} == {"p": False, "same": True}


# --- tokens, resources, logs, web ------------------------------------------------------

def test_tokens_and_cost(rows, value):
    from evidex.functions import text as tx

    assert value(lambda x: tx.estimate_tokens(x, "whitespace"), "one two three") == 3
    df = rows([("gpt-4o-2024-08-06", 1_000_000, 1_000_000), ("unknown", 1, 1), ("deepseek-r1:7b", 5, 5)],
              "model string, input_tokens bigint, output_tokens bigint")
    assert [x["estimated_cost"] for x in p.cost(df).collect()] == [12.5, None, 0.0]


def test_truncation(value):
    text = "One two three. Four five six. Seven eight nine."
    cut = lambda n: value(lambda x: p.truncate_to_tokens(x, F.lit(n), "whitespace"), text)
    assert cut(9) == text and cut(7) == "One two three. Four five six." and cut(2) == "One two" and cut(0) is None


PACK = ("query_id bigint, id string, chunk_id string, document_id string, chunk_index bigint, text string, filename string, display_name string, "
        "source_type string, document_type string, law_name string, court string, start_offset bigint, end_offset bigint, score double, "
        "relevance_score double, ordinal bigint")


def test_packing_respects_budgets(rows):
    def hit(n, words, source="legal", score=0.5, doc=None):
        text = ". ".join(f"w{n} " + " ".join(f"x{n}_{i}" for i in range(4)) for _ in range(words // 5))
        return (1, f"p{n}", f"c{n}", doc or f"d{n}", n, text, f"f{n}", None, source, None, None, None, None, None, score, None, n)

    hits = rows([hit(0, 50, score=0.9), hit(1, 50, score=0.8), hit(2, 50, "matter", 0.1), hit(3, 500, score=0.01, doc="d0")], PACK)
    room = rows([(1, 70, 0, 20, 0)], "query_id bigint, legal_budget bigint, conversation_budget bigint, matter_budget bigint, web_budget bigint")
    got = {x["ordinal"]: (x["packed_tokens"], x["truncated"]) for x in p.pack_evidence(hits, room, "whitespace").collect()}
    assert got[0] == (50, False) and got[1] == (20, True) and 3 not in got
    assert sum(n for k, (n, _) in got.items() if k != 2) <= 70 and got.get(2, (0,))[0] <= 20


def test_history_compression(rows):
    talk = [(0, "user", "old words " * 30), (1, "assistant", "The bail under section 497 was refused. " * 40), (2, "user", "and now")]
    df = rows([(1, t, r, x) for t, r, x in talk], "conv_id bigint, turn bigint, role string, text string")
    budgets = rows([(1, 60, None)], "conv_id bigint, history_budget bigint, summary string")
    got = {x["turn"]: x for x in p.compress_history(df, budgets, "whitespace").collect()}
    assert set(got) == {1, 2} and got[1]["compressed"] and got[1]["content"].startswith("[compressed] ")


SOURCE = ("query_id bigint, source_id string, number bigint, document_id string, chunk_id string, chunk_index bigint, text string, excerpt string, "
          "display_name string, document_name string, filename string, source_type string, start_offset bigint, end_offset bigint, relevance double")


def test_one_document_is_one_resource(rows):
    def source(n, text, relevance, chunk=None):
        return (1, f"source-{n}", n, "d1", chunk or f"c{n}", n, text, text, None, "Doc", "f.txt", "legal", n * 1000, n * 1000 + 400, relevance)

    df = rows([source(1, "First passage about bail and its grounds.", 0.9), source(2, "Second passage about appeals in the high court.", 0.7),
               source(3, "Third one on limitation periods in civil suits.", 0.5), source(4, "First passage about bail and its grounds.", 0.9, "c1")], SOURCE)
    got = res.build_resources(df).collect()
    assert len(got) == 1 and got[0]["passages"] == 3 and got[0]["relevance_percent"] == 100
    assert "Second passage" in got[0]["excerpt"] and got[0]["excerpt"].count("First passage") == 1


def test_relevance_percent(rows):
    df = rows([(0.5,), (1.0,)], "r double")
    assert [x["v"] for x in df.select(res.relevance_percent(F.col("r"), F.lit(1.0)).alias("v")).collect()] == [50, 100]


def test_devices(rows):
    df = rows([("Mozilla (iPhone; like Mac OS X) Mobile Safari/604",), ("Chrome/1 OPR/2",), (None,)], "ua string")
    got = [tuple(x) for x in df.select(*lg.device_columns("ua").values()).collect()]
    assert got == [("mobile", "macOS", "Safari"), ("desktop", None, "Chrome"), ("unknown", None, None)]


def test_redirects_and_hosts(value):
    link = "//r.example/l/?uddg=https%3A%2F%2Fwww.supremecourt.gov.pk%2Fa%3Fb%3D1&rut=x"
    assert value(w.unwrap_redirect, link) == "https://www.supremecourt.gov.pk/a?b=1"
    assert value(w.is_official, "https://www.supremecourt.gov.pk/a") and not value(w.is_official, "https://example.com/na.gov.pk")


def test_result_page(rows):
    html = ('<a rel="n" class="result__a" href="https://a.org/1">One &amp; <b>two</b></a><a class="result__snippet" href="#">First&nbsp;text</a>'
            '<a class="result__a" href="https://a.org/1">again</a><a class="result__a" href="https://duckduckgo.com/x">own</a>'
            '<a class="result__a" href="https://b.org">B</a>')
    got = w.extract_links(rows([(1, html)], "page_id bigint, html string")).orderBy("position").collect()
    assert [(x["url"], x["title"], x["snippet"]) for x in got] == [("https://a.org/1", "One & two", "First text"), ("https://b.org", "B", "")]
    assert got[1]["score"] == pytest.approx(0.85 - 3 * 0.07)


def test_redline_reads_the_pairs_once(spark):
    from evidex.operators import contracts as c
    from evidex.plans import contracts as pc

    plan = c.document_hunks(pc.versions(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
