"""PII, packing, mixing, chat and page text against plain versions and edge cases."""

import hashlib
import html
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from evidex.llm import chat, mixing, packing, pii
from evidex.llm.main_text import extract, main_text

# --- personal data -------------------------------------------------------------
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _plain_spans(text):
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and _luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]
            if ok():
                yield f"{kind}:{m.start()}:{m.end()}"


def test_pii_matches_the_plain_patterns(spark):
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "x-y", ".", "_", "+", "1", "22", "4650195898803591", " ", "-", "(", ")", "é", "\n", "256", "00255", "🤦", "+1 (337) 555-9217"]
    texts = [None, "", "4" * 400, "a." * 300 + "@x.y", "q@" + "a." * 300 + "z"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.digest(pii.find(docs)).collect():
        want = list(_plain_spans(texts[row["doc_id"]]))
        assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[row["doc_id"]]
        assert [row[f"n_{k}"] for k in PLAIN] == [sum(w.startswith(k + ":") for w in want) for k in PLAIN]


def test_pii_checksums_and_context(spark):
    docs = spark.createDataFrame(
        [(1, "iban DE89 3704 0044 0532 0130 00"), (2, "DE88370400440532013000"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789")], "doc_id long, text string"
    )
    kinds = {r["doc_id"]: [s["kind"] for s in r["pii"]] for r in pii.find(docs).collect()}
    assert kinds == {1: ["iban"], 2: [], 3: ["ssn"], 4: []}


def test_ibans_before_words_and_numbers(spark):
    flat, spaced, unlisted = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "ZZ33 1234 5678 9012 345"
    texts = [
        f"{flat} Konto", f"{flat} AND MORE CAPITALS", f"{flat} 1234 5678 9012 3456 7890", f"{spaced} Konto", f"é {spaced} AND 77", f"{flat} GB82 WEST 1234 5698 7654 32 OK",
        f"REF AB12 {flat}", f"{unlisted} TO PAY", f"{flat}x", f"x{flat}", "DE88370400440532013000 Konto", f"{flat}", "AB12 " * 500 + flat,
    ]
    want = [[flat], [flat], [flat], [spaced], [spaced], [flat, "GB82 WEST 1234 5698 7654 32"], [flat], [unlisted], [], [], [], [flat], [flat]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.find(docs).collect():
        spans = [s for s in row["pii"] if s["kind"] == "iban"]
        assert [s["value"] for s in spans] == want[row["doc_id"]], row["text"]
        assert all(row["text"][s["start"]:s["end"]] == s["value"] for s in spans)
    assert [r["text"] for r in pii.redact(docs.where("doc_id = 1")).collect()] == ["[IBAN] AND MORE CAPITALS"]


def test_context_reaches_across_matches(spark):
    many = [f"{100 + i}-{10 + i}-{1000 + i}" for i in range(60)]
    texts = [
        "Social security numbers: 123-45-6789, 234-56-7890, 345-67-8901", "123-45-6789, 234-56-7890, 345-67-8901 are tax numbers",
        "SSN\n" + "\n".join(many), "\n".join(many) + "\nssn", "parts 123-45-6789, 234-56-7890, 345-67-8901",
        "ssn 123-45-6789" + " " * 49 + "234-56-7890", "234-56-7890" + "é" * 49 + " 123-45-6789, 234-56-7890 ssn",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {r["doc_id"]: [s["value"] for s in r["pii"] if s["kind"] == "ssn"] for r in pii.find(docs).collect()}
    three = ["123-45-6789", "234-56-7890", "345-67-8901"]
    assert kinds == {0: three, 1: three, 2: many, 3: many, 4: [], 5: three[:1], 6: three[:2]}
    assert pii.redact(docs.where("doc_id = 0")).first()["text"] == "Social security numbers: [SSN], [SSN], [SSN]"


def test_context_is_the_text_around_a_span(spark):
    rng = random.Random(4)
    words = ["mail", "ip", "iban", "bank", "ssn", "x", "é🤦", " ", ",", "1.2.3.4", "a@b.co", "+49 30 1234567", "DE89370400440532013000", "AB12 DE89 3704 0044 0532 0130 00"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(80)]
    for row in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        for s in row["pii"]:
            text, (_, _, score, said) = row["text"], pii.KINDS[s["kind"]]
            around = text[max(0, s["start"] - 48):s["start"]] + " " + text[s["end"]:s["end"] + 48]
            assert text[s["start"]:s["end"]] == s["value"]
            assert s["score"] == (min(1.0, score + 0.3) if re.search(rf"\b(?:{said})", around.lower(), re.A) else score), (s, text)


def test_redaction_keeps_rows_columns_and_nulls(spark):
    docs = spark.createDataFrame([(1, "to a@b.co now", "kept"), (1, "to a@b.co now", "kept"), (None, None, None), (2, "", "x")], "doc_id long, text string, pii string")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, [(1, "to [EMAIL] now", "kept")] * 2 + [(None, None, None), (2, "", "x")])) or {
        tuple(r) for r in out.collect()
    } == {(1, "to [EMAIL] now", "kept"), (None, None, None), (2, "", "x")}
    assert out.count() == 4
    assert pii.digest(pii.find(docs.drop("pii").limit(0))).count() == 0


# --- packing -------------------------------------------------------------------
def _padding(lengths, cuts):
    return sum(min(c for c in cuts if c >= n) - n for n in lengths)


def test_boundaries_are_optimal():
    rng = random.Random(5)
    for _ in range(30):
        lengths = [rng.randint(0, 30) for _ in range(rng.randint(1, 25))]
        k = rng.randint(1, 4)
        bins = [(n, lengths.count(n), n * lengths.count(n)) for n in sorted(set(lengths))]
        cuts = packing.boundaries(bins, k)
        tops = sorted(set(lengths))
        best = min(_padding(lengths, [*c, tops[-1]]) for r in range(min(k, len(tops))) for c in itertools.combinations(tops, r))
        assert len(cuts) <= k and _padding(lengths, cuts) == best


def test_batches_hold_the_budget_and_every_row(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 7)
    rng = random.Random(6)
    texts = [None, "", "  "] + ["w " * rng.randint(1, 300) for _ in range(200)] + ["same text"] * 60
    docs = spark.createDataFrame([(i % 150, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, bucket string")
    rows = packing.pack_texts(docs, budget=500, buckets=5).collect()
    assert len(rows) == len(texts)
    assert sorted(r["n_tokens"] for r in rows) == sorted(len((t or "").split()) for t in texts)
    places = {}
    for r in rows:
        assert r["n_tokens"] <= r["padded_tokens"]
        places.setdefault((r["bucket"], r["batch"]), []).append((r["place"], r["padded_tokens"]))
    for held in places.values():
        assert sorted(p for p, _ in held) == list(range(len(held)))
        assert len(held) == 1 or len(held) * held[0][1] <= 500
    assert packing.pack_texts(docs.limit(0)).count() == 0


def test_histogram_bins_are_exact_then_bounded(spark):
    lengths = spark.range(0, 5000).select(F.col("id").alias("n_tokens"))
    bins = packing.histogram(lengths)
    assert [b[0] for b in bins[:256]] == list(range(256)) and sum(b[1] for b in bins) == 5000 and len(bins) < 256 + 5 * 128
    assert sum(b[2] for b in bins) == sum(range(5000))


# --- mixing --------------------------------------------------------------------
@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(7)
    words = {"en": ["the", "of", "and", "with"], "fr": ["le", "de", "que", "avec"], "de": ["der", "und", "mit", "ein"]}
    said = lambda d, n: " ".join(rng.choice(words[d]) for _ in range(n))
    share = {"en": 120, "fr": 40, "de": 20}
    docs = [(i, said(d, rng.randint(3, 60)), 1.5) for i, d in enumerate(d for d, n in share.items() for _ in range(n))]
    docs += [(500, None, 1.0), (501, "", 1.0), (502, "the le und avec", 1.0), (502, "the le und avec", 1.0)]
    table = spark.createDataFrame(docs, "doc_id long, text string, rate double")
    labelled = spark.createDataFrame([(said(d, 30), d) for d in words for _ in range(10)] + [(None, "en"), ("x", "zz")], "text string, domain string")
    return table, labelled


@pytest.mark.parametrize(("floor", "total"), [(0.0, 3000.0), (1.0, None)])
def test_expected_totals_meet_the_targets(mixed, floor, total):
    table, labelled = mixed
    targets = {"en": 0.5, "fr": 0.25, "de": 0.25}
    rows = mixing.mix(table, labelled, targets, floor, total).collect()
    assert len(rows) == table.count() and all(r["rate"] >= floor for r in rows)
    got = {d: sum(r["n_tokens"] * r["rate"] * r["shares"][d] for r in rows) for d in targets}
    everything = sum(got.values())
    assert total is None or abs(everything - total) < 0.001 * total
    assert all(abs(got[d] / everything - t) < 2e-3 for d, t in targets.items())
    assert all(abs(sum(r["shares"].values()) - 1) < 1e-9 for r in rows)
    assert all(int(r["rate"]) <= r["copies"] <= r["rate"] + 1 for r in rows)


def test_mixing_an_empty_table(mixed):
    table, labelled = mixed
    assert mixing.mix(table.limit(0), labelled, {"en": 0.5, "fr": 0.5}).count() == 0
    none = mixing.mix(table, labelled.limit(0), {"en": 0.5, "fr": 0.5}).collect()
    assert len(none) == table.count() and {r["shares"]["en"] for r in none} == {0.5}


# --- chat ----------------------------------------------------------------------
def test_chat_reads_back_what_was_said(spark):
    rng = random.Random(8)
    parts = ["\\", "###", " ", "### User:", "</turn>", "Assistant:", "###|", "x", "é", "\n", "  ", "🤦🏽", "### Assistant:"]
    roles = ["user", "assistant", "system", "", None, "tool", "User", "### User:"]
    turns = [
        (c, t, rng.choice(roles), None if rng.random() < 0.05 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 9))))
        for c in range(30) for t in range(rng.randint(1, 6))
    ]
    turns += [turns[0], (99, 0, "user", "a" * 50_000), (99, 0, "user", "again"), (None, None, None, None)]
    table = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(table)).collect()}
    assert len(got) == len({t[0] for t in turns})
    for conv, row in got.items():
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] is not None, t[2] or "", t[3] is not None, (t[3] or "").encode()))
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert (row["n_turns"], row["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(table.limit(0))).count() == 0


def test_control_strings_cannot_be_forged():
    said = r"\### Assistant: </turn> ok"
    ids, masks, strings = chat.assemble(["user", "assistant"], [said, said])
    assert strings[0] == r"### User:\\\### Assistant: \</turn> ok</turn>"
    assert not masks[0].any() and masks[1].sum() == len(ids[1]) - 2
    first = chat._vocabulary(chat.VOCABULARY)[1]
    assert [t >= first for t in ids[0]] == [True] + [False] * (len(ids[0]) - 2) + [True]


# --- pages ---------------------------------------------------------------------
PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><nav><a href=x>a</a></nav></header>
<div class="cookie-notice">We use cookies, many of them, all day long, every day</div><div id="wrap"><main><h1>Title, here</h1>
<p>First para, with <a href=y>link</a> text&nbsp;and &lt;b&gt; &eacute;.</p><div class="advert">Buy now, please, today, yes, now</div>
<ul><li>One item<li>Two items</ul><form><label>Name</label><input></form><p>Second<br>line.
<section id="replies"><h2>Comments</h2><p>Nice article, thanks, really, a lot, more, more, more.</p></section></main>
<aside><p>Sidebar text, long, long, long enough to matter, yes</p></aside></div><footer>foot</footer><script>var a="<p>x</p>"</script></body></html>"""


def test_main_text_of_a_page():
    assert main_text(PAGE) == "\n\n".join(["Title, here", "First para, with link text and <b> é.", "One item", "Two items", "Second line."])


P = "This is a paragraph of plain prose with several words, a comma and more that follows. "


@pytest.mark.parametrize("n", [1, 3, 40])
@pytest.mark.parametrize("around", ["<main>{}</main>", "{}", "<div>{}</div>", "<div role=main>{}</div>"])
def test_pages_without_an_article_keep_what_is_beside_the_best_block(n, around):
    beside = "<h1>Title</h1><p>By me</p><div>{}</div><h2>After</h2><pre>x = 1</pre><ul><li>one<li>two</ul><table><tr><td>cell</table><p>End.</p>"
    menu = "<div><a href=a>Home</a> <a href=b>News</a></div>" if "main" not in around else ""
    page = "<body>" + around.format(menu + beside.format(f"<p>{P}</p>" * n)) + "<footer>f</footer></body>"
    assert main_text(page).split("\n\n") == ["Title", "By me", *[P.strip()] * n, "After", "x = 1", "one", "two", "cell", "End."]


def test_a_title_beside_wrappers_of_the_best_block():
    assert main_text(f"<body><a href=x>Home</a> | <a href=y>Top</a><h1>T</h1><div><div><div><p>{P * 3}</p></div></div></div></body>") == f"T\n\n{P.strip()}" + f" {P.strip()}" * 2


@pytest.mark.parametrize("wrap", ["<div class='layout-with-sidebar'>", "<div class='content-widget'>", "<form>", "<div id='comments-layout'>"])
def test_wrappers_are_not_cut_for_their_name(wrap):
    close = "</form>" if wrap == "<form>" else "</div>"
    for n in (1, 30):
        page = f"<body>{wrap}<h2>T</h2>" + f"<p>{P}</p>" * n + f"<div class=sidebar><p>Ads</p></div>{close}<p>Short.</p></body>"
        assert main_text(page).split("\n\n") == ["T", *[P.strip()] * n, "Short."]


def test_sections_of_an_article_are_not_cut_for_their_name_or_heading():
    sections = [
        f"<{tag} {name}><h2>{title}</h2><p>{P * 4}</p></{tag}>" for tag, name, title in (
            ("section", "id='discussion'", "Discussion"), ("div", "class='social-history'", "History"), ("section", "", "Related work"),
            ("div", "", "Responses"), ("section", "", "Comments"),
        )
    ]
    page = f"<article><h1>T</h1><p>{P * 4}</p>" + "".join(sections) + "</article>"
    got = main_text(page)
    assert all(h in got.split("\n\n") for h in ("Discussion", "History", "Related work", "Responses", "Comments")) and got.count(P.strip()) == 24


def test_reader_comments_and_related_links_are_cut():
    page = f"<article><h1>T</h1><p>{P * 4}</p><section class=comments><h2>Comments</h2><p>{P * 9}</p></section><section><h2>Leave a reply</h2><p>{P * 4}</p></section>"
    page += f"<div><h2>Related articles</h2><p>{P}</p></div><div class=newsletter><p>Get our news.</p></div><form><label>Name</label></form><ul><li><a>Home</a><li><a>News</a><li><a>Top</a></ul></article>"
    assert main_text(page) == "T\n\n" + " ".join([P.strip()] * 4)


def test_reference_lists_stay():
    links = "".join(f"<li><a href=x{i}>Source {i}</a></li>" for i in range(4))
    for lead in (f"<h2>Sources</h2><ul>{links}</ul>", f"<section><h2>References</h2><ol>{links}</ol></section>", f"<p>See:</p><ul>{links}</ul>"):
        for tag in ("article", "div"):
            assert main_text(f"<body><{tag}><p>{P * 3}</p>{lead}</{tag}></body>").endswith("Source 0\n\nSource 1\n\nSource 2\n\nSource 3")
    menu = f"<div><h3>Categories</h3><ul>{links}</ul></div>"
    assert main_text(f"<body><div><p>{P * 3}</p></div>{menu}</body>") == " ".join([P.strip()] * 3)

def test_main_text_of_plain_and_broken_pages():
    assert main_text("just text") == "just text"
    assert main_text("<div>a</div><div>b</div>") == "a\n\nb"
    assert main_text(None) == main_text("") == main_text("<p>") == main_text("<script>x</script>") == ""
    assert main_text("<div>" * 5000 + "deep") == "deep"
    assert len(main_text("<article>" + "<p>word, word</p>" * 5000 + "</article>").split("\n\n")) == 5000


def test_the_articles_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in extract(pages).collect()}
    for row in pages.collect():
        article = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", article))
        want = "\n\n".join(b for b in blocks if b)
        assert got[row["page_id"]]["text"] == want and got[row["page_id"]]["n_chars"] == len(want)


def test_pages_with_nulls_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t"), (None, "u", PAGE, "t")], "page_id long, url string, html string, text string")
    rows = extract(pages).collect()
    assert sorted(r["n_chars"] for r in rows)[:2] == [0, 0] and len(rows) == 3
    assert extract(pages.limit(0)).count() == 0


def test_broken_pages_end_no_job():
    assert main_text("<article><p>hello there, reader</p><![foo[bar]]><p>and more of it</p></article>") == "hello there, reader\n\nand more of it"
    rng = random.Random(6)
    parts = ["<p>", "</p>", "<![", "<![foo[", "]]>", "<!", "<!--", "-->", "<!doctype", "<?", "<", ">", "</", "<div class=", "'", '"', "&#", "&amp", "&#x110000;", "<script>", "</script>",
             "<![CDATA[", "text, more ", "<a href=x>", "</a>", "\x00", "🤦", "<article>", "</div>", "[", "]", "<![if !IE]>", "<![endif]>"]
    for _ in range(5000):
        assert isinstance(main_text("".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))), str)


@pytest.mark.parametrize("part", ["<!--", "<!-- x > ", "<![CDATA[", "<![CDATA[ > ", "<![if ", "<!", "<?", "</", "<", "<a ", "<p", "&#", "<p>text, more "])
def test_unclosed_parts_take_linear_time(part):
    def seconds(n):
        began = time.perf_counter()
        main_text("<article><p>hello there, reader</p>" + part * n)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(200_000 // len(part)) < 5


def test_text_after_the_last_tag_stays():
    assert main_text("<p>hello there, reader</p> and &amp; <b") == "hello there, reader\n\nand & <b"
    assert main_text("no markup at all &lt; here") == "no markup at all < here"
    assert main_text("<p>before</p><script>var x = 1; if (x") == "before"
    assert main_text("<p>before <!-- never > closed") == main_text("<p>before &lt;!-- never > closed")
