"""Documents rebuilt from windows: golden cases, plain versions of every step, whole tables."""

import random

import pytest

from evidex.operators import stitch

HEAD = "CLOG ON DISCRETION\nBy A. Writer\nThe owner ran a mill of one kilowatt and a poor person of domestic means"
TAIL = "erson of domestic means asked the board for a new line, and the board refused it in the end."
BOOK = " ".join(f"word{i} of the text" for i in range(400))
WINDOWS = [BOOK[s : s + 1200].strip() for s in range(0, len(BOOK), 1000)]


def _lists(spark, lists):
    rows = [(name, 0, i, body) for name, bodies in lists.items() for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, "document_id string, list int, place int, body string")


@pytest.fixture(scope="module")
def stitched(spark):
    lists = {
        "in order": WINDOWS,
        "reversed": WINDOWS[::-1],
        "shuffled": random.Random(1).sample(WINDOWS, len(WINDOWS)),
        "head behind": [TAIL, HEAD],
        "said twice": [*WINDOWS, *WINDOWS],
        "inside": ["one", "two", WINDOWS[0], WINDOWS[0][300:500], "wo"],
        "cut word": [WINDOWS[0] + " wor", WINDOWS[1]],
        "no overlap": ["begins small, and is the longest of all", "The lead.", "Third piece there is."],
        "ring": ["Aring one two three four five six" + "B" * 30, "B" * 30 + "seven eight nine ten" + "Aring one two three four five six"],
        "shared header": [f"{'=' * 40}\npage {i} says {'abcdefgh'[i] * 50}" for i in range(6)],
        "alone": ["x"],
    }
    return {r["document_id"]: r["text"] for r in stitch.stitched(_lists(spark, lists)).collect()}


@pytest.mark.parametrize("order", ["in order", "reversed", "shuffled", "said twice"])
def test_windows_in_any_order_give_the_book(stitched, order):
    assert stitched[order] == BOOK


def test_the_head_leads(stitched):
    text = stitched["head behind"]
    assert text.startswith("CLOG ON DISCRETION") and text.count("one kilowatt") == 1 and text.endswith("in the end.")
    assert stitched["no overlap"] == "Third piece there is.\n\nbegins small, and is the longest of all\n\nThe lead."
    assert stitched["ring"].startswith("Aring one") and stitched["ring"].count("seven") == 1


def test_contained_windows_and_cut_words_go(stitched):
    assert stitched["inside"] == WINDOWS[0] + "\n\none\n\ntwo"
    assert stitched["cut word"] == BOOK[:2200].strip()
    assert stitched["alone"] == "x"


def test_repeated_words_join_without_a_cut(spark):
    left, right = "a small beginning " + "Abcdef " * 6 + "Ab", "Abcdef " * 6 + "goes on"
    got = stitch.stitched(_lists(spark, {"d": [left, right]})).first()["text"]
    assert got == left + right[37:]


def test_a_header_on_every_window_joins_nothing(stitched):
    assert stitched["shared header"].count("=" * 40) == 6 and stitched["shared header"].count("\n\n") == 5


def _brute_overlap(left, right):
    """Longest end of ``left`` that begins ``right``; then the same without a cut word."""
    for text, cut in ((left, 0), (left[: len(left) - stitch.last_word(left)], stitch.last_word(left))):
        sizes = [n for n in range(1, min(len(text), len(right)) + 1) if text.endswith(right[:n])]
        sizes = [n for n in sizes if n >= stitch.MIN_OVERLAP or (not cut and n in (len(left), len(right)))]
        if sizes:
            return max(sizes), cut
    return 0, 0


def test_overlap_agrees_with_brute_force():
    rng = random.Random(7)
    base = "".join(rng.choice("ab ") for _ in range(400))
    for _ in range(400):
        a, b = sorted(rng.sample(range(400), 2))
        c, d = sorted(rng.sample(range(400), 2))
        left, right = base[a:b] + rng.choice(["", " yy", "x"]), base[c:d] + rng.choice(["", "x", "yy"])
        assert stitch.overlap(left, right) == _brute_overlap(left, right), (left, right)


def _plain_links(chains):
    """The rounds of mutual preference over all ends, by dictionaries."""
    links, taken_tail, taken_head = {}, set(), set()
    while True:
        groups = {}
        for c, (head, tail) in chains.items():
            if c not in taken_head:
                for n in range(stitch.MIN_OVERLAP, len(head) + 1):
                    groups.setdefault(head[:n], []).append((c, False, 0))
            if c not in taken_tail:
                for cut in {0, stitch.last_word(tail)}:
                    text = tail[: len(tail) - cut]
                    for n in range(stitch.MIN_OVERLAP, len(text) + 1):
                        groups.setdefault(text[-n:], []).append((c, True, -cut))
        ends, heads = {}, {}
        for stretch, events in groups.items():
            events.sort()
            for i, (c, is_tail, cut) in enumerate(events):
                if is_tail:
                    other = [x for x, t, _ in events[i + 1 :] if not t] or [x for x, t, _ in events if not t]
                    if other and min(other) != c:
                        ends[c] = max(ends.get(c, (0,)), (len(stretch), cut, min(other)))
                else:
                    other = [x for x, t, _ in events[:i] if t] or [x for x, t, _ in events if t]
                    if other and max(other) != c:
                        heads[c] = max(heads.get(c, (0,)), (len(stretch), max(other)))
        new = {c: (e[2], e[0], -e[1]) for c, e in ends.items() if heads.get(e[2], (0, None))[1] == c}
        if not new:
            return links
        links |= new
        taken_tail |= set(new)
        taken_head |= {n for n, _, _ in new.values()}


def _plain_stitch(bodies):
    def chained(windows):
        chains = []
        for body in windows:
            size, cut = _brute_overlap(chains[-1][-1][0], body) if chains else (0, 0)
            (chains[-1].append((body, size, cut)) if size else chains.append([(body, 0, 0)]))
        return chains

    rank = lambda b: (not (b[:1].isupper() or (b[:1] in "'\"“‘" and b[1:2].isupper())), b[:1].islower(), -len(b))
    bodies = list(dict.fromkeys(bodies))
    chains = chained(bodies)
    clean = [rank(b)[:2] for b in bodies]
    broken = len(chains) > 1 or min(clean) < clean[0]
    if broken:
        bodies = [b for b in bodies if not any(b != o and b in o for o in bodies)]
        chains = [[(b, 0, 0)] for b in bodies]
    numbered = dict(enumerate(chains, 1))
    links = _plain_links({c: (x[0][0], x[-1][0]) for c, x in numbered.items()}) if broken else {}
    before = {n: c for c, (n, _, _) in links.items()}
    roots = [c for c in numbered if c not in before]
    on_paths = set()
    for r in roots:
        while r:
            on_paths.add(r)
            r = links.get(r, (None,))[0]
    for c in sorted(numbered, key=lambda c: (rank(numbered[c][0][0]), c)):
        if c not in on_paths:  # the best beginning of a ring
            roots.append(c)
            x = c
            while x not in on_paths:
                on_paths.add(x)
                x = links[x][0]
    runs = []
    for r in roots:
        run, c = list(numbered[r]), r
        while c in links and links[c][0] != r:
            c, size, cut = links[c]
            run += [(numbered[c][0][0], size, cut), *numbered[c][1:]]
        text = "".join(b[s : len(b) - (run[i + 1][2] if i + 1 < len(run) else 0)] for i, (b, s, _) in enumerate(run))
        runs.append((min(bodies.index(b) for b, _, _ in run), text, [b for b, _, _ in run]))
    lead = min(bodies, key=lambda b: (rank(b), bodies.index(b)))
    runs.sort(key=lambda r: (lead not in r[2], r[0]))
    return "\n\n".join(r[1] for r in runs).strip()


def test_random_lists_match_the_plain_version(spark, monkeypatch):
    rng = random.Random(3)
    lists = {}
    for n in range(120):
        alphabet = rng.choice(["ab", "abcdefghijklmnop ", "Abc é", "xyz🤦"])
        base = "".join(rng.choice(alphabet) for _ in range(rng.randint(60, 400)))
        windows = []
        for _ in range(rng.randint(1, 9)):
            start = rng.randrange(len(base) - 30)
            body = base[start : start + rng.randint(5, 150)].strip() + rng.choice(["", "", " cut"])
            windows += [body] if body.strip() else []
        lists[f"d{n}"] = windows or ["x"]
    got = {r["document_id"]: r["text"] for r in stitch.stitched(_lists(spark, lists)).collect()}
    wrong = [k for k in lists if got[k] != _plain_stitch(lists[k])]
    assert not wrong, (len(wrong), lists[wrong[0]], got[wrong[0]], _plain_stitch(lists[wrong[0]]))


def test_a_long_document_needs_few_hash_rows(spark):
    """Rows of hashes follow the ends of chains, not the windows."""
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(40_000))
    windows = [text[s : s + 1200].strip() for s in range(0, len(text), 1000)]
    half = len(windows) // 2
    got = stitch.stitched(_lists(spark, {"d": windows[half:] + windows[:half]})).first()["text"]
    assert got == text


def test_whole_tables_come_back_from_shuffled_windows(spark):
    from pyspark.sql import functions as F

    from evidex.plans import ingest
    from evidex.sources import tables

    folder = "/root/testdata/sf0.001"
    chunks = ingest.chunks(spark, folder)
    mixed = chunks.select("document_id", F.lit(0).alias("list"), F.xxhash64("text").alias("place"), F.col("text").alias("body"))
    got = {r["document_id"]: r["text"] for r in stitch.stitched(mixed).collect()}
    docs = {r["document_id"]: r["text"].strip() for r in tables.docs(spark, folder).collect() if r["text"].strip()}
    assert got.keys() == docs.keys()
    differ = [k for k in docs if got[k] != docs[k]]
    periodic = [k for k in differ if len(set(docs[k].split())) < len(docs[k].split()) / 4]
    assert len(differ) <= 0.02 * len(docs) and differ == periodic
