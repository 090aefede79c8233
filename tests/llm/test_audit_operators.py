"""Exact dedup, source divergence and filter interaction against plain versions and edge cases."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from evidex.llm import content_sort, divergence, filter_audit

LOWER = str.maketrans(content_sort.UPPER, content_sort.LOWER)
DOCS = "doc_id long, text string, lang string, source string"


def _docs(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def _texts(rng, n):
    """Texts with copies, a hot copy, shared openings, empties, nulls and odd characters."""
    base = ["", None, "Alpha beta", "alpha BETA", "É a", "é a", "z" * 5000, "same opening " * 40 + "x", "same opening " * 40 + "y", "a b c # d", "🤦 A\x0bB"]
    return [rng.choice(base) if rng.random() < 0.6 else " ".join(rng.choice(["Ab", "cd", "EF", "g"]) for _ in range(rng.randint(1, 90))) for _ in range(n)]


# --- exact duplicates -------------------------------------------------------------------
def _plain_copies(rows, best):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        digest, stays = hashlib.sha256(text.encode()).hexdigest(), 1
        for i in ids:
            out.append((i, keep, len(ids), i == keep and stays == 1, digest))
            stays -= i == keep
    return Counter(out)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_copies_match_plain_groups(spark, keep, monkeypatch):
    monkeypatch.setattr(content_sort, "SAMPLED", 8)
    rng = random.Random(5)
    texts = _texts(rng, 500) + ["Hot copy"] * 250
    rows = [(rng.choice([None, rng.randint(-300, 300)]) if rng.random() < 0.1 else i - 200, t) for i, t in enumerate(texts)]
    rows += rows[:40]
    found = content_sort.copies(_docs(spark, rows, "doc_id long, text string"), keep=keep).collect()
    assert Counter(tuple(r) for r in found) == _plain_copies(rows, max if keep == "largest" else min)


def test_a_hot_text_lies_in_several_ranges(spark):
    docs = _docs(spark, [(i, "HOT " * 30 if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    cuts = content_sort.splitters(docs, "text", 16)
    keys = Counter(c.rsplit(" ", 1)[0] for c in cuts)
    assert max(keys.values()) > 5
    found = content_sort.copies(docs)
    assert {(r["keep_id"], r["group_size"]) for r in found.where("group_size > 1").collect()} == {(2999, 2000)}
    assert found.where("kept").count() == 1001


def test_deduplicate_keeps_rows_and_clashing_columns(spark):
    rows = [(1, "A b", "x", 1, "r"), (2, "a B", "y", 2, "s"), (3, "c", None, 3, "t"), (3, "c", None, 3, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha string, part int, row string")
    kept = content_sort.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [rows[1], rows[2]]
    assert content_sort.deduplicate(docs.where("false")).count() == 0
    assert content_sort.copies(docs.where("false")).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


# --- divergence -------------------------------------------------------------------------
def _plain_divergence(rows, top=200):
    rows = [(t or "", la or "", s or "") for _, t, la, s in rows]
    counts, docs, groups = Counter(), Counter(), sorted({(la, s) for _, la, s in rows})
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        counts.update((lang, source, t) for t in terms)
        docs.update({(lang, t) for t in terms})
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (la, t), n in docs.items() if la == lang and n >= 3)
        sources = [s for la, s in groups if la == lang]
        v = len(kept)
        share = lambda ns: [1 + 10**9 * (n + 1) // (sum(ns) + v) for n in ns]
        own = {s: share([counts[lang, s, t] for t in kept]) for s in sources}
        whole = share([sum(counts[lang, s, t] for s in sources) for t in kept])
        for s in sources:
            pair = [(sum((p - q) ** 2 // q for p, q in zip(own[s], own[o])), o) for o in sources if o != s]
            term = [((p - q) ** 2 // q, t) for p, q, t in zip(own[s], whole, kept) if counts[lang, s, t] and p > q]
            for part, items, last in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:last]
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def _audited(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_matches_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 40)  # many blocks and merges
    monkeypatch.setattr(divergence, "FAN", 2)
    rng = random.Random(2)
    pool = ["a", "B", "c d", "É", "über", "x-y", "x_y", "z9z", "🤦", "\x00q", "é", "long " * 300]
    rows = [(i, " ".join(rng.choice(pool) + "abcdefgh"[: rng.randint(0, 4)] for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "hot", "hot", None])) for i in range(300)]
    rows += rows[:20] + [(None, None, None, None), (5, "", "fr", "s1"), (6, "one two", "fr", "s2"), (7, None, "solo", "only")]
    docs = _docs(spark, rows).selectExpr("*", "'x' AS term", "1 AS block", "2 AS value", "3 AS n")
    assert _audited(divergence.audit(docs)) == _plain_divergence(rows)


def test_divergence_ranks_to_the_top(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 300)
    monkeypatch.setattr(divergence, "TOP", 7)
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{chr(97 + int(rng.expovariate(0.15)) % 26)}{chr(97 + int(rng.expovariate(0.4)) % 26)}" for _ in range(60)), "en", f"s{i % 3}") for i in range(120)]
    assert _audited(divergence.audit(_docs(spark, rows))) == _plain_divergence(rows, 7)


def test_divergence_of_nothing(spark):
    assert divergence.audit(_docs(spark, [(1, "x", "en", "s")]).where("false")).count() == 0
    assert divergence.audit(_docs(spark, [(1, None, "en", "s")])).count() == 0


def test_skyband_against_all_pairs():
    rng = np.random.default_rng(1)
    for k in (1, 3, 10):
        high, low, name = rng.integers(0, 9, 300), rng.integers(0, 9, 300), rng.permutation(300)
        before = (high[:, None] >= high) & (low[:, None] <= low) & (name[:, None] < name)
        want = np.flatnonzero(before.sum(0) < k)
        assert sorted(divergence.skyband(high, low, name, k)) == want.tolist()


def test_proportions_are_exact():
    counts, whole = [0, 1, 7, 10**12, 8 * 10**15], [1, 3, 10**9 + 7, 3 * 10**12, 9 * 10**15]
    got = divergence.proportions(np.array(counts), np.array(whole))
    assert got.tolist() == [1 + 10**9 * (c + 1) // w for c, w in zip(counts, whole)]


# --- filters ----------------------------------------------------------------------------
def _plain_filters(rows, labels):
    good, toxic = ({d for d, q, t in labels if (q, t)[i] == 1 and d is not None} for i in range(2))
    least = {}
    for doc_id, text, _, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    docs = []
    for doc_id, text, _, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {n for n, bad in {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": doc_id is not None and doc_id > least[t],
        }.items() if bad}
        docs.append((source or "", failed, doc_id in good, doc_id in toxic))
    out = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        removed = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                removed[f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), f])
        for row in out:
            if row[0] == part:
                row[-1] = removed[row[1][row[2] - 1]]
    return sorted(map(tuple, out))


COUNTS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filters_match_a_plain_walk(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD", 2_000)
    monkeypatch.setattr(filter_audit, "RANGE", 30)
    rng = random.Random(4)
    pool = ["Ab", "cd", "EF", "g", "#", "ü", "🤦", "h\x1ci", "j\x85k", "l m"]
    texts = [" \t".join(rng.choice(pool) + rng.choice("abcdefghij" * 3 + "\x0b") for _ in range(rng.choice([0, 3, 49, 50, 51, 120]))) for _ in range(150)]
    texts += [None, "", " ", "\n", "word " * 20_000, *texts[:50], *["hot copy"] * 60]
    rows = [(None if rng.random() < 0.03 else i, t, "en", rng.choice(["s1", "hot", "hot", None, ""])) for i, t in enumerate(texts)]
    rows += rows[:20]
    labels = [(rng.randint(0, 250), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(150)] + [(None, 1, 1)]
    docs = _docs(spark, rows).selectExpr("*", "1 AS failed", "'x' AS first", "2 AS shard", "0 AS good", "'q' AS part")
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.select(*COUNTS).collect()) == _plain_filters(rows, labels)


def test_filters_of_no_documents(spark):
    empty = _docs(spark, [(1, "x", "en", "s")]).where("false")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, labels).count() == 0
    alone = filter_audit.audit(_docs(spark, [(1, None, "en", None)]), labels.where("false"))
    assert alone.count() == 600 and alone.selectExpr("sum(kept) + sum(removed)").first()[0] is not None


def test_matrix_numbers_words_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD", 60)
    monkeypatch.setattr(filter_audit, "RANGE", 2)
    texts = ["a b a", "b c", "", "d a", "e " * 40] * 4
    shards = filter_audit.matrix(_docs(spark, list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' AS source")).collect()
    rows = {}
    for shard in shards:
        numbers = np.array(shard["numbers"] or [], np.int64)
        bounds, columns, counts = filter_audit.rows_of(*(bytes(shard[c]) for c in ("bounds", "columns", "counts")), numbers)
        for i, doc in enumerate(shard["docs"]):
            rows[doc] = {int(c): int(n) for c, n in zip(columns[bounds[i] : bounds[i + 1]], counts[bounds[i] : bounds[i + 1]])}
    assert {n for r in rows.values() for n in r} == set(range(5))
    names = {}
    for doc, text in enumerate(texts):
        assert sorted(rows[doc].values()) == sorted(Counter(text.split()).values())
        if len(rows[doc]) == 1:
            names.setdefault(text.split()[0], set()).update(rows[doc])
    assert names == {"e": next(iter(names.values()))} and len(names["e"]) == 1
