"""Joins, searches and classifiers against brute force, held-out labels and edge cases."""

import random
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidex.llm import embedding_dedup, hnsw, ngram_join, quality, queries, subword, topk, toxicity
from evidex.llm.graph import components


def _classes(pairs, nodes):
    """Least member reachable, by repeated merging."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


# --- components ----------------------------------------------------------------
def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (7, 8), (8, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _classes(edges, {n for e in edges for n in e})
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: want[n] for n in linked}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- n-gram join ---------------------------------------------------------------
def _set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def _corpus():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = [None, "", " \t\n", "One two", "one TWO", "one two three four five", "x " * 3000]
    for length in (6, 9, 20, 45, 64, 68, 72, 90, 150, 400):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randint(0, max(1, length // 30))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words[: len(words) - rng.randint(0, length // 10)]))
    for _ in range(60):  # documents that share a passage, no more
        own = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        at = rng.randint(0, len(own))
        texts.append(" ".join(own[:at] + passage + own[at:]))
    texts += [texts[20].upper()] * 5
    return texts


@pytest.mark.parametrize("crowd", [32, 1])
def test_join_equals_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    texts = _corpus()
    rows = [(i, t, 1.0) for i, t in enumerate(texts)] + [(3, texts[3], 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n double")
    sets = [_set(t) for t in texts]
    pairs = [
        (a, b) for a in range(len(sets)) for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    want = _classes(pairs, range(len(sets)))
    got = ngram_join.join(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_linked_sets_share_two_keys():
    rng = np.random.default_rng(4)
    for n in (5, 6, 9, 30, 51, 52, 63, 64, 65, 66, 80, 81, 82, 101, 300, 3000):
        for _ in range(40):
            base = rng.integers(0, 1 << 62, n).astype(np.uint64)
            lost = int(rng.integers(0, n // 5 + 1))
            added = int(rng.integers(0, n // 5 + 1))
            other = np.concatenate([base[lost:], rng.integers(0, 1 << 62, added).astype(np.uint64)])
            a, b = np.unique(base), np.unique(other)
            common = len(np.intersect1d(a, b))
            union = len(a) + len(b) - common
            if 100 * common >= 80 * union and common < union:
                assert len(np.intersect1d(ngram_join.signatures(a), ngram_join.signatures(b))) >= 2
                apart = np.unpackbits((ngram_join.sketch(a) ^ ngram_join.sketch(b)).view(np.uint8)).sum()
                assert apart <= union - common


def test_join_of_empty_and_null_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (9, None)], "doc_id long, text string")
    assert ngram_join.join(docs.limit(0)).count() == 0
    rows = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs).collect()}
    assert rows == {None: 4, 4: 4, 9: 9}


# --- embeddings ----------------------------------------------------------------
def _vectors(rng, clusters, size, dim=16, noise=0.05):
    centres = rng.normal(size=(clusters, dim))
    return np.concatenate([c + noise * rng.normal(size=(size, dim)) * np.linalg.norm(c) / dim**0.5 for c in centres])


def _table(spark, vectors, extra=()):
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, links long")


ODD = [
    (900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] + [1.0] * 15, 0), (904, [None] + [1.0] * 15, 0),
    (905, [float("inf")] + [1.0] * 15, 0), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0),
]


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = np.concatenate([_vectors(rng, 12, 25), rng.normal(size=(200, 16))])
    vectors = np.concatenate([vectors, vectors[:6] * 3])
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(_table(spark, vectors, [*ODD, ODD[0]]), shard=150, block=90).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    found = sum(got[i]["n_links"] for i in range(len(vectors)))
    assert found >= 0.9 * close.sum() and all(got[i]["n_links"] <= close[i].sum() for i in range(len(vectors)))
    want = _classes(list(zip(*np.nonzero(close))), range(len(vectors)))
    assert sum(got[i]["component_id"] != want[i] for i in range(len(vectors))) <= 0.02 * len(vectors)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(900, 906))
    assert got[906]["n_links"] == got[907]["n_links"] == 1 and got[907]["component_id"] == 906
    assert len(got) == len(vectors) + len(ODD)


@pytest.mark.parametrize("shard", [5000, 900])
def test_a_hot_group_does_not_hide_missed_pairs(spark, shard):
    rng = np.random.default_rng(8)
    vectors = np.concatenate([_vectors(rng, 1, 900, 32, 0.01), _vectors(rng, 300, 2, 32, 0.12), rng.normal(size=(1200, 32))])
    table = _table(spark, vectors).select("vec_id", "embedding")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(table, ef=1, shard=shard, block=600).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.95).sum(1) - 1
    recalls = [got[i] / n for i, n in enumerate(true) if n]
    pairs = [got[i] / n for i, n in enumerate(true) if 0 < n < 4]
    assert len(pairs) == 600 and np.mean(pairs) >= 0.98 and np.mean(recalls) >= 0.98


def test_equal_vectors_are_counted_without_pairs(spark):
    table = _table(spark, np.ones((500, 4)))
    rows = embedding_dedup.near_duplicates(table).collect()
    assert {(r["n_links"], r["component_id"]) for r in rows} == {(499, 0)}
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_rows_of_one_vec_id_are_vectors_of_their_own(spark):
    east, north = [1.0, 0.0], [0.0, 1.0]
    data = [(3, east), (3, north), (3, None), (5, [1.0, 0.1]), (7, [0.1, 1.0]), (7, [0.1, 1.0]), (9, [-1.0, 0.0]), (None, east)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id bigint, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == [
        (3, 0, 3, True), (3, 1, 3, True), (3, 2, 3, True), (5, 1, 3, False), (7, 2, 3, False), (7, 2, 3, False), (9, 0, 9, True)]


def _as_shard(vectors):
    """One shard's graph and its vectors as queries, as the tasks get them."""
    ids = np.arange(len(vectors))
    queries = pd.DataFrame({"id": ids, "salt": ids, "v": list(vectors), "held": 1, "shard": 0})
    return embedding_dedup._graph(queries), queries


def test_a_beam_of_the_whole_shard_finds_all_links():
    rng = np.random.default_rng(9)
    graph, queries = _as_shard(np.concatenate([_vectors(rng, 40, 5), rng.normal(size=(100, 16))]))
    graph["sizes"] = [[len(queries)]]
    graph["layers"] = [np.full((len(queries), 2 * hnsw.OWN), -1, np.int32).tobytes()]  # a graph without any link
    unit = embedding_dedup._unit(np.stack(queries["v"]))
    true = (unit @ unit.T >= 0.95).sum(1) - 1
    audit = embedding_dedup._audit(0.95, 1.0, 1)(graph, queries)
    assert all(f[-1] == t for f, t in zip(audit["found"], audit["truth"])) and len(audit) == (true > 0).sum()
    assert any(f[0] < t for f, t in zip(audit["found"], audit["truth"]))
    found = embedding_dedup._search(0.95)(graph.assign(beam=len(queries)), queries)
    same = found[found["a"] == found["b"]]
    assert dict(zip(same["a"], same["links"])) == {i: n for i, n in enumerate(true) if n}


def test_near_copies_of_a_third_of_a_shard_fit_into_memory():
    rng = np.random.default_rng(10)
    graph, queries = _as_shard(np.concatenate([_vectors(rng, 1, 20_000, 8, 0.01), rng.normal(size=(2_000, 8))]))
    tracemalloc.start()
    found = embedding_dedup._search(0.95)(graph.assign(beam=48), queries.iloc[:1024])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    links = found[found["a"] == found["b"]].set_index("a")["links"]
    assert (links >= 0.99 * 19_999).sum() >= 1_000 and peak < 1 << 31


def test_graph_finds_the_nearest_rows():
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(3000, 16)).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    layers = hnsw.build(rows)
    query, row = hnsw.pairs_over(rows, layers, rows, 0.8, 64)
    truth = int((rows @ rows.T >= 0.8).sum())
    assert 0.97 * truth <= len(query) <= truth + 5


# --- top k ---------------------------------------------------------------------
def test_top_k_is_exact(spark):
    rng = np.random.default_rng(7)
    vectors = np.round(rng.normal(size=(400, 6)), 1)
    vectors[::50] = 0
    vectors[100:130] = vectors[100]
    got = topk.top_k(_table(spark, vectors, ODD), F.col("vec_id") % 20 == 0, k=7, shard=90, block=8).collect()
    scaled = np.floor(vectors * 1024).astype(np.int64)
    want = []
    for q in range(0, 400, 20):
        scores = scaled @ scaled[q]
        order = [i for i in np.lexsort((np.arange(400), -scores)) if i != q][:7]
        want += [(q, rank + 1, int(i), int(scores[i])) for rank, i in enumerate(order)]
    assert sorted(tuple(r) for r in got if r["query_id"] < 400) == want
    assert not [r for r in got if r["query_id"] in (900,)]
    assert topk.top_k(_table(spark, vectors).limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_rows_of_one_vec_id_are_candidates_of_their_own(spark):
    data = [(0, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [2.0, 1.0]), (7, [0.5, 0.0])] + [(9, [0.25, 1.0])] * 40
    got = topk.top_k(spark.createDataFrame(data, "vec_id bigint, embedding array<float>"), F.col("vec_id") == 0, k=5, shard=10).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [
        (1, 5, 2097152), (2, 5, 1048576), (3, 7, 524288), (4, 9, 262144), (5, 9, 262144)]


def test_search_stops_before_the_end_of_the_lists():
    rows = np.arange(4000, dtype=np.int64)[:, None] * np.array([[3, 1]])
    lists = np.argsort(rows, axis=0, kind="stable").T.copy()
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, tuple) and isinstance(key[1], slice):
                read.append(key[1].stop - key[1].start)
            return super().__getitem__(key)

    ids, scores = topk.threshold_search(rows, np.arange(4000), lists.view(Counted), np.array([2, 5]), -1, 3)
    assert list(ids) == [3999, 3998, 3997] and list(scores) == [11 * i for i in (3999, 3998, 3997)]
    assert sum(read) < 4000


# --- classifiers ---------------------------------------------------------------
def test_features_are_the_windows_of_each_word():
    spec = subword.Spec(shortest=3, longest=4)
    ids, place = subword.features(["idiot", "idioot", "a"], spec)
    of = [set(ids[place == i]) for i in range(3)]
    assert len(of[0]) == 5 + 4 and len(of[2]) == 1  # <id idi dio iot ot> and four windows of four
    assert len(of[0] & of[1]) >= 5 and not of[0] & of[2]
    assert [len(x) for x in subword.features(["a"], subword.Spec(shortest=4, longest=4))] == [1, 1]


@pytest.mark.parametrize(("operator", "query", "label", "folds", "held"), [
    (toxicity, "op2_toxicity", "toxic", 4, 2), (quality, "op8_quality", "quality", 3, 1),
])
def test_held_out_accuracy(spark, operator, query, label, folds, held):
    folder = "/root/testdata/sf0.1"  # the small tables hold some forty toxic labels, too few to learn from
    rows = queries.QUERIES[query](spark, folder).collect()
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= operator.THRESHOLD) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in rows)
    out = [(r["predicted"], truth[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == t for p, t, _ in out) >= 0.9 * len(out)
    ones, zeros = [s for _, t, s in out if t == 1], [s for _, t, s in out if t == 0]
    assert np.mean([o > z for o in ones for z in zeros]) > 0.9


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_scores_of_odd_rows(spark, operator):
    label = "toxic" if operator is toxicity else "quality"
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "z " * 5000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (5, 7)], f"doc_id long, {label} int")
    model = operator.fit(docs, labels, F.lit(True))
    rows = operator.score(docs, model).collect()
    assert len(rows) == 4 and {round(r["score"], 6) for r in rows} == {0.75}
    assert operator.score(docs.limit(0), model).count() == 0
    none = operator.fit(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in operator.score(docs, none).collect()} == {0.5}


def test_misspellings_are_caught(spark):
    rng = random.Random(9)
    clean = ["river", "table", "window", "garden", "morning", "paper", "summer", "letter"]
    texts, labels = [], []
    for i in range(400):
        words = [rng.choice(clean) for _ in range(20)]
        if i % 2:
            words[rng.randrange(20)] = rng.choice(["stupid", "worthless"])
        texts.append((i, " ".join(words)))
        labels.append((i, i % 2))
    docs, table = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, table, F.lit(True))
    new = [(0, "river stuppid table garden morning paper window letter"), (1, "river summer table garden morning paper window letter")]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    assert scores[0] > 0.5 > scores[1]
    assert [r["doc_id"] for r in toxicity.reject(spark.createDataFrame(new, "doc_id long, text string"), model).collect()] == [1]


# --- the Jaccard join on large sets, hot families and rows without id -------------------------
def _plain_components(texts):
    """Least row reachable by links of whole shingle sets."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()})
    label = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_large_sets_and_near_copies_of_a_third_of_the_rows(spark):
    rng = np.random.default_rng(8)
    texts = []
    for n in (600, 1200, 3000):
        base = rng.integers(0, 10**6, n)
        for change in (0, n // 60, n // 30, n // 20, n // 12):  # from copies to families just short of a link
            words = base.copy()
            words[rng.choice(n, change, replace=False)] = rng.integers(10**6, 10**7, change)
            texts.append(" ".join(map(str, words)))
    hot = rng.integers(0, 10**6, 300)
    for _ in range(20):
        words = hot.copy()
        words[rng.choice(300, 4, replace=False)] = rng.integers(10**6, 10**7, 4)
        texts.append(" ".join(map(str, words)))
    passage = " ".join(map(str, rng.integers(0, 10**6, 60)))
    texts += [passage + " " + " ".join(map(str, rng.integers(0, 10**6, 400))) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs).collect()}
    assert [got[i] for i in range(len(texts))] == _plain_components(texts)


def test_rows_without_id_link_by_their_text(spark):
    words = [f"w{i}" for i in range(60)]
    near = [*words[:30], "other", *words[31:]]
    near = [*words[:-1], "other"]
    rows = [(None, " ".join(words)), (4, " ".join(near)), (None, "alone in the world it stands"), (9, " ".join(words[:-2] + ["x", "y"]))]
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0), r["component_id"]) for r in found if r["component_id"] is not None) == [(0, 4), (4, 4), (9, 4)]


def test_sketches_fold_to_the_level_below():
    rng = np.random.default_rng(2)
    shingles = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    whole = ngram_join.sketch(shingles)
    bits = 64 * len(whole)
    half = np.bincount((shingles & np.uint64(bits // 2 - 1)).astype(np.int64), minlength=bits // 2) & 1
    assert (whole[: len(whole) // 2] ^ whole[len(whole) // 2 :]).tolist() == np.packbits(half.astype(np.uint8)).view(np.int64).tolist()
    assert 2 * len(shingles) <= bits <= 4 * len(shingles)


def test_a_line_that_many_small_texts_hold_is_no_bucket(spark, monkeypatch):
    rng = random.Random(12)
    line = [f"line{i}" for i in range(14)]
    texts = [" ".join([f"w{rng.randrange(10**6)}" for _ in range(14)] + line) for _ in range(200)]
    texts += [t + " more" for t in texts[:20]]
    written, staged = {}, ngram_join.staged
    monkeypatch.setattr(ngram_join, "staged", lambda df, name: written.setdefault(name, staged(df, name)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs).collect()}
    assert got == {i: i - 200 if i >= 200 else i for i in range(len(texts))}
    assert max([r["count"] for r in written["open"].groupBy("key").count().collect()], default=0) < 20


@pytest.mark.parametrize("size", [5, 60])
def test_sketches_of_a_bucket_are_compared_in_parts(spark, monkeypatch, size):
    """Every pair of different labels whose sketches allow a link, once; sizes on both sides of a level."""
    rng = np.random.default_rng(13)
    monkeypatch.setattr(ngram_join, "PART", 16)
    rows, sets = [], {}
    for key in (1, 2):
        base = rng.integers(1, 1 << 62, 262).astype(np.uint64)
        for i in range(size):
            shingles = np.unique(np.concatenate([base[int(rng.integers(0, 25)):], rng.integers(1, 1 << 62, 9 * (i % 3)).astype(np.uint64)]))
            sets[key * 1000 + i] = shingles
            rows.append((key, key * 1000 + i, i // 2, len(shingles), ngram_join.sketch(shingles).tolist()))
    members = spark.createDataFrame(rows, "key long, node long, label long, n long, w array<bigint>")
    assert size == 5 or {len(r[4]) for r in rows} == {8, 16}
    got = sorted(map(tuple, ngram_join._between(members).collect()))

    def may(a, b):
        x, y = ngram_join.sketch(sets[a]), ngram_join.sketch(sets[b])
        x, y = (w[: len(w) // 2] ^ w[len(w) // 2 :] if len(w) > min(len(x), len(y)) else w for w in (x, y))
        apart, n, m = np.unpackbits((x ^ y).view(np.uint8)).sum(), len(sets[a]), len(sets[b])
        return a // 1000 == b // 1000 and a % 1000 // 2 != b % 1000 // 2 and 5 * n >= 4 * m and 5 * m >= 4 * n and 9 * apart <= n + m

    assert got == [(a, b) for a in sets for b in sets if a < b and may(a, b)] and got


def test_graphs_are_sent_in_small_rows(spark, monkeypatch):
    """No row of a shard's graph grows with the shard; float and double vectors give the same."""
    rng = np.random.default_rng(14)
    vectors = np.concatenate([_vectors(rng, 100, 4), rng.normal(size=(600, 16))]).astype(np.float32)
    written, staged = {}, embedding_dedup.staged
    monkeypatch.setattr(embedding_dedup, "staged", lambda df, name: written.setdefault(name, []).append(staged(df, name)) or written[name][-1])
    wide = _table(spark, vectors, ODD)
    got = [sorted(map(tuple, embedding_dedup.near_duplicates(t, shard=400, block=100).collect())) for t in (
        wide, wide.withColumn("embedding", F.col("embedding").cast("array<float>")))]
    assert got[0] == got[1] and sum(r[1] > 0 for r in got[0]) > 300
    sizes = [r[0] for g in written["graphs"] for r in g.select(sum(F.length(c) for c in ("ids", "held", "vectors", "layers"))).collect()]
    assert max(sizes) <= 5_000


def test_a_forest_of_pairs_that_come_in_turn():
    rng = np.random.default_rng(15)
    names = rng.permutation(500) * 7
    forest, pairs = embedding_dedup._Forest(names[:300], names[200:]), []
    for _ in range(20):
        a, b = rng.choice(names, 15), rng.choice(names, 15)
        forest.join(forest.place(a), forest.place(b))
        pairs += zip(a.tolist(), b.tolist())
    want = _classes(pairs, names.tolist())
    assert dict(zip(*(x.tolist() for x in forest.edges()))) == {k: v for k, v in want.items() if k != v}
