"""Every stage of the pipeline against a plain version on the smallest tables."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from evidex.llm import pii, toxicity
from evidex.llm.common import staged, work_folder

SF_DIR = "/root/testdata/sf0.001"


def _set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = {"start": docs.collect()}
    for name, stage in cp.STAGES:
        docs = staged(stage(spark, docs, SF_DIR), name)
        out[name] = docs.collect()
        out[f"{name} columns"] = docs.columns
    return out


def test_stages_keep_the_columns(steps):
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "near_duplicates", "personal_data", "mixture", "packing"]
    assert all(steps[f"{n} columns"] == ["doc_id", "text", "lang", "source", "n_chars"] for n in names[:-1])
    assert set(steps["packing columns"]) >= {"doc_id", "text", "lang", "source", "n_chars", "bucket", "batch", "place"}


def test_toxic_documents_go_and_no_others(spark, steps):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = toxicity.fit(docs, labels, labels["doc_id"].isNotNull())
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert {r["doc_id"] for r in steps["toxicity"]} == {d for d, s in scores.items() if s < cp.TOXIC}


def test_one_of_each_group_stays(steps):
    before = {r["doc_id"]: _set(r["text"]) for r in steps["toxicity"]}
    label = {d: d for d in before}
    for _ in range(len(before)):
        moved = False
        for a, x in before.items():
            for b, y in before.items():
                if a < b and x and y and label[a] != label[b] and 100 * len(x & y) >= 80 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
        if not moved:
            break
    assert sorted(r["doc_id"] for r in steps["near_duplicates"]) == sorted(set(label.values()))


def test_personal_data_is_masked(spark, steps):
    assert len(steps["personal_data"]) == len(steps["near_duplicates"])
    found = pii.digest(pii.find(spark.createDataFrame(steps["personal_data"]))).collect()
    assert sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in found) == 0
    assert all(r["n_chars"] == len(r["text"]) for r in steps["personal_data"])


def test_the_mixture_only_repeats(steps):
    before = collections.Counter(r["doc_id"] for r in steps["personal_data"])
    after = collections.Counter(r["doc_id"] for r in steps["mixture"])
    assert set(before) == set(after) and all(after[d] >= n for d, n in before.items())
    words = collections.Counter()
    for r in steps["mixture"]:
        words[r["lang"]] += len(r["text"].split())
    share = {k: n / sum(words.values()) for k, n in words.items()}
    assert all(abs(share[k] - v) < 0.12 for k, v in cp.SHARES.items())


def test_packing_places_every_row(steps):
    assert len(steps["packing"]) == len(steps["mixture"])
    assert len({(r["bucket"], r["batch"], r["place"]) for r in steps["packing"]}) == len(steps["packing"])


def test_columns_named_as_internal_ones_pass_unchanged(spark):
    names = ["_text", "_PII", "_toxic", "_rows", "_bucket", "_salt", "_part", "_n", "_at", "_before", "_row"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id < 60").withColumns({n: F.lit("mine") for n in names})
    for name, stage in cp.STAGES:
        docs = staged(stage(spark, docs, SF_DIR), name)
        assert set(names) <= set(docs.columns), name
        rows = docs.select(*names).distinct().collect()
        assert [tuple(r) for r in rows] == [("mine",) * len(names)], name


def test_a_session_without_a_shared_folder_has_one_of_its_own(spark):
    class Session:
        sparkContext = spark.sparkContext
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    assert work_folder(Session) == work_folder(Session)
