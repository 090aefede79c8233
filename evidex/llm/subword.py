"""Document classifiers on averaged subword vectors, trained in numpy.

A word is the average of the vectors of its features: hashed character n-grams of the word
between boundary marks, and (if asked) the hashed word itself.  A document is the average of
its words, and a linear softmax over it gives the classes.  Vectors and softmax are learned
together by stochastic gradient descent with per-feature step sizes.

Because everything after the vectors is linear, a document's score is the average of one
number per word; scoring looks words up in a cache and needs no vectors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import staged, unused, whole_text

CACHE = 300_000


@dataclass(frozen=True)
class Spec:
    """What a word's features are and how the model is fitted."""

    shortest: int = 3
    longest: int = 6
    words: bool = False  # the whole word as a feature too
    lower: bool = True
    buckets: int = 1 << 18
    dim: int = 8
    epochs: int = 8
    rate: float = 0.3
    batch: int = 16
    rare: int = 3  # features of fewer training texts keep a zero vector
    repeats: bool = False  # a repeated word counts as a feature of its own, else not at all
    per_class: int = 3_000  # labelled rows of each class at most
    seed: int = 7


_STEP = np.uint64(0x9E3779B97F4A7C15)


def features(words: list[str], spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of many words, and for each the place of its word.

    One rolling hash over all words' code points; windows that cross a word's end are left out.
    """
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), np.fromiter(map(len, marked), np.int64, len(marked)))
    ids, places, rolled = [], [], codes.copy()
    for n in range(2, spec.longest + 1):
        if len(codes) < n:
            break
        rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint64(29))) * _STEP + codes[n - 1 :]
        if n >= spec.shortest:
            inside = word[: len(rolled)] == word[n - 1 :]
            hashed = rolled[inside] * _STEP
            ids.append(((hashed ^ (hashed >> np.uint64(32))) % np.uint64(spec.buckets)).astype(np.int64))
            places.append(word[: len(rolled)][inside])
    with_word = np.ones(len(words), bool)
    if not spec.words and places:
        with_word = np.bincount(np.concatenate(places), minlength=len(words)) == 0
    whole = np.flatnonzero(with_word)
    ids.append(np.array([zlib.crc32(words[i].encode("utf-8", "surrogatepass")) % spec.buckets for i in whole], np.int64))
    places.append(whole)
    return np.concatenate(ids), np.concatenate(places)


AGAIN = "\x00again"  # stands for the word pair of a word and itself


def tokens(text: str | None, spec: Spec) -> list[str]:
    """The words of a text; a word said again at once becomes ``AGAIN``, or goes."""
    text = text or ""
    words = (text.lower() if spec.lower else text).split()
    if spec.repeats:
        return [w if w != last else AGAIN for last, w in zip(["", *words], words)]
    return [w for last, w in zip(["", *words], words) if w != last]


def _sparse(texts: list[str | None], spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, their weights (adding up to one a text) and the bounds of each text."""
    ids, weights, bounds = [], [], [0]
    for text in texts:
        words = tokens(text, spec)
        if words:
            each, said = np.unique(np.array(words, object), return_counts=True)
            every, word = features(list(each), spec)
            share = said / np.bincount(word, minlength=len(each)) / len(words)
            own, place = np.unique(every, return_inverse=True)
            ids.append(own)
            weights.append(np.bincount(place, share[word]))
        bounds.append(bounds[-1] + (len(ids[-1]) if words else 0))
    empty = np.zeros(0)
    every = np.concatenate(ids) if ids else empty.astype(np.int64)
    weight = (np.concatenate(weights) if weights else empty).astype(np.float32)
    common = np.bincount(every, minlength=spec.buckets)[every] >= spec.rare
    kept = np.concatenate([[0], np.cumsum(common)])
    return every[common], weight[common], kept[np.array(bounds)]


def train(texts: list[str | None], labels: np.ndarray, spec: Spec) -> np.ndarray:
    """One number per feature, then the intercept: the log odds of class 1 of a text is their average plus it."""
    rng = np.random.default_rng(spec.seed)
    ids, weights, bounds = _sparse(texts, spec)
    vectors = (rng.random((spec.buckets, spec.dim), np.float32) - 0.5) / spec.dim
    softmax = np.stack([-np.ones(spec.dim), np.ones(spec.dim)], 1).astype(np.float32) * rng.choice([-1, 1], (spec.dim, 1)) * 0.5
    bias = np.zeros(2, np.float32)
    vectors[np.setdiff1d(np.arange(spec.buckets), ids)] = 0
    seen_v = np.full(spec.buckets, 1e-8, np.float32)
    seen_s, seen_b = np.full(softmax.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    for _ in range(spec.epochs):
        order = rng.permutation(len(texts))
        for start in range(0, len(order), spec.batch):
            docs = order[start : start + spec.batch]
            spans = [np.arange(bounds[d], bounds[d + 1]) for d in docs]
            at = np.concatenate(spans)
            doc = np.repeat(np.arange(len(docs)), [len(s) for s in spans])
            own, place = np.unique(ids[at], return_inverse=True)
            local = np.zeros((len(docs), len(own)), np.float32)
            local[doc, place] = weights[at]  # features of a text are distinct
            rows = vectors[own]
            mean = local @ rows
            logits = mean @ softmax + bias
            odds = np.exp(logits - logits.max(1, keepdims=True))
            odds /= odds.sum(1, keepdims=True)
            odds[np.arange(len(docs)), labels[docs]] -= 1
            slope_v = local.T @ (odds @ softmax.T)
            slope_s, slope_b = mean.T @ odds / len(docs), odds.mean(0)
            seen_v[own] += (slope_v**2).mean(1)
            seen_s += slope_s**2
            seen_b += slope_b**2
            vectors[own] = rows - spec.rate * slope_v / np.sqrt(seen_v[own])[:, None]
            softmax -= spec.rate * slope_s / np.sqrt(seen_s) * 0.1
            bias -= spec.rate * slope_b / np.sqrt(seen_b) * 0.1
    side = softmax[:, 1] - softmax[:, 0]
    return np.append(vectors @ side, bias[1] - bias[0]).astype(np.float32)


class Scorer:
    """Log odds of texts; remembers what words add."""

    def __init__(self, model: np.ndarray, spec: Spec):
        self.model, self.spec, self.known = model.astype(np.float64), spec, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        known, said = self.known, [tokens(t, self.spec) for t in texts]
        fresh = sorted(set().union(*said) - known.keys()) if said else []
        if len(known) + len(fresh) > CACHE:
            known.clear()
            fresh = sorted(set().union(*said))
        if fresh:
            ids, word = features(fresh, self.spec)
            each = np.bincount(word, self.model[ids], len(fresh)) / np.bincount(word, minlength=len(fresh))
            known.update(zip(fresh, each.tolist()))
        means = [sum(map(known.__getitem__, words)) / len(words) if words else 0.0 for words in said]
        return np.array(means) + self.model[-1]


def chunks(texts: list[str | None], size: int = 1 << 20) -> Iterator[list[str | None]]:
    """Runs of texts of about ``size`` characters."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text or "")
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, spec: Spec, text: str = "text") -> tuple[np.ndarray, float]:
    """The model and the log odds that correct its intercept for how the sample was drawn.

    At most ``spec.per_class`` labelled documents of each class, by the order of a hash, are
    brought to one task, which trains; the shares of the classes are counted over all labels.
    Without labels of both classes every feature is zero and the shares alone decide.
    """
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    known = staged(known, "labels")
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    prior = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not n0 or not n1:
        return np.zeros(spec.buckets + 1, np.float32), prior
    part = lambda y: known.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(spec.per_class)
    sample = docs.select("doc_id", whole_text(text).alias("text")).join(F.broadcast(part(0).union(part(1))), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "_y"))))
        model = train([r[1] for r in rows], np.array([r[2] for r in rows], np.int64), spec) if rows else np.zeros(spec.buckets + 1, np.float32)
        drawn = sum(r[2] for r in rows)
        yield pa.RecordBatch.from_pydict({"model": pa.array([model.tobytes()], pa.binary()), "n1": [drawn], "n0": [len(rows) - drawn]})

    row = sample.repartition(1).mapInArrow(run, "model binary, n1 bigint, n0 bigint").first()
    shift = prior - float(np.log((row["n1"] + 0.5) / (row["n0"] + 0.5)))
    return np.frombuffer(row["model"], np.float32), shift


def score(docs: DataFrame, model: tuple[np.ndarray, float], spec: Spec, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of class 1; every word of every text counts."""
    weights, shift = model
    schema = docs.drop(into).withColumn(into, F.lit(0.0)).schema
    names = [f.name for f in schema.fields if f.name != into]
    body = unused(docs, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights, spec)
        for batch in batches:
            texts = batch.column(body).to_pylist()
            odds = np.concatenate([scorer(c) for c in chunks(texts)]) + shift if texts else np.zeros(0)
            probability = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(probability)], [*names, into])

    return docs.drop(into).withColumn(body, whole_text(text)).mapInArrow(run, schema)
