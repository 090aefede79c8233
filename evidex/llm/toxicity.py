"""Toxicity from subword vectors: misspellings share character n-grams with what was seen.

Character n-grams only, lower case, learned together with a linear softmax over their average
(:mod:`evidex.llm.subword`).  A word said again at once counts once.

Defined results: a null or empty text gets the share of toxic labels as its score; a table
without labels of both classes gives every document that share (half if there are none);
repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from evidex.llm import subword
from evidex.llm.common import unused

SPEC = subword.Spec(shortest=3, longest=5, words=False, lower=True, dim=8, epochs=10, rate=0.5)
THRESHOLD = 0.3


def fit(docs: DataFrame, labels: DataFrame, learn: Column, spec: subword.Spec = SPEC) -> tuple[np.ndarray, float]:
    return subword.fit(docs, labels, "toxic", learn, spec)


def score(docs: DataFrame, model: tuple[np.ndarray, float], spec: subword.Spec = SPEC) -> DataFrame:
    return subword.score(docs, model, spec)


def reject(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5, spec: subword.Spec = SPEC) -> DataFrame:
    """The documents whose score stays under ``threshold``, with their own columns."""
    into = unused(docs, "_toxic")
    scored = subword.score(docs, model, spec, into=into)
    return scored.where(scored[into] < threshold).select(*docs.columns)
