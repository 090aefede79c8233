"""Text quality from learned vectors of words, their character n-grams and repeated pairs.

Words as they are written (:mod:`evidex.llm.subword`); of the word pairs, the one that
carries over to unseen words is a word followed by itself, and it has a vector of its own.

Defined results: as for toxicity.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from evidex.llm import subword

SPEC = subword.Spec(shortest=2, longest=4, words=True, lower=False, repeats=True, dim=8, epochs=5, rate=0.3, per_class=1_500)
THRESHOLD = 0.5


def fit(docs: DataFrame, labels: DataFrame, learn: Column, spec: subword.Spec = SPEC) -> tuple[np.ndarray, float]:
    return subword.fit(docs, labels, "quality", learn, spec)


def score(docs: DataFrame, model: tuple[np.ndarray, float], spec: subword.Spec = SPEC) -> DataFrame:
    return subword.score(docs, model, spec)
