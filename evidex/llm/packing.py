"""Length buckets of least padding, and batches of a token budget inside each bucket.

The global histogram of lengths goes to the driver: exact up to ``2 * FINE`` tokens, above
that ``FINE`` bins an octave, each with the longest length it holds, so it has at most
``FINE * 64`` rows whatever the corpus.  Dynamic programming over it picks the bucket
boundaries with the least padding.  A batch holds as many documents as fit the budget when
padded to the boundary; a document longer than the budget is a batch of its own.

Documents are numbered inside parts of a bucket (a part holds about ``PART`` rows) and the
counts of the parts before give the offset, so no task sorts a whole bucket.

Defined results: a null or empty text has length 0; repeated rows take a place each; ties
are ordered by a hash and doc_id; an empty table gives no rows; added columns replace
columns of the same name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidex.llm.common import staged, unused, whole_text

FINE = 128
PART = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("bigint")


def _bin(n: Column) -> Column:
    """The histogram bin: the number itself, or its leading eight bits and their place."""
    shift = F.greatest(F.length(F.bin(n)) - 8, F.lit(0))
    return (shift * 2 * FINE + F.floor(n / F.pow(F.lit(2.0), shift))).cast("bigint")


def histogram(lengths: DataFrame, length: str = "n_tokens") -> list[tuple[int, int, int]]:
    """(longest length, documents, tokens) of each bin, by length."""
    n = F.col(length)
    rows = lengths.groupBy(_bin(n).alias("b")).agg(F.max(n).alias("top"), F.count("*").alias("docs"), F.sum(n).alias("tokens"))
    return sorted((r["top"], r["docs"], r["tokens"]) for r in rows.collect())


def boundaries(bins: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """The upper lengths of at most ``buckets`` buckets with the least total padding."""
    if not bins:
        return []
    top = np.array([b[0] for b in bins], np.float64)
    docs = np.concatenate([[0], np.cumsum([b[1] for b in bins], dtype=np.float64)])
    tokens = np.concatenate([[0], np.cumsum([b[2] for b in bins], dtype=np.float64)])
    n, layers = len(bins), min(buckets, len(bins))
    best = np.full(n + 1, np.inf)
    best[0] = 0
    choice = np.zeros((layers, n + 1), np.int64)
    for layer in range(layers):
        now = np.full(n + 1, np.inf)
        for j in range(1, n + 1):
            # the last bucket holds bins i..j-1, padded to the longest of them
            cost = best[:j] + top[j - 1] * (docs[j] - docs[:j]) - (tokens[j] - tokens[:j])
            choice[layer, j] = i = int(np.argmin(cost))
            now[j] = cost[i]
        best = now
    cuts, j = [], n
    for layer in range(layers - 1, -1, -1):
        cuts.append(int(top[j - 1]))
        j = int(choice[layer, j])
    return sorted(cuts)


def pack(docs: DataFrame, budget: int = 65_536, buckets: int = 16, length: str = "n_tokens") -> DataFrame:
    """``docs`` (with a ``length`` column, not null) with ``bucket``, ``padded_tokens``, ``batch`` and ``place``.

    ``batch`` counts from 0 in each bucket, ``place`` is the row in the batch.
    """
    bins = histogram(docs, length)
    cuts = boundaries(bins, buckets)
    if not cuts:
        none = {"bucket": "int", "padded_tokens": "bigint", "batch": "bigint", "place": "int"}
        return docs.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    own = {c: unused(docs, f"_{c}") for c in ("bucket", "salt", "part", "n", "at", "before")}
    held = [sum(b[1] for b in bins if low < b[0] <= high) for low, high in zip([-1, *cuts], cuts)]
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col(own["bucket"]))
    salt = F.xxhash64("doc_id", F.col(length))
    placed = (
        docs.withColumn(own["bucket"], F.size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]), lambda c: c < F.col(length))))
        .withColumn(own["salt"], salt)
        .withColumn(own["part"], F.pmod(own["salt"], pick([-(-h // PART) or 1 for h in held])))
    )
    sizes = placed.groupBy(own["bucket"], own["part"]).agg(F.count("*").alias(own["n"]))
    before = Window.partitionBy(own["bucket"]).orderBy(own["part"]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(own["bucket"], own["part"], F.coalesce(F.sum(own["n"]).over(before), F.lit(0)).alias(own["before"]))
    inside = Window.partitionBy(own["bucket"], own["part"]).orderBy(own["salt"], "doc_id")
    row = F.col(own["before"]) + F.col(own["at"]) - 1
    per_batch = pick([max(1, budget // max(1, c)) for c in cuts])
    return (
        placed.withColumn(own["at"], F.row_number().over(inside)).join(offsets, [own["bucket"], own["part"]])
        .withColumns({
            "bucket": F.col(own["bucket"]), "padded_tokens": pick(cuts).cast("bigint"),
            "batch": F.floor(row / per_batch).cast("bigint"), "place": (row % per_batch).cast("int"),
        })
        .drop(own["bucket"], own["salt"], own["part"], own["at"], own["before"])
    )


def pack_texts(docs: DataFrame, budget: int = 65_536, buckets: int = 16, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Counts the words of whole texts once, then packs; ``keep_text`` carries the texts along."""
    counted = docs.withColumn("n_tokens", word_count(text))
    return pack(staged(counted if keep_text else counted.drop(text), "lengths"), budget, buckets)
