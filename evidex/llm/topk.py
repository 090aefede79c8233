"""Exact top-k search by the threshold algorithm.

Vectors are dealt to shards of about ``SHARD`` rows.  A shard keeps, for every dimension, its
rows in order of that component.  A query reads all lists from the end its own component
favours, in steps; rows met are scored in full, and it stops when the score of an imaginary
row made of the components last read falls below its k-th best.  Each shard gives a query k
rows, and the best k of all shards are the answer.

Components are floor(1024 * x) as 64-bit integers; scores are exact as long as the sum of
products stays below 2 ** 63.

Defined results: vectors that are null, empty or hold null or non-finite components take no
part; a query meets vectors of its own length only; ties go to the smaller vec_id; rows of one
vec_id are candidates of their own, save for queries of that vec_id, whose finds are ranked
together; without candidates there are no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidex.llm.common import staged

SHARD = 16_384
BLOCK = 2_048  # queries that meet a shard together
SCALE = 1024
FOUND = "query_id bigint, vec_id bigint, score bigint"


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(``vec_id``, ``v``) with doubles, only whole finite vectors."""
    doubles = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return doubles.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def threshold_search(rows: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of a shard for one query: (ids, scores).

    ``lists[d]`` orders the rows by component ``d``, ascending.
    """
    n, used = len(rows), np.flatnonzero(query)
    up = query[used] > 0
    best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    met = ids == own
    depth, step = 0, max(16, n // 64)
    if not len(used):  # every score is zero
        order = np.sort(ids[~met])[:k]
        return order, np.zeros(len(order), np.int64)
    while depth < n:
        to = min(n, depth + step)
        read = np.concatenate([lists[used[up], n - to : n - depth].ravel(), lists[used[~up], depth:to].ravel()])
        fresh = np.zeros(n, bool)
        fresh[read] = True
        fresh &= ~met
        met |= fresh
        at = np.flatnonzero(fresh)
        pool, scores = np.concatenate([best_ids, ids[at]]), np.concatenate([best, rows[at] @ query])
        keep = _best(scores, pool, k)
        best_ids, best = pool[keep], scores[keep]
        depth, step = to, step * 2
        last = np.where(up, rows[lists[used, n - depth], used], rows[lists[used, depth - 1], used])
        if len(best) == k and best[-1] > int(last @ query[used]):
            break  # a row not met scores at most the bound; an equal score could still win by id
    return best_ids, best


def _meet(k: int):
    def run(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        rows, ids = np.stack(shard["v"].to_numpy()).astype(np.int64), shard["vec_id"].to_numpy(np.int64)
        lists = np.argsort(rows, axis=0, kind="stable").T.copy()
        out = [threshold_search(rows, ids, lists, q.astype(np.int64), int(own), k) for own, q in zip(queries["vec_id"], queries["v"])]
        return pd.DataFrame({
            "query_id": np.repeat(queries["vec_id"].to_numpy(np.int64), [len(o[0]) for o in out]),
            "vec_id": np.concatenate([o[0] for o in out]), "score": np.concatenate([o[1] for o in out]),
        })

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, column: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): the k best other rows of every query."""
    scaled = usable(vectors, column).select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE).cast("bigint")).alias("v"))
    # of equal rows no more than k can be among the best, nor change them as queries
    distinct = scaled.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    each = distinct.select("vec_id", "v", F.size("v").alias("dim"), F.explode(F.sequence(F.lit(1), "n"))).drop("col")
    table = staged(each, "vectors")
    queries = table.where(is_query)
    counts = table.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    shards, blocks = -(-counts["n"] // shard) or 1, -(-counts["q"] // block) or 1
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n, seed: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(n)).cast("int")
    left = table.select("*", part(shards, 1).alias("shard"), numbers(blocks).alias("block"))
    right = queries.select("*", part(blocks, 2).alias("block"), numbers(shards).alias("shard"))
    key = ["dim", "shard", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_meet(k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
