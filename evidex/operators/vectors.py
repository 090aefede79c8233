"""Exact cosine top-k, batched over queries (C1, C5, C6).

The corpus is scanned once per block of queries.  A block is a dense matrix of
at most ``QUERY_BLOCK`` rows shipped to the tasks; each task multiplies its
Arrow batches with it and keeps only the k best rows per query and tier, so what
is shuffled is ``tasks x queries x k`` small rows, never vectors and never
query-chunk pairs.  Larger query sets become several blocks, each its own scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERY_BLOCK = 2048
SCORE_DIGITS = 9


@dataclass
class QueryBlock:
    """One block of queries as arrays; ``attrs`` holds scope keys and limits."""

    ids: np.ndarray
    matrix: np.ndarray
    attrs: pd.DataFrame


@dataclass
class Tier:
    """A labelled slice of the corpus: which rows each query may see, and how many.

    ``mask(rows, queries)`` returns a boolean rows x queries array or None for all.
    """

    name: str
    limit: Callable[[pd.DataFrame], np.ndarray]
    mask: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray | None]
    columns: list[str] = field(default_factory=list)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _best(frame: pd.DataFrame, limits: dict) -> pd.DataFrame:
    """Best rows per query: by score, equal scores by id."""
    frame = frame.sort_values(["q", "score", "chunk_id"], ascending=[True, False, True])
    place = frame.groupby("q", sort=False).cumcount()
    return frame[place < frame["q"].map(limits)]


def _batch_candidates(scores: np.ndarray, ids: np.ndarray, limits: np.ndarray) -> pd.DataFrame:
    """Rows that can be among the best of this batch, ties at the cut included.

    Queries of one limit are cut together, along the rows of the score matrix.
    """
    cut = np.full(scores.shape[1], np.inf)
    for limit in np.unique(limits[limits > 0]):
        same = np.flatnonzero(limits == limit)
        cut[same] = np.partition(scores[:, same], len(ids) - limit, axis=0)[len(ids) - limit] if limit < len(ids) else -np.inf
    row, q = np.nonzero((scores >= cut) & (scores > -np.inf))
    return pd.DataFrame({"q": q, "chunk_id": ids[row], "score": scores[row, q]})


def _fitting(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    """Rows whose vectors have the queries' size; the others are those ``validate_vectors`` lists."""
    return batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("embedding")), size), False))


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The vectors of an Arrow batch as one matrix, without a Python object per row."""
    return batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _scan(block: QueryBlock, tiers: list[Tier]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, pd.DataFrame] = {}
        limits = {t.name: t.limit(block.attrs).astype(int) for t in tiers}
        for batch in batches:
            batch = _fitting(batch, block.matrix.shape[1])
            if not len(batch):
                continue
            scores = np.round(_unit(_matrix(batch, block.matrix.shape[1])) @ block.matrix.T, SCORE_DIGITS)
            rows = batch.select([n for n in batch.schema.names if n != "embedding"]).to_pandas()
            ids = rows["chunk_id"].to_numpy()
            for tier in tiers:
                mask = tier.mask(rows, block.attrs)
                visible = scores if mask is None else np.where(mask, scores, -np.inf)
                found = _batch_candidates(visible, ids, limits[tier.name])
                pool = [f for f in (kept.get(tier.name), found) if f is not None and len(f)]
                if pool:
                    kept[tier.name] = _best(pd.concat(pool), dict(enumerate(limits[tier.name])))
        for name, frame in kept.items():
            q = frame["q"].to_numpy(dtype=int)
            yield pa.RecordBatch.from_pandas(pd.DataFrame(
                {"query_id": block.ids[q], "tier": name, "chunk_id": frame["chunk_id"].to_numpy(),
                 "score": frame["score"].to_numpy(dtype=float), "tier_limit": limits[name][q]}
            ), preserve_index=False)

    return run


def _blocks(queries: DataFrame, attrs: list[str]) -> Iterator[QueryBlock]:
    """Query blocks of proven size: hash buckets, split until none exceeds the bound."""
    count = queries.count()
    buckets = max(1, -(-count // QUERY_BLOCK))
    bucket = F.pmod(F.xxhash64("query_id"), F.lit(buckets))
    for b in range(buckets):
        part = queries.filter(bucket == b).select("query_id", "embedding", *attrs).orderBy("query_id").toPandas()
        for at in range(0, len(part), QUERY_BLOCK):
            piece = part.iloc[at:at + QUERY_BLOCK].reset_index(drop=True)
            matrix = _unit(np.vstack(piece["embedding"].to_numpy()).astype(np.float64))
            yield QueryBlock(piece["query_id"].to_numpy(), matrix, piece[attrs])


def tiered_topk(queries: DataFrame, chunks: DataFrame, tiers: list[Tier],
                attrs: list[str] | None = None) -> DataFrame:
    """``query_id, tier, chunk_id, score, rank``: the best rows of every tier in one scan per block."""
    attrs = attrs or []
    id_type = queries.schema["query_id"].dataType.simpleString()
    chunk_type = chunks.schema["chunk_id"].dataType.simpleString()
    schema = f"query_id {id_type}, tier string, chunk_id {chunk_type}, score double, tier_limit long"
    needed = ["chunk_id", "embedding"] + sorted({c for t in tiers for c in t.columns})
    rows = chunks.filter(F.size("embedding") > 0).select(*needed)
    parts = [rows.mapInArrow(_scan(block, tiers), schema) for block in _blocks(queries, attrs)]
    if not parts:
        return rows.sparkSession.createDataFrame([], schema.replace("tier_limit long", "rank long"))
    place = F.row_number().over(
        Window.partitionBy("query_id", "tier").orderBy(F.desc("score"), F.asc("chunk_id"))
    )
    return (
        reduce(DataFrame.unionByName, parts)
        .withColumn("rank", place.cast("bigint"))
        .filter(F.col("rank") <= F.col("tier_limit"))
        .drop("tier_limit")
    )


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int, predicate=None) -> DataFrame:
    """Plain form: one tier, the same k for every query, payload filter pushed to the scan."""
    rows = chunks if predicate is None else chunks.filter(predicate)
    everything = Tier("all", lambda q: np.full(len(q), k), lambda r, q: None)
    return tiered_topk(queries, rows, [everything]).drop("tier")


# --- scope masks ---------------------------------------------------------------

def _equal(rows: pd.DataFrame, queries: pd.DataFrame, column: str) -> np.ndarray:
    """Where a row's value is a query's; values are compared as whole numbers that stand for them."""
    values = [*rows[column].to_numpy(dtype=object), *queries[column].to_numpy(dtype=object)]
    codes, _ = pd.factorize(np.array(values, dtype=object))
    left, right = codes[: len(rows)].astype(np.int32), codes[len(rows):].astype(np.int32)
    return (left[:, None] == right[None, :]) & (left >= 0)[:, None]


def _scoped(rows: pd.DataFrame, queries: pd.DataFrame, scope: str, column: str) -> np.ndarray:
    in_scope = (rows["scope"] == scope).to_numpy()
    return in_scope[:, None] & _equal(rows, queries, column)


def _owner(rows: pd.DataFrame, queries: pd.DataFrame) -> np.ndarray:
    return (rows["collection"] != "legal").to_numpy()[:, None] & _equal(rows, queries, "user_id")


SCOPE_COLUMNS = ["collection", "scope", "user_id", "matter_id", "conversation_id", "document_id", "year", "court"]
QUERY_COLUMNS = [
    "user_id", "matter_id", "conversation_id", "document_id", "year", "court",
    "legal_limit", "conversation_limit", "matter_limit", "document_limit",
]


def _legal(rows: pd.DataFrame, queries: pd.DataFrame) -> np.ndarray:
    mask = np.repeat((rows["collection"] == "legal").to_numpy()[:, None], len(queries), axis=1)
    for column in ("year", "court"):
        mask &= _equal(rows, queries, column) | pd.isna(queries[column]).to_numpy()[None, :]
    return mask


def _memory(rows: pd.DataFrame, queries: pd.DataFrame) -> np.ndarray:
    shared = np.repeat((rows["scope"] == "user").to_numpy()[:, None], len(queries), axis=1)
    shared |= _scoped(rows, queries, "matter", "matter_id")
    shared |= _scoped(rows, queries, "conversation", "conversation_id")
    return shared & _equal(rows, queries, "user_id")


def search_tiers() -> list[Tier]:
    """Corpus, own conversation, own matter, the matter's other conversations, one pinned document."""
    return [
        Tier("legal", lambda q: q["legal_limit"].to_numpy(), _legal, SCOPE_COLUMNS),
        Tier("conversation", lambda q: q["conversation_limit"].to_numpy(),
             lambda r, q: _owner(r, q) & _scoped(r, q, "conversation", "conversation_id")),
        Tier("matter", lambda q: q["matter_limit"].to_numpy(),
             lambda r, q: _owner(r, q) & _scoped(r, q, "matter", "matter_id")),
        Tier("linked",
             lambda q: np.where(q["matter_limit"] > 0, q[["conversation_limit", "matter_limit"]].max(axis=1), 0),
             lambda r, q: _owner(r, q) & _scoped(r, q, "conversation", "matter_id")),
        Tier("document", lambda q: q["document_limit"].to_numpy(),
             lambda r, q: _owner(r, q) & _equal(r, q, "document_id") & _memory(r, q)),
    ]


def tiered_search(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """All tiers of all queries; ``source_type`` follows the row's scope inside the private tiers."""
    hits = tiered_topk(queries, chunks, search_tiers(), QUERY_COLUMNS)
    source = (
        F.when(F.col("tier") == "legal", "legal").when(F.col("tier") == "matter", "matter")
        .when(F.col("tier").isin("conversation", "linked"), "conversation")
    )
    return hits.withColumn("source_type", source)


def memory_topk(queries: DataFrame, memories: DataFrame, k: int = 5) -> DataFrame:
    tier = Tier("memory", lambda q: np.full(len(q), k), _memory,
                ["scope", "user_id", "matter_id", "conversation_id"])
    attrs = ["user_id", "matter_id", "conversation_id"]
    return tiered_topk(queries, memories, [tier], attrs).drop("tier")
