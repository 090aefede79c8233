"""Near-duplicate vectors by small-world graphs.

Equal vectors are one class with a count.  Classes are dealt by hash to shards of about
``SHARD`` rows; every shard builds a graph (:mod:`evidex.llm.hnsw`), and every class is
searched in every shard, in blocks of queries, with a beam of rows; a search goes on from every
row found over the threshold to that row's neighbours.  The beam of a shard comes from an audit
before the search: some queries of every block are compared with all shards, and the beam
doubles from ``EF`` until queries find ``RECALL`` of their links; a beam of a whole shard is a plain
product with all its vectors, which misses none.
That is the mean over queries, each counted once, and it must hold for every class of queries
(by the binary magnitude of their number of links), in the shard and over all shards: large
groups do not hide what pairs miss.  More queries are audited until ``LINKED`` of them have links
or ``SHARD`` or all queries were audited.  Pairs found are verified by cosine in double
precision, so a link is never wrong; it may be missed.

Graphs are written and sent in small pieces; a task puts one together and then takes its queries one
after the other, ``BLOCK`` at a time.  A block goes through a shard in steps of ``STEP`` queries, which
keep the number of links of each query and a spanning forest, not the pairs: a task holds one graph and the pairs of a
few queries, whatever the number of vectors, and large groups of copies cost a row per vector.
Components are joined over all forests.  There are as many copies of a shard's graph as there are
shards, or as make ``TASKS`` tasks, so sending graphs costs no more than sending queries.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of different lengths do not link; rows
without vec_id are left out; rows that share a vec_id are vectors of their own, one row each; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from evidex.llm import hnsw
from evidex.llm.common import staged
from evidex.llm.graph import components

SHARD = 65_536
BLOCK = 4_096
STEP = 256
SCORED = 32  # queries that are compared with all vectors of a shard at a time
PAIRS = 8_192  # pairs whose vectors are gathered at a time
PIECE = 4_096  # bytes of a graph in a row
TASKS = 64
EF = 48
RECALL = 0.99
AUDITED = 128  # queries of each block (about) that are compared with all shards at first
LINKED = 256  # audited queries with links that are enough
GRAPH = "dim int, shard int, piece int, ids binary, held binary, vectors binary, layers binary, sizes array<int>"
PARTS = ["ids", "held", "vectors", "layers"]
AUDIT = "dim int, shard int, id bigint, truth bigint, found array<bigint>"
FOUND = "a bigint, b bigint, links bigint"
AUDIT_ROWS = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("id", pa.int64()), ("truth", pa.int64()), ("found", pa.list_(pa.int64()))])
FOUND_ROWS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt(np.einsum("nd,nd->n", scaled, scaled))[:, None]


def _graph(shard: pd.DataFrame) -> pd.DataFrame:
    shard = shard.sort_values(["salt", "id"])
    exact = _unit(np.stack(shard["v"].to_numpy()))
    layers = hnsw.build(exact.astype(np.float32))
    return pd.DataFrame({
        "dim": [exact.shape[1]], "shard": [int(shard["shard"].iloc[0])],
        "ids": [shard["id"].to_numpy(np.int64).tobytes()], "held": [shard["held"].to_numpy(np.int64).tobytes()], "vectors": [exact.tobytes()],
        "layers": [b"".join(links.astype(np.int32).tobytes() for links in layers)], "sizes": [[len(links) for links in layers]],
    })


def _pieces(shard: pd.DataFrame) -> pd.DataFrame:
    """The graph of a shard in rows of about ``PIECE`` bytes."""
    graph = _graph(shard).iloc[0]
    n = -(-sum(len(graph[c]) for c in PARTS) // PIECE)
    cut = {c: [graph[c][len(graph[c]) * k // n : len(graph[c]) * (k + 1) // n] for k in range(n)] for c in PARTS}
    return pd.DataFrame({"dim": graph["dim"], "shard": graph["shard"], "piece": range(n), **cut, "sizes": [graph["sizes"]] * n})


class _Forest:
    """The least name reachable from each name by the pairs joined so far."""

    def __init__(self, *names: np.ndarray):
        self.names = np.unique(np.concatenate(names))
        self.label = np.arange(len(self.names))

    def place(self, names: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.names, names)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """``a`` and ``b`` are places; labels are always those of the least place."""
        while True:
            a, b = self.label[a], self.label[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Names that are not the least of their tree, and the least."""
        other = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.names[other], self.names[self.label[other]]


def _read(graph: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids, class sizes, unit vectors and layers of a shard."""
    ids, held = np.frombuffer(graph["ids"], np.int64), np.frombuffer(graph["held"], np.int64)
    exact = np.frombuffer(graph["vectors"], np.float64).reshape(len(ids), -1)
    flat, layers = np.frombuffer(graph["layers"], np.int32).reshape(-1, 2 * hnsw.OWN), []
    for size in graph["sizes"]:
        layers.append(flat[:size])
        flat = flat[size:]
    return ids, held, exact, layers


def _links(own: np.ndarray, wanted: np.ndarray, ids: np.ndarray, exact: np.ndarray, layers: list[np.ndarray], threshold: float,
           beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) of the links that a search with this beam finds, those of a few queries at a time."""
    rows = exact.astype(np.float32)

    def pairs(some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if beam < len(ids):
            yield from hnsw.each_over(rows, layers, some.astype(np.float32), threshold - 1e-4, beam)
            return
        for at in range(0, len(some), SCORED):
            query, row = np.nonzero(some[at : at + SCORED] @ exact.T >= threshold - 1e-9)
            yield query + at, row

    for start in range(0, len(own), STEP):
        some = wanted[start : start + STEP]
        for query, row in pairs(some):
            close = np.concatenate([
                np.einsum("pd,pd->p", some[query[i : i + PAIRS]], exact[row[i : i + PAIRS]]) >= threshold for i in range(0, len(query), PAIRS)
            ] or [np.zeros(0, bool)])
            close &= ids[row] != own[query + start]
            yield query[close] + start, row[close]


def _audit(threshold: float, recall: float, ef: int):
    """The number of links of queries in a shard, and how many each beam from ``ef`` on finds; a query is done at ``recall``."""

    def run(graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"dim": [], "shard": [], "id": [], "truth": [], "found": []}, dtype=object)
        if not len(graphs) or not len(queries):
            return none
        ids, _, exact, layers = _read(graphs.iloc[0])
        queries = queries.sort_values(["salt", "id"])
        own, wanted = queries["id"].to_numpy(np.int64), _unit(np.stack(queries["v"].to_numpy()))
        truth = np.zeros(len(own), np.int64)
        for i in range(0, len(own), SCORED):
            score = wanted[i : i + SCORED] @ exact.T
            at, row = np.nonzero(np.abs(score - threshold) < 1e-9)
            score[at, row] = np.einsum("pd,pd->p", wanted[at + i], exact[row])
            truth[i : i + SCORED] = ((score >= threshold) & (ids[None, :] != own[i : i + SCORED, None])).sum(1)
        some = np.flatnonzero(truth)
        if not len(some):
            return none
        own, wanted, truth, beam, found = own[some], wanted[some], truth[some], ef, [np.zeros(len(some), np.int64)]
        while True:
            few = np.flatnonzero(found[-1] < recall * truth)
            if not len(few):
                break
            now = found[-1].copy()
            now[few] = sum((np.bincount(query, minlength=len(few)) for query, _ in _links(own[few], wanted[few], ids, exact, layers, threshold, beam)), np.zeros(len(few), np.int64))
            found.append(np.minimum(now, truth))
            if beam >= len(ids):
                break
            beam *= 2
        found = found[1:]
        return pd.DataFrame({"dim": exact.shape[1], "shard": int(graphs["shard"].iloc[0]), "id": own, "truth": truth, "found": np.stack(found, 1).tolist()})

    return run


def _beams(audits: DataFrame, recall: float, ef: int) -> list[tuple[tuple[int, int | None], int]]:
    """By dim and shard the least beam whose recall is enough in the shard and over all shards; at None that of shards without audited links."""
    steps = audits.agg(F.max(F.size("found"))).first()[0] or 1
    each = audits.select("dim", "shard", "id", "truth", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.get("found", F.least(k, F.size("found") - 1))
    )).alias("step", "hit"))

    def enough(*keys: str) -> dict:
        queries = each.groupBy(*keys, "id", "step").agg(F.sum("truth").alias("truth"), F.sum("hit").alias("hit"))
        kinds = queries.groupBy(*keys, F.floor(F.log2("truth")).alias("kind"), "step").agg(F.avg(F.col("hit") / F.col("truth")).alias("recall"))
        worst = kinds.groupBy(*keys, "step").agg(F.min("recall").alias("recall"))
        return {tuple(r[k] for k in keys): r["step"] for r in worst.where(F.col("recall") >= recall).groupBy(*keys).agg(F.min("step").alias("step")).collect()}

    whole, own = enough("dim"), enough("dim", "shard")
    dims = {r["dim"]: r["shards"] for r in audits.groupBy("dim").agg(F.collect_set("shard").alias("shards")).collect()}
    wide = lambda d, s: ef << max(whole.get((d,), steps), own.get((d, s), steps) if s is not None else 0)
    return [((d, s), wide(d, s)) for d, held in dims.items() for s in [*held, None]]


def _search(threshold: float):
    def run(graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(graphs) or not len(queries):
            return pd.DataFrame({"a": [], "b": [], "links": []}, dtype="int64")
        ids, held, exact, layers = _read(graphs.iloc[0])
        queries = queries.sort_values(["salt", "id"])
        own, wanted = queries["id"].to_numpy(np.int64), _unit(np.stack(queries["v"].to_numpy()))
        links, forest = np.zeros(len(own), np.int64), _Forest(ids, own)
        at, place = forest.place(own), forest.place(ids)
        for query, row in _links(own, wanted, ids, exact, layers, threshold, int(graphs["beam"].iloc[0])):
            links += np.bincount(query, held[row], len(own)).astype(np.int64)
            forest.join(at[query], place[row])
        with_links = np.flatnonzero(links)
        near, least = forest.edges()
        return pd.DataFrame({
            "a": np.concatenate([own[with_links], near]), "b": np.concatenate([own[with_links], least]),
            "links": np.concatenate([links[with_links], np.zeros(len(near), np.int64)]),
        })

    return run


def _in_blocks(run, schema: pa.Schema):
    """``run`` for a graph and ``BLOCK`` queries at a time; rows come sorted by ``dim``, the pieces of a graph before its queries."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, pieces, graph, waiting = None, [], None, []

        def answers(least: int) -> Iterator[pa.RecordBatch]:
            """What there is to say about waiting queries, if they are ``least`` or more."""
            nonlocal graph, pieces, waiting
            if sum(map(len, waiting)) < least or not waiting:
                return
            if pieces:
                graph = pa.concat_tables(pieces)
                whole = {c: b"".join(graph[c].to_pylist()) for c in PARTS}
                first = {c: graph[c][0].as_py() for c in ("dim", "shard", "beam", "sizes")}
                graph, pieces = pd.DataFrame([{**first, **whole}]), []
            queries, waiting = pa.concat_tables(waiting), []
            for i in range(0, len(queries) if graph is not None else 0, BLOCK):
                some = queries.slice(i, BLOCK).combine_chunks()
                v = some["v"].combine_chunks()
                values = v.flatten().to_numpy().reshape(len(some), -1)
                found = run(graph, pd.DataFrame({"id": some["id"].to_numpy(), "salt": some["salt"].to_numpy(), "v": list(values)}))
                if len(found):
                    yield pa.RecordBatch.from_pandas(found, schema, preserve_index=False)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            kind = np.stack([table["dim"].to_numpy(), table["piece"].is_null().to_numpy().astype(np.int32)])
            starts = np.flatnonzero(np.concatenate([[True], (kind[:, 1:] != kind[:, :-1]).any(0)])) if len(table) else []
            for start, end in zip(starts, [*starts[1:], len(table)]):
                if kind[0, start] != dim:
                    yield from answers(1)
                    dim, pieces, graph, waiting = kind[0, start], [], None, []
                (waiting if kind[1, start] else pieces).append(table.slice(start, end - start))
            yield from answers(BLOCK)
        yield from answers(1)

    return each


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, column: str = "embedding", recall: float = RECALL, ef: int = EF,
                    shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(``vec_id``, ``n_links``, ``component_id``, ``kept``): one row per vector."""
    given = vectors.select(column).schema[0].dataType
    number = "float" if isinstance(getattr(given, "elementType", None), FloatType) else "double"
    named = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(column).cast(f"array<{number}>").alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = staged(named.withColumn("v", F.when(whole, F.col("v"))), "vectors")
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("held"))
    # Classes may share their least vec_id, so they are numbered; what is dealt by hash goes by the vector.
    classes = classes.select(F.monotonically_increasing_id().alias("id"), "least", "held", "v", F.size("v").alias("dim"), F.xxhash64(F.col("v").cast("array<double>")).alias("salt"))
    classes = staged(classes, "classes")
    n = classes.count()
    shards, blocks = -(-n // shard) or 1, -(-n // block) or 1
    numbers = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    part = lambda k, seed: F.pmod(F.xxhash64("salt", F.lit(seed)), F.lit(k)).cast("int")
    graphs = staged(classes.withColumn("shard", part(shards, 1)).groupBy("dim", "shard").applyInPandas(_pieces, GRAPH), "graphs")

    def together(graphs: DataFrame, queries: DataFrame, blocks: int, run, rows: pa.Schema, schema: str) -> DataFrame:
        """``run`` for every shard and every query."""
        copies = min(blocks, max(shards, -(-TASKS // shards)))
        task = (F.col("shard") * copies + F.col("block")).alias("task")
        left = graphs.select("*", numbers(copies).alias("block")).select("*", task)
        right = queries.select("id", "salt", "v", "dim", part(copies, 2).alias("block"), numbers(shards).alias("shard")).select("*", task)
        both = left.unionByName(right, allowMissingColumns=True).drop("block").repartitionById(shards * copies, "task")
        return both.sortWithinPartitions("task", "dim", F.asc_nulls_last("piece"), "salt", "id").mapInArrow(_in_blocks(run, rows), schema)

    sample = min(AUDITED, block)
    while True:
        some = classes.where(F.pmod(F.xxhash64("salt", F.lit(3)), F.lit(block)) < sample)
        audits = together(graphs.withColumn("beam", F.lit(ef)), some, -(-blocks * sample // block), _audit(threshold, recall, ef), AUDIT_ROWS, AUDIT)
        audits = staged(audits, "audits")
        if sample >= block or sample * blocks >= SHARD or audits.select("id").distinct().count() >= LINKED:
            break
        sample = min(4 * sample, block)
    beam = F.when(F.lit(False), ef)
    for (dim, at), wide in _beams(audits, recall, ef):
        beam = beam.when((F.col("dim") == dim) & (F.lit(True) if at is None else F.col("shard") == at), wide)
    found = together(graphs.withColumn("beam", beam.otherwise(ef)), classes, blocks, _search(threshold), FOUND_ROWS, FOUND)
    found = staged(found, "found")
    links = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    labels = components(found.where("a <> b").select("a", "b"))
    joined = classes.join(links, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    known = joined.select("v", "least", "held", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "id").alias("label"))
    first = known.groupBy("label").agg(F.min("least").alias("component_id"))
    out = rows.join(known.join(first, "label"), "v", "left").select(
        "vec_id", F.coalesce(F.col("links") + F.col("held") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
