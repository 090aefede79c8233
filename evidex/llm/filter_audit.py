"""Audit of five filters in every order, from a sparse document-term matrix.

The filters look at whole texts: A too few words, B too few distinct words, C too many capitals,
D forbidden characters, E a copy of a text with a smaller doc_id.

* **Local shards.** Tasks cut Arrow batches into shards of at most ``SHARD`` bytes of text.  A
  shard holds its documents' rows in CSR form over its own words, and their marks for C, D and E.
  Its words stand in the order of their hashes.
* **Dictionary.** Hash ranges of about ``RANGE`` entries gather their words from all shards, a
  list from each; a word's global number is its rank in its range on top of the sizes of the
  ranges before.  A word is one entry for each shard, however often it is said.
* **Matrix.** Every shard meets the global numbers of its words and becomes CSR over the whole
  dictionary.  A row's sum is the document's words, its nonzero count the distinct ones.
* **Marks.** The least doc_id of each text, by digest, meets the rows of that digest and doc_id;
  the others are copies.  Keys are pairs, so a text said by a third of the rows is no hot key.
* **Orders.** Documents become counts by part and set of failed filters, 32 at most a part.  From
  these follow all 120 orders.

Defined results: null texts count as empty and empty texts as copies of each other; a null source
is the part ''; a document without doc_id is no copy, and none of it has labels; of repeated rows
each counts, and they are no copies of each other; of several labels of a document one is enough;
an empty table gives no rows; long texts are read whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.llm.common import staged
from evidex.llm.term_counts import content, counted, slices, words

FILTERS = "ABCDE"
A, B, C, D, E = (1 << i for i in range(5))
MIN_WORDS = 50
DISTINCT = 65  # percent of the words
CAPITALS = 5  # percent of the code points
FORBIDDEN = re.compile(rb"[#$%&*|]")
SHARD = 4_000_000  # bytes of text
RANGE = 500_000  # entries of a hash range of words, about
_CAPITALS = bytes(range(65, 91))
_TRAIL = bytes(range(0x80, 0xC0))  # bytes inside a UTF-8 character

_SHARD = (
    "docs array<bigint>, sources array<string>, texts array<binary>, marks binary, bounds binary, columns binary, counts binary, "
    "words array<string>, hashes binary"
)


def _packed(values: np.ndarray) -> bytes:
    """Numbers of 32 bits byte by byte: all lowest bytes, then the next; small numbers compress well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _steps_of(columns: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The columns of each row as steps from the one before."""
    steps = np.diff(columns, prepend=0)
    first = bounds[:-1][np.diff(bounds) > 0]
    steps[first] = columns[first]
    return steps


def _columns_of(steps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(steps))
    return sums[1:] - np.repeat(sums[bounds[:-1]], np.diff(bounds))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in slices(batch.column("text"), SHARD):
            n = len(texts)
            bounds, data = content(texts)
            marks, digests = np.zeros(n, np.uint8), []
            for i, (a, b) in enumerate(itertools.pairwise(bounds.tolist())):
                text = data[a:b]
                capitals = len(text) - len(text.translate(None, _CAPITALS))
                points = len(text.translate(None, _TRAIL))
                marks[i] = C * (100 * capitals > CAPITALS * points) | D * bool(FORBIDDEN.search(text))
                digests.append(hashlib.sha256(text).digest())
            rows, codes, names = words(bounds, data)
            hashes = np.fromiter(map(zlib.crc32, names.cast(pa.large_binary()).to_pylist()), np.uint32, len(names))
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(names), np.int64)
            place[order] = np.arange(len(names))
            rows, cols, times = counted(rows, place[codes], len(names))
            row_bounds = np.searchsorted(rows, np.arange(n + 1))
            lists = [(batch.column("doc_id").slice(start, n), pa.int64()), (batch.column("source").slice(start, n), pa.string()), (pa.array(digests, pa.binary()), pa.binary()), (names.take(pa.array(order)), pa.string())]
            docs, sources, digests, entries = (pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(t)) for x, t in lists)
            blobs = (marks.tobytes(), _packed(row_bounds), _packed(_steps_of(cols, row_bounds)), _packed(times), hashes[order].tobytes())
            marks, row_bounds, cols, times, hashes = (pa.array([x], pa.binary()) for x in blobs)
            yield pa.RecordBatch.from_arrays(
                [docs, sources, digests, marks, row_bounds, cols, times, entries, hashes],
                ["docs", "sources", "texts", "marks", "bounds", "columns", "counts", "words", "hashes"],
            )


def local_shards(documents: DataFrame, text: str = "text") -> DataFrame:
    """CSR shards over their own words, numbered."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    return staged(rows.mapInArrow(_shards, _SHARD).withColumn("shard", F.monotonically_increasing_id()), "shards")


def _cells(ranges: int):
    """Splits the words of a shard by hash range."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                hashes = np.frombuffer(batch.column("hashes")[i].as_py(), np.uint32).astype(np.uint64)
                owner = ((hashes * np.uint64(ranges)) >> np.uint64(32)).astype(np.int32)
                held, starts = np.unique(owner, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(owner)), pa.int32()), batch.column("words")[i].values)
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("shard")[i], len(held)), pa.array(held), lists], ["shard", "range", "words"])

    return split


_RANKS = "shard bigint, range int, size int, ranks array<int>"


def _ranks(cells: pa.Table) -> pa.Table:
    """The rank of every word among those of its range, by UTF-8; shards keep their lists."""
    lists = cells.column("words").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int32)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank), dtype=np.int32)
    ranks = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy())), pa.int32()), pa.array(rank[coded.indices.to_numpy()]))
    size = pa.repeat(pa.scalar(len(rank), pa.int32()), len(cells))
    return pa.table({"shard": cells.column("shard"), "range": cells.column("range"), "size": size, "ranks": ranks})


def dictionary(shards: DataFrame) -> DataFrame:
    """(``shard``, ``numbers``): the global numbers, from 0 and without gaps, of each shard's words in their order."""
    entries = shards.agg(F.sum(F.size("words"))).first()[0] or 0
    ranges = min(1 << 30, entries // RANGE + 1)
    cells = shards.select("shard", "words", "hashes").mapInArrow(_cells(ranges), "shard bigint, range int, words array<string>")
    ranks = staged(cells.groupBy("range").applyInArrow(_ranks, _RANKS), "ranks")
    before = F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = ranks.groupBy("range").agg(F.max("size").cast("bigint").alias("size"))
    offsets = sizes.select("range", F.coalesce(before, F.lit(0)).alias("offset"))
    lists = ranks.join(offsets, "range").groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("range", "offset", "ranks"))).alias("lists"))
    number = lambda part: F.transform(part["ranks"], lambda r: part["offset"] + r)
    return lists.select("shard", F.flatten(F.transform("lists", number)).alias("numbers"))


def matrix(documents: DataFrame, text: str = "text") -> DataFrame:
    """The document-term matrix of ``documents``: CSR shards and the global ``numbers`` of their columns.

    :func:`rows_of` reads a shard.
    """
    shards = local_shards(documents, text)
    return shards.drop("words", "hashes").join(dictionary(shards), "shard", "left")


def rows_of(bounds: bytes, columns: bytes, counts: bytes, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row bounds, global columns and values of a CSR shard."""
    at = _unpacked(bounds)
    return at, numbers[_columns_of(_unpacked(columns), at)], _unpacked(counts)


_FLAGS = "doc_id bigint, source string, text binary, failed int"


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row sums and nonzero counts of CSR rows decide A and B; the marks come along."""
    for batch in batches:
        for i in range(len(batch)):
            row = lambda c: batch.column(c)[i]
            numbers = row("numbers").values
            numbers = np.zeros(0, np.int64) if numbers is None else numbers.to_numpy()
            bounds, columns, times = rows_of(*(row(c).as_py() for c in ("bounds", "columns", "counts")), numbers)
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            total = np.bincount(owner, times, len(bounds) - 1).astype(np.int64)
            # columns are global numbers: a row's different ones are its distinct words
            cells = np.sort((owner << 40) | columns)
            fresh = np.append(True, cells[1:] != cells[:-1])[: len(cells)]
            distinct = np.bincount(cells[fresh] >> 40, minlength=len(bounds) - 1)
            failed = np.frombuffer(row("marks").as_py(), np.uint8).astype(np.int32)
            failed = failed | A * (total < MIN_WORDS) | B * (100 * distinct < DISTINCT * total)
            yield pa.RecordBatch.from_arrays([row("docs").values, row("sources").values, row("texts").values, pa.array(failed.astype(np.int32))], ["doc_id", "source", "text", "failed"])


def failures(documents: DataFrame, text: str = "text") -> DataFrame:
    """(``doc_id``, ``source``, ``failed``) of every document; ``failed`` has one bit for each of ``FILTERS``."""
    columns = ["docs", "sources", "texts", "marks", "bounds", "columns", "counts", "numbers"]
    flags = staged(matrix(documents, text).select(*columns).mapInArrow(_flags, _FLAGS), "flags")
    first = flags.where("doc_id IS NOT NULL").groupBy("text").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    marked = flags.join(first, ["text", "doc_id"], "left")
    return marked.select("doc_id", "source", F.col("failed").bitwiseOR(F.when(copy, E).otherwise(0)).alias("failed"))


def _steps() -> list[dict]:
    """All orders of the filters, step by step, with the filters before."""
    steps = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for at, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            steps.append({"filter_order": "".join(order), "step": at, "bit": bit, "before": before})
            before |= bit
    return steps


def audit(documents: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """One row for every part, order of the filters and step, with its counts of documents."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = failures(documents, text).join(known, "doc_id", "left")
    count = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("bigint")
    cells = marked.groupBy(F.col("source").alias("part"), "failed").agg(F.count("*").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    rows = parts.select("part", "cells", F.inline(steps))
    bit, before = F.col("bit"), F.col("before")

    def over(value: str, which: Callable[[Column], Column], weight: Callable[[Column], Column] = lambda failed: F.lit(1)) -> Column:
        nothing = F.lit(0).cast("bigint")
        return F.aggregate("cells", nothing, lambda total, c: total + F.when(which(c["failed"]), c[value] * weight(c["failed"])).otherwise(nothing))

    has = lambda failed, mask: failed.bitwiseAND(mask) != 0
    here = lambda failed: has(failed, bit) & ~has(failed, before)
    # of a document's failing filters, each comes first in an equal share of the 120 orders
    orders_led = lambda failed: (F.lit(120) / F.greatest(F.bit_count(failed), F.lit(1))).cast("bigint")
    return rows.select(
        "part", "filter_order", "step",
        over("n", lambda f: ~has(f, before.bitwiseOR(bit))).alias("kept"),
        over("n", here).alias("removed"),
        over("n", lambda f: has(f, bit) & has(f, before)).alias("redundant"),
        over("n", lambda f: f == bit).alias("unique_fails"),
        over("good", here).alias("good_lost"),
        over("toxic", here).alias("toxic_lost"),
        over("n", lambda f: has(f, bit), orders_led).alias("shapley"),
    )
