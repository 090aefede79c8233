"""Audit of how a source's words depart from its language, by dominance skybands.

Each language keeps the terms of at least ``MIN_DOCS`` of its documents.  A group (language and
source) gives a kept term p = 1 + floor(10^9 (count + 1) / (N + V)), with V kept terms and N of
their occurrences in the group; the divergence of p from a q is floor((p - q)^2 / q).

* **Counts.** Tasks tokenise Arrow batches and hand on one row for each term of a batch; one
  shuffle by language and term sums them.  A row is then a term with its sources.
* **Blocks.** The terms of a language lie in blocks of at most ``CELLS`` cells (terms times
  sources), each beside the language's sources.  A block is a matrix of counts: it adds up the
  divergence of every pair of sources and finds the skyband of every source.
* **Skyband.** Among terms with p > q, one with a higher count in the group, a lower count in the
  language and an earlier name diverges no less and ranks no later.  A term with ``TOP`` such
  terms before it is in no answer; the others are the block's skyband.  Skybands of ``FAN``
  blocks are merged in the same way, and what is left is ranked exactly.

Arithmetic is exact: the quotient is found in three steps of 1,000, for up to 9 * 10^15 words.

Defined results: null texts, languages and sources count as ''; a group without terms has its
pairs (a value of 0 if its language keeps none) and no terms; repeated rows count each; long
texts are counted whole; ties rank by UTF-8; an empty table gives no rows; other columns of the
input are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidex.llm.common import staged
from evidex.llm.term_counts import content, counted, slices, words

MIN_DOCS = 3
TOP = 200
CELLS = 2_000_000
FAN = 16
BATCH = 12_000_000  # bytes of text tokenised together
# A-Z in lower case; what is neither a letter nor outside ASCII parts the terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, term string, sources array<string>, counts array<bigint>, docs bigint"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each language and term of a run of texts, with its count in every source."""
    for batch in batches:
        lang, source = (pc.fill_null(batch.column(c).cast(pa.string()), "") for c in ("lang", "source"))
        for start, texts in slices(batch.column("text"), BATCH):
            own = [c.slice(start, len(texts)).dictionary_encode() for c in (lang, source)]
            langs, sources = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in own)
            width = len(own[1].dictionary)
            bounds, data = content(texts)
            rows, codes, names = words(bounds, data.translate(_TERMS))
            if not len(codes):
                continue
            # cells: (language, term) by source, and by document
            of_lang = langs[rows] * len(names) + codes
            heads, cols, times = counted(of_lang, sources[rows], width)
            keys, starts = np.unique(heads, return_index=True)
            doc_cells = counted(rows, codes, len(names))
            held, docs = np.unique(langs[doc_cells[0]] * len(names) + doc_cells[1], return_counts=True)
            assert len(held) == len(keys)
            lists = pa.array(np.append(starts, len(heads)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [own[0].dictionary.take(pa.array(keys // len(names))), names.take(pa.array(keys % len(names))).cast(pa.string()),
                 pa.ListArray.from_arrays(lists, own[1].dictionary.take(pa.array(cols))), pa.ListArray.from_arrays(lists, pa.array(times)), pa.array(docs)],
                ["lang", "term", "sources", "counts", "docs"],
            )


def kept_terms(documents: DataFrame, text: str = "text") -> DataFrame:
    """Kept terms: ``lang``, ``term``, ``total`` and the counts by source (``sources``, ``counts``)."""
    rows = documents.select(*[F.col(c).cast("string").alias(n) for c, n in ((text, "text"), ("lang", "lang"), ("source", "source"))])
    cells = rows.mapInArrow(_counts, _COUNTS).repartition("lang", "term")
    flat = cells.select("lang", "term", F.inline(F.arrays_zip("sources", "counts", F.transform("sources", lambda s, i: F.when(i == 0, F.col("docs")).otherwise(0)).alias("docs"))).alias("source", "n", "docs"))
    by_source = flat.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    entry = F.collect_list(F.struct("source", "n"))
    terms = by_source.groupBy("lang", "term").agg(entry.alias("entries"), F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    return terms.where(F.col("docs") >= MIN_DOCS).select("lang", "term", "total", F.col("entries.source").alias("sources"), F.col("entries.n").alias("counts"))


def group_totals(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Every (``lang``, ``source``) that occurs, with ``held`` (N), ``lang_held``, ``width`` (V), ``n_sources`` and ``blocks``."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    groups = documents.select(*named).distinct()
    held = terms.select("lang", F.inline(F.arrays_zip("sources", "counts")).alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("held"))
    by_lang = terms.groupBy("lang").agg(F.count("*").alias("width"), F.sum("total").alias("lang_held"))
    members = groups.groupBy("lang").agg(F.count("*").alias("n_sources"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    totals = groups.join(held, ["lang", "source"], "left").join(members, "lang").join(by_lang, "lang", "left")
    blocks = F.greatest(F.lit(1), F.ceil(zero("width") * F.col("n_sources") / CELLS)).cast("int").alias("blocks")
    return totals.select("lang", "source", zero("held"), zero("lang_held"), zero("width"), "n_sources", blocks)


def proportions(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / whole), exactly; ``whole`` is at most 9 * 10^15."""
    quotient, rest = np.divmod(counts + 1, whole)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1_000, whole)
        quotient = quotient * 1_000 + digits
    return quotient + 1


def skyband(high: np.ndarray, low: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Rows that fewer than ``k`` others dominate: no lower ``high``, no higher ``low``, earlier ``name``.

    Rows are visited so that who dominates comes first.  Counting the rows found so far is
    enough: of the rows that dominate one that is left out, the first k are themselves found.
    """
    order = np.lexsort((name, low, -high))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    starts = np.flatnonzero(fresh)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    order = order[place < k]  # of rows alike but for the name, the first k
    lows, names = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    found, m = [], 0
    for i, x, y in zip(order.tolist(), low[order].tolist(), name[order].tolist()):
        if m < k or np.count_nonzero((lows[:m] <= x) & (names[:m] <= y)) < k:
            lows[m], names[m] = x, y
            m += 1
            found.append(i)
    return np.array(found, np.int64)


_FOUND = "lang string, source string, block int, item string, value bigint, high bigint, low bigint"
_FOUND_TYPES = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("block", pa.int32()), ("item", pa.string()), *[(c, pa.int64()) for c in ("value", "high", "low")]]
)


def _name_order(names: pa.Array) -> np.ndarray:
    """The place of every name in UTF-8 order."""
    place = np.empty(len(names), np.int64)
    place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
    return place


def _block(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Divergence sums of all pairs of sources (``high`` null) and the skyband of each source, over one block of terms."""
    lang, block, sources = groups.column("lang")[0], groups.column("block")[0], groups.column("source").combine_chunks()
    size, width = len(sources), groups.column("width")[0].as_py()
    held, lang_held = groups.column("held").to_numpy(), groups.column("lang_held")[0].as_py()
    tall = len(terms)
    counts = np.zeros((tall, size), np.int64)
    parts = []

    def add(source: pa.Array, item: pa.Array, *numbers: np.ndarray | None) -> None:
        n = len(item)
        columns = [pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in numbers]
        parts.append(pa.Table.from_arrays([pa.repeat(lang, n), source.cast(pa.string()), pa.repeat(block, n), item.cast(pa.string()), *columns], schema=_FOUND_TYPES))

    if tall:
        lists = terms.column("sources").combine_chunks()
        row = np.repeat(np.arange(tall), np.diff(np.asarray(lists.offsets)))
        col = pc.index_in(lists.flatten(), sources).to_numpy(zero_copy_only=False).astype(np.int64)
        counts[row, col] = terms.column("counts").combine_chunks().flatten().to_numpy()
        names = terms.column("term").combine_chunks()
        order, total = _name_order(names), terms.column("total").to_numpy()
        p = proportions(counts, (held + width)[None, :])
        q = proportions(total, np.int64(lang_held + width))
    for h in range(size):
        away = (np.arange(size) != h).nonzero()[0]
        if tall:
            apart = p[:, away] - p[:, h : h + 1]
            value = (apart * apart // p[:, h : h + 1]).sum(0)
        else:
            value = np.zeros(len(away), np.int64)
        add(sources.take(pa.array(away)), pa.repeat(sources[h], len(away)), value, None, None)
        if tall:
            over = np.flatnonzero((counts[:, h] > 0) & (p[:, h] > q))
            best = over[skyband(counts[over, h], total[over], order[over], TOP)]
            apart = p[best, h] - q[best]
            add(pa.repeat(sources[h], len(best)), names.take(pa.array(best)), apart * apart // q[best], counts[best, h], total[best])
    return pa.concat_tables(parts)


def _merge(found: pa.Table) -> pa.Table:
    """The skyband of several skybands of one group."""
    high, low = (found.column(c).to_numpy() for c in ("high", "low"))
    best = skyband(high, low, _name_order(found.column("item").combine_chunks()), TOP)
    return found.take(pa.array(best)).select(_FOUND_TYPES.names)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))


def _found(documents: DataFrame, text: str) -> DataFrame:
    terms = staged(kept_terms(documents, text), "terms")
    groups = staged(group_totals(documents, terms), "groups")
    blocks = groups.select("lang", "blocks").distinct()
    left = terms.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).drop("blocks")
    right = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block"))
    return staged(both.applyInArrow(_block, _FOUND), "divergence")


def audit(documents: DataFrame, text: str = "text") -> DataFrame:
    """(``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``): every pair of sources, and the ``TOP`` terms of each."""
    found = _found(documents, text)
    pairs = found.where("high IS NULL").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    merged = found.where("high IS NOT NULL").groupBy("lang", "source", F.floor(F.col("block") / FAN)).applyInArrow(_merge, _FOUND)
    return _ranked(pairs, "pair").union(_ranked(merged, "term").where(F.col("rank") <= TOP))
