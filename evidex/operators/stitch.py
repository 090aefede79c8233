"""Rebuilding documents from overlapping windows (A14, A15).

The windows of a document form lists.  The text of a list comes from four steps, all joins and
windows over the rows of windows:

* **Neighbours.** A window follows the one before it in the list if the end of the one is the
  beginning of the other: the longest such stretch of ``MIN_OVERLAP`` to ``SEARCH_LIMIT`` code
  points, or all of the shorter one.  An end cut inside a word counts without that word.  A list
  whose windows all follow each other, from its best beginning on, is done: the usual case.
* **Contained windows** of the other lists go.  Sampled grams (the least hash of every stretch of
  ``MIN_OVERLAP``) index the windows; a window that lies in another has all its grams there, so
  the pairs to look at are those that share its rarest one.
* **Ends.** Rolling hashes of all beginnings and ends of their windows, one row each, meet by
  length and hash.  A window's best continuation is the longest; links are made where both sides
  prefer each other, and again until there are none.
* **Ranking.** Pointer doubling over the links gives each window its place, in rounds that grow
  with the logarithm of the longest run.  A ring opens at its best beginning.

The run with the best start leads, the others follow in list order after a blank line.  Python
sees one pair of windows, or one window, at a time; texts meet only in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions import text as tx
from evidex.operators.ingest import chunk_body, looks_like_start
from evidex.staging import staged

MIN_OVERLAP = 24
SEARCH_LIMIT = 8000
GRAM = 12  # code points of a sampled gram
DOUBLINGS = 3  # between two written tables
LIST = ["document_id", "list"]


# --- two windows -----------------------------------------------------------------------
def last_word(text: str) -> int:
    """Code points after the last white space, if they are a cut word and not the text."""
    word = len(text) - len(text.rstrip()) or len(text) - max(text.rfind(" "), text.rfind("\n"), text.rfind("\t")) - 1
    return word if 0 < word <= MIN_OVERLAP and word < len(text) else 0


def _shared(left: str, right: str) -> int:
    """Code points of the longest end of ``left`` that begins ``right``."""
    if left.endswith(right):
        return len(right)
    if right.startswith(left):
        return len(left)
    reach = min(len(left), len(right), SEARCH_LIMIT)
    tail, opening = left[len(left) - reach :], right[:MIN_OVERLAP]
    at = tail.find(opening) if reach >= MIN_OVERLAP else -1
    while at >= 0:  # the first place from which all of the tail agrees is the longest
        if right.startswith(tail[at:]):
            return len(tail) - at
        at = tail.find(opening, at + 1)
    return 0


def overlap(left: str | None, right: str) -> tuple[int, int]:
    """Code points ``right`` repeats of ``left``, and those cut from the end of ``left`` for it; (0, 0) if they do not join."""
    if left is None:
        return 0, 0
    size = _shared(left, right)
    if not size and (word := last_word(left)):
        size = _shared(left[:-word], right)
        size = size if size >= MIN_OVERLAP else 0
        return size, word if size else 0
    return size, 0


def _overlaps(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([overlap(x, y) for x, y in zip(left, right)], columns=["shared", "cut"])


def follow(windows: DataFrame) -> DataFrame:
    """``windows`` (list, ``place``, ``body``) with ``shared``, ``cut`` and ``chain``: the chains of neighbours, from 1."""
    in_list = Window.partitionBy(*LIST).orderBy("place")
    joins = F.pandas_udf(_overlaps, "shared int, cut int")
    paired = windows.withColumn("before", F.lag("body").over(in_list)).withColumn("o", joins("before", "body")).drop("before")
    flat = paired.select(*LIST, "place", "body", "o.shared", "o.cut")
    return flat.withColumn("chain", F.sum((F.col("shared") == 0).cast("int")).over(in_list))


# --- grams and rolling hashes ------------------------------------------------------------
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _sums(text: str) -> np.ndarray:
    """Hash sums of all beginnings: those of a stretch are a difference, moved back by its place."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.append(np.uint64(0), np.cumsum(_mixed(codes + np.uint64(1)) * _powers(np.uint64(_BASE), len(codes)), dtype=np.uint64))


def gram_hashes(text: str, size: int) -> np.ndarray:
    """The hash of every stretch of ``size`` code points."""
    sums = _sums(text)
    if len(sums) <= size:
        return np.zeros(0, np.uint64)
    return _mixed((sums[size:] - sums[:-size]) * _powers(_INVERSE, len(sums) - size))


def sampled_grams(text: str, lengths: list[int] | None = None) -> np.ndarray:
    """The least gram of every stretch of ``MIN_OVERLAP``; of shorter texts, and for ``lengths``, the whole stretches."""
    found = []
    if len(text) < MIN_OVERLAP:
        found.append(gram_hashes(text, len(text)))
    else:
        hashes = gram_hashes(text, GRAM)
        found.append(np.lib.stride_tricks.sliding_window_view(hashes, MIN_OVERLAP - GRAM + 1).min(1))
    for size in lengths or []:
        found.append(gram_hashes(text, size))
    return np.unique(np.concatenate(found))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, (text, lengths) in enumerate(zip(batch.column("body").to_pylist(), batch.column("lengths").to_pylist())):
            grams = sampled_grams(text, [n for n in lengths or [] if n <= len(text)]).view(np.int64)
            keys = [pa.repeat(batch.column(c)[i], len(grams)) for c in (*LIST, "place")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(grams)], [*LIST, "place", "gram"])


def contained(windows: DataFrame) -> DataFrame:
    """(list, ``place``) of the windows that lie inside another window of their list; bodies differ."""
    short = windows.where(F.length("body") < MIN_OVERLAP).groupBy(*LIST).agg(F.collect_set(F.length("body")).alias("lengths"))
    rows = windows.select(*LIST, "place", "body").join(short, LIST, "left")
    grams = staged(rows.mapInArrow(_grams, "document_id string, list int, place bigint, gram bigint"), "grams")
    often = grams.groupBy(*LIST, "gram").agg(F.count("*").alias("n"))
    rarest = grams.join(often, [*LIST, "gram"]).groupBy(*LIST, "place").agg(F.min(F.struct("n", "gram")).alias("r"))
    keys = rarest.where("r.n > 1").select(*LIST, "place", F.col("r.gram").alias("gram"))
    pairs = keys.join(grams.withColumnRenamed("place", "outer"), [*LIST, "gram"]).where("place <> outer").select(*LIST, "place", "outer")
    inner = windows.select(*LIST, "place", F.col("body").alias("inner_body"))
    outer = windows.select(*LIST, F.col("place").alias("outer"), F.col("body").alias("outer_body"))
    both = pairs.join(inner, [*LIST, "place"]).join(outer, [*LIST, "outer"])
    return both.where((F.length("inner_body") < F.length("outer_body")) & F.contains("outer_body", "inner_body")).select(*LIST, "place").distinct()


# --- beginnings and ends ------------------------------------------------------------------
def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every beginning and every end of a window, the end whole and without a cut word."""
    names = [*LIST, "place", "tail", "cut", "size", "hash"]
    for batch in batches:
        for i, text in enumerate(batch.column("body").to_pylist()):
            whole, word = _sums(text), last_word(text)
            for tail, cut in ((False, 0), (True, 0), *([(True, word)] if word else [])):
                n = len(text) - cut
                sizes = np.arange(MIN_OVERLAP, min(n, SEARCH_LIMIT) + 1)
                if not len(sizes):
                    continue
                back = _powers(_INVERSE, n + 1)
                hashes = _mixed((whole[n] - whole[n - sizes]) * back[n - sizes] if tail else whole[sizes])
                keys = [pa.repeat(batch.column(c)[i], len(sizes)) for c in (*LIST, "place")]
                marks = [pa.repeat(pa.scalar(tail), len(sizes)), pa.repeat(pa.scalar(cut, pa.int32()), len(sizes))]
                yield pa.RecordBatch.from_arrays([*keys, *marks, pa.array(sizes, pa.int32()), pa.array(hashes.view(np.int64))], names)


def _best_links(events: DataFrame) -> DataFrame:
    """(list, ``place``, ``next``, ``size``, ``cut``) where a window's end and another's beginning prefer each other."""
    group = [*LIST, "size", "hash"]
    # a window's beginning stands before its own end, so neither meets the other
    order = Window.partitionBy(*group).orderBy("place", "tail", F.col("cut").desc())
    after, before, all_of = order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*group)
    head, tail = F.when(~F.col("tail"), F.col("place")), F.when(F.col("tail"), F.struct("place", (-F.col("cut")).alias("kept")))
    met = events.select(
        *group, "place", "tail", "cut",
        F.coalesce(F.min(head).over(after), F.min(head).over(all_of)).alias("next"),
        F.coalesce(F.max(tail).over(before), F.max(tail).over(all_of)).alias("previous"),
    )

    def preferred(rows: DataFrame, other: str, kept: Column) -> DataFrame:
        # two windows that join without a cut do so, however long the stretch before the cut word
        pairs = rows.groupBy(*LIST, "place", other).agg(F.max(F.struct((kept == 0).alias("whole"), "size", kept.alias("kept"))).alias("p"))
        return pairs.groupBy(*LIST, "place").agg(F.max(F.struct("p.size", "p.kept", other)).alias("b"))

    ends = preferred(met.where("tail AND next IS NOT NULL AND next <> place"), "next", -F.col("cut"))
    before_it = met.where("NOT tail AND previous IS NOT NULL AND previous.place <> place")
    heads = preferred(before_it.select(*LIST, "place", "size", F.col("previous.place").alias("from"), F.col("previous.kept").alias("whole_of")), "from", F.col("whole_of"))
    ends = ends.select(*LIST, "place", F.col("b.next").alias("next"), F.col("b.size").alias("size"), (-F.col("b.kept")).alias("cut"))
    heads = heads.select(*LIST, F.col("place").alias("next"), F.col("b.from").alias("place"))
    return ends.join(heads, [*LIST, "place", "next"])


def link_windows(windows: DataFrame) -> DataFrame:
    """Links between windows (list, ``place``, ``next``, ``size``, ``cut``) by their longest overlaps."""
    schema = "document_id string, list int, place bigint, tail boolean, cut int, size int, hash bigint"
    events = staged(windows.select(*LIST, "place", "body").mapInArrow(_end_hashes, schema), "hashes")
    # a stretch that is on one side only joins nothing
    both = events.groupBy(*LIST, "size", "hash").agg(F.max("tail").alias("ends"), F.min("tail").alias("only")).where("ends AND NOT only")
    events = staged(events.join(both.drop("ends", "only"), [*LIST, "size", "hash"], "left_semi"), "met")
    links = None
    while True:
        left = events
        if links is not None:
            left = left.join(links.select(*LIST, "place", F.lit(True).alias("tail")), [*LIST, "place", "tail"], "left_anti")
            left = left.join(links.select(*LIST, F.col("next").alias("place"), F.lit(False).alias("tail")), [*LIST, "place", "tail"], "left_anti")
        x = windows.select(*LIST, "place", F.col("body").alias("x"))
        y = windows.select(*LIST, F.col("place").alias("next"), F.col("body").alias("y"))
        same = F.expr("substring(x, length(x) - cut - size + 1, size) = substring(y, 1, size)")
        found = staged(_best_links(left).join(x, [*LIST, "place"]).join(y, [*LIST, "next"]).where(same).select(*LIST, "place", "next", "size", "cut"), "links")
        if found.isEmpty():
            return links if links is not None else found
        links = found if links is None else staged(links.unionByName(found), "links")


def _doubled(now: DataFrame) -> DataFrame:
    """Every window points to where the one it points to points."""
    far = now.select(*LIST, F.col("place").alias("ptr"), F.col("ptr").alias("p"), F.col("rank").alias("r"), F.col("root").alias("o"), F.col("best").alias("b"))
    return now.join(far, [*LIST, "ptr"], "left").select(
        *LIST, "place", "start", F.col("p").alias("ptr"), "previous", (F.col("rank") + F.coalesce("r", F.lit(0))).alias("rank"),
        F.coalesce("o", "root").alias("root"), F.least("best", F.coalesce("b", "best")).alias("best"),
    )


def rank_windows(windows: DataFrame, links: DataFrame) -> DataFrame:
    """(list, ``place``, ``root``, ``rank``): the first window of each run of links and the place in it.

    ``windows`` has list, ``place`` and ``start``, the smaller the better a beginning.
    """
    before = links.select(*LIST, F.col("next").alias("place"), F.col("place").alias("ptr"))
    state = windows.join(before, [*LIST, "place"], "left")
    while True:
        fresh = state.select(
            *LIST, "place", "start", "ptr", F.col("ptr").alias("previous"), F.when(F.col("ptr").isNull(), 0).otherwise(1).alias("rank"),
            F.coalesce("ptr", "place").alias("root"), F.struct("start", "place").alias("best"),
        )
        now, longest = staged(fresh, "ranks"), windows.groupBy(*LIST).count().agg(F.max("count")).first()[0] or 1
        left = int(longest).bit_length() + 1
        while not (done := now.where("ptr IS NOT NULL").isEmpty()) and left > 0:
            for _ in range(DOUBLINGS):
                now = _doubled(now)
            now, left = staged(now, "ranks"), left - DOUBLINGS
        if done:
            return now.select(*LIST, "place", "root", "rank")
        # what still points on goes round in a ring: it opens before its best beginning
        opens = F.col("ptr").isNotNull() & (F.col("best.place") == F.col("place"))
        state = now.select(*LIST, "place", "start", F.when(~opens, F.col("previous")).alias("ptr"))


# --- texts -----------------------------------------------------------------------------------
def start_rank(body: Column) -> Column:
    """Smaller for a better beginning: opens a document, not inside a word, longest."""
    return F.struct(~looks_like_start(body), body.rlike(r"^\p{IsLowercase}"), -F.length(body))


def _assembled(windows: DataFrame) -> DataFrame:
    """(list, ``text``) of windows with ``root``, ``rank``, ``place``, ``shared`` and ``cut``."""
    in_list, in_root = Window.partitionBy(*LIST), Window.partitionBy(*LIST, "root")
    order = Window.partitionBy(*LIST, "root").orderBy("rank", "place")
    best = F.struct(start_rank(F.col("body")).alias("start"), F.col("place").alias("place"))
    placed = windows.select(
        *LIST, "root", "rank", "place", "body", "shared", F.coalesce(F.lead("cut").over(order), F.lit(0)).alias("gone"), F.row_number().over(order).alias("n"),
        F.min("place").over(in_root).alias("first"), F.min_by("root", best).over(in_list).alias("lead"),
    )
    rest = F.expr("substring(body, shared + 1, greatest(length(body) - shared - gone, 0))")
    # what is cut from a window that repeats nearly all of the one before goes from that one too
    piece = F.when((F.col("n") == 1), F.concat(F.lit("\n\n"), rest)).otherwise(rest)
    entry = F.struct((F.col("root") != F.col("lead")).alias("later"), "first", "root", "rank", "place", piece.alias("piece"))
    pieces = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["piece"])
    return placed.groupBy(*LIST).agg(tx.strip(F.array_join(pieces, "")).alias("text"))


def stitched(windows: DataFrame) -> DataFrame:
    """(``document_id``, ``list``, ``text``) of the ``windows`` (list, ``place``, ``body``) of each list.

    Bodies are trimmed and not empty; of equal bodies in a list the first counts.
    """
    again = F.row_number().over(Window.partitionBy(*LIST, "body").orderBy("place"))
    once = windows.select(*LIST, F.col("place").cast("bigint").alias("place"), "body").repartition(*LIST).withColumn("again", again).where("again = 1").drop("again")
    followed = staged(follow(once), "followed")
    alone = [F.lit(1).cast("bigint").alias("root"), F.lit(0).alias("rank")]
    # a list is done if its windows follow each other and none is a better beginning than its first
    clean = F.struct(*[start_rank(F.col("body"))[f"col{i}"].alias(f"c{i}") for i in (1, 2)])
    marked = followed.groupBy(*LIST).agg(F.max("chain").alias("chains"), F.min(clean).alias("best"), F.min_by(clean, "place").alias("first"))
    broken = staged(marked.where("chains > 1 OR best <> first").select(*LIST), "broken")
    if broken.isEmpty():
        return _assembled(followed.select(*LIST, "place", "body", "shared", "cut", *alone))
    whole = followed.join(broken, LIST, "left_anti").select(*LIST, "place", "body", "shared", "cut", *alone)
    pieces = followed.join(broken, LIST, "left_semi").select(*LIST, "place", "body")
    pieces = staged(pieces.join(contained(pieces), [*LIST, "place"], "left_anti"), "pieces")
    links = link_windows(pieces)
    ranks = rank_windows(pieces.select(*LIST, "place", start_rank(F.col("body")).alias("start")), links)
    joined = links.select(*LIST, F.col("next").alias("place"), "size", "cut")
    on = F.col("rank") > 0  # a ring's first window repeats nothing
    size, cut = (F.when(on, F.col(c)).otherwise(0).alias(n) for c, n in (("size", "shared"), ("cut", "cut")))
    linked = pieces.join(ranks, [*LIST, "place"]).join(joined, [*LIST, "place"], "left").select(*LIST, "place", "body", size, cut, "root", "rank")
    return _assembled(whole.unionByName(linked))


# --- documents -------------------------------------------------------------------------------
CHILDREN, TOGETHER = 0, 1


def best_document_text(points: DataFrame) -> DataFrame:
    """One row per document: its best text and the number of windows it was made from.

    The choice is between the children stitched, parents and children stitched, and each parent;
    what opens a document, does not begin inside a word and is longest wins.  Copies of a window
    (same chunk id, else same body) count once.
    """
    body = chunk_body()
    parent = F.coalesce(F.col("is_parent"), F.lit(False)) | (F.lower(F.coalesce(F.col("chunk_role"), F.lit(""))) == "parent")
    identity = F.coalesce(F.nullif(F.trim("chunk_id"), F.lit("")), body)
    index = F.coalesce(F.col("chunk_index"), F.lit(0)).cast("bigint")
    windows = (
        points.select("document_id", "ordinal", body.alias("body"), parent.alias("parent"), identity.alias("_id"), index.alias("chunk_index"))
        .where("body <> ''").repartition("document_id")
        .withColumn("again", F.row_number().over(Window.partitionBy("document_id", "_id").orderBy("ordinal"))).where("again = 1")
    )
    of_document = Window.partitionBy("document_id")
    order = of_document.orderBy(~F.col("parent"), F.when(~F.col("parent"), F.col("chunk_index")), F.when(~F.col("parent"), -F.length("body")), "ordinal")
    placed = windows.select(
        "document_id", "body", "parent", F.row_number().over(order).alias("place"),
        F.sum(F.col("parent").cast("int")).over(of_document).alias("parents"), F.count("*").over(of_document).alias("n"),
    )
    placed = staged(placed, "windows")
    lists = F.when(F.col("parent"), F.array(F.lit(TOGETHER))).when(F.col("parents") > 0, F.array(F.lit(CHILDREN), F.lit(TOGETHER))).otherwise(F.array(F.lit(CHILDREN)))
    listed = placed.where("n > 1").select("document_id", F.explode(lists).alias("list"), "place", "body")
    texts = stitched(listed).select("document_id", F.col("list").alias("choice"), "text")
    sizes = placed.groupBy("document_id").agg(F.first("n").alias("n"), F.first("parents").alias("parents"))
    joined = texts.join(sizes, "document_id").select("document_id", "choice", "text", F.when(F.col("choice") == CHILDREN, F.col("n") - F.col("parents")).otherwise(F.col("n")).alias("chunk_count"))
    alone = placed.where("parent OR n = 1").select("document_id", (F.col("place") + TOGETHER).alias("choice"), F.col("body").alias("text"), F.lit(1).cast("bigint").alias("chunk_count"))
    options = joined.unionByName(alone)
    best = F.min_by(F.struct("text", "chunk_count"), F.struct(start_rank(F.col("text")).alias("start"), F.col("choice").alias("choice"))).alias("b")
    return options.groupBy("document_id").agg(best).select("document_id", "b.text", F.col("b.chunk_count").cast("bigint").alias("chunk_count"))


def stitch_documents(chunks: DataFrame) -> DataFrame:
    """Plain form for chunk tables without parents or payload fallbacks."""
    points = chunks.select(
        "document_id", "chunk_id", "chunk_index", "text",
        F.lit(None).cast("string").alias("chunk_text"), F.lit(None).cast("string").alias("content"),
        F.lit(None).cast("boolean").alias("is_parent"), F.lit(None).cast("string").alias("chunk_role"),
        F.col("chunk_index").alias("ordinal"),
    )
    return best_document_text(points)
