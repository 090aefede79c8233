"""Exact duplicates by content sort: ranges of normalised bytes, an external sort, comparison of neighbours.

* **Ranges.** A bounded sample of rows (``SAMPLED`` a range) gives the splitters.  A row's place
  among them is its first bytes, then the digest of its text, then its doc_id: texts that open
  alike are told apart by the digest and the copies of one text by their ids, so neither a
  passage many texts begin with nor a text a third of the rows share fills one range.
* **Sort.** Each range is sorted by whole text and doc_id; Spark's sort spills to disk.
* **Neighbours.** A row starts a run if its whole text differs from the one before it.  Of a run
  the row with the preferred doc_id stays.
* **Runs over several ranges.** A text lies in two ranges only if a splitter carries it.  Runs of
  such texts, two a range at most, hand on their text once; those of equal text are one group.

Only A-Z are lower-cased.  All of it is SQL functions and windows; a text is shuffled once.

Defined results: a null text counts as empty, and empty texts are copies of each other; a null
doc_id is the last choice; of rows with equal text and doc_id one stays; an empty table gives no
rows; texts of any length are compared whole; columns of other names pass through
:func:`deduplicate` untouched, whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.llm.common import staged, whole_text

RANGES = 4  # a shuffle partition
SAMPLED = 32  # rows a range
OPENING = 8  # code points of a text in its splitter
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str) -> Column:
    """The whole text with A-Z in lower case, null counting as empty."""
    return F.translate(whole_text(text), UPPER, LOWER)


def _place() -> tuple[Column, Column]:
    """The sort key of a text, and of a row: its text's key and its doc_id."""
    of_text = F.concat_ws(" ", F.hex(F.left("text", F.lit(OPENING)).cast("binary")), "sha")
    return of_text, F.concat_ws(" ", of_text, F.coalesce(F.hex("doc_id"), F.lit("")))


def splitters(documents: DataFrame, text: str, ranges: int) -> list[str]:
    """At most ``ranges`` - 1 keys that cut a sample of ``documents`` into equal parts."""
    total = documents.count()
    fraction = min(1.0, SAMPLED * ranges / max(1, total))
    sample = documents if fraction == 1.0 else documents.sample(fraction, seed=11)
    sample = sample.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised(text).alias("text"))
    keys = sample.withColumn("sha", F.sha2("text", 256)).select(_place()[1].alias("key"))
    tiles = keys.select("key", F.ntile(ranges).over(Window.orderBy("key")).alias("tile"))
    return sorted({r["first"] for r in tiles.groupBy("tile").agg(F.min("key").alias("first")).where("tile > 1").collect()})


def _range_of(key: Column, cuts: list[str]) -> Column:
    """How many of the sorted ``cuts`` are not above ``key``, by halving steps; the key is computed once."""
    if not cuts:
        return F.lit(0)
    table = F.split(F.lit("\n".join(cuts)), "\n")
    steps = F.array(*[F.lit(1 << i) for i in range(int(math.log2(len(cuts))), -1, -1)])
    start = F.struct(F.lit(0).alias("at"), key.alias("key"))

    def halve(state: Column, step: Column) -> Column:
        further = state["at"] + step
        at = F.when(F.get(table, further - 1) <= state["key"], further).otherwise(state["at"])
        return F.struct(at.alias("at"), state["key"].alias("key"))

    return F.aggregate(steps, start, halve, lambda state: state["at"])


def _marked(documents: DataFrame, text: str, keep: str, carried: list[str]) -> DataFrame:
    """``doc_id``, ``sha``, ``keep_id``, ``group_size``, ``kept`` and the ``carried`` columns as ``row``."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    best = F.max if keep == "largest" else F.min
    by_id = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    row = F.struct(*[F.col(c) for c in carried]) if carried else F.lit(None).cast("struct<none: int>")
    ranges = RANGES * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = splitters(documents, text, ranges)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised(text).alias("text"), row.alias("row"))
    of_text, of_row = _place()
    spread = rows.withColumn("sha", F.sha2("text", 256)).withColumn("part", _range_of(of_row, cuts))
    if cuts:
        # a text whose key a splitter next to its range carries may go on in the neighbouring range
        table = F.split(F.lit("\n".join(c.rsplit(" ", 1)[0] for c in cuts)), "\n")
        shared = F.coalesce(F.get(table, F.col("part")) == of_text, F.lit(False)) | F.coalesce(F.get(table, F.col("part") - 1) == of_text, F.lit(False))
    else:
        shared = F.lit(False)
    spread = spread.withColumn("shared", shared)
    inside = Window.partitionBy("part").orderBy("text", by_id)
    neighbours = spread.select("*", F.lag("text").over(inside).alias("before"), F.row_number().over(inside).alias("at"))
    starts = neighbours.select(
        "part", "at", "doc_id", "sha", "row", (~F.col("text").eqNullSafe(F.col("before"))).cast("int").alias("start"),
        F.when(F.col("shared") & ~F.col("text").eqNullSafe(F.col("before")), F.col("text")).alias("edge"),
    )
    runs = starts.withColumn("run", F.sum("start").over(Window.partitionBy("part").orderBy("at")))
    whole = Window.partitionBy("part", "run")
    sized = runs.select(
        "part", "run", "doc_id", "sha", "row", "edge", best("doc_id").over(whole).alias("best"), F.count("*").over(whole).alias("n"), "start"
    )
    sized = staged(sized, "runs")
    edges = sized.where("edge IS NOT NULL").select("part", "run", "edge", "best", "n")
    joined = edges.groupBy("edge").agg(best("best").alias("all_best"), F.sum("n").alias("all_n"))
    wide = edges.select("part", "run", "edge").join(joined, "edge").select("part", "run", "all_best", "all_n")
    known = sized.drop("edge").join(staged(wide, "edges"), ["part", "run"], "left")
    keep_id = F.when(F.col("all_n").isNull(), F.col("best")).otherwise(F.col("all_best"))
    kept = (F.col("start") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))  # a run begins with its preferred row
    answered = known.select("doc_id", "sha", "row", "start", keep_id.alias("keep_id"), F.coalesce("all_n", "n").alias("group_size"))
    return answered.withColumn("kept", kept).drop("start")


def copies(documents: DataFrame, text: str = "text", keep: str = "largest") -> DataFrame:
    """(``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``) of every row of ``documents``."""
    marked = _marked(documents, text, keep, [])
    return marked.select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def deduplicate(documents: DataFrame, text: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``documents`` that stay, one of each group of equal texts, with all their columns."""
    marked = _marked(documents, text, keep, documents.columns)
    return marked.where("kept").select("row.*")
