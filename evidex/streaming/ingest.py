"""Continuous ingest and incremental index maintenance (P1, P2)."""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from evidex.functions.text import is_blank
from evidex.operators import ingest as op
from evidex.sources.documents import BINARY_FILE_SCHEMA, from_binary_files
from evidex.streaming import work

KEY = op.INDEX_KEY
BUCKETS = 64
ROWS = [*KEY, "version", "chunk_index", "chunk_id", "point_id", "text", "start_offset", "end_offset"]
EMPTY = (
    "document_id string, user_id string, version bigint, chunk_index bigint, chunk_id string, point_id string, text string, "
    "start_offset bigint, end_offset bigint"
)
#: One row per live folder of a bucket; ``documents`` counts those in it, blank ones included.
MANIFEST = "bucket int, folder bigint, documents bigint, buckets int"


def file_stream(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """New text files in a folder as document rows."""
    files = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
        .option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    )
    return from_binary_files(files)


def chunk_stream(documents: DataFrame) -> DataFrame:
    """Gate, status and chunks of arriving documents; stateless, so any stream of documents will do."""
    accepted = op.gate_documents(documents).filter("accepted").drop("accepted", "reason")
    return op.chunk_documents(op.mark_processed(accepted).filter("processed").drop("extracted_text", "processed", "vectorized"))


def newest_versions(documents: DataFrame) -> DataFrame:
    """The newest version of every document in a batch; older ones collapse before the shuffle.

    Two texts under one version number: the greater one stays, so a replay chooses alike.
    """
    others = [c for c in documents.columns if c not in (*KEY, "version")]
    return documents.groupBy(*KEY).agg(F.max(F.struct("version", *others)).alias("d")).select(*KEY, "d.*")


def newest_rows(rows: DataFrame) -> DataFrame:
    """The rows of every document's newest version; of a version that came twice, the later folder counts.

    Finding the versions reads the key columns, and only documents that have several take part
    in the join.
    """
    each = rows.select(*KEY, "version", "folder").distinct()
    several = each.groupBy(*KEY).agg(F.max(F.struct("version", "folder")).alias("_newest"), F.count("*").alias("_n")).filter("_n > 1")
    several = several.select(*[F.col(k).alias(f"_{k}") for k in KEY], "_newest")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY])
    newest = F.col("_newest").isNull() | F.struct("version", "folder").eqNullSafe(F.col("_newest"))
    return rows.join(several, same, "left").filter(newest).select(*rows.columns)


def merge_from(sizes: list[int], new: int) -> int:
    """From which of a bucket's folders on, oldest first, they are rewritten together with ``new`` documents.

    It is the oldest with no more documents than came after it.  So a folder left in place holds
    more documents than all later ones together: some of its rows are still the newest, a bucket
    has a logarithmic number of folders, and a row moves again only with as many others.
    """
    return next((i for i, size in enumerate(sizes) if size <= new + sum(sizes[i + 1:])), len(sizes))


def manifests(spark: SparkSession, path: str) -> list[int]:
    """Batches whose manifest is complete, in order."""
    names = [n for n in work.names(spark, f"{path}/manifest") if n.startswith("batch_id=")]
    return sorted(int(n.split("=")[1]) for n in names if "_SUCCESS" in work.names(spark, f"{path}/manifest/{n}"))


def live_folders(spark: SparkSession, path: str, batch_id: int) -> list[Row]:
    """The manifest of a batch: at most buckets times the logarithm of the documents of one."""
    return spark.read.schema(MANIFEST).json(f"{path}/manifest/batch_id={batch_id}").orderBy("bucket", "folder").collect()


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def _sizes(documents: DataFrame, bucket: Column) -> dict[int, int]:
    """Documents by bucket."""
    counts = documents.select(*KEY, bucket.alias("bucket")).distinct().groupBy("bucket").agg(F.count("*").alias("n"))
    return {r["bucket"]: r["n"] for r in counts.collect()}


def _read(spark: SparkSession, path: str, live: list[Row]) -> DataFrame:
    """The rows of these folders, no others."""
    root = f"{path}/rows"
    found = spark.read.option("basePath", root).parquet(*[f"{root}/folder={r['folder']}/bucket={r['bucket']}" for r in live])
    return found.select(*ROWS, F.col("folder").cast("bigint").alias("folder"))


def write_batch(path: str, batch: DataFrame, batch_id: int, buckets: int = BUCKETS) -> None:
    """Add one batch of document versions to the index at ``path``.

    Documents belong to buckets by the hash of their key.  A batch writes one folder for each
    bucket it touches, which also takes in that bucket's smaller folders (``merge_from``), and then
    a manifest that names the live folders of all buckets.  Readers follow the newest complete
    manifest, so a batch is there as a whole or not at all.  Everything derives from the manifest
    before and the batch itself: a replayed batch writes the same bytes.  Blank texts leave a row
    without chunks that hides earlier versions.  An index keeps the number of buckets it began with.
    """
    spark = batch.sparkSession
    before = [n for n in manifests(spark, path) if n < batch_id]
    live = live_folders(spark, path, before[-1]) if before else []
    buckets = live[0]["buckets"] if live else buckets
    came = _sizes(batch, _bucket(buckets))
    kept, merged = [], []
    for bucket, group in groupby(live, key=lambda r: r["bucket"]):
        old = list(group)
        at = merge_from([r["documents"] for r in old], came[bucket]) if bucket in came else len(old)
        kept, merged = kept + old[:at], merged + old[at:]
    written = []
    if came:
        newest = newest_versions(batch)
        blank = newest.filter(F.col("text").isNull() | is_blank("text")).select(*KEY, "version")
        rows = op.chunk_documents(newest).select(*ROWS).unionByName(blank, allowMissingColumns=True)
        if merged:
            rows = newest_rows(_read(spark, path, merged).unionByName(rows.withColumn("folder", F.lit(batch_id).cast("bigint"))))
        target = f"{path}/rows/folder={batch_id}"
        rows = rows.select(*ROWS, _bucket(buckets).alias("bucket")).orderBy("bucket", *KEY, "chunk_index")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(target)
        sizes = _sizes(spark.read.parquet(target), F.col("bucket"))
        written = [(bucket, batch_id, size, buckets) for bucket, size in sorted(sizes.items())]
    manifest = spark.createDataFrame([*map(tuple, kept), *written], MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/batch_id={batch_id}")


def drop_superseded(spark: SparkSession, path: str, keep: int) -> None:
    """Delete the folders that none of the newest ``keep`` manifests names, and the manifests before.

    Readers that began up to ``keep`` - 1 batches ago go on undisturbed.
    """
    done = manifests(spark, path)
    if not done:
        return
    named = {(r["folder"], r["bucket"]) for n in done[-keep:] for r in live_folders(spark, path, n)}
    for folder in work.names(spark, f"{path}/rows"):
        number = int(folder.split("=")[1]) if folder.startswith("folder=") else None
        if number is None or number > done[-1]:
            continue
        inside = [b for b in work.names(spark, f"{path}/rows/{folder}") if b.startswith("bucket=")]
        gone = [b for b in inside if (number, int(b.split("=")[1])) not in named]
        for name in ([folder] if len(gone) == len(inside) else [f"{folder}/{b}" for b in gone]):
            work.remove(spark, f"{path}/rows/{name}")
    for number in done[:-keep]:
        work.remove(spark, f"{path}/manifest/batch_id={number}")


def maintain_index(documents: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, keep: int = 8):
    """Streaming query that keeps the index at ``path`` up to date and readable as of the last ``keep`` batches."""
    if keep < 2:
        raise ValueError("a replayed batch needs the manifest before its own: keep at least 2")

    def add(batch: DataFrame, batch_id: int) -> None:
        write_batch(path, batch, batch_id, buckets)
        drop_superseded(batch.sparkSession, path, keep)

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_index(spark: SparkSession, path: str) -> DataFrame:
    """The index as of the newest complete manifest: the chunks of every document's newest version.

    A bucket with one live folder is read as it is, without a shuffle; in the others the newest
    version of a document is looked for among the bucket's folders.
    """
    done = manifests(spark, path)
    live = live_folders(spark, path, done[-1]) if done else []
    if not live:
        return spark.createDataFrame([], EMPTY)
    groups = [list(g) for _, g in groupby(live, key=lambda r: r["bucket"])]
    alone = [g[0] for g in groups if len(g) == 1]
    several = [r for g in groups if len(g) > 1 for r in g]
    parts = ([_read(spark, path, alone)] if alone else []) + ([newest_rows(_read(spark, path, several))] if several else [])
    return reduce(DataFrame.unionByName, parts).filter(F.col("chunk_index").isNotNull()).select(*ROWS)
