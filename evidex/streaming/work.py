"""Where streams keep checkpoints and output."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="evidex-")
    return f"{base.rstrip('/')}/evidex/{name}-{uuid.uuid4().hex}"


def _located(spark: SparkSession, path: str):
    """A path and the file system it is in, whichever Spark is set up for."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies right under a folder; none if there is no such folder."""
    at, fs = _located(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds."""
    at, fs = _located(spark, path)
    fs.delete(at, True)


FOLDER = 1_024


def write_text_files(rows: DataFrame, path: str) -> int:
    """Each ``value`` as a text file of its own in folders of about ``FOLDER`` files below ``path``; how many.

    Folders are moved into place as a whole.  On a mounted file system tasks write by themselves:
    Hadoop without its native library starts processes for the permissions of each file there.
    """
    at, fs = _located(rows.sparkSession, path)
    if fs.getUri().getScheme() != "file":
        files = rows.count()
        folder = F.pmod(F.xxhash64("value"), F.lit(-(-files // FOLDER) or 1)).alias("folder")
        dealt = rows.select("value", folder).repartition("folder").write.partitionBy("folder").option("maxRecordsPerFile", 1)
        dealt.option("mapreduce.fileoutputcommitter.algorithm.version", 1).text(path)
        return files
    base = fs.makeQualified(at).toUri().getPath()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, files = f"{base}/_attempt-{uuid.uuid4().hex}", TaskContext.get().partitionId(), 0
        for batch in batches:
            for value in batch["value"]:
                folder = f"{own}/folder={task}-{files // FOLDER}"
                if files % FOLDER == 0:
                    os.makedirs(folder)
                files += 1
                with open(f"{folder}/part-{files:08d}.txt", "wb") as out:
                    out.write(value.as_buffer())
        for name in os.listdir(own) if files else []:
            if not os.path.exists(f"{base}/{name}"):  # else another attempt has written it
                os.rename(f"{own}/{name}", f"{base}/{name}")
        shutil.rmtree(own, ignore_errors=True)
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    os.makedirs(base, exist_ok=True)
    lines = rows.select(F.concat("value", F.lit("\n")).cast("binary").alias("value"))
    return lines.mapInArrow(write, "files bigint").agg(F.sum("files")).first()[0] or 0


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """One table as a stream, whether it is a single Parquet file or a folder of part files.

    A stream takes a plain path for a folder; written as a glob, it may be either.
    """
    schema: StructType = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{name}.parque[t]")


NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_to_files(stream: DataFrame, path: str, mode: str = "append", timers: bool = False) -> DataFrame:
    """Process everything available into Parquet files and return them.

    ``timers`` says that the stream has timers of the wall clock.  Such a stream always asks for
    another batch, with or without data, so it would never be done; batches without data are
    left out for it.  A query keeps the settings it was started with.
    """
    conf = stream.sparkSession.conf
    before = conf.get(NO_DATA_BATCHES, "true")
    if timers:
        conf.set(NO_DATA_BATCHES, "false")
    try:
        query = (
            stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/_stream")
            .trigger(availableNow=True).start(f"{path}/rows")
        )
    finally:
        conf.set(NO_DATA_BATCHES, before)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
