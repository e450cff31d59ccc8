"""Folders that the driver and all executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, what: str = "stream") -> str:
    """A new folder under spark.checkpoint.dir; a temporary one on a single machine only."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="noteframe-")
    return f"{at.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """The file system removes the path when the application ends; until then tables read from it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def gone_now(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_files(df: DataFrame, folder: str, per_folder: int = 10_000) -> list[tuple[str, int]]:
    """A file for each row of df (a key and its text), with the key in its name (key=value); the folders they are in, and how many each holds.

    Tasks write through Arrow, which makes a file in a tenth of a millisecond, where Spark's writer takes some 20 (a local
    Hadoop file system starts a process for each file). A task that runs again writes to folders of its own, and only those of tasks that ended
    are given back. Where Arrow does not know the store, Spark's writer does it.
    """
    key, at = df.columns[0], df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    folder = at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()  # a path without a scheme is not always local
    try:
        where, at = fs.FileSystem.from_uri(folder)
        where.create_dir(at)
    except (pa.ArrowInvalid, NotImplementedError, OSError):
        df = kept(df, "files")
        df.write.partitionBy(key).option("maxRecordsPerFile", 1).text(folder)
        return [(f"{folder}/*", df.count())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = fs.FileSystem.from_uri(folder)
        task, names, files = f"task-{TaskContext.get().taskAttemptId()}", [], 0
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if files % per_folder == 0:
                    names.append(f"{task}-{len(names)}")
                    where.create_dir(f"{at}/{names[-1]}")
                with where.open_output_stream(f"{at}/{names[-1]}/{files}-{key}={k}.json") as out:
                    out.write(value)
                files += 1
        counts = [min(per_folder, files - per_folder * k) for k in range(len(names))]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["name", "files"])

    made = df.select(F.col(key).cast("string"), F.col(df.columns[1]).cast("binary")).mapInArrow(run, "name string, files long").collect()  # a row for each folder
    return [(f"{folder}/{r['name']}", r["files"]) for r in made]


def kept(df: DataFrame, what: str) -> DataFrame:
    """Written to a shared folder and read back: what is computed once stays as it is, whatever executors are lost, until the application ends."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    gone_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
