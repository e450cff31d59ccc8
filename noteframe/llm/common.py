"""What the operators of this subpackage share: reading tables, shared storage, safe column names."""

from __future__ import annotations

import math
import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a task takes of a table read back by gathered(), and rows that are sent to all tasks at most (a few MB of keys and labels).
ROWS_A_TASK, FEW = 10_000, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's own reader, whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where the setting is absent (tests on one machine) a temporary folder is taken; on a cluster that is an error,
    as a machine-local folder would lose data with the machine.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="noteframe-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the lineage ends in the shared folder and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame, rows: int | None = None) -> DataFrame:
    """As cut(), for what goes from round to round: as many tasks take it as its rows need, since a round over a small table costs by its tasks.

    The driver keeps figures of every task, so they cost its memory too. `rows`: how many df has at most, where that is known.
    """
    fit = lambda df, n: df.coalesce(max(8, math.ceil(n / ROWS_A_TASK)))
    if rows is not None:
        return cut(fit(df, rows))
    out = cut(df)
    return fit(out, out.coalesce(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)).count())


def sent(df: DataFrame) -> DataFrame:
    """What gathered() gave, marked to be sent to all tasks in joins if it is small."""
    return F.broadcast(df) if df.count() <= FEW else df


def stored(df: DataFrame, what: str) -> DataFrame:
    """Written to the shared folder as compressed Parquet and read back; for large intermediate tables."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def digest_of(column: str = "text") -> Column:
    """Tells texts apart, whatever their rows' ids are."""
    return F.md5(text_of(column).cast("binary"))


def text_of(column: str = "text") -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def attached(rows: DataFrame, keyed: DataFrame, on: list[str], heavy: Column, how: str = "left") -> DataFrame:
    """rows joined with `keyed`, which has one row a key; keys that many rows have are sent to all tasks, so none of them meets in one.

    `heavy` (over keyed's columns) marks those keys. It must hold for a number of keys that does not grow with the data, as
    a share of a total does: at most a thousand keys have a thousandth each.
    """
    many, few = F.broadcast(keyed.where(heavy)), keyed.where(~heavy)
    return rows.join(many, on).unionByName(rows.join(F.broadcast(keyed.where(heavy).select(on)), on, "left_anti").join(few, on, how))


def running(df: DataFrame, by: str, order: list[Column], **values: tuple[Callable, str]) -> DataFrame:
    """Add running aggregates within each group, the row itself included: name=(F.sum or F.bit_xor, column without nulls).

    Rows are sorted by ranges of the group and the order, and stored, so a group of any size lies in many tasks. Within a
    range rows are added up as they come; a group that goes on from one range to the next also gets the total of its
    earlier ranges. Only the first and the last group of a range can go on, so these totals are two rows a range at most.
    """
    rows = stored(df.orderBy(by, *order).withColumn("_block", F.spark_partition_id()), "running")
    edges = rows.groupBy("_block").agg(F.min(by).alias("_low"), F.max(by).alias("_high"))
    parts = rows.join(F.broadcast(edges), "_block").where((F.col(by) == F.col("_low")) | (F.col(by) == F.col("_high")))
    parts = parts.groupBy(by, "_block").agg(*(f(c).alias(f"_{n}") for n, (f, c) in values.items()))
    before = W.partitionBy(by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    ahead = parts.select(by, "_block", *(f(f"_{n}").over(before).alias(f"_{n}") for n, (f, _) in values.items()))
    here = W.partitionBy("_block", by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    added = rows.withColumns({n: f(c).over(here) for n, (f, c) in values.items()}).join(F.broadcast(ahead), [by, "_block"], "left")

    def both(n: str, f: Callable) -> Column:
        old = F.coalesce(f"_{n}", F.lit(0))
        return F.col(n).bitwiseXOR(old) if f is F.bit_xor else F.col(n) + old

    return added.withColumns({n: both(n, f) for n, (f, _) in values.items()}).drop("_block", *(f"_{n}" for n in values))
