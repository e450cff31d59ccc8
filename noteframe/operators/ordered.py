"""Running aggregates and places in ordered groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteframe.sources.storage import kept


def running(df: DataFrame, by: list[str], order: list[Column], **sums: str) -> DataFrame:
    """Add running sums within each group, the row itself included: name=column (without nulls).

    Rows are sorted by ranges of the group and the order, and stored, so a group of any size lies in many tasks and ranges
    stay as they are. Within a range rows are added up as they come; a group that goes on from one range to the next also
    gets the total of its earlier ranges. Only the first and the last group of a range can go on, so these totals are two
    rows a range at most, whatever the number of groups.
    """
    rows = kept(df.orderBy(*by, *order).withColumn("_block", F.spark_partition_id()), "ordered")
    key = F.struct(*by)
    edges = rows.groupBy("_block").agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    parts = rows.join(F.broadcast(edges), "_block").where((key == F.col("_low")) | (key == F.col("_high")))
    parts = parts.groupBy(*by, "_block").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    ahead = parts.select(*by, "_block", *(F.sum(f"_{n}").over(before).alias(f"_{n}") for n in sums))
    here = W.partitionBy("_block", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    added = rows.withColumns({n: F.sum(c).over(here) for n, c in sums.items()}).join(F.broadcast(ahead), [*by, "_block"], "left")
    return added.withColumns({n: F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n in sums}).drop("_block", *(f"_{n}" for n in sums))


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "turn") -> DataFrame:
    """Add the place of each row in its group, from 1, in an order that tells its rows apart."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), by, order, **{name: "_one"}).drop("_one")
