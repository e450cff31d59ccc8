"""Sharding by proportional stratified interleaving, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteframe.llm.common import stored, table, text_of

#: Ranking runs in this many buckets of the shuffle key; a bucket holds rows / BUCKETS rows of any source, however hot.
BUCKETS = 4096


def seeded(column: Column, seed: int) -> Column:
    """A shuffle key that depends on the row's id and the seed alone; 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")))


def interleave(df: DataFrame, shards: int, id_col: str = "doc_id", source_col: str = "source", seed: int = 7) -> DataFrame:
    """Add `shard` and `slot`: every shard holds the mixture of sources of the whole, and counts differ by one at most.

    Rows of a source are ranked in a seeded shuffle; rank r of n gets the fraction (2r + 1) / 2n. All rows are ranked
    by that fraction (ties: source, then shuffle key) and position p of N goes to shard floor(p * shards / N), slot
    counted from 0. Ranks are taken in buckets (of the shuffle key, then of the fraction) to which the counts of the
    earlier buckets are added, so that a source with any share of the rows never meets in one task. All columns of `df` are
    moved and, once ranked, written to the shared folder, so callers select what they need and join texts afterwards.

    Rows without an id are told apart by their other columns, null sources form one source of their own. Rows that are alike in id and source
    are told apart arbitrarily; their shards are still balanced. An empty frame gives an empty result. The columns
    `_key`, `_stratum` ... used inside begin with an underscore; columns of `df` of other names pass through.
    """
    keyed = df.withColumns(
        {
            "_key": seeded(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null"), F.xxhash64(*df.columns).cast("string"))), seed),
            "_stratum": F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")),
        }
    ).withColumn("_bucket", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int"))
    counts = keyed.groupBy("_stratum", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumns(
        {
            "_before": F.sum("_n").over(W.partitionBy("_stratum").orderBy("_bucket")) - F.col("_n"),
            "_total": F.sum("_n").over(W.partitionBy("_stratum")),
        }
    ).drop("_n")
    rank = F.row_number().over(W.partitionBy("_stratum", "_bucket").orderBy("_key")) - 1
    ranked = keyed.withColumn("_rank", rank).join(before, ["_stratum", "_bucket"])
    ranked = ranked.withColumn("_twice", (F.col("_rank") + F.col("_before")) * 2 + 1)
    # the fraction is _twice / (2 * _total); as a decimal it is exact enough to be ordered alike by every engine
    ranked = ranked.withColumn("_fraction", F.col("_twice").cast("double") / (F.col("_total") * 2).cast("double"))
    ranked = ranked.withColumn("_band", F.floor(F.col("_fraction") * BUCKETS).cast("int"))
    ranked = stored(ranked, "ranked")
    bands = ranked.groupBy("_band").agg(F.count(F.lit(1)).alias("_size"))  # BUCKETS rows at most
    edges = bands.select("_band", (F.sum("_size").over(W.orderBy("_band")) - F.col("_size")).alias("_ahead"), F.sum("_size").over(W.partitionBy()).alias("_all"))
    order = W.partitionBy("_band").orderBy("_fraction", "_stratum", "_key")
    placed = ranked.withColumn("_in_band", F.row_number().over(order) - 1).join(edges, "_band")
    position = F.col("_ahead") + F.col("_in_band")
    placed = placed.withColumn("_position", position)
    shard = F.floor(F.col("_position") * shards / F.col("_all").cast("decimal(20,0)"))
    placed = placed.withColumn("shard", shard.cast("int"))
    first = F.ceil(F.col("shard") * F.col("_all") / F.lit(shards).cast("decimal(20,0)")).cast("long")
    placed = placed.withColumn("slot", F.col("_position") - first)
    return placed.drop("_key", "_stratum", "_bucket", "_rank", "_before", "_total", "_twice", "_fraction", "_band", "_in_band", "_ahead", "_all", "_position")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law `rows`: counts at most one apart, every shard with the mixture."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.octet_length(text_of()) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
    )
    out = interleave(docs, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
