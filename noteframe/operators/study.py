"""Study sessions: the last answer to a card counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteframe.functions import text as T


def last_answer(events: DataFrame) -> DataFrame:
    """session_id, card_idx and the result of the last event by time, then event_id. One partial aggregate, no window."""
    latest = F.max(F.struct("ts", "event_id", "result"))
    return events.groupBy("session_id", "card_idx").agg(latest.alias("last")).select("session_id", "card_idx", "last.result")


def study_summary(events: DataFrame) -> DataFrame:
    """Per session: cards reviewed, known, to learn, the share known and its tier."""
    out = last_answer(events).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("result") == "know").alias("know"), F.count_if(F.col("result") == "learning").alias("learning")
    )
    return out.withColumns({"score": T.score_ratio(F.col("know"), F.col("reviewed")), "tier": T.score_tier(F.col("know"), F.col("reviewed"))})


def missed_only(events: DataFrame) -> DataFrame:
    """Cards that a restart would ask again; a session without any has ended."""
    return last_answer(events).where(F.col("result") == "learning").select("session_id", "card_idx")


def shuffle_cards(cards: DataFrame, seed: int) -> DataFrame:
    """Add `position`: a permutation of each set's cards that depends on the seed and the card alone."""
    order = W.partitionBy("set_id").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), "id")
    return cards.withColumn("position", F.row_number().over(order))
