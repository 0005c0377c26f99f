"""Card ranges under attack: many cards of one issuer number, mostly declined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import percent


def bin_attack(
    df: DataFrame, min_cards: int = 3, min_decline_pct: float = 60, ordered: bool = True
) -> DataFrame:
    """Per day and first six card digits: more than ``min_cards`` cards and a high decline rate.

    Counted per card first, which makes the distinct count a plain count and spreads a busy
    range over its cards.
    """
    cards = df.groupBy(F.col("txn_time").cast("date").alias("txn_date"), "card_number").agg(
        F.count(F.lit(1)).alias("_attempts"),
        F.count(F.when(F.col("status") == "declined", 1)).alias("_declines"),
    )
    out = (
        cards.groupBy("txn_date", F.left("card_number", F.lit(6)).alias("bin"))
        .agg(
            F.count("card_number").alias("unique_cards"),
            F.sum("_attempts").alias("total_attempts"),
            F.sum("_declines").alias("decline_count"),
        )
        .withColumn("decline_rate_pct", percent(F.col("decline_count"), F.col("total_attempts")))
        .where((F.col("unique_cards") > min_cards) & (F.col("decline_rate_pct") > min_decline_pct))
        .withColumn("fraud_flag", F.lit("BIN_ATTACK"))
    )
    return out.orderBy(F.desc("unique_cards"), "txn_date", "bin") if ordered else out
