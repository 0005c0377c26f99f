"""Distinct cards per card range over any stretch of days, from daily sketches.

Counting distinct cards of a month needs every card again, since days share cards. A sketch per
day and range has a bounded size and merges, so a longer stretch is read off the stored days. It is
for wide windows and dashboards; ``bin_attack`` stays exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Registers of a sketch, as a power of two, and four times the standard error they give.
LOG_REGISTERS = 12
BOUND = 4 * 1.04 / 2 ** (LOG_REGISTERS / 2)


def daily_card_sketches(df: DataFrame, log_registers: int = LOG_REGISTERS) -> DataFrame:
    """(txn_date, bin, attempts, declines, cards): one mergeable row per day and card range.

    Meant to be written by day: a new day, or a corrected one, touches no other rows. Rows without
    a time or a card are left out.
    """
    known = df.where(F.col("txn_time").isNotNull() & F.col("card_number").isNotNull())
    return known.groupBy(F.col("txn_time").cast("date").alias("txn_date"), _bin().alias("bin")).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count(F.when(F.col("status") == "declined", 1)).alias("declines"),
        F.hll_sketch_agg("card_number", log_registers).alias("cards"),
    )


def merge_days(daily: DataFrame, window_start: Column | None = None) -> DataFrame:
    """Daily rows of a card range merged per window, which begins at ``window_start`` of the day.

    The default is the week that begins on Monday. Any rows of ``daily_card_sketches`` can be
    merged, whatever dates were selected; no card is read.
    """
    start = F.trunc("txn_date", "week") if window_start is None else window_start
    return daily.groupBy(start.alias("window_start"), "bin").agg(
        F.sum("attempts").alias("attempts"),
        F.sum("declines").alias("declines"),
        F.hll_union_agg("cards").alias("cards"),
    )


def card_estimates(merged: DataFrame) -> DataFrame:
    """``merged`` with ``estimated_cards`` in place of the sketch."""
    return merged.withColumn("estimated_cards", F.hll_sketch_estimate("cards")).drop("cards")


def weekly_cards(df: DataFrame, bound: float = BOUND, ordered: bool = True) -> DataFrame:
    """Exact distinct cards per week and range, beside the estimate from the days and its check.

    ``within_bound`` says that the estimate is off by no more than ``bound`` times the exact count,
    rounded up. The exact count goes by card first, so that a busy range is spread over its cards.
    """
    known = df.where(F.col("txn_time").isNotNull() & F.col("card_number").isNotNull())
    cards = known.select(
        F.trunc(F.col("txn_time").cast("date"), "week").alias("window_start"), _bin().alias("bin"), "card_number"
    ).distinct()
    exact = cards.groupBy("window_start", "bin").agg(F.count(F.lit(1)).alias("exact_cards"))
    estimated = card_estimates(merge_days(daily_card_sketches(df)))
    off = F.abs(F.col("estimated_cards") - F.col("exact_cards"))
    out = exact.join(estimated, ["window_start", "bin"]).select(
        "window_start",
        "bin",
        "attempts",
        "declines",
        "exact_cards",
        "estimated_cards",
        (off <= F.ceil(F.col("exact_cards") * bound)).alias("within_bound"),
    )
    return out.orderBy("window_start", F.desc("exact_cards"), "bin") if ordered else out


def _bin() -> Column:
    return F.left("card_number", F.lit(6))
