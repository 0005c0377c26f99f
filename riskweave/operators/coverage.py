"""How many signals fire on the fraud that actually happened."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exact import percent_1dp
from ..functions.signals import SIGNALS, flag, foreign_flag
from .profiles import with_spike_limit
from .skew import HOT_SHARE


def signals_fired(df: DataFrame, hot_share: float = HOT_SHARE) -> DataFrame:
    """Number of signals per fraud row. Only fraud rows look their user up."""
    quiet = [foreign_flag() if n == "foreign" else flag(p) for n, p in SIGNALS.items() if n != "amount_spike"]
    fraud = df.where(F.col("is_fraud") == 1).select(
        "txn_id", "user_id", "amount", reduce(Column.__add__, quiet).alias("_quiet")
    )
    known = with_spike_limit(fraud, df, hot_share)
    fired = F.col("_quiet") + flag(SIGNALS["amount_spike"])
    return known.select("txn_id", fired.alias("signals_fired"))


def signal_coverage(df: DataFrame, hot_share: float = HOT_SHARE) -> DataFrame:
    """Fraud rows per number of signals, with shares and running sums of the rounded shares."""
    counts = signals_fired(df, hot_share).groupBy("signals_fired").agg(F.count(F.lit(1)).alias("fraud_cases"))
    # The rows here are one per number of signals.
    whole = Window.partitionBy(F.lit(1))
    running = whole.orderBy("signals_fired").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tenths = counts.withColumn(
        "_tenths", percent_1dp(F.col("fraud_cases"), F.sum("fraud_cases").over(whole))
    )
    return tenths.select(
        "signals_fired",
        "fraud_cases",
        _tenth(F.col("_tenths")).alias("pct_of_fraud"),
        _tenth(F.sum("_tenths").over(running)).alias("cumulative_pct"),
    ).orderBy("signals_fired")


def low_signal_share(df: DataFrame, at_most: int = 1, hot_share: float = HOT_SHARE) -> DataFrame:
    """Fraud rows with few signals, and their share of all fraud. One row."""
    low = F.count(F.when(F.col("signals_fired") <= at_most, 1))
    return (
        signals_fired(df, hot_share)
        .agg(low.alias("low_signal_fraud"), F.count(F.lit(1)).alias("total_fraud"))
        .select(
            "low_signal_fraud",
            "total_fraud",
            _tenth(percent_1dp(F.col("low_signal_fraud"), F.col("total_fraud"))).alias("low_signal_pct"),
        )
    )


def _tenth(tenths: Column) -> Column:
    return tenths.cast("double") / F.lit(10.0).cast("double")
