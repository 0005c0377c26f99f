"""Amounts split to stay below a reporting threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import cents, money


def structuring(
    df: DataFrame,
    threshold: int = 900,
    near_low: int = 700,
    near_high: int = 899,
    min_near: int = 2,
    ordered: bool = True,
) -> DataFrame:
    """User-days of approved rows, all below the threshold, some near it, above it in sum.

    Near means ``near_low`` to ``near_high``, both included: amounts between ``near_high`` and
    the threshold do not count as near.
    """
    near = F.col("amount").between(near_low, near_high)
    out = (
        df.where(F.col("status") == "approved")
        .groupBy("user_id", F.col("txn_time").cast("date").alias("txn_date"))
        .agg(
            F.count(F.lit(1)).alias("txn_count"),
            F.sum(cents("amount")).alias("_total"),
            F.count(F.when(near, 1)).alias("near_threshold_count"),
            F.max(cents("amount")).alias("_max"),
        )
        .where(
            (F.col("near_threshold_count") >= min_near)
            & (F.col("_total") > threshold * 100)
            & (F.col("_max") < threshold * 100)
        )
        .select(
            "user_id",
            "txn_date",
            "txn_count",
            money("_total").alias("total_amount"),
            "near_threshold_count",
            money("_max").alias("max_single_txn"),
            F.lit("STRUCTURING_ALERT").alias("fraud_flag"),
        )
    )
    return out.orderBy(F.desc("total_amount"), "user_id", "txn_date") if ordered else out
