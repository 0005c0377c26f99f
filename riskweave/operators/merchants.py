"""Chargeback monitoring of merchants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import percent

_DETAILS = ("merchant_id", "merchant_name", "merchant_cat", "risk_tier")


def merchant_chargebacks(
    df: DataFrame,
    merchants: DataFrame,
    warning_pct: float = 1,
    critical_pct: float = 2,
    include_safe: bool = False,
) -> DataFrame:
    """Merchants whose rounded chargeback rate is above the warning level.

    Transactions are counted per merchant before the join, so one row per merchant meets the
    details and a busy merchant costs nothing extra. A merchant listed several times counts
    its transactions once per listing, as joining the rows first would.
    """
    counts = (
        df.where(F.col("merchant_id").isNotNull())
        .groupBy("merchant_id")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.sum("is_chargeback").alias("_chargebacks"),
            F.count("is_chargeback").alias("_chargeback_known"),
            F.sum("is_fraud").alias("_fraud"),
            F.count("is_fraud").alias("_fraud_known"),
        )
    )
    listed = merchants.groupBy(*_DETAILS).agg(F.count(F.lit(1)).alias("_listed"))
    rate = F.col("chargeback_rate_pct")
    out = counts.join(listed, "merchant_id").select(
        *_DETAILS,
        (F.col("_rows") * F.col("_listed")).alias("total_transactions"),
        (F.col("_chargebacks") * F.col("_listed")).alias("chargeback_count"),
        percent(F.col("_chargebacks"), F.col("_chargeback_known")).alias("chargeback_rate_pct"),
        percent(F.col("_fraud"), F.col("_fraud_known")).alias("fraud_rate_pct"),
    )
    if not include_safe:
        out = out.where(rate > warning_pct)
    status = F.when(rate > critical_pct, "CRITICAL").when(rate > warning_pct, "WARNING").otherwise("SAFE")
    return out.withColumn("status", status).orderBy(F.desc("chargeback_rate_pct"), "merchant_id")
