"""Exposure reports per segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import cents, money, percent


def overview(df: DataFrame) -> DataFrame:
    """Size, label rate and money of the whole table, one row."""
    return _rates(df.groupBy(), with_amount=True).select(
        "total_transactions",
        F.col("fraud_count").alias("total_fraud"),
        "fraud_rate_pct",
        "total_amount",
        F.col("fraud_amount").alias("total_fraud_amount"),
    )


def segment_rates(df: DataFrame, segment: Column | str, name: str, with_fraud_amount: bool = True) -> DataFrame:
    """Count, fraud and rate per segment, worst first."""
    segment = F.col(segment) if isinstance(segment, str) else segment
    out = _rates(df.groupBy(segment.alias(name)))
    columns = [name, "total_transactions", "fraud_count", "fraud_rate_pct"]
    if with_fraud_amount:
        columns.append("fraud_amount")
    return out.select(*columns).orderBy(F.desc("fraud_rate_pct"), name)


def fraud_by_txn_type(df: DataFrame) -> DataFrame:
    return segment_rates(df, "txn_type", "txn_type")


def fraud_by_merchant_cat(df: DataFrame) -> DataFrame:
    return segment_rates(df, "merchant_cat", "merchant_cat")


def fraud_by_account_age(df: DataFrame) -> DataFrame:
    return segment_rates(df, age_bucket(), "age_bucket", with_fraud_amount=False)


def age_bucket() -> Column:
    """Bucket of the account's age in days; unknown and negative ages fall in the last one."""
    age = F.col("account_age")
    return (
        F.when(age.between(0, 30), "0-30 days (New)")
        .when(age.between(31, 90), "31-90 days")
        .when(age.between(91, 365), "91-365 days")
        .otherwise("365+ days (Established)")
    )


def fraud_by_kyc(df: DataFrame) -> DataFrame:
    """Grouped on the raw flag, so 0 and unknown give two rows with the same label."""
    label = F.when(F.col("kyc_verified") == 1, "KYC Verified").otherwise("KYC Not Verified")
    return (
        _rates(df.groupBy("kyc_verified"))
        .select(label.alias("kyc_status"), "total_transactions", "fraud_rate_pct")
        .orderBy(F.desc("fraud_rate_pct"), "kyc_status")
    )


def _rates(groups, with_amount: bool = False) -> DataFrame:
    fraud = F.col("is_fraud") == 1
    measures = [
        F.count(F.lit(1)).alias("total_transactions"),
        F.count("is_fraud").alias("_labelled"),
        F.sum("is_fraud").alias("_label_sum"),
        F.count(F.when(fraud, 1)).alias("fraud_count"),
        F.sum(F.when(fraud, cents("amount")).otherwise(0)).alias("_fraud_cents"),
    ]
    if with_amount:
        measures.append(F.sum(cents("amount")).alias("_cents"))
    out = (
        groups.agg(*measures)
        .withColumn("fraud_rate_pct", percent(F.col("_label_sum"), F.col("_labelled")))
        .withColumn("fraud_amount", money("_fraud_cents"))
    )
    return out.withColumn("total_amount", money("_cents")) if with_amount else out
