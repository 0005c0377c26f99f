"""Account takeover: several signals on one row, alone or with impossible travel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signals import TAKEOVER
from .intervals import interval_join
from .skew import CELL_PAIRS, HOT_SHARE, grid_join
from .travel import SLICE_SECONDS, travel_hops


def is_takeover() -> Column:
    """All four takeover signals hold."""
    return F.expr(" AND ".join(TAKEOVER))


def takeover_rows(df: DataFrame) -> DataFrame:
    """Rows on which all four takeover signals hold; no shuffle, pushed to the scan."""
    return df.where(is_takeover())


def ato_risk(df: DataFrame, ordered: bool = True) -> DataFrame:
    """Takeover candidates, largest amount first."""
    out = takeover_rows(df).select(
        "txn_id",
        "user_id",
        F.col("amount").cast("double").alias("amount"),
        "txn_time",
        "txn_type",
        "failed_logins",
        "kyc_verified",
        "country",
        "txn_location",
        F.lit("ATO_RISK").alias("fraud_flag"),
    )
    return out.orderBy(F.desc("amount"), "txn_id") if ordered else out


def ato_geo_risk(
    df: DataFrame,
    max_hours: int = 2,
    slice_seconds: int = SLICE_SECONDS,
    hot_share: float = HOT_SHARE,
    ordered: bool = True,
    cell_pairs: int = CELL_PAIRS,
) -> DataFrame:
    """Takeover candidates with every impossible hop of the same user, whenever it was.

    Only users with a candidate can match, so the others leave before the hops are built.
    """
    candidates, hops = _suspects(df, max_hours, slice_seconds, hot_share)
    pairs = grid_join(
        candidates,
        hops.drop("hop_time"),
        ["user_id"],
        left_id="txn_id",
        right_id="hop_id",
        cell_pairs=cell_pairs,
    )
    out = pairs.select(
        "txn_id",
        "user_id",
        F.col("amount").cast("double").alias("amount"),
        F.col("txn_time").alias("ato_txn_time"),
        "failed_logins",
        "current_country",
        "prev_country",
        "hours_between",
        F.lit("ATO_GEO_RISK").alias("fraud_flag"),
    )
    return out.orderBy(F.desc("amount"), "txn_id", "hours_between") if ordered else out


def ato_travel_linked(
    df: DataFrame,
    before_hours: float = 24,
    after_hours: float = 24,
    max_hours: int = 2,
    slice_seconds: int = SLICE_SECONDS,
    hot_share: float = HOT_SHARE,
    ordered: bool = True,
    cell_pairs: int = CELL_PAIRS,
) -> DataFrame:
    """Takeover candidates with the impossible hops of the same user near them in time.

    A hop counts from ``before_hours`` before the candidate to ``after_hours`` after it, both
    included. Unlike ``ato_geo_risk``, a long history does not multiply with itself.
    """
    candidates, hops = _suspects(df, max_hours, slice_seconds, hot_share)
    pairs = interval_join(
        candidates,
        hops,
        ["user_id"],
        left_time="txn_time",
        right_time="hop_time",
        low_seconds=-before_hours * 3600,
        high_seconds=after_hours * 3600,
        left_id="txn_id",
        right_id="hop_id",
        cell_pairs=cell_pairs,
    )
    out = pairs.select(
        "txn_id",
        "user_id",
        F.col("amount").cast("double").alias("amount"),
        F.col("txn_time").alias("ato_txn_time"),
        "hop_time",
        "failed_logins",
        "current_country",
        "prev_country",
        "hours_between",
        F.lit("ATO_GEO_LINKED").alias("fraud_flag"),
    )
    return out.orderBy(F.desc("amount"), "txn_id", "hop_time") if ordered else out


def _suspects(
    df: DataFrame, max_hours: int, slice_seconds: int, hot_share: float
) -> tuple[DataFrame, DataFrame]:
    """Takeover candidates, and the hops of the users who have one."""
    candidates = takeover_rows(df).select("user_id", "txn_id", "amount", "txn_time", "failed_logins")
    suspects = df.join(candidates.select("user_id"), "user_id", "left_semi")
    hops = travel_hops(suspects, max_hours, slice_seconds, hot_share).select(
        "user_id",
        F.col("txn_id").alias("hop_id"),
        F.col("txn_time").alias("hop_time"),
        "current_country",
        "prev_country",
        "hours_between",
    )
    return candidates, hops
