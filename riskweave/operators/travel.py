"""Consecutive transactions of a user in two countries too soon after each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exact import epoch_second, minutes_between, ratio_2dp
from .skew import HOT_SHARE, row_total

# Width of the time slices a hot user's history is cut into, in seconds.
SLICE_SECONDS = 10


def impossible_travel(
    df: DataFrame,
    max_hours: int = 2,
    slice_seconds: int = SLICE_SECONDS,
    ordered: bool = True,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Hops to another country in less than ``max_hours`` hours."""
    out = travel_hops(df, max_hours, slice_seconds, hot_share).select(
        "user_id",
        F.col("txn_time").alias("current_txn_time"),
        "prev_txn_time",
        F.col("hours_between").alias("hours_between_txn"),
        "current_country",
        "prev_country",
        F.lit("GEO_VELOCITY").alias("fraud_flag"),
    )
    return out.orderBy("hours_between_txn", "user_id", "current_txn_time") if ordered else out


def travel_hops(
    df: DataFrame,
    max_hours: int = 2,
    slice_seconds: int = SLICE_SECONDS,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Each qualifying row with its predecessor, by time and ``txn_id`` within the user.

    Rows are shuffled once, by user. Only a user with more than ``hot_share`` of all rows is cut
    into time slices: within a slice the predecessor is known but for the first row, whose
    predecessor is the last row of an earlier slice. A second window carries these last rows over
    to the first ones; besides them it only sees hops that are already found.
    """
    moment = F.col("txn_time").cast("timestamp_ntz")
    known = df.where(F.col("txn_time").isNotNull())
    hot = (
        known.groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > row_total(known) * hot_share)
        # Rows without a user form one group too, which may be hot.
        .select(F.col("user_id").alias("_hot_user"), F.lit(True).alias("_hot"))
    )
    rows = (
        known.select("user_id", "txn_id", moment.alias("txn_time"), "country")
        # Of bounded size, see HOT_SHARE.
        .join(F.broadcast(hot), F.col("user_id").eqNullSafe(F.col("_hot_user")), "left")
        .withColumn("slice", F.when(F.col("_hot"), F.floor(epoch_second(F.col("txn_time")) / slice_seconds)))
        .drop("_hot_user", "_hot")
    )
    # Rows that arrive partitioned by user, as after a join, would satisfy the window as they are.
    rows = rows.repartition("user_id", "slice")
    in_slice = Window.partitionBy("user_id", "slice").orderBy("txn_time", "txn_id")
    here = F.struct("txn_time", "country")
    near = rows.select(
        "*",
        F.lag(here).over(in_slice).alias("prev"),
        F.lead(F.lit(1)).over(in_slice).isNull().alias("last"),
    )
    edge = F.col("slice").isNotNull() & (F.col("prev").isNull() | F.col("last"))
    kept = near.where(edge | _is_hop(max_hours))
    across = Window.partitionBy("user_id", F.when(~edge, F.col("slice"))).orderBy("txn_time", "txn_id")
    linked = kept.withColumn("prev", F.coalesce(F.col("prev"), F.lag(here).over(across)))
    minutes = minutes_between(F.col("prev.txn_time"), F.col("txn_time"))
    return linked.where(_is_hop(max_hours)).select(
        "user_id",
        "txn_id",
        "txn_time",
        F.col("prev.txn_time").alias("prev_txn_time"),
        ratio_2dp(minutes, F.lit(60)).alias("hours_between"),
        F.col("country").alias("current_country"),
        F.col("prev.country").alias("prev_country"),
    )


def _is_hop(max_hours: int) -> Column:
    """Rounded hours stay below a whole number exactly as whole minutes do."""
    soon = minutes_between(F.col("prev.txn_time"), F.col("txn_time")) < max_hours * 60
    return (F.col("country") != F.col("prev.country")) & soon
