"""Users with many transactions in a day or in the preceding hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.exact import cents, epoch_second, money

_HOUR = 3600
_SUMS = ("rows", "cents", "amounts")
_GONE_SECOND, _OWN, _GONE = 0, 1, 2


def daily_velocity(df: DataFrame, ordered: bool = True) -> DataFrame:
    """User-days with more than one transaction."""
    out = (
        df.groupBy("user_id", F.col("txn_time").cast("date").alias("txn_date"))
        .agg(F.count(F.lit(1)).alias("daily_txn_count"), F.sum(cents("amount")).alias("_cents"))
        .where("daily_txn_count > 1")
        .select(
            "user_id",
            "txn_date",
            "daily_txn_count",
            money("_cents").alias("daily_amount"),
            F.lit("HIGH_VELOCITY").alias("fraud_flag"),
        )
    )
    # The keys break ties, so that the range sort can cut runs of equal counts.
    return out.orderBy(F.desc("daily_txn_count"), "user_id", "txn_date") if ordered else out


def rolling_velocity_1h(df: DataFrame, ordered: bool = True) -> DataFrame:
    """Per user and time, the transactions of the hour up to it, both ends included.

    Equal to joining each row with its user's rows of the last hour: with ``k`` rows at one
    moment and ``n`` in its hour the join counts ``k * n``. No pairs are formed here. The
    hour is the sum of three parts, each a running total: the moment's own second up to the
    moment, the 3599 whole seconds before that, and what is left of the second that is one
    hour older. Window groups are thus bounded for any user: two seconds of distinct moments
    in the fine step, two hours of seconds in the coarse one.
    """
    moments = (
        df.where(F.col("user_id").isNotNull() & F.col("txn_time").isNotNull())
        .groupBy("user_id", F.col("txn_time").cast("timestamp_ntz").alias("moment"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(cents("amount")), F.lit(0)).alias("cents"),
            F.count("amount").alias("amounts"),
        )
        .withColumn("second", epoch_second(F.col("moment")))
    )
    hour_ago = F.expr("moment + INTERVAL 1 HOUR")
    events = moments.select(
        "user_id",
        *_SUMS,
        F.explode(
            F.array(
                F.struct(F.lit(_OWN).alias("kind"), "second", "moment"),
                F.struct(
                    F.lit(_GONE).alias("kind"),
                    (F.col("second") + _HOUR).alias("second"),
                    hour_ago.alias("moment"),
                ),
            )
        ).alias("e"),
    ).select("user_id", "e.*", *_SUMS)
    inner = _whole_seconds(moments).select(
        "user_id",
        F.lit(None).cast("int").alias("kind"),
        "second",
        F.lit(None).cast("timestamp_ntz").alias("moment"),
        *_SUMS,
    )
    group = Window.partitionBy("user_id", "second").orderBy("moment", "kind")
    hour_sums = [_total(c, group, Window.currentRow).alias(f"sum_{c}") for c in _SUMS]
    # Asked for, because rows already partitioned by user would satisfy the window as they are.
    hits = (
        events.unionByName(inner)
        .repartition("user_id", "second")
        .select("user_id", "kind", "moment", "rows", *hour_sums)
        .where((F.col("kind") == _OWN) & (F.col("rows") * F.col("sum_rows") > 1))
    )
    out = hits.select(
        "user_id",
        F.col("moment").alias("txn_time"),
        (F.col("rows") * F.col("sum_rows")).alias("txns_last_1hr"),
        F.when(F.col("sum_amounts") > 0, money(F.col("rows") * F.col("sum_cents"))).alias("amount_last_1hr"),
        F.lit("HIGH_VELOCITY_1HR").alias("fraud_flag"),
    )
    return out.orderBy(F.desc("txns_last_1hr"), "user_id", "txn_time") if ordered else out


def _whole_seconds(moments: DataFrame) -> DataFrame:
    """Per user and second, the sums over the 3599 seconds before it, where there are any."""
    seconds = moments.groupBy("user_id", "second").agg(*[F.sum(c).alias(c) for c in _SUMS])
    events = seconds.select(
        "user_id",
        *_SUMS,
        F.explode(
            F.array(
                F.struct(F.lit(_OWN).alias("kind"), "second"),
                F.struct(F.lit(_GONE_SECOND).alias("kind"), (F.col("second") + _HOUR).alias("second")),
            )
        ).alias("e"),
    ).select("user_id", "e.*", *_SUMS, F.floor(F.col("e.second") / _HOUR).alias("hour"))
    group = Window.partitionBy("user_id", "hour").orderBy("second", "kind")
    sums = [_total(c, group, -1).alias(f"sum_{c}") for c in _SUMS]
    return (
        events.repartition("user_id", "hour")
        .select("user_id", "kind", "second", *sums)
        .where((F.col("kind") == _OWN) & (F.col("sum_rows") > 0))
        .select("user_id", "second", *[F.col(f"sum_{c}").alias(c) for c in _SUMS])
    )


def _total(name: str, group: WindowSpec, last: int) -> Column:
    """Everything carried into the group, plus what has come, minus what has left by then.

    Both frames share one order, so that the group is sorted once.
    """
    value = F.col(name)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = F.sum(F.when(F.col("kind") == _OWN, 0).otherwise(value)).over(whole)
    moved = (
        F.when(F.col("kind") == _OWN, value)
        .when(F.col("kind").isin(_GONE, _GONE_SECOND), -value)
        .otherwise(0)
    )
    running = group.rowsBetween(Window.unboundedPreceding, last)
    return carried + F.coalesce(F.sum(moved).over(running), F.lit(0))
