"""Per-user and per-user-day statistics that scores and features compare a row with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exact import cents, floor_div, money
from .skew import HOT_SHARE, attach, row_total

# Stands in for the day of a row without a time, which still has a user mean.
_NO_DAY = "DATE'0001-01-01'"


def user_profiles(df: DataFrame) -> DataFrame:
    """One row per user: rows, non-null amounts, their sum in cents and the spike limit."""
    return (
        df.where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("user_rows"),
            F.count("amount").alias("user_amounts"),
            F.sum(cents("amount")).alias("user_cents"),
        )
        .withColumn("spike_limit", spike_limit("user_cents", "user_amounts"))
    )


def spike_limit(total_cents: str, count: str) -> Column:
    """Largest amount not above three times the mean, exact.

    Amounts are whole cents, so ``amount > 3 * sum / n`` holds exactly when the amount is
    above the quotient rounded down to a cent. Decimals keep ``3 * sum`` from overflowing.
    """
    tripled = F.col(total_cents).cast("decimal(38,0)") * F.lit(3).cast("decimal(1,0)")
    limit = floor_div(tripled, F.nullif(F.col(count), F.lit(0)).cast("decimal(20,0)"))
    return (limit.cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)")


def with_spike_limit(df: DataFrame, source: DataFrame, hot_share: float = HOT_SHARE) -> DataFrame:
    """Rows of ``df`` plus the spike limit of their user over all rows of ``source``."""
    return attach(
        df,
        user_profiles(source),
        ["user_id"],
        ["spike_limit"],
        rows="user_rows",
        total=row_total(source),
        spread_by=[c for c in ("txn_id", "amount") if c in df.columns],
        hot_share=hot_share,
    )


def user_days(df: DataFrame) -> DataFrame:
    """(user_id, txn_date, day_rows, day_count, day_amounts, day_cents): mergeable by adding up.

    Rows without a time go under a day of their own, since they still have a user mean.
    """
    day = F.coalesce(F.col("txn_time").cast("date"), F.expr(_NO_DAY))
    return (
        df.where(F.col("user_id").isNotNull())
        .groupBy("user_id", day.alias("txn_date"))
        .agg(
            F.count(F.lit(1)).alias("day_rows"),
            F.count("txn_id").alias("day_count"),
            F.count("amount").alias("day_amounts"),
            F.coalesce(F.sum(cents("amount")), F.lit(0)).alias("day_cents"),
        )
    )


def with_user_day(
    df: DataFrame,
    source: DataFrame | None = None,
    hot_share: float = HOT_SHARE,
    days: DataFrame | None = None,
) -> DataFrame:
    """Rows plus ``day_count``, ``user_mean`` and ``spike_limit`` in a single shuffle of the rows.

    User totals are summed from the user-day table, where no user has more rows than days.
    ``source`` gives other rows to take the statistics from, such as a training part, and ``days``
    that table itself, one row per user and day, as a profile table keeps it.
    """
    day = F.coalesce(F.col("txn_time").cast("date"), F.expr(_NO_DAY))
    if days is None:
        source = df if source is None else source
        days, total = user_days(source), row_total(source)
    else:
        total = days.agg(F.sum("day_rows")).scalar()
    # A window rather than a join back: each user has one row per day here.
    user = Window.partitionBy("user_id")
    totals = days.select(
        "user_id",
        "txn_date",
        "day_rows",
        "day_count",
        F.sum("day_amounts").over(user).alias("user_amounts"),
        F.sum("day_cents").over(user).alias("user_cents"),
    )
    mean = money("user_cents") / F.nullif(F.col("user_amounts"), F.lit(0))
    stats = totals.select(
        "user_id",
        "txn_date",
        "day_rows",
        "day_count",
        mean.alias("user_mean"),
        spike_limit("user_cents", "user_amounts").alias("spike_limit"),
    )
    out = attach(
        df.withColumn("txn_date", day),
        stats,
        ["user_id", "txn_date"],
        ["day_count", "user_mean", "spike_limit"],
        rows="day_rows",
        total=total,
        spread_by=["txn_id"],
        hot_share=hot_share,
    )
    known_day = F.when(F.col("txn_time").isNotNull(), F.col("day_count"))
    return out.withColumn("day_count", known_day).drop("txn_date")
