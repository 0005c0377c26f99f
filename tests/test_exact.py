import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskweave.functions import exact


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("num", "den", "expected"),
    [(1, 8, 12.5), (1, 3, 33.33), (2, 3, 66.67), (1, 800, 0.13), (0, 5, 0.0), (5, 5, 100.0), (3, 0, None)],
)
def test_percent_rounds_halves_up(spark, num, den, expected):
    assert one(spark, exact.percent(F.col("n"), F.col("d")), n=num, d=den) == expected


@pytest.mark.parametrize(("num", "den", "tenths"), [(1, 8, 125), (1, 16, 62), (3, 16, 188), (1, 3, 333), (1, 1, 1000)])
def test_tenths_round_halves_to_even(spark, num, den, tenths):
    assert one(spark, exact.percent_1dp(F.col("n"), F.col("d")), n=num, d=den) == tenths


@pytest.mark.parametrize(("num", "expected"), [(7, 3), (-7, -4), (8, 4), (-8, -4)])
def test_floor_division_of_decimals(spark, num, expected):
    wide = F.col("n").cast("decimal(38,0)")
    assert one(spark, exact.floor_div(wide, F.lit(2).cast("decimal(20,0)")), n=num) == expected


def test_times_ignore_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # The clocks skip an hour between these two.
        df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 01:30:00' AS a, TIMESTAMP_NTZ'2024-03-10 03:29:59.9' AS b")
        row = df.select(
            exact.minutes_between(F.col("a"), F.col("b")).alias("m"), exact.epoch_second(F.col("b")).alias("s")
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert row.m == 119
    assert row.s == int(dt.datetime(2024, 3, 10, 3, 29, 59, tzinfo=dt.UTC).timestamp())


def test_money_round_trip(spark):
    df = spark.sql("SELECT CAST(9999999999.99 AS DECIMAL(12,2)) AS a")
    row = df.select(exact.cents("a").alias("c"), exact.money(exact.cents("a")).alias("m")).first()
    assert (row.c, row.m) == (999999999999, 9999999999.99)
