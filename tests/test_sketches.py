"""Card sketches per day, merged over any days, against exact counts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from rows import NOON, collected, frame, random_rows

from riskweave.operators.card_sketches import BOUND, card_estimates, daily_card_sketches, merge_days, weekly_cards


def many_cards(spark, n=60_000):
    """Three ranges over 40 days; cards come back on several days."""
    day = (F.col("id") % 40).cast("int")
    return spark.range(n).select(
        F.col("id").alias("txn_id"),
        F.make_dt_interval(day).alias("gap"),
        F.concat(
            F.lit("40000"), (F.col("id") % 3).cast("string"), F.lpad((F.col("id") * 7 % 9_000).cast("string"), 10, "0")
        ).alias("card_number"),
        F.when(F.col("id") % 4 == 0, "declined").otherwise("approved").alias("status"),
    ).withColumn("txn_time", F.lit(NOON).cast("timestamp_ntz") + F.col("gap"))


def exact(df, start):
    return {
        (r.s, r.bin): (r.n, r.cards)
        for r in df.groupBy(start.alias("s"), F.left("card_number", F.lit(6)).alias("bin"))
        .agg(F.count("*").alias("n"), F.countDistinct("card_number").alias("cards"))
        .collect()
    }


@pytest.mark.parametrize("window", ["week", "month"])
def test_merged_days_estimate_the_distinct_cards(spark, tmp_path, window):
    df = many_cards(spark)
    daily_card_sketches(df).write.partitionBy("txn_date").parquet(str(tmp_path / "days"))
    stored = spark.read.parquet(str(tmp_path / "days"))  # the cards are not read again
    merged = card_estimates(merge_days(stored, F.trunc("txn_date", window)))
    want = exact(df, F.trunc(F.col("txn_time").cast("date"), window))
    rows = merged.collect()
    assert {(r.window_start, r.bin) for r in rows} == set(want)
    for r in rows:
        n, cards = want[r.window_start, r.bin]
        assert r.attempts == n
        assert abs(r.estimated_cards - cards) <= BOUND * cards


def test_any_stretch_of_days_can_be_merged(spark):
    df = many_cards(spark, 20_000)
    some = F.col("txn_date").between(NOON.date() + dt.timedelta(days=3), NOON.date() + dt.timedelta(days=9))
    merged = card_estimates(merge_days(daily_card_sketches(df).where(some), F.lit(NOON.date())))
    days = df.where(F.col("txn_time").cast("date").between(NOON.date() + dt.timedelta(days=3), NOON.date() + dt.timedelta(days=9)))
    want = exact(days, F.lit(NOON.date()))
    for r in merged.collect():
        assert abs(r.estimated_cards - want[r.window_start, r.bin][1]) <= BOUND * want[r.window_start, r.bin][1]


def test_weeks_are_checked_against_exact_counts(spark):
    df = frame(spark, random_rows(71, n=400, span_s=30 * 86_400))
    rows = weekly_cards(df).collect()
    known = df.where("txn_time IS NOT NULL AND card_number IS NOT NULL")
    want = exact(known, F.trunc(F.col("txn_time").cast("date"), "week"))
    assert {(r.window_start, r.bin): (r.attempts, r.exact_cards) for r in rows} == want
    assert all(r.within_bound and r.window_start.weekday() == 0 for r in rows)
    assert collected(weekly_cards(df.limit(0))) == []
