"""The grid join and the interval join against nested loops, and how they spread their work."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from rows import NOON

from riskweave.operators.intervals import interval_join
from riskweave.operators.skew import grid_join


def sides(seed, n=120, users=5):
    rng = random.Random(seed)
    pick = lambda: rng.choice([None, 1, 1, 1, *range(2, users)])
    left = [(pick(), rng.choice(["a", "b", None]), k) for k in range(n)]
    right = [(pick(), rng.choice(["a", "b", None]), k) for k in range(n // 2)]
    return left, right


@pytest.mark.parametrize("cell_pairs", [1, 300, 10**9])
def test_grid_join_equals_a_join(spark, cell_pairs):
    left, right = sides(cell_pairs)
    a = spark.createDataFrame(left, "u long, s string, l long")
    b = spark.createDataFrame(right, "u long, s string, r long")
    for keys in (["u"], ["u", "s"]):
        mine = b if len(keys) == 2 else b.drop("s")
        got = grid_join(a, mine, keys, left_id="l", right_id="r", cell_pairs=cell_pairs)
        want = a.join(mine, keys)
        assert sorted(got.columns) == sorted(want.columns)
        names = sorted(want.columns)
        assert sorted(map(repr, got.select(names).collect())) == sorted(map(repr, want.select(names).collect()))
    assert grid_join(a.limit(0), b.drop("s"), ["u"], left_id="l", right_id="r").count() == 0


def moments(rng, n):
    steps = (0, 1, 1_000_000, 3_599_999_999, 3_600_000_000, 3_600_000_001, 7_200_000_000)
    times = [NOON + dt.timedelta(microseconds=rng.choice(steps) + rng.choice(steps)) for _ in range(n)]
    return [None if rng.random() < 0.05 else t for t in times]


@pytest.mark.parametrize("cell_pairs", [1, 10**9])
@pytest.mark.parametrize(("low", "high"), [(-3600, 0), (0, 0), (3600, 7200), (0.000001, 0.000001), (-10**6, 10**6)])
def test_interval_join_equals_a_nested_loop(spark, low, high, cell_pairs):
    rng = random.Random(3)
    users = lambda n: [rng.choice([None, 1, 1, 2]) for _ in range(n)]
    left = list(zip(users(60), moments(rng, 60), range(60), strict=True))
    right = list(zip(users(50), moments(rng, 50), range(50), strict=True))
    a = spark.createDataFrame(left, "u long, t timestamp_ntz, l long")
    b = spark.createDataFrame(right, "u long, v timestamp_ntz, r long")
    got = interval_join(
        a, b, ["u"], left_time="t", right_time="v", low_seconds=low, high_seconds=high,
        left_id="l", right_id="r", cell_pairs=cell_pairs,
    )
    micro = dt.timedelta(microseconds=1)
    want = sorted(
        (i, j)
        for u, t, i in left
        for w, v, j in right
        if u is not None and u == w and t and v and round(low * 10**6) <= (v - t) // micro <= round(high * 10**6)
    )
    assert sorted((r.l, r.r) for r in got.collect()) == want


def test_interval_join_refuses_what_it_cannot_do(spark):
    df = spark.createDataFrame([(1, NOON, 1)], "u long, t timestamp_ntz, l long")
    with pytest.raises(ValueError, match="ends before"):
        interval_join(df, df, ["u"], left_time="t", right_time="t", low_seconds=1, high_seconds=0, left_id="l", right_id="l")
    with pytest.raises(ValueError, match="both sides: l, t"):
        interval_join(df, df, ["u"], left_time="t", right_time="t", low_seconds=0, high_seconds=1, left_id="l", right_id="l")


@pytest.fixture
def plain(spark):
    """Joins by shuffle into 16 partitions, none of which is split or merged at run time."""
    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def largest_share(df):
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(counts) / sum(counts)


def test_a_quiet_key_with_many_partners_is_spread(spark, plain):
    # One key has 1 of 40,000 rows on the left, less than 1/20,000 of them, and 100,000 on the right.
    a = spark.range(40_000).select(F.when(F.col("id") < 1, 0).otherwise(F.col("id")).alias("u"), F.col("id").alias("l"))
    b = spark.range(100_000).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("r"))
    out = grid_join(a, b, ["u"], left_id="l", right_id="r")
    assert out.count() == 100_000
    assert largest_share(out) < 0.2


def test_two_long_sides_are_spread(spark, plain):
    a = spark.range(1_000).select(F.lit(7).cast("long").alias("u"), F.col("id").alias("l"))
    b = spark.range(1_000).select(F.lit(7).cast("long").alias("u"), F.col("id").alias("r"))
    out = grid_join(a, b, ["u"], left_id="l", right_id="r")
    assert out.count() == 10**6
    assert largest_share(out) < 0.2


def test_one_busy_bucket_is_spread(spark, plain):
    moment = F.lit("2024-03-05 12:00:00").cast("timestamp_ntz")
    a = spark.range(800).select(F.lit(1).cast("long").alias("u"), moment.alias("t"), F.col("id").alias("l"))
    b = spark.range(800).select(F.lit(1).cast("long").alias("u"), moment.alias("v"), F.col("id").alias("r"))
    out = interval_join(
        a, b, ["u"], left_time="t", right_time="v", low_seconds=-60, high_seconds=60, left_id="l", right_id="r"
    )
    assert out.count() == 640_000
    assert largest_share(out) < 0.2
