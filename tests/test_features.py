import datetime as dt
import hashlib
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F
from rows import NOON, collected, frame, made, random_rows

from riskweave.operators.explore import age_bucket, fraud_by_account_age, fraud_by_kyc, overview
from riskweave.operators import features
from riskweave.operators.features import FEATURES_V1, FEATURES_V2, feature_stats, features_v1, features_v2, flag_counts
from riskweave.operators.split import class_weights, stratified_split


def pandas_frame(rows):
    pdf = pd.DataFrame(rows)
    pdf["amount"] = pdf["amount"].astype(float)
    pdf["txn_time"] = pd.to_datetime(pdf["txn_time"])
    keys = [pdf["user_id"], pdf["txn_time"].dt.date]
    pdf["day_count"] = pdf.groupby(keys)["txn_id"].transform("count")
    pdf["user_mean"] = pdf.groupby("user_id")["amount"].transform("mean")
    return pdf.set_index("txn_id")


@pytest.mark.parametrize("hot_share", [0.0, 0.1, 2.0])
def test_features_v2_equal_pandas(spark, hot_share):
    rows = random_rows(12, span_s=300_000)
    pdf = pandas_frame(rows)
    got = features_v2(frame(spark, rows), hot_share=hot_share).toPandas().set_index("txn_id").sort_index()
    assert list(got.columns) == ["is_fraud", *FEATURES_V2]
    ratio = (pdf["amount"] / pdf["user_mean"].replace(0, float("nan"))).fillna(1)
    pd.testing.assert_series_equal(got["amt_vs_avg_ratio"], ratio, check_names=False)
    pd.testing.assert_series_equal(
        got["daily_velocity"].astype(float), pdf["day_count"], check_names=False, check_dtype=False
    )
    pd.testing.assert_series_equal(got["txn_hour"].astype(float), pdf["txn_time"].dt.hour, check_names=False, check_dtype=False)
    foreign = (pdf["country"] != pdf["txn_location"]) | pdf["country"].isna() | pdf["txn_location"].isna()
    assert (got["is_foreign"] == foreign.astype(int)).all()


@pytest.mark.parametrize("hot_share", [0.0, 2.0])
def test_features_v1_equal_pandas(spark, hot_share):
    rows = random_rows(13, span_s=300_000)
    pdf = pandas_frame(rows)
    got = features_v1(frame(spark, rows), hot_share=hot_share).toPandas().set_index("txn_id").sort_index()
    assert list(got.columns) == ["is_fraud", *FEATURES_V1]
    expected = {
        "flag_high_amount": pdf["amount"] > 800,
        "flag_no_kyc": pdf["kyc_verified"] == 0,
        "flag_new_account": pdf["account_age"] < 30,
        "flag_off_hours": pdf["txn_time"].dt.hour.between(2, 5),
        "flag_velocity": pdf["day_count"] > 2,
        "flag_amt_spike": pdf["amount"] > 3 * pdf["user_mean"],
    }
    for name, column in expected.items():
        assert (got[name] == column.astype(int)).all(), name
    sums = {r.feature: r.flagged for r in flag_counts(features_v1(frame(spark, rows))).collect()}
    assert sums == {n: int(got[n].sum()) for n in FEATURES_V1}


def test_row_without_a_time_keeps_its_users_mean(spark):
    df = made(spark, {"amount": 10}, {"amount": 30, "txn_time": None})
    rows = {r.txn_id: r for r in features_v2(df).collect()}
    assert (rows[2].amt_vs_avg_ratio, rows[2].daily_velocity, rows[2].txn_hour) == (1.5, None, None)


def test_mean_of_zero_gives_ratio_one(spark):
    assert features_v2(made(spark, {"amount": 0})).first().amt_vs_avg_ratio == 1.0
    assert features_v2(made(spark, {"amount": 0}), unknown_ratio=0.0).first().amt_vs_avg_ratio == 0.0


def test_statistics_may_come_from_other_rows(spark):
    df = made(spark, {"amount": 10}, {"amount": 30})
    rows = {r.txn_id: r for r in features_v2(df, stats_from=df.where("txn_id = 1")).collect()}
    assert (rows[2].amt_vs_avg_ratio, rows[2].daily_velocity) == (3.0, 1)


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_stats_equal_pandas(spark, accuracy, n):
    rows = [
        (float(i * 7919 % 101), float(i % 2), None if i % 5 == 0 and n > 5 else i * i / 7) for i in range(n)
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(3)
    want = pd.DataFrame(rows, columns=["a", "b", "c"]).describe()
    got = {r.feature: r for r in feature_stats(df, ("a", "b", "c"), accuracy=accuracy).collect()}
    for name in ("a", "b", "c"):
        row = got[name]
        assert row["count"] == want[name]["count"]
        for ours, theirs in (("mean", "mean"), ("min", "min"), ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")):
            assert row[ours] == pytest.approx(want[name][theirs], abs=0.00501), (name, ours)
        if n > 1:
            assert row["std"] == pytest.approx(want[name]["std"], abs=0.00501)


@pytest.mark.parametrize("accuracy", [50, 1_000])
@pytest.mark.parametrize("ordered", [20, 200])
def test_stats_narrow_until_few_values_are_left(spark, accuracy, ordered):
    rng = random.Random(accuracy + ordered)
    n = 6_000
    columns = {
        "spread": [rng.random() * 1e6 for _ in range(n)],
        "crowded": [rng.choice([0.0, 0.0, 0.0, 1.0, 1.0, rng.random()]) for _ in range(n)],
        "two": [float(rng.random() < 0.25) for _ in range(n)],
        "near": [1.0 + rng.randrange(5) * 2.0**-50 for _ in range(n)],
        "holes": [rng.choice([None, None, rng.gauss(0, 1)]) for _ in range(n)],
    }
    rows = list(zip(*columns.values(), strict=True))
    schema = ", ".join(f"{name} double" for name in columns)
    df = spark.createDataFrame(rows, schema).repartition(4)
    want = pd.DataFrame(columns, dtype=float).describe()
    for r in feature_stats(df, tuple(columns), accuracy, ordered).collect():
        for ours, theirs in (("q25", "25%"), ("q50", "50%"), ("q75", "75%")):
            assert r[ours] == pytest.approx(want[r.feature][theirs], abs=0.00501), (r.feature, ours)


def test_what_is_ordered_does_not_grow(spark):
    """The values that stay in the last brackets, of 10,000 rows and of 1,000,000."""
    held = []
    for n in (10_000, 1_000_000):
        df = spark.range(n).select(((F.col("id") * 7_919) % n).cast("double").alias("v0"))
        seen = []
        original = features.F.collect_list

        def counted(column, seen=seen, original=original):
            seen.append(F.count(column))
            return original(column)

        features.F.collect_list = counted
        try:
            feature_stats(df, ("v0",))
        finally:
            features.F.collect_list = original
        held.append(max(df.agg(*seen).first()))
    assert held[0] <= features.ORDERED_VALUES and held[1] <= features.ORDERED_VALUES


def test_stats_run_one_job_first_and_keep_rows_whole(spark):
    df = spark.range(1_000).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("stats", "stats")
    try:
        out = feature_stats(df, ("a", "b"))
        assert len(jobs.getJobIdsForGroup("stats")) <= 2  # one action; Spark may run a stage as its own job
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Window" not in plan


def test_stats_of_an_unknown_column(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    rows = {r.feature: tuple(r)[1:] for r in feature_stats(df, ("a", "b")).collect()}
    assert rows == {
        "a": (2, 2.0, 1.41, 1.0, 1.5, 2.0, 2.5, 3.0),
        "b": (0, None, None, None, None, None, None, None),
    }


@pytest.mark.parametrize("test_pct", [0, 20, 100])
def test_split_is_exact_per_class(spark, test_pct):
    rows = [{"txn_id": i, "is_fraud": int(i % 13 == 0)} for i in range(1, 301)]
    df = made(spark, *rows)
    expected = set()
    for label in (0, 1):
        ids = [r["txn_id"] for r in rows if r["is_fraud"] == label]
        ids.sort(key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        expected |= set(ids[: (len(ids) * test_pct + 50) // 100])
    got = {r.txn_id for r in stratified_split(df, test_pct=test_pct).where("part = 'test'").collect()}
    assert got == expected


@pytest.mark.parametrize("hot_share", [0.0, 2.0])
def test_split_with_unknown_keys_and_labels(spark, hot_share):
    rows = [(None if k < 600 else k, k % 2 if k % 5 else None, k) for k in range(1_000)]
    df = spark.createDataFrame(rows, "txn_id long, is_fraud int, x long").repartition(5)
    got = stratified_split(df, hot_share=hot_share)
    assert got.count() == 1_000
    counts = {(r.is_fraud, r.known, r.part): r["count"] for r in got.groupBy(
        "is_fraud", F.col("txn_id").isNotNull().alias("known"), "part").count().collect()}
    for label in (0, 1, None):
        known = sum(1 for key, y, _ in rows if key is not None and y == label)
        assert counts[label, True, "test"] == (known * 20 + 50) // 100
        assert (label, False, "test") not in counts


def test_split_divides_repeated_keys(spark):
    df = spark.createDataFrame([(7, 0, k) for k in range(100)], "txn_id long, is_fraud int, x long")
    assert stratified_split(df).where("part = 'test'").count() == 20


def test_split_refuses_equal_rows_on_both_sides(spark):
    df = spark.createDataFrame([(7, 0)] * 100, "txn_id long, is_fraud int")
    with pytest.raises(Exception, match="tells them apart"):
        stratified_split(df).collect()
    assert stratified_split(df, test_pct=100).where("part = 'test'").count() == 100


@pytest.mark.parametrize("hot_share", [0.0, 2.0])
def test_split_of_many_classes_by_any_key(spark, hot_share):
    rows = [(f"k{k}", f"class {k % 40}") for k in range(400)]
    df = spark.createDataFrame(rows, "name string, kind string")
    got = stratified_split(df, label="kind", key="name", hot_share=hot_share)
    assert {r["count"] for r in got.where("part = 'test'").groupBy("kind").count().collect()} == {2}


def test_split_depends_on_the_seed(spark):
    df = made(spark, *[{} for _ in range(100)])
    parts = [
        {r.txn_id for r in stratified_split(df, seed=s).where("part = 'test'").collect()} for s in (42, 42, 43)
    ]
    assert parts[0] == parts[1] != parts[2]


def test_class_weights(spark):
    df = made(spark, *[{"is_fraud": int(i == 0)} for i in range(5)])
    assert tuple(class_weights(df).first()) == (4, 1, 4.0)
    assert class_weights(df.where("is_fraud = 0")).first().pos_weight is None


AGES = [(0, 0), (30, 0), (31, 1), (90, 1), (91, 2), (365, 2), (366, 3), (None, 3), (-1, 3)]


def test_age_buckets(spark):
    names = ["0-30 days (New)", "31-90 days", "91-365 days", "365+ days (Established)"]
    df = made(spark, *[{"account_age": a} for a, _ in AGES])
    got = {r.txn_id: r.b for r in df.select("txn_id", age_bucket().alias("b")).collect()}
    assert got == {i: names[b] for i, (_, b) in enumerate(AGES, start=1)}
    counts = {r.age_bucket: r.total_transactions for r in fraud_by_account_age(df).collect()}
    assert counts == Counter(names[b] for _, b in AGES)


def test_unknown_kyc_is_a_row_of_its_own(spark):
    df = made(spark, {"kyc_verified": 1}, {"kyc_verified": 0}, {"kyc_verified": None, "is_fraud": 1})
    assert [tuple(r) for r in fraud_by_kyc(df).collect()] == [
        ("KYC Not Verified", 1, 100.0),
        ("KYC Not Verified", 1, 0.0),
        ("KYC Verified", 1, 0.0),
    ]


def test_overview(spark):
    df = made(spark, {"amount": 10.10, "is_fraud": 1}, {"amount": 20.20}, {"amount": None})
    assert tuple(overview(df).first()) == (3, 1, 33.33, 30.3, 10.1)


def test_days_end_at_midnight(spark):
    late = dt.datetime(2024, 3, 5, 23, 59, 59)
    df = made(spark, {"txn_time": late}, {"txn_time": late + dt.timedelta(seconds=1)}, {"txn_time": NOON})
    got = dict(collected(features_v2(df).select("txn_id", F.col("daily_velocity")), "txn_id", "daily_velocity"))
    assert got == {1: 2, 2: 1, 3: 2}
