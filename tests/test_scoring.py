import datetime as dt
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from rows import NOON, collected, frame, made, random_rows

from riskweave.operators import metrics, scoring, summaries
from riskweave.operators.profiles import user_profiles, with_spike_limit

LOUD = {
    "failed_logins": 3,
    "amount": 801,
    "kyc_verified": 0,
    "risk_segment": "High",
    "merchant_cat": "Crypto",
    "txn_location": "UK",
    "account_age": 29,
    "txn_time": dt.datetime(2024, 3, 5, 2, 0),
    "txn_type": "CNP",
}
# Small rows of the same user that push the mean below a third of 801.
SMALL = [{"amount": 0.01} for _ in range(4)]


def scores(df, operator, name):
    return dict(collected(operator(df), "txn_id", name))


def test_all_and_no_signals(spark):
    df = made(spark, LOUD, *SMALL, {"user_id": 2})
    assert scores(df, scoring.soft_score, "soft_score")[1] == 62
    assert scores(df, scoring.risk_score, "risk_score")[1] == 97
    assert scores(df, scoring.soft_score, "soft_score")[6] == 0


@pytest.mark.parametrize(
    ("change", "decision"),
    [
        ({"amount": 900, "kyc_verified": 0, "account_age": 3}, "APPROVE"),  # 10 + 9 + 5
        ({"amount": 900, "kyc_verified": 0, "country": "UK"}, "REVIEW"),  # 10 + 9 + 6
    ],
)
def test_review_cut(spark, change, decision):
    df = made(spark, change)
    assert scores(df, scoring.hybrid_decisions, "decision") == {1: decision}


@pytest.mark.parametrize(
    ("change", "score", "tier"),
    [
        ({"failed_logins": 3, "kyc_verified": 0, "account_age": 3}, 49, "MEDIUM"),
        ({"failed_logins": 3, "amount": 900, "account_age": 3}, 50, "HIGH"),
    ],
)
def test_block_cut(spark, change, score, tier):
    rows = collected(scoring.score_decisions(made(spark, change)), "risk_score", "risk_tier")
    assert rows == [(score, tier)]


@pytest.mark.parametrize(
    ("change", "blocked"),
    [
        ({"failed_logins": 6}, True),
        ({"failed_logins": 5}, False),
        ({"failed_logins": 3, "kyc_verified": 0}, True),
        ({"failed_logins": 2, "kyc_verified": 0}, False),
        ({"failed_logins": 3, "amount": 800.01}, True),
        ({"failed_logins": 3, "amount": 800}, False),
        ({"failed_logins": 3, "kyc_verified": None}, False),
        ({"risk_segment": "High", "kyc_verified": 0, "merchant_cat": "Gaming"}, True),
        ({"risk_segment": "High", "kyc_verified": 0, "merchant_cat": "Travel"}, False),
        ({"risk_segment": "High", "kyc_verified": 1, "merchant_cat": "Crypto"}, False),
        ({"failed_logins": None, "kyc_verified": None, "merchant_cat": None}, False),
    ],
)
def test_hard_rule_bounds(spark, change, blocked):
    label = scores(made(spark, change), scoring.hard_rules, "hard_rule")[1]
    assert label == ("HARD_BLOCK" if blocked else "SCORE")


@pytest.mark.parametrize(("hour", "points"), [(1, 0), (2, 5), (5, 5), (6, 0)])
def test_off_hours(spark, hour, points):
    df = made(spark, {"txn_time": dt.datetime(2024, 3, 5, hour, 59, 59)})
    assert scores(df, scoring.soft_score, "soft_score") == {1: points}


def test_unknown_keys_leave_unknown_values_stay(spark):
    df = made(spark, {"user_id": None}, {"txn_time": None}, {"country": None, "amount": None, "account_age": None})
    assert scores(df, scoring.soft_score, "soft_score") == {3: 0}


def test_three_times_the_mean_is_not_above_it(spark):
    # 0.30 is exactly three times the mean of 0.30, 0, 0; in binary fractions it would not be.
    df = made(spark, {"amount": 0.30}, {"amount": 0}, {"amount": 0})
    assert scores(df, scoring.soft_score, "soft_score") == {1: 0, 2: 0, 3: 0}
    df = made(spark, {"amount": 0.31}, {"amount": 0}, {"amount": 0}, {"amount": 0})
    assert scores(df, scoring.soft_score, "soft_score")[1] == 5


def test_spike_limit_of_refunds_rounds_down(spark):
    df = made(spark, {"amount": -0.01}, {"amount": 0})
    # Three times the mean is -1.5 cents; the largest amount not above it is -2 cents.
    assert float(user_profiles(df).first().spike_limit) == -0.02


@pytest.mark.parametrize("hot_share", [0.0, 0.1, 0.3, 2.0])
def test_lookup_is_the_same_for_hot_and_cold_keys(spark, hot_share):
    rows = random_rows(7)
    df = frame(spark, rows)
    sums, counts = Counter(), Counter()
    for r in rows:
        if r["amount"] is not None:
            sums[r["user_id"]] += int(r["amount"] * 100)
            counts[r["user_id"]] += 1
    expected = sorted(
        (
            (r["txn_id"], None if r["user_id"] is None else 3 * sums[r["user_id"]] // counts[r["user_id"]])
            for r in rows
        ),
        key=repr,
    )
    got = with_spike_limit(df, df, hot_share).select("txn_id", (F.col("spike_limit") * 100).cast("int").alias("c"))
    assert collected(got) == expected


def tallied(rows, column, hard=None):
    out = defaultdict(Counter)
    for r in rows:
        key = r[column]
        out[key]["total"] += 1
        out[key]["fraud"] += r["is_fraud"]
    return {k: (v["total"], v["fraud"]) for k, v in out.items()}


@pytest.mark.parametrize("hot_share", [0.0, 0.2, 2.0])
@pytest.mark.parametrize("seed", [1, 2])
def test_tallies_equal_the_rows(spark, seed, hot_share):
    df = frame(spark, random_rows(seed, n=700))
    for rows_of, tally in (
        (scoring.hybrid_decisions, scoring.tally_hybrid),
        (scoring.score_decisions, scoring.tally_score),
    ):
        rows = rows_of(df, hot_share=hot_share).select("txn_id", "decision").join(df, "txn_id")
        expected = tallied([r.asDict() for r in rows.collect()], "decision")
        got = {r.decision: (r.total, r.fraud) for r in tally(df, hot_share=hot_share).collect()}
        assert got == expected
        assert len(got) == 3


@pytest.mark.parametrize("seed", [3, 4])
def test_summaries_agree_with_each_other(spark, seed):
    df = frame(spark, random_rows(seed, n=700))
    kept = df.where("user_id IS NOT NULL AND txn_time IS NOT NULL")
    summary = summaries.hybrid_summary(df).collect()
    assert [r.decision for r in summary] == ["BLOCK", "REVIEW", "APPROVE"]
    assert sum(r.total_txns for r in summary) == kept.count()
    by_name = {r.decision: r for r in summary}
    assert by_name["APPROVE"].false_positives == 0
    assert by_name["APPROVE"].approval_rate_pct == 100.0
    for r in summary[:2]:
        assert abs(r.fraud_rate_pct + r.fp_rate_pct - 100) < 0.011
    recall = summaries.recall_summary(scoring.tally_hybrid(df)).first()
    assert recall.caught_block == by_name["BLOCK"].fraud_count
    assert recall.total_fraud == sum(r.fraud_count for r in summary)
    engines = {r.version: r for r in summaries.engine_comparison(df).collect()}
    score = {r.decision: r for r in summaries.score_summary(df).collect()}
    assert engines["V3"].block_count == by_name["BLOCK"].total_txns
    assert engines["V3"].overall_recall == recall.recall_pct
    assert engines["V2"].block_count == score["BLOCK"].total_txns
    assert engines["V2"].block_precision == score["BLOCK"].fraud_rate_pct
    assert engines["V2"].block_fp_rate == score["BLOCK"].fp_rate_pct


def test_empty_decisions_count_as_nothing(spark):
    df = made(spark, {"is_fraud": 1})
    row = summaries.recall_summary(scoring.tally_hybrid(df)).first()
    assert (row.caught_block, row.caught_review, row.missed, row.recall_pct) == (0, 0, 1, 0.0)
    engines = summaries.engine_comparison(df).collect()
    assert [(r.block_count, r.block_precision, r.overall_recall) for r in engines] == [(0, None, 0.0)] * 2


def test_weights_are_arguments(spark):
    df = made(spark, {"txn_type": "CNP"}, {"amount": 900})
    got = dict(collected(scoring.risk_score(df, {"cnp": 40, "high_amount": 3}), "txn_id", "risk_score"))
    assert got == {1: 40, 2: 3}
    with pytest.raises(ValueError, match="unknown signals"):
        scoring.risk_score(df, {"no_such": 1})


@pytest.mark.parametrize("seed", [5, 6])
def test_sweep_equals_flagging_rows(spark, seed):
    df = frame(spark, random_rows(seed, n=500))
    rows = scoring.risk_score(df).collect()
    fraud = sum(r.is_fraud for r in rows)
    got = metrics.threshold_sweep_score(df).collect()
    expected = []
    for t in range(35, 98, 5):
        hit = [r.is_fraud for r in rows if r.risk_score >= t]
        if hit:
            p, c = sum(hit) / len(hit), sum(hit) / fraud
            f1 = 2 * p * c / (p + c) if p + c else 0.0
            expected.append((t, p, c, f1, (len(hit) - sum(hit)) / len(hit) * 100, sum(hit), fraud - sum(hit)))
    assert [tuple(r) for r in got] == expected
    recalls = [r.recall for r in got]
    assert recalls == sorted(recalls, reverse=True)
    best = metrics.best_threshold(metrics.threshold_sweep_score(df)).first()
    top = max(expected, key=lambda e: e[3])
    assert best.threshold == top[0]


def test_rows_at_noon_score_by_default(spark):
    assert scores(made(spark, {"txn_time": NOON}), scoring.soft_score, "soft_score") == {1: 0}
