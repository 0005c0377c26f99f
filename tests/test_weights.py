import pytest

from riskweave.functions.signals import RISK_WEIGHTS
from riskweave.operators.scoring import risk_score
from riskweave.operators.weights import signal_weights, weights_linear, weights_minmax
from rows import collected, made

PUBLISHED = {
    "failed_logins": 0.605,
    "amount": 0.113,
    "kyc_verified": 0.082,
    "flag_high_risk_seg": 0.078,
    "flag_risky_merchant": 0.062,
    "is_foreign": 0.031,
    "smallest": 0.007,
    "daily_velocity": 0.0,
}


def table(spark, importances):
    return spark.createDataFrame(list(importances.items()), "feature string, importance double")


def weights(df):
    return dict(collected(df, "feature", "sql_weight"))


def test_published_importances_give_the_engine_weights(spark):
    got = weights(weights_minmax(table(spark, PUBLISHED)))
    assert list(got.values()) == [10, 0, 35, 9, 8, 6, 9, 5]
    assert got["daily_velocity"] == 0
    signals = signal_weights(weights_minmax(table(spark, PUBLISHED)))
    assert signals == {n: RISK_WEIGHTS[n] for n in signals}
    assert len(signals) == 6


def test_linear_scaling_floors_small_ones(spark):
    got = weights(weights_linear(table(spark, PUBLISHED)))
    assert (got["failed_logins"], got["amount"], got["is_foreign"], got["daily_velocity"]) == (35, 7, 5, 0)


@pytest.mark.parametrize(("importance", "weight"), [(0.5, 18), (0.1, 5)])
def test_halves_round_to_even(spark, importance, weight):
    # 0.5 * 35 = 17.5 and 0.1 * 35 = 3.5, which the floor lifts.
    assert weights(weights_linear(table(spark, {"a": 1.0, "b": importance})))["b"] == weight


def test_equal_importances_get_the_top_weight(spark):
    assert weights(weights_minmax(table(spark, {"a": 0.5, "b": 0.5, "c": 0.0}))) == {"a": 35, "b": 35, "c": 0}


def test_no_importance_at_all(spark):
    assert weights(weights_minmax(table(spark, {"a": 0.0}))) == {"a": 0}
    assert weights(weights_linear(table(spark, {"a": 0.0}))) == {"a": 0}


def test_weights_feed_the_score(spark):
    signals = signal_weights(weights_minmax(table(spark, PUBLISHED)))
    df = made(spark, {"failed_logins": 3, "country": "UK"})
    assert collected(risk_score(df, signals), "risk_score") == [(41,)]
