"""Risk signals and rules as data, compiled into Spark columns.

Predicates are SQL text over the transaction columns. ``spike_limit`` is the largest
amount that is not yet three times the user's mean (see operators.profiles).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The predicates, weights, rules and cut points that define the results.
SIGNALS: dict[str, str] = {
    "failed_logins": "failed_logins > 2",
    "high_amount": "amount > 800",
    "no_kyc": "kyc_verified = 0",
    "high_segment": "risk_segment = 'High'",
    "risky_merchant": "merchant_cat IN ('Crypto', 'Gaming')",
    "foreign": "country <> txn_location",
    "amount_spike": "amount > spike_limit",
    "new_account": "account_age < 30",
    "off_hours": "hour(txn_time) BETWEEN 2 AND 5",
    "cnp": "txn_type = 'CNP'",
}

SOFT_WEIGHTS: dict[str, int] = {
    "high_amount": 10,
    "no_kyc": 9,
    "high_segment": 9,
    "risky_merchant": 8,
    "foreign": 6,
    "amount_spike": 5,
    "new_account": 5,
    "off_hours": 5,
    "cnp": 5,
}

RISK_WEIGHTS: dict[str, int] = {"failed_logins": 35, **SOFT_WEIGHTS}

HARD_RULES: tuple[str, ...] = (
    "failed_logins > 5",
    "failed_logins > 2 AND kyc_verified = 0",
    "failed_logins > 2 AND amount > 800",
    "risk_segment = 'High' AND kyc_verified = 0 AND merchant_cat IN ('Crypto', 'Gaming')",
)

# All of these together are a takeover.
TAKEOVER: tuple[str, ...] = ("failed_logins > 2", "txn_type = 'CNP'", "amount > 500", "kyc_verified = 0")

REVIEW_CUT = 25
BLOCK_CUT = 50

FEATURES_V1 = (
    "flag_high_amount",
    "flag_cnp",
    "flag_foreign",
    "flag_failed_logins",
    "flag_no_kyc",
    "flag_new_account",
    "flag_risky_merchant",
    "flag_high_risk_seg",
    "flag_off_hours",
    "flag_velocity",
    "flag_amt_spike",
)

FEATURES_V2 = (
    "amount",
    "failed_logins",
    "account_age",
    "kyc_verified",
    "daily_velocity",
    "amt_vs_avg_ratio",
    "txn_hour",
    "is_foreign",
    "flag_cnp",
    "flag_risky_merchant",
    "flag_high_risk_seg",
)

# Model features and the signal each one is about; the way from importances back to weights.
# Daily velocity is a feature of both models, but not a signal.
FEATURE_SIGNALS: dict[str, str] = {
    "amount": "high_amount",
    "failed_logins": "failed_logins",
    "account_age": "new_account",
    "kyc_verified": "no_kyc",
    "amt_vs_avg_ratio": "amount_spike",
    "txn_hour": "off_hours",
    "is_foreign": "foreign",
    "flag_cnp": "cnp",
    "flag_risky_merchant": "risky_merchant",
    "flag_high_risk_seg": "high_segment",
    "flag_high_amount": "high_amount",
    "flag_foreign": "foreign",
    "flag_failed_logins": "failed_logins",
    "flag_no_kyc": "no_kyc",
    "flag_new_account": "new_account",
    "flag_off_hours": "off_hours",
    "flag_amt_spike": "amount_spike",
}


def flag(predicate: str | Column) -> Column:
    """1 where the predicate holds, 0 where it is false or unknown."""
    condition = F.expr(predicate) if isinstance(predicate, str) else predicate
    return F.when(condition, 1).otherwise(0)


def foreign_flag() -> Column:
    """Country differs from place; an unknown one counts as different in features and coverage."""
    return F.coalesce(F.col("country") != F.col("txn_location"), F.lit(True)).cast("int")


def score(weights: Mapping[str, int], signals: Mapping[str, str] = SIGNALS) -> Column:
    """Sum of the weights of the signals that fire."""
    unknown = [name for name in weights if name not in signals]
    if unknown:
        raise ValueError(f"unknown signals: {', '.join(unknown)}")
    terms = [f"CASE WHEN {signals[name]} THEN {points:d} ELSE 0 END" for name, points in weights.items()]
    return F.expr(" + ".join(terms) or "0")


def any_rule(rules: Sequence[str] = HARD_RULES) -> Column:
    """True where at least one rule holds; never NULL."""
    return F.expr(" OR ".join(f"coalesce({rule}, false)" for rule in rules) or "false")


def cuts_reached(value: Column, cuts: Sequence[float]) -> Column:
    """How many of the cut points ``value`` reaches."""
    return reduce(Column.__add__, [(value >= cut).cast("int") for cut in cuts], F.lit(0))
