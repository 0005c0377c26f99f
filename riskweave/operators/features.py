"""Model features per transaction, and reports about them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signals import FEATURES_V1, FEATURES_V2, SIGNALS, flag, foreign_flag
from .profiles import with_user_day
from .skew import HOT_SHARE

QUARTILES = (0.25, 0.5, 0.75)

# Values that are ordered for one quartile, about, and cuts of a narrowing sketch.
ORDERED_VALUES = 10_000
_CUTS = 1_000


def features_v1(
    df: DataFrame, stats_from: DataFrame | None = None, hot_share: float = HOT_SHARE
) -> DataFrame:
    """Eleven 0/1 flags per row, with key and label."""
    columns = {
        "flag_high_amount": flag(SIGNALS["high_amount"]),
        "flag_cnp": flag(SIGNALS["cnp"]),
        "flag_foreign": foreign_flag(),
        "flag_failed_logins": flag(SIGNALS["failed_logins"]),
        "flag_no_kyc": flag(SIGNALS["no_kyc"]),
        "flag_new_account": flag(SIGNALS["new_account"]),
        "flag_risky_merchant": flag(SIGNALS["risky_merchant"]),
        "flag_high_risk_seg": flag(SIGNALS["high_segment"]),
        "flag_off_hours": flag(SIGNALS["off_hours"]),
    }
    late = {
        "flag_velocity": flag("day_count > 2"),
        "flag_amt_spike": flag(SIGNALS["amount_spike"]),
    }
    return _build(df, columns, late, FEATURES_V1, stats_from, hot_share)


def features_v2(
    df: DataFrame,
    stats_from: DataFrame | None = None,
    unknown_ratio: float = 1.0,
    hot_share: float = HOT_SHARE,
    days: DataFrame | None = None,
) -> DataFrame:
    """Raw and engineered values per row, with key and label.

    The ratio to the user's mean is ``unknown_ratio`` where the mean is unknown or zero. Statistics
    come from the rows, from those of ``stats_from``, or from a profile table's ``days``.
    """
    columns = {
        "failed_logins": F.col("failed_logins"),
        "account_age": F.col("account_age"),
        "kyc_verified": F.col("kyc_verified"),
        "txn_hour": F.hour("txn_time"),
        "is_foreign": foreign_flag(),
        "flag_cnp": flag(SIGNALS["cnp"]),
        "flag_risky_merchant": flag(SIGNALS["risky_merchant"]),
        "flag_high_risk_seg": flag(SIGNALS["high_segment"]),
    }
    amount = F.col("amount").cast("double")
    ratio = amount / F.nullif(F.col("user_mean"), F.lit(0.0).cast("double"))
    late = {
        "amount": amount,
        "daily_velocity": F.col("day_count"),
        "amt_vs_avg_ratio": F.coalesce(ratio, F.lit(unknown_ratio).cast("double")),
    }
    return _build(df, columns, late, FEATURES_V2, stats_from, hot_share, days)


def _build(
    df: DataFrame,
    early: dict[str, Column],
    late: dict[str, Column],
    order: Sequence[str],
    stats_from: DataFrame | None,
    hot_share: float,
    days: DataFrame | None = None,
) -> DataFrame:
    """Row-local features are computed before the shuffle, so that only they travel."""
    source = df if stats_from is None else stats_from
    narrow = df.select(
        "txn_id", "user_id", "txn_time", F.col("amount"), "is_fraud", *[c.alias(n) for n, c in early.items()]
    )
    known = with_user_day(narrow, source, hot_share, days)
    return known.select("txn_id", "is_fraud", *[late.get(n, F.col(n)).alias(n) for n in order])


def flag_counts(features: DataFrame) -> DataFrame:
    """How often each flag fires, most frequent first."""
    names = [c for c in features.columns if c.startswith("flag_")]
    sums = features.agg(*[F.sum(n).alias(n) for n in names])
    return sums.unpivot([], names, "feature", "flagged").orderBy(F.desc("flagged"), "feature")


def feature_stats(
    features: DataFrame,
    names: Sequence[str] = FEATURES_V2,
    accuracy: int = 10_000,
    ordered: int = ORDERED_VALUES,
) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per feature, two decimals.

    Quartiles are selected by narrowing brackets around their ranks, all of them side by side. A
    first aggregate, run at once, brings back one row with counts and a sketch that brackets every
    rank. While a bracket may hold more than ``ordered`` values, which with the defaults begins at
    some sixteen million rows, another aggregate of one row counts and sketches what lies in the
    brackets. The values that are left are ordered, at most about ``ordered`` per quartile at any
    size of the table, and a rank that lies outside its bracket fails. No row is copied per feature.
    """
    columns = [f"v{i}" for i in range(len(names))]
    values = features.select(*[F.col(n).cast("double").alias(c) for n, c in zip(names, columns, strict=True)])
    # A few ranks more than a sketch may be off: of many rows, and of as few as are sketched.
    shares = (3 / accuracy, 3 / accuracy + 3 / ordered)
    probes = [min(1.0, max(0.0, q + side * s)) for s in shares for q in QUARTILES for side in (-1, 1)]
    first = values.agg(
        *[
            F.struct(
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
                F.percentile_approx(c, probes, accuracy).alias("probe"),
            ).alias(c)
            for c in columns
        ]
    ).first()
    brackets, left = [], 0.0
    for c in columns:
        found = first[c]
        many = found["count"] > max(accuracy, ordered)
        for i, q in enumerate(QUARTILES):
            low, high = found.min, found.max  # all of few rows
            if found["count"] > ordered:
                at = 2 * i + (0 if many else 2 * len(QUARTILES))
                low, high = found.probe[at : at + 2]
                left = max(left, 2 * shares[0 if many else 1] * found["count"])
            brackets.append(_Bracket(c, f"{c}_{i}", (found["count"] - 1) * q, low, high))
    while left > ordered:
        brackets = _narrowed(values, brackets, accuracy)
        left *= min(0.5, (2 * _margin(accuracy) + 2) / _CUTS + 2 / accuracy)
    found = values.agg(
        *[
            F.struct(
                *b.counts(), F.sort_array(F.collect_list(F.when(b.holds(), F.col(b.column)))).alias("inside")
            ).alias(b.name)
            for b in brackets
        ]
    )
    quartiles = {b.name: b.value() for b in brackets}
    rows = []
    for name, c in zip(names, columns, strict=True):
        known = {n: F.lit(first[c][n]).cast("double") for n in ("mean", "std", "min")}
        known |= {f"q{int(q * 100)}": quartiles[f"{c}_{i}"] for i, q in enumerate(QUARTILES)}
        known["max"] = F.lit(first[c].max).cast("double")
        count = F.lit(first[c]["count"]).cast("long").alias("count")
        rounded = [F.round(v, 2).alias(n) for n, v in known.items()]
        rows.append(F.struct(F.lit(name).alias("feature"), count, *rounded))
    return found.select(F.inline(F.array(*rows))).orderBy("feature")


@dataclass(frozen=True)
class _Bracket:
    """Two values of a column between which, ends included, the rows at a rank lie.

    ``place`` is the rank counted from 0; between two whole ranks it asks for both.
    """

    column: str
    name: str
    place: float
    low: float | None
    high: float | None

    def _ends(self) -> tuple[Column, Column]:
        return F.lit(self.low).cast("double"), F.lit(self.high).cast("double")

    def holds(self) -> Column:
        """Strictly between the ends, so that a value of many rows need not be held."""
        low, high = self._ends()
        return (F.col(self.column) > low) & (F.col(self.column) < high)

    def counts(self) -> list[Column]:
        value = F.col(self.column)
        low, high = self._ends()
        return [
            F.count(F.when(value < low, 1)).alias("below"),
            F.count(F.when(value == low, 1)).alias("at_low"),
            F.count(F.when(value == high, 1)).alias("at_high"),
        ]

    def value(self) -> Column:
        """The interpolated value, from a row with the counts and the values inside."""
        if self.low is None:
            return F.lit(None).cast("double")
        low, high = self._at(math.floor(self.place)), self._at(math.ceil(self.place))
        between = low + (high - low) * F.lit(self.place - math.floor(self.place))
        missed = F.raise_error(F.lit("a quartile lies outside its bracket")).cast("double")
        return F.coalesce(between, missed)

    def _at(self, rank: int) -> Column:
        found = F.col(self.name)
        inside = rank - found["below"] - found["at_low"]
        size = F.size(found["inside"])
        low, high = self._ends()
        return (
            F.when(F.lit(rank) < found["below"], F.lit(None).cast("double"))
            .when(inside < 0, low)
            .when(inside < size, F.get(found["inside"], inside.cast("int")))
            .when(inside < size + found["at_high"], high)
        )


def _margin(accuracy: int) -> int:
    """Cuts that a rank may be off by in a sketch."""
    return 1 + math.ceil(_CUTS / accuracy)


def _narrowed(values: DataFrame, brackets: list[_Bracket], accuracy: int) -> list[_Bracket]:
    """Brackets with a small share of what they held: cuts of a sketch of it, around the rank."""
    steps = [k / _CUTS for k in range(1, _CUTS)]
    row = values.agg(
        *[
            F.struct(
                *b.counts(),
                F.count(F.when(b.holds(), 1)).alias("inside"),
                F.percentile_approx(F.when(b.holds(), F.col(b.column)), steps, accuracy).alias("cuts"),
            ).alias(b.name)
            for b in brackets
        ]
    ).first()
    out = []
    for b in brackets:
        found = row[b.name]
        if found.inside:
            # Some cuts more on either side than the rank needs; beyond the last cut the end stays.
            before = found.below + found.at_low
            down = math.floor((math.floor(b.place) - before) * _CUTS / found.inside) - _margin(accuracy)
            up = math.ceil((math.ceil(b.place) + 1 - before) * _CUTS / found.inside) + _margin(accuracy)
            low = found.cuts[min(down, _CUTS - 1) - 1] if down >= 1 else b.low
            high = found.cuts[max(up, 1) - 1] if up <= _CUTS - 1 else b.high
            b = replace(b, low=low, high=high)
        out.append(b)
    return out
