"""Hard rules, weighted scores, tiers and decisions, per row and tallied."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import cents
from ..functions.signals import (
    BLOCK_CUT,
    HARD_RULES,
    REVIEW_CUT,
    RISK_WEIGHTS,
    SOFT_WEIGHTS,
    any_rule,
    cuts_reached,
    score,
)
from .profiles import with_spike_limit
from .skew import HOT_SHARE

SPIKE = "amount_spike"


def keyed_rows(df: DataFrame) -> DataFrame:
    """Rows that scoring applies to: user and time are known."""
    return df.where(F.col("user_id").isNotNull() & F.col("txn_time").isNotNull())


# -- per row ---------------------------------------------------------------------------


def hard_rules(df: DataFrame, rules: Sequence[str] = HARD_RULES) -> DataFrame:
    """``HARD_BLOCK`` where any rule holds, else ``SCORE``; no shuffle."""
    return keyed_rows(df).select("txn_id", _hard_label(any_rule(rules)).alias("hard_rule"))


def soft_score(
    df: DataFrame, weights: Mapping[str, int] = SOFT_WEIGHTS, hot_share: float = HOT_SHARE
) -> DataFrame:
    """Weighted score of the nine soft signals."""
    return _scored(df, weights, "soft_score", [], hot_share).select("txn_id", "soft_score")


def risk_score(
    df: DataFrame, weights: Mapping[str, int] = RISK_WEIGHTS, hot_share: float = HOT_SHARE
) -> DataFrame:
    """Weighted score of all ten signals, with the label."""
    return _scored(df, weights, "risk_score", ["is_fraud"], hot_share).select(
        "txn_id", "is_fraud", "risk_score"
    )


def hybrid_decisions(
    df: DataFrame,
    rules: Sequence[str] = HARD_RULES,
    weights: Mapping[str, int] = SOFT_WEIGHTS,
    review_cut: int = REVIEW_CUT,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """BLOCK by hard rule, else REVIEW from the cut on, else APPROVE."""
    hard = {"hard": any_rule(rules)}
    scored = _scored(df, weights, "soft_score", ["is_fraud"], hot_share, extra=hard)
    return scored.select(
        "txn_id",
        "amount",
        "is_fraud",
        _hard_label(F.col("hard")).alias("hard_rule"),
        "soft_score",
        hybrid_decision(F.col("hard"), F.col("soft_score") >= review_cut).alias("decision"),
    )


def score_decisions(
    df: DataFrame,
    weights: Mapping[str, int] = RISK_WEIGHTS,
    review_cut: int = REVIEW_CUT,
    block_cut: int = BLOCK_CUT,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Tier and decision from the full score alone."""
    level = cuts_reached(F.col("risk_score"), (review_cut, block_cut))
    return risk_score(df, weights, hot_share).select(
        "txn_id",
        "risk_score",
        _pick(level, ("LOW", "MEDIUM", "HIGH")).alias("risk_tier"),
        score_decision(level).alias("decision"),
    )


def hybrid_decision(hard: Column, review: Column) -> Column:
    return F.when(hard, "BLOCK").when(review, "REVIEW").otherwise("APPROVE")


def score_decision(level: Column) -> Column:
    return _pick(level, ("APPROVE", "REVIEW", "BLOCK"))


# -- tallied ---------------------------------------------------------------------------


def open_tallies(
    df: DataFrame,
    weights: Mapping[str, int],
    cuts: Sequence[int],
    by: Mapping[str, Column] | None = None,
    settled: Column | None = None,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Partial counts with ``by`` columns and the number of cut points reached (``level``).

    Only the spike signal needs the user's mean, and it matters only to a row whose other
    points lie just below a cut. All other rows collapse inside the scanning task, so what
    is shuffled is the few undecided (user, amount) groups and one row per level and task.
    ``settled`` marks rows whose level does not matter either.
    """
    by = dict(by or {})
    spike = weights.get(SPIKE, 0)
    base = score({name: points for name, points in weights.items() if name != SPIKE})
    low, high = cuts_reached(F.col("base"), cuts), cuts_reached(F.col("base") + spike, cuts)
    open_row = low != high
    if settled is not None:
        open_row = open_row & ~settled
    groups = (
        keyed_rows(df)
        .select(*[c.alias(name) for name, c in by.items()], "user_id", "amount", "is_fraud", base.alias("base"))
        .groupBy(
            *by,
            low.alias("low"),
            F.when(open_row, high).otherwise(low).alias("high"),
            F.when(open_row, F.col("user_id")).alias("user_id"),
            F.when(open_row, F.col("amount")).alias("amount"),
        )
        .agg(*_tallies())
    )
    level = F.when(F.col("amount") > F.col("spike_limit"), F.col("high")).otherwise(F.col("low"))
    return with_spike_limit(groups, df, hot_share).select(*by, level.alias("level"), *TALLIES)


def sum_tallies(tallies: DataFrame, *keys: Column | str) -> DataFrame:
    """Partial counts added up per key."""
    return tallies.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in TALLIES])


TALLIES = ("total", "labelled", "fraud", "legit", "fraud_cents")


def _tallies() -> list[Column]:
    fraud_amount = F.when(F.col("is_fraud") == 1, cents("amount")).otherwise(0)
    return [
        F.count(F.lit(1)).alias("total"),
        F.count("is_fraud").alias("labelled"),
        F.sum("is_fraud").alias("fraud"),
        F.count(F.when(F.col("is_fraud") == 0, 1)).alias("legit"),
        F.sum(fraud_amount).alias("fraud_cents"),
    ]


def tally_hybrid(
    df: DataFrame,
    rules: Sequence[str] = HARD_RULES,
    weights: Mapping[str, int] = SOFT_WEIGHTS,
    review_cut: int = REVIEW_CUT,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Counts per hybrid decision."""
    hard = {"hard": any_rule(rules)}
    tallies = open_tallies(df, weights, (review_cut,), hard, F.col("hard"), hot_share)
    decision = hybrid_decision(F.col("hard"), F.col("level") >= 1)
    return sum_tallies(tallies, decision.alias("decision"))


def tally_score(
    df: DataFrame,
    weights: Mapping[str, int] = RISK_WEIGHTS,
    review_cut: int = REVIEW_CUT,
    block_cut: int = BLOCK_CUT,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Counts per decision of the pure score."""
    tallies = open_tallies(df, weights, (review_cut, block_cut), hot_share=hot_share)
    return sum_tallies(tallies, score_decision(F.col("level")).alias("decision"))


def _scored(
    df: DataFrame,
    weights: Mapping[str, int],
    name: str,
    keep: Sequence[str],
    hot_share: float,
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Score every row. All but the spike is computed before the shuffle, to keep it narrow."""
    base = score({signal: points for signal, points in weights.items() if signal != SPIKE})
    narrow = keyed_rows(df).select(
        "txn_id",
        "user_id",
        "amount",
        *keep,
        *[c.alias(n) for n, c in (extra or {}).items()],
        base.alias("base"),
    )
    if SPIKE not in weights:
        return narrow.withColumnRenamed("base", name)
    known = with_spike_limit(narrow, df, hot_share)
    return known.withColumn(name, F.col("base") + score({SPIKE: weights[SPIKE]}))


def _hard_label(hard: Column) -> Column:
    return F.when(hard, "HARD_BLOCK").otherwise("SCORE")


def _pick(level: Column, names: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), level + 1)
