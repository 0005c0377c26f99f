"""Reports over tallied decisions: a handful of rows, whatever the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import money, percent
from ..functions.signals import BLOCK_CUT, REVIEW_CUT, RISK_WEIGHTS, SOFT_WEIGHTS, any_rule
from .scoring import TALLIES, hybrid_decision, open_tallies, score_decision, tally_hybrid, tally_score
from .skew import HOT_SHARE

DECISIONS = ("BLOCK", "REVIEW", "APPROVE")


def hybrid_summary(df: DataFrame, hot_share: float = HOT_SHARE) -> DataFrame:
    """Outcome per decision of the hybrid engine, BLOCK first."""
    return decision_summary(tally_hybrid(df, hot_share=hot_share))


def score_summary(df: DataFrame, hot_share: float = HOT_SHARE) -> DataFrame:
    """The same report for the pure score."""
    return decision_summary(tally_score(df, hot_share=hot_share))


def decision_summary(tallies: DataFrame) -> DataFrame:
    """Rates per decision from its counts.

    ``fp_rate_pct`` is false positives per rows of the group; ``approval_rate_pct`` is taken
    per group as well, so it is always 0 or 100.
    """
    approved = F.col("decision") == "APPROVE"
    wrong = F.when(approved, 0).otherwise(F.col("legit")).cast("long")
    order = F.array_position(F.array(*[F.lit(d) for d in DECISIONS]), F.col("decision"))
    return tallies.select(
        "decision",
        F.col("total").alias("total_txns"),
        F.col("fraud").alias("fraud_count"),
        percent(F.col("fraud"), F.col("labelled")).alias("fraud_rate_pct"),
        money("fraud_cents").alias("fraud_amount"),
        wrong.alias("false_positives"),
        percent(wrong, F.col("total")).alias("fp_rate_pct"),
        F.when(approved, 100.0).otherwise(0.0).cast("double").alias("approval_rate_pct"),
    ).orderBy(order)


def recall_summary(tallies: DataFrame) -> DataFrame:
    """Where the labelled fraud went: blocked, sent to review, or missed. One row."""
    return tallies.agg(
        _fraud_in("BLOCK").alias("caught_block"),
        _fraud_in("REVIEW").alias("caught_review"),
        _fraud_in("APPROVE").alias("missed"),
        F.sum("fraud").alias("total_fraud"),
    ).select(
        "total_fraud",
        "caught_block",
        "caught_review",
        (F.col("total_fraud") - F.col("missed")).alias("caught_total"),
        percent(F.col("total_fraud") - F.col("missed"), F.col("total_fraud")).alias("recall_pct"),
        "missed",
        percent(F.col("missed"), F.col("total_fraud")).alias("missed_pct"),
    )


def engine_comparison(df: DataFrame, hot_share: float = HOT_SHARE) -> DataFrame:
    """Pure score against hybrid engine: precision and size of BLOCK, and overall recall.

    Both decisions come from one pass. The soft weights are the score's without failed
    logins, so the score's level is found from the soft base shifted by that signal.
    """
    extra = {name: points for name, points in RISK_WEIGHTS.items() if name not in SOFT_WEIGHTS}
    shift = sum(extra.values())
    wanted = {REVIEW_CUT, BLOCK_CUT, REVIEW_CUT - shift, BLOCK_CUT - shift}
    cuts = sorted(cut for cut in wanted if cut > 0)
    both = open_tallies(
        df,
        SOFT_WEIGHTS,
        cuts,
        {"hard": any_rule(), "shifted": F.coalesce(F.expr("failed_logins > 2"), F.lit(False))},
        hot_share=hot_share,
    )

    def reaches(cut: int) -> Column:
        return F.lit(True) if cut <= 0 else F.col("level") >= cuts.index(cut) + 1

    score_level = F.when(
        F.col("shifted"), reaches(REVIEW_CUT - shift).cast("int") + reaches(BLOCK_CUT - shift).cast("int")
    ).otherwise(reaches(REVIEW_CUT).cast("int") + reaches(BLOCK_CUT).cast("int"))
    engines = F.array(
        F.struct(
            F.lit("V2").alias("version"),
            F.lit("Pure scoring").alias("architecture"),
            score_decision(score_level).alias("decision"),
        ),
        F.struct(
            F.lit("V3").alias("version"),
            F.lit("Hard rules + soft scoring").alias("architecture"),
            hybrid_decision(F.col("hard"), reaches(REVIEW_CUT)).alias("decision"),
        ),
    )
    rows = both.select(F.explode(engines).alias("e"), *TALLIES).select("e.*", *TALLIES)
    blocked = F.col("decision") == "BLOCK"
    return (
        rows.groupBy("version", "architecture")
        .agg(
            F.coalesce(F.sum(F.when(blocked, F.col("total"))), F.lit(0)).alias("block_count"),
            F.coalesce(F.sum(F.when(blocked, F.col("labelled"))), F.lit(0)).alias("_labelled"),
            F.coalesce(F.sum(F.when(blocked, F.col("legit"))), F.lit(0)).alias("_wrong"),
            _fraud_in("BLOCK").alias("_block_fraud"),
            _fraud_in("APPROVE").alias("_missed"),
            F.sum("fraud").alias("_fraud"),
        )
        .select(
            "version",
            "architecture",
            percent(F.col("_block_fraud"), F.col("_labelled")).alias("block_precision"),
            percent(F.col("_wrong"), F.col("block_count")).alias("block_fp_rate"),
            "block_count",
            percent(F.col("_fraud") - F.col("_missed"), F.col("_fraud")).alias("overall_recall"),
        )
        .orderBy("version")
    )


def _fraud_in(decision: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("decision") == decision, F.col("fraud"))), F.lit(0))
