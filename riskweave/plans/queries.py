"""One query per operator, over the sample view of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.signals import flag
from ..operators import (
    card_sketches,
    card_testing,
    coverage,
    explore,
    features,
    merchants,
    metrics,
    model,
    scoring,
    split,
    structuring,
    summaries,
    takeover,
    travel,
    trees,
    velocity,
    weights,
)
from ..operators.model import MODEL_V1, MODEL_V2, ModelSpec
from ..session import shared_path
from ..sources import dataset_check
from ..sources.profile_table import ProfileTable
from . import sample_view
from .models import all_fitted, fitted

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> dict[str, Query]:
    """Name to query; each takes the session and the folder with the tables."""
    return {
        "overview": _on_rows(explore.overview),
        "fraud_by_txn_type": _on_rows(explore.fraud_by_txn_type),
        "fraud_by_merchant_cat": _on_rows(explore.fraud_by_merchant_cat),
        "fraud_by_account_age": _on_rows(explore.fraud_by_account_age),
        "fraud_by_kyc": _on_rows(explore.fraud_by_kyc),
        "daily_velocity": _on_rows(velocity.daily_velocity),
        "rolling_velocity_1h": _on_rows(velocity.rolling_velocity_1h),
        "bin_attack": _on_rows(card_testing.bin_attack),
        "weekly_cards": _on_rows(lambda t: card_sketches.weekly_cards(t).drop("estimated_cards")),
        "impossible_travel": _on_rows(travel.impossible_travel),
        "ato_risk": _on_rows(takeover.ato_risk),
        "ato_geo_risk": _on_rows(takeover.ato_geo_risk),
        "ato_travel_linked": _on_rows(takeover.ato_travel_linked),
        "merchant_chargebacks": lambda spark, path: merchants.merchant_chargebacks(
            sample_view.transactions(spark, path), sample_view.merchants(spark, path)
        ),
        "structuring": _on_rows(structuring.structuring),
        "hard_rules": _on_rows(scoring.hard_rules),
        "soft_score": _on_rows(scoring.soft_score),
        "hybrid_decisions": _on_rows(
            lambda t: scoring.hybrid_decisions(t).withColumn("amount", F.col("amount").cast("double"))
        ),
        "hybrid_summary": _on_rows(summaries.hybrid_summary),
        "risk_score": _on_rows(scoring.risk_score),
        "score_decisions": _on_rows(scoring.score_decisions),
        "score_summary": _on_rows(summaries.score_summary),
        "features_v1": _on_rows(features.features_v1),
        "flag_counts": _on_rows(lambda t: features.flag_counts(features.features_v1(t))),
        "features_v2": _on_rows(features.features_v2),
        "features_v2_from_profiles": _features_from_profiles,
        "feature_stats": _on_rows(lambda t: features.feature_stats(features.features_v2(t))),
        "stratified_split": _on_rows(
            lambda t: split.stratified_split(t.select("txn_id", "is_fraud"))
        ),
        "class_weights": _on_rows(_train_class_weights),
        "train_model_v1": _fit_summary(MODEL_V1),
        "train_model_v2": _fit_summary(MODEL_V2),
        "score_model": lambda spark, path: fitted(spark, path, MODEL_V2).scored,
        "classification_report": _on_rows(
            lambda t: metrics.classification_report(metrics.decision_counts(scoring.tally_hybrid(t)))
        ),
        "ranking_metrics": _on_rows(
            lambda t: metrics.ranking_metrics(scoring.risk_score(t), "risk_score")
        ),
        "confusion_matrix": _on_rows(
            lambda t: metrics.confusion_matrix(metrics.decision_counts(scoring.tally_hybrid(t)))
        ),
        "feature_importance": lambda spark, path: model.feature_importance(
            fitted(spark, path, MODEL_V2).model, MODEL_V2.features
        ),
        "weights_linear": _on_rows(lambda t: weights.weights_linear(_fraud_flag_shares(t))),
        "weights_minmax": _on_rows(lambda t: weights.weights_minmax(_fraud_flag_shares(t))),
        "threshold_sweep_score": _on_rows(metrics.threshold_sweep_score),
        "threshold_sweep_model": lambda spark, path: metrics.threshold_sweep(
            fitted(spark, path, MODEL_V2).scored, "probability"
        ),
        "classification_report_model": lambda spark, path: metrics.classification_report(
            metrics.confusion_counts(fitted(spark, path, MODEL_V2).scored)
        ),
        "confusion_matrix_model": lambda spark, path: metrics.confusion_matrix(
            metrics.confusion_counts(fitted(spark, path, MODEL_V2).scored)
        ),
        "ranking_metrics_model": lambda spark, path: metrics.ranking_metrics(
            fitted(spark, path, MODEL_V2).scored, "probability"
        ),
        "weights_minmax_model": lambda spark, path: weights.weights_minmax(_importance(spark, path)),
        "score_summary_model_weights": _decisions_by_model_weights,
        "score_trees_model": _compiled_scores,
        "best_threshold": _on_rows(
            lambda t: metrics.best_threshold(metrics.threshold_sweep_score(t))
        ),
        "best_threshold_model": lambda spark, path: metrics.best_threshold(
            metrics.threshold_sweep(fitted(spark, path, MODEL_V2).scored, "probability")
        ),
        "signal_coverage": _on_rows(coverage.signal_coverage),
        "low_signal_share": _on_rows(coverage.low_signal_share),
        "recall_summary": _on_rows(lambda t: summaries.recall_summary(scoring.tally_hybrid(t))),
        "engine_comparison": _on_rows(summaries.engine_comparison),
        "model_comparison": lambda spark, path: model.model_comparison(
            {name: fit.scored for name, fit in all_fitted(spark, path, (MODEL_V1, MODEL_V2)).items()}
        ),
        "dataset_check": _on_rows(dataset_check),
    }


def _on_rows(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, path: operator(sample_view.transactions(spark, path))


def _train_class_weights(t: DataFrame) -> DataFrame:
    parts = split.stratified_split(t.select("txn_id", "is_fraud"))
    return split.class_weights(parts.where("part = 'train'"))


def _fit_summary(spec: ModelSpec) -> Query:
    """What a fit was made of and what came out, one row."""

    def query(spark: SparkSession, path: str) -> DataFrame:
        fit = fitted(spark, path, spec)
        forest = fit.model.stages[-1]
        return split.class_weights(fit.train).select(
            F.lit(spec.name).alias("version"),
            F.lit(len(spec.features)).alias("features"),
            F.lit(forest.getNumTrees).alias("trees"),
            F.lit(spec.depth).alias("depth"),
            F.lit(spec.rate).alias("rate"),
            (F.col("negatives") + F.col("positives")).alias("train_rows"),
            F.col("positives").alias("train_fraud"),
            "pos_weight",
        )

    return query


def _features_from_profiles(spark: SparkSession, path: str) -> DataFrame:
    """The features by a profile table that was filled in four steps: the older days, then day by day."""
    t = sample_view.transactions(spark, path)
    day = F.col("txn_time").cast("date")
    newest = t.agg(F.max(day)).first()[0]
    table = ProfileTable(spark, shared_path(spark, "profiles"))
    steps = [(F.coalesce(day <= F.lit(newest) - 3, F.lit(True)), "older")]
    steps += [(day == F.lit(newest) - back, f"day-{back}") for back in (2, 1, 0)]
    for step, name in steps:
        table.add(t.where(step), name)
    return features.features_v2(t, days=table.days())


def _importance(spark: SparkSession, path: str) -> DataFrame:
    return model.feature_importance(fitted(spark, path, MODEL_V2).model, MODEL_V2.features)


def _decisions_by_model_weights(spark: SparkSession, path: str) -> DataFrame:
    """The loop closed: importances of the trees become the weights of the score."""
    found = weights.signal_weights(weights.weights_minmax(_importance(spark, path)))
    return summaries.decision_summary(scoring.tally_score(sample_view.transactions(spark, path), found))


def _compiled_scores(spark: SparkSession, path: str) -> DataFrame:
    """The test rows scored by the trees as expressions instead of the model."""
    fit = fitted(spark, path, MODEL_V2)
    nodes = trees.tree_nodes(fit.model, MODEL_V2.features)
    return trees.score_trees(nodes, fit.test).select("txn_id", "is_fraud", "prediction", "probability")


def _fraud_flag_shares(t: DataFrame) -> DataFrame:
    """Stand-in importances that plain SQL can follow: each flag's share of the fraud rows' flags.

    Flags that fire on no fraud row get 0, as unused features do.
    """
    counts = features.flag_counts(_fraud_flags(t))  # one row per flag
    total = F.sum("flagged").over(Window.partitionBy(F.lit(1)))
    return counts.select("feature", (F.col("flagged") / total).alias("importance"))


def _fraud_flags(t: DataFrame) -> DataFrame:
    flags = features.features_v1(t)
    on_fraud = flag(F.col("is_fraud") == 1)
    return flags.select(*[(F.col(n) * on_fraud).alias(n) for n in features.FEATURES_V1])
