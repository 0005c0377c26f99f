"""Boosted trees on Spark ML: training, scoring, importance and evaluation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import FEATURES_V1, FEATURES_V2
from .metrics import confusion_counts, confusion_matrix, ranking_metrics

# Rows of a fit that a task has at least, and at most.
_LEAST_TASK_ROWS = 20_000
_MOST_TASK_ROWS = 500_000


@dataclass(frozen=True)
class ModelSpec:
    """Features and settings of a model."""

    name: str
    features: tuple[str, ...]
    trees: int
    rate: float
    depth: int = 4
    row_share: float = 1.0
    column_share: str = "all"
    seed: int = 42


# The two trained models.
MODEL_V1 = ModelSpec("V1", FEATURES_V1, trees=200, rate=0.1)
MODEL_V2 = ModelSpec("V2", FEATURES_V2, trees=300, rate=0.05, row_share=0.8, column_share="0.8")


def train_model(train: DataFrame, spec: ModelSpec, label: str = "is_fraud") -> PipelineModel:
    """Fit on the training part. A positive row weighs as much as the class ratio says.

    Every row of a known label takes part. Every tree reads its input again, so equal rows become
    one of that weight where all rows go into every tree. What is read is dealt out to the cores
    first, since each level of each tree is a round of tasks. Unknown features count as 0; rows of
    an unknown label teach nothing.
    """
    known = train.where(F.col(label).isNotNull())
    rows = known.select(label, *spec.features).fillna(0, list(spec.features))
    if spec.row_share == 1.0:
        rows = rows.groupBy(label, *spec.features).agg(F.count(F.lit(1)).alias("_rows"))
    else:
        rows = rows.withColumn("_rows", F.lit(1).cast("long"))
    rows = kept(rows)
    totals = rows.agg(
        F.sum(F.when(F.col(label) == 1, F.col("_rows"))).alias("fraud"),
        F.sum("_rows").alias("all"),
        F.count(F.lit(1)).alias("read"),
    ).first()
    ratio = (totals["all"] - totals["fraud"]) / totals["fraud"] if totals["fraud"] else 1.0
    weight = F.col("_rows") * F.when(F.col(label) == 1, ratio).otherwise(1.0)
    weighted = _dealt(rows.withColumn("_weight", weight), totals["read"])
    trees = GBTClassifier(
        featuresCol="features",
        labelCol=label,
        weightCol="_weight",
        maxIter=spec.trees,
        maxDepth=spec.depth,
        stepSize=spec.rate,
        subsamplingRate=spec.row_share,
        featureSubsetStrategy=spec.column_share,
        seed=spec.seed,
        checkpointInterval=10,
    )
    assembler = VectorAssembler(inputCols=list(spec.features), outputCol="features")
    model = Pipeline(stages=[assembler, trees]).fit(weighted)
    rows.unpersist()
    return model


def _dealt(rows: DataFrame, count: int) -> DataFrame:
    """About ``count`` rows in one partition per core: fewer where they are few, several where many."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    waves = max(math.ceil(count / (cores * _MOST_TASK_ROWS)), 1)
    parts = max(min(waves * cores, math.ceil(count / _LEAST_TASK_ROWS)), 1)
    return rows.coalesce(1) if parts == 1 else rows.repartition(parts)


def score_model(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Predicted class and probability of fraud per row, with the columns of ``rows``."""
    return (
        model.transform(rows.fillna(0))
        .withColumn("probability", vector_to_array("probability")[1])
        .withColumn("prediction", F.col("prediction").cast("int"))
        .select(*rows.columns, "prediction", "probability")
    )


def feature_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """One row per feature; importances sum to one."""
    importances = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(features, importances, strict=True)]
    spark = SparkSession.active()
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def model_report(scored: DataFrame, version: str, label: str = "is_fraud") -> DataFrame:
    """Ranking quality, share of fraud caught and false positives of one model, one row."""
    cells = confusion_matrix(confusion_counts(scored, label))
    fraud = F.nullif(F.col("true_positives") + F.col("false_negatives"), F.lit(0))
    caught = cells.select(F.round(F.col("true_positives") / fraud * 100, 1)).scalar()
    return ranking_metrics(scored, "probability", label).select(
        F.lit(version).alias("version"),
        "auc_roc",
        "auc_pr",
        caught.alias("fraud_caught_pct"),
        cells.select("false_positives").scalar().alias("false_positives"),
    )


def model_comparison(scored: dict[str, DataFrame], label: str = "is_fraud") -> DataFrame:
    """The report of several models, one row each."""
    reports = [model_report(df, version, label) for version, df in scored.items()]
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return out.orderBy("version")


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once: a checkpoint in the shared folder, or cached where none is named."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist()
