"""Trained models of a session, so that the queries about one model share one fit."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import features_v1, features_v2
from ..operators.model import MODEL_V1, MODEL_V2, ModelSpec, kept, score_model, train_model
from ..operators.split import stratified_split
from .sample_view import transactions


class Fitted(NamedTuple):
    spec: ModelSpec
    model: PipelineModel
    train: DataFrame
    test: DataFrame
    scored: DataFrame


_FITS: dict[tuple[str, str, str], Fitted] = {}
_BUILDERS = {MODEL_V1.name: features_v1, MODEL_V2.name: features_v2}


def fitted(spark: SparkSession, sf_dir: str, spec: ModelSpec) -> Fitted:
    """Features, split, fit and scored test part; the scores are kept."""
    key = (spark.sparkContext.applicationId, sf_dir, spec.name)
    if key not in _FITS:
        # Kept, since both parts and every report read them.
        rows = kept(stratified_split(_BUILDERS[spec.name](transactions(spark, sf_dir))))
        train, test = (rows.where(F.col("part") == part).drop("part") for part in ("train", "test"))
        model = train_model(train, spec)
        scored = score_model(model, test).select("txn_id", "is_fraud", "prediction", "probability")
        _FITS[key] = Fitted(spec, model, train, test, kept(scored))
    return _FITS[key]


def all_fitted(spark: SparkSession, sf_dir: str, specs: Sequence[ModelSpec]) -> dict[str, Fitted]:
    """Several models, made side by side: a fit waits for its rounds of tasks more than it computes."""
    fit = inheritable_thread_target(spark)(lambda spec: fitted(spark, sf_dir, spec))
    with ThreadPool(len(specs)) as pool:
        return dict(zip([s.name for s in specs], pool.map(fit, specs), strict=True))
