import threading
from dataclasses import replace
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from riskweave.operators import metrics, trees
from riskweave.operators.features import features_v1, features_v2
from riskweave.operators.model import (
    _LEAST_TASK_ROWS,
    MODEL_V1,
    MODEL_V2,
    feature_importance,
    model_comparison,
    score_model,
    train_model,
)
from riskweave.operators.split import stratified_split
from riskweave.plans import models, oracle, queries
from riskweave.plans.sample_view import VIEW_SQL, transactions
from compare import connect, differences
from rows import collected

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fits(spark):
    out = {}
    for spec, build in ((MODEL_V1, features_v1), (MODEL_V2, features_v2)):
        spec = replace(spec, trees=5)
        parts = stratified_split(build(transactions(spark, SMALL)))
        model = train_model(parts.where("part = 'train'"), spec)
        scored = score_model(model, parts.where("part = 'test'")).checkpoint()
        out[spec.name] = (spec, model, scored)
    return out


def test_scores_are_probabilities(fits):
    for _, _, scored in fits.values():
        rows = scored.collect()
        assert len(rows) == 200
        assert all(0 <= r.probability <= 1 and r.prediction == int(r.probability > 0.5) for r in rows)


def test_models_rank_fraud_first(fits):
    scored = {name: s for name, (_, _, s) in fits.items()}
    rows = model_comparison(scored).collect()
    assert [r.version for r in rows] == ["V1", "V2"]
    assert all(r.auc_roc > 0.5 for r in rows)
    for r in rows:
        cells = metrics.confusion_matrix(metrics.confusion_counts(scored[r.version])).first()
        assert r.false_positives == cells.false_positives


def test_importances_sum_to_one(spark, fits):
    for spec, model, _ in fits.values():
        rows = feature_importance(model, spec.features).collect()
        assert {r.feature for r in rows} == set(spec.features)
        assert sum(r.importance for r in rows) == pytest.approx(1)


def test_settings_reach_the_trees(fits):
    spec, model, _ = fits["V2"]
    trees = model.stages[-1]
    assert trees.getNumTrees == 5
    assert (trees.getMaxDepth(), trees.getStepSize()) == (4, 0.05)
    assert (trees.getSubsamplingRate(), trees.getFeatureSubsetStrategy()) == (0.8, "0.8")


def test_sweep_over_probabilities(fits):
    scored = fits["V2"][2]
    rows = metrics.threshold_sweep(scored, "probability").collect()
    pairs = collected(scored, "probability", "is_fraud")
    for r in rows:
        assert r.caught == sum(y for p, y in pairs if p >= r.threshold)


def test_compiled_trees_score_as_the_model_does(spark, fits):
    for spec, model, scored in fits.values():
        nodes = trees.tree_nodes(model, spec.features)
        assert len(nodes) == model.stages[-1].totalNumNodes
        rows = scored.withColumnsRenamed({"probability": "wanted", "prediction": "class"})
        got = trees.score_trees(nodes, rows).collect()
        assert max(abs(r.probability - r.wanted) for r in got) <= 1e-12
        assert all(r.prediction == r["class"] for r in got)


def test_the_same_text_runs_in_another_engine(spark, fits, tmp_path):
    spec, model, scored = fits["V2"]
    nodes = trees.tree_nodes(model, spec.features)
    scored.write.parquet(str(tmp_path / "rows"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW rows AS SELECT * FROM read_parquet('{tmp_path}/rows/*.parquet')")
    con.execute(
        f"CREATE TABLE scores AS SELECT txn_id, is_fraud, probability AS wanted, "
        f"{trees.probability_sql(trees.margin_sql(nodes))} AS p FROM rows"
    )
    assert con.sql("SELECT max(abs(p - wanted)) FROM scores").fetchall()[0][0] <= 1e-12
    for r in metrics.threshold_sweep(scored, "probability").collect():
        ((caught, flagged),) = con.execute(
            "SELECT count(*) FILTER (is_fraud = 1), count(*) FROM scores WHERE p >= ?", [r.threshold]
        ).fetchall()
        assert r.caught == caught and r.fp_rate == pytest.approx((flagged - caught) / flagged * 100)
    (cells,) = con.sql(
        "SELECT count(*) FILTER (p <= 0.5 AND is_fraud = 0), count(*) FILTER (p > 0.5 AND is_fraud = 0), "
        "count(*) FILTER (p <= 0.5 AND is_fraud = 1), count(*) FILTER (p > 0.5 AND is_fraud = 1) FROM scores"
    ).fetchall()
    assert tuple(metrics.confusion_matrix(metrics.confusion_counts(scored)).first()) == cells


def test_unknown_features_and_node_table(spark, fits):
    spec, model, scored = fits["V2"]
    nodes = trees.tree_nodes(model, spec.features)
    holes = scored.select("txn_id", *[F.lit(None).cast("double").alias(f) for f in spec.features]).limit(1)
    zeros = scored.select("txn_id", *[F.lit(0.0).alias(f) for f in spec.features]).limit(1)
    first = trees.score_trees(nodes, holes).first().probability
    assert first == trees.score_trees(nodes, zeros).first().probability
    table = trees.node_table(spark, nodes)
    assert table.count() == len(nodes)
    assert table.where("feature IS NULL").agg(F.count("prediction")).first()[0] == table.where(
        "prediction IS NOT NULL"
    ).count()
    assert trees.score_trees([], zeros).first().probability == 0.5



def test_rows_of_unknown_label_are_not_learnt_from(spark):
    rows = [(float(k % 7), k % 2) for k in range(100)] + [(float(k), None) for k in range(50)]
    spec = replace(MODEL_V1, features=("x",), trees=2)
    df = spark.createDataFrame(rows, "x double, is_fraud int")
    fits = [train_model(some, spec) for some in (df, df.where("is_fraud IS NOT NULL"))]
    assert trees.tree_nodes(fits[0], ["x"]) == trees.tree_nodes(fits[1], ["x"])


@pytest.mark.parametrize(("spec", "rate"), [(MODEL_V1, 0.1), (MODEL_V2, 0.05)])
def test_what_a_fit_is_made_of(spark, monkeypatch, spec, rate):
    monkeypatch.setattr(models, "_FITS", {})
    df = queries._fit_summary(replace(spec, trees=2))(spark, SMALL)
    sql = VIEW_SQL + oracle._training(spec.name, trees=2, rate=rate)
    assert differences(df, connect(SMALL), sql) == []


@pytest.mark.parametrize(("rows", "parts", "wanted"), [(2 * _LEAST_TASK_ROWS + 1, 1, 3), (100, 16, 1)])
def test_rows_of_a_fit_are_dealt_to_the_cores(spark, monkeypatch, rows, parts, wanted):
    read = []
    monkeypatch.setattr("pyspark.ml.Pipeline.fit", lambda _, df: read.append(df))
    ids = spark.range(rows).repartition(parts)
    df = ids.selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id % 2 AS INT) AS is_fraud")
    train_model(df, replace(MODEL_V2, features=("x",)))
    assert read[0].rdd.getNumPartitions() == wanted
    assert read[0].count() == rows


@pytest.mark.parametrize("spec", [MODEL_V1, MODEL_V2])
def test_every_row_is_learnt_from(spark, monkeypatch, spec):
    read = []
    monkeypatch.setattr("pyspark.ml.Pipeline.fit", lambda _, df: read.append(df))
    rows = 2_000_003  # the first fit groups equal rows, so all of these differ
    df = spark.range(rows).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id % 4 = 0 AS INT) AS is_fraud")
    train_model(df, replace(spec, features=("x",)))
    assert read[0].selectExpr("count(*)", "sum(x)").first() == (rows, rows * (rows - 1) / 2)
    fraud = (rows + 3) // 4
    weights = read[0].groupBy("is_fraud").sum("_weight").collect()
    assert dict(weights) == pytest.approx({0: rows - fraud, 1: rows - fraud})


def test_compared_models_are_fitted_side_by_side(spark, monkeypatch, fits):
    both = threading.Barrier(2, timeout=60)

    def fitted(spark, path, spec):
        both.wait()
        return SimpleNamespace(scored=fits[spec.name][2])

    monkeypatch.setattr(models, "fitted", fitted)
    monkeypatch.setattr(queries, "fitted", fitted)
    df = queries.registry()["model_comparison"](spark, SMALL)
    assert [r.version for r in df.collect()] == ["V1", "V2"]
