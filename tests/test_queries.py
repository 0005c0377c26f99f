import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from compare import connect, differences  # noqa: E402
from riskweave.plans.oracle import oracle_texts  # noqa: E402

SMALL = "/root/testdata/sf0.001"
CHECKED = sorted(set(oracle_texts()) - {"train_model_v1", "train_model_v2"})  # see test_model


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", CHECKED)
def test_equals_its_sql(spark, con, name):
    assert differences(contract.queries()[name](spark, SMALL), con, contract.oracle_sql()[name]) == []


def test_only_fitted_models_lack_sql():
    text = {n for n in contract.queries() if n == "pipeline" or n.startswith("op")}
    unchecked = set(contract.queries()) - set(oracle_texts()) - text
    assert all("model" in n or n == "feature_importance" for n in unchecked)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert [r.decision for r in contract.entry(spark).collect()] == ["BLOCK", "REVIEW", "APPROVE"]
