"""What the physical plans must and must not contain, and that skewed rows are spread."""

import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from rows import frame, random_rows

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from riskweave.operators import metrics  # noqa: E402
from riskweave.operators.metrics import ranking_metrics  # noqa: E402
from riskweave.operators.profiles import with_spike_limit, with_user_day  # noqa: E402
from riskweave.operators.skew import HOT_SHARE  # noqa: E402
from riskweave.operators.summaries import hybrid_summary  # noqa: E402
from riskweave.operators.takeover import ato_geo_risk, ato_risk  # noqa: E402
from riskweave.operators.travel import impossible_travel  # noqa: E402
from riskweave.operators.velocity import rolling_velocity_1h  # noqa: E402
from riskweave.plans.oracle import oracle_texts  # noqa: E402

SMALL = "/root/testdata/sf0.001"
TRAINED = {"train_model_v1", "train_model_v2"}  # their reports read what was split, not the model


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(oracle_texts()) - TRAINED))
def test_no_nested_loops_and_no_python(spark, name):
    text = plan(contract.queries()[name](spark, SMALL))
    for bad in ("CartesianProduct", "NestedLoop", "EvalPython", "PythonUDF", "InPandas"):
        assert bad not in text


@pytest.fixture
def shuffled_joins(spark):
    """No size-based broadcasts and no merging of small partitions, as with large tables."""
    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def largest_share(df) -> float:
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(counts) / sum(counts)


@pytest.mark.parametrize("user", [1, None])
@pytest.mark.parametrize("lookup", [with_spike_limit, with_user_day])
def test_lookup_spreads_a_hot_or_unknown_user(spark, shuffled_joins, user, lookup):
    rows = random_rows(31, n=2000, users=400, hot_share=0.0)
    for r in rows[:1000]:
        r["user_id"] = user
    df = frame(spark, rows)
    # A bar between the hot user's share and those of the others.
    assert largest_share(lookup(df, df, hot_share=0.1)) < 0.2


def test_rolling_hour_spreads_a_hot_user(spark, shuffled_joins):
    rows = random_rows(32, n=2000, hot_share=1.0, span_s=3000)
    assert largest_share(rolling_velocity_1h(frame(spark, rows), ordered=False)) < 0.2


@pytest.mark.parametrize(
    ("operator", "keys"),
    [
        (rolling_velocity_1h, ("second", "hour")),
        (impossible_travel, ("slice",)),
        (ato_geo_risk, ("slice",)),
    ],
)
def test_windows_do_not_settle_for_rows_partitioned_by_user(spark, shuffled_joins, operator, keys):
    df = frame(spark, random_rows(35, n=200)).repartition(16, "user_id")
    text = plan(operator(df, ordered=False))
    for key in keys:
        assert re.search(rf"hashpartitioning\(user_id#\d+L?, {key}#", text), key


def test_skew_join_applies_to_the_suspects_rows(spark, shuffled_joins):
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "5k",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = random_rows(36, n=6000, users=300, hot_share=0.5)
        df = frame(spark, rows).repartition(8)
        out = ato_geo_risk(df, ordered=False)
        assert out.collect()
        assert "SortMergeJoin(skew=true)" in plan(out)
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_hot_keys_fit_a_broadcast():
    assert 1 / HOT_SHARE <= 20_000


def test_takeover_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, random_rows(33, n=50)).write.parquet(path)
    text = plan(ato_risk(spark.read.parquet(path), ordered=False))
    for pushed in ("GreaterThan(failed_logins,2)", "EqualTo(txn_type,CNP)", "EqualTo(kyc_verified,0)"):
        assert pushed in text
    assert "Exchange" not in text
    assert "card_number" not in text


def test_summary_reads_only_what_it_needs(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, random_rows(34, n=50)).write.parquet(path)
    text = plan(hybrid_summary(spark.read.parquet(path)))
    assert "card_number" not in text
    assert "merchant_id" not in text


def exchanges(df) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\([^)]*\)", plan(df))


def test_travel_shuffles_all_rows_once(spark, shuffled_joins):
    """The second exchange of a user's rows carries hops and the edges of hot users' slices only."""
    rows = random_rows(37, n=3000, users=300, hot_share=0.0, span_s=400_000)
    df = frame(spark, rows).repartition(4)
    out = impossible_travel(df, ordered=False, hot_share=0.5)
    second = [n for n in nodes(out, "ShuffleExchange") if "_w" in n[0] or "CASE WHEN" in n[0]]
    assert second
    known = sum(r["txn_time"] is not None for r in rows)
    out.collect()
    assert min(written(out)) == out.count()
    assert sorted(written(out))[-1] == known


def nodes(df, name: str) -> list[tuple[str, object]]:
    """(text, node) of the plan's nodes of that kind."""
    found, waiting = [], [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        if node.getClass().getSimpleName().startswith(name):
            found.append((node.simpleString(1000), node))
        children = node.children()
        waiting += [children.apply(k) for k in range(children.size())]
    return found


def written(df) -> list[int]:
    """Rows that each exchange of rows has written, once the plan has run."""
    by_key = [n for text, n in nodes(df, "ShuffleExchange") if "REPARTITION" in text or "CASE WHEN" in text or "_w" in text]
    return [n.metrics().apply("shuffleRecordsWritten").value() for n in by_key]


def test_ranking_evaluates_the_scored_rows_once(spark, shuffled_joins):
    scored = spark.range(1000).select(
        (F.col("id") % 50).cast("double").alias("score"), (F.col("id") % 3 == 0).cast("int").alias("is_fraud")
    )
    text = plan(ranking_metrics(scored, "score"))
    assert text.count(" Range (") == 1  # the sketch and both sides of the join share one shuffle
    assert text.count("ReusedExchange") == 2


def test_crowded_scores_are_dealt_evenly(spark):
    crowd = spark.range(100_000).select((F.lit(0.5) + F.col("id") * 1e-11).alias("score"))
    one = spark.createDataFrame([(1e9,)], "score double")
    counts = crowd.union(one).groupBy("score").agg(
        F.count(F.lit(1)).alias("pos"), F.count(F.lit(1)).alias("neg")
    )
    cells = metrics._with_cell(counts, F.col("score"), 32).groupBy("cell").count().collect()
    assert max(r["count"] for r in cells) <= 0.02 * 100_001
    assert sum(r["count"] for r in cells) == 100_001
