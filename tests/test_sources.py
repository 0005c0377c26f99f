import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from rows import frame, made, money, random_rows

from riskweave.schema import MERCHANTS, TRANSACTIONS
from riskweave.sources import (
    conform,
    dataset_check,
    load_checked,
    load_merchants,
    load_transactions,
    read_table,
    reject_summary,
)


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_formats_round_trip(spark, tmp_path, fmt):
    df = frame(spark, random_rows(1, n=50))
    path = str(tmp_path / fmt)
    options = {"header": "true"} if fmt == "csv" else {}
    df.write.format(fmt).options(**options).save(path)
    back = load_transactions(spark, path, fmt, **options)
    assert back.schema == TRANSACTIONS
    assert sorted(back.collect(), key=lambda r: r.txn_id) == sorted(df.collect(), key=lambda r: r.txn_id)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, random_rows(1, n=50)).write.parquet(path)
    df = load_transactions(spark, path).where("failed_logins > 2").select("txn_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(failed_logins,2)" in plan
    assert "ReadSchema: struct<txn_id:bigint,failed_logins:int>" in plan


def test_times_in_text_become_timestamps(spark):
    df = made(spark, {}).withColumn("txn_time", F.col("txn_time").cast("string"))
    row = conform(df, TRANSACTIONS).first()
    assert row.txn_time == dt.datetime(2024, 3, 5, 12)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="is_fraud"):
        conform(made(spark, {}).drop("is_fraud"), TRANSACTIONS)


def test_views_and_merchants(spark, tmp_path):
    made(spark, {}, {}).createOrReplaceTempView("some_transactions")
    assert read_table(spark, "some_transactions").count() == 2
    spark.catalog.dropTempView("some_transactions")
    rows = [(1, "a", "b", "c")]
    spark.createDataFrame(rows, MERCHANTS).write.parquet(str(tmp_path / "m"))
    assert [tuple(r) for r in load_merchants(spark, str(tmp_path / "m")).collect()] == rows


def test_dataset_check(spark):
    df = made(spark, {"is_fraud": 1}, {}, {}, {"is_fraud": None})
    row = dataset_check(df).first()
    assert (row.row_count, row.fraud_rate_pct) == (4, 33.33)
    assert row.column_types.startswith("txn_id bigint, user_id bigint, txn_time timestamp_ntz, amount decimal(12,2)")


CELLS = {
    "txn_id": "1", "user_id": "2", "txn_time": "2024-03-05 12:00:00", "amount": "12.30", "txn_type": "CP",
    "status": "approved", "card_number": "4000001234567890", "merchant_id": "3", "failed_logins": "0",
    "kyc_verified": "1", "account_age": "5", "risk_segment": "Low", "country": "IN", "txn_location": "IN",
    "merchant_cat": "Grocery", "is_fraud": "0", "is_chargeback": "0",
}
BAD_CELLS = [
    ({"txn_time": "2024-02-30 10:00:00"}, ["txn_time: not a timestamp_ntz"]),
    ({"txn_time": "yesterday", "amount": "12,30"}, ["txn_time: not a timestamp_ntz", "amount: not a decimal(12,2)"]),
    ({"amount": "12.345"}, ["amount: not a decimal(12,2)"]),
    ({"amount": "99999999999.00"}, ["amount: not a decimal(12,2)"]),
    ({"failed_logins": "1.9"}, ["failed_logins: not a int"]),
    ({"user_id": "99999999999999999999"}, ["user_id: not a bigint"]),
    ({"txn_id": None}, ["txn_id: missing"]),
]
GOOD_CELLS = [{}, {"amount": None}, {"user_id": None, "txn_time": None}, {"amount": "-7"}, {"txn_time": "2024-03-05T12:00:00.25"}]


def written_text(folder, fmt):
    """A file of good and bad rows and two that are broken; the number of its rows."""
    rows = [{**CELLS, **change} for change in [*GOOD_CELLS, *(c for c, _ in BAD_CELLS)]]
    if fmt == "json":
        lines = [json.dumps({k: v for k, v in r.items() if v is not None}) for r in rows]
        lines += ['{"txn_id": 1, "amount":', "no json"]
    else:
        header = ",".join(CELLS)
        quoted = lambda v: "" if v is None else f'"{v}"'
        lines = [header, *(",".join(map(quoted, r.values())) for r in rows), "7,8", ",".join(["9"] * 19)]
    folder.mkdir()
    (folder / f"rows.{fmt}").write_text("\n".join(lines) + "\n")
    return len(rows) + 2


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_loaded_and_rejected_rows_add_up(spark, tmp_path, fmt):
    total = written_text(tmp_path / "in", fmt)
    options = {"header": "true"} if fmt == "csv" else {}
    loaded = load_checked(spark, str(tmp_path / "in"), fmt, **options)
    assert loaded.rows.schema == TRANSACTIONS
    rows, rejected = loaded.rows.collect(), loaded.rejected.collect()
    assert len(rows) == len(GOOD_CELLS) and len(rows) + len(rejected) == total
    assert {r.amount for r in rows} == {None, money(12.3), money(-7)}
    assert dt.datetime(2024, 3, 5, 12, 0, 0, 250_000) in {r.txn_time for r in rows}
    assert all(r.raw for r in rejected)
    reasons = sorted(r.reasons for r in rejected)
    want = sorted([why for _, why in BAD_CELLS])
    broken = [r for r in reasons if r[0] == "malformed record"]
    assert len(broken) == 2
    assert [r for r in reasons if r[0] != "malformed record"] == want
    summary = {r.reason: r.rejected for r in reject_summary(loaded.rejected).collect()}
    assert summary["malformed record"] == 2 and summary["amount: not a decimal(12,2)"] == 3


def test_checked_loading_of_good_files(spark, tmp_path):
    df = frame(spark, random_rows(1, n=50))
    for fmt, options in (("csv", {"header": "true"}), ("json", {})):
        df.write.format(fmt).options(**options).save(str(tmp_path / fmt))
        loaded = load_checked(spark, str(tmp_path / fmt), fmt, **options)
        assert loaded.rejected.count() == 0
        assert sorted(loaded.rows.collect(), key=lambda r: r.txn_id) == sorted(df.collect(), key=lambda r: r.txn_id)
    with pytest.raises(ValueError, match="csv or json"):
        load_checked(spark, "x", "orc")
