"""User-day totals kept in a table, against the same statistics from all rows."""

import datetime as dt

import pytest
from rows import NOON, collected, frame, money, random_rows

from riskweave.operators.features import features_v2
from riskweave.sources.profile_table import ProfileTable

DAY = dt.timedelta(days=1)


def days(seed):
    """Rows of four days, a list per day; rows without a time are in the first."""
    out = []
    for k in range(4):
        rows = random_rows(seed + k, n=80, span_s=80_000)
        for r in rows:
            r["txn_id"] += 1_000 * k
            r["txn_time"] = r["txn_time"] and r["txn_time"] - dt.timedelta(hours=12) + k * DAY
        out.append(rows)
    return out


@pytest.mark.parametrize("hot_share", [0.0, 2.0])
def test_features_from_the_table_equal_those_from_all_rows(spark, tmp_path, hot_share):
    first, *more = days(50)
    table = ProfileTable(spark, str(tmp_path / "profiles"))
    table.add(frame(spark, first), "day-0")
    for k, rows in enumerate(more, 1):
        table.add(frame(spark, rows), f"day-{k}")
    # A late correction: one row of an earlier day had another amount, one had not happened.
    wrong, gone = [r for r in more[0] if r["user_id"] == 1 and r["amount"]][:2]
    right = {**wrong, "amount": money(4_321.5)}
    table.add(frame(spark, [right]), "day-1-again", taken_back=frame(spark, [wrong, gone]))

    changed = [right if r is wrong else r for r in more[0] if r is not gone]
    every = frame(spark, [*first, *changed, *more[1], *more[2]])
    want = collected(features_v2(every, hot_share=hot_share))
    assert collected(features_v2(every, days=table.days(), hot_share=hot_share)) == want

    compacted = table.compacted(str(tmp_path / "compacted"))
    assert collected(compacted.days()) == collected(table.days())
    assert collected(features_v2(every, days=compacted.days(), hot_share=hot_share)) == want


def test_a_batch_written_again_counts_once(spark, tmp_path):
    rows = frame(spark, days(60)[0])
    table = ProfileTable(spark, str(tmp_path / "profiles"))
    assert table.days().count() == 0
    table.add(rows, "a")
    once = collected(table.days())
    table.add(rows, "a")
    assert collected(table.days()) == once
    with pytest.raises(ValueError, match="named by"):
        table.add(rows, "a/b")


def test_new_days_leave_old_files_alone(spark, tmp_path):
    table = ProfileTable(spark, str(tmp_path / "profiles"))
    first, second, *_ = days(70)
    table.add(frame(spark, first), "a")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "profiles").rglob("*.parquet")}
    table.add(frame(spark, second), "b")
    assert all(p.stat().st_mtime_ns == at for p, at in before.items())
    day = NOON.date() + DAY
    assert any(f"txn_date={day}" in str(p) for p in (tmp_path / "profiles").rglob("*.parquet"))


def test_all_rows_taken_back_leave_nothing(spark, tmp_path):
    table = ProfileTable(spark, str(tmp_path / "profiles"))
    rows = frame(spark, days(80)[0])
    table.add(rows, "a")
    table.add(rows.limit(0), "b", taken_back=rows)
    assert table.days().count() == 0
