import datetime as dt
from collections import Counter, defaultdict

import pytest
from rows import NOON, collected, frame, made, money, random_rows

from riskweave.operators.velocity import daily_velocity, rolling_velocity_1h

HOUR = dt.timedelta(hours=1)


def joined(rows):
    """The self join, spelled out."""
    rows = [r for r in rows if r["user_id"] is not None and r["txn_time"] is not None]
    counts, sums = Counter(), defaultdict(list)
    for a in rows:
        for b in rows:
            if a["user_id"] == b["user_id"] and a["txn_time"] - HOUR <= b["txn_time"] <= a["txn_time"]:
                key = (a["user_id"], a["txn_time"])
                counts[key] += 1
                sums[key].append(b["amount"])
    out = []
    for key, n in counts.items():
        known = [x for x in sums[key] if x is not None]
        if n > 1:
            out.append((*key, n, float(sum(known)) if known else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("span", [400, 30_000])
def test_equals_the_self_join(spark, seed, span):
    rows = random_rows(seed, n=250, span_s=span)
    got = collected(rolling_velocity_1h(frame(spark, rows)), "user_id", "txn_time", "txns_last_1hr", "amount_last_1hr")
    assert got == joined(rows)


def test_repeated_time_counts_every_pair(spark):
    df = made(spark, {"amount": 10}, {"amount": 15})
    row = rolling_velocity_1h(df).collect()
    assert [(r.txns_last_1hr, r.amount_last_1hr, r.fraud_flag) for r in row] == [(4, 50.0, "HIGH_VELOCITY_1HR")]


@pytest.mark.parametrize(
    ("later", "found"),
    [(HOUR, [2]), (HOUR + dt.timedelta(seconds=1), []), (HOUR + dt.timedelta(microseconds=1), [])],
)
def test_hour_is_inclusive(spark, later, found):
    df = made(spark, {"txn_time": NOON}, {"txn_time": NOON + later})
    assert [r.txns_last_1hr for r in rolling_velocity_1h(df).collect()] == found


def test_amounts_that_are_all_unknown_stay_unknown(spark):
    df = made(spark, {"amount": None}, {"amount": None, "txn_time": NOON + dt.timedelta(minutes=1)})
    assert collected(rolling_velocity_1h(df), "txns_last_1hr", "amount_last_1hr") == [(2, None)]


def test_order_is_by_count(spark):
    rows = random_rows(9, n=200)
    counts = [r.txns_last_1hr for r in rolling_velocity_1h(frame(spark, rows)).collect()]
    assert counts == sorted(counts, reverse=True)


def test_daily_velocity(spark):
    rows = random_rows(3)
    days = defaultdict(list)
    for r in rows:
        days[(r["user_id"], r["txn_time"] and r["txn_time"].date())].append(r["amount"])
    expected = []
    for (user, day), amounts in days.items():
        if len(amounts) > 1:
            total = sum((a for a in amounts if a is not None), money(0))
            expected.append((user, day, len(amounts), float(total)))
    got = collected(daily_velocity(frame(spark, rows)), "user_id", "txn_date", "daily_txn_count", "daily_amount")
    assert got == sorted(expected, key=repr)
