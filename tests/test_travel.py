import datetime as dt
from itertools import pairwise

import pytest
from rows import NOON, collected, frame, made, random_rows

from riskweave.operators.takeover import ato_geo_risk, ato_risk, ato_travel_linked
from riskweave.operators.travel import impossible_travel, travel_hops

NAMES = ("user_id", "current_txn_time", "prev_txn_time", "hours_between_txn", "current_country", "prev_country")


def hops(rows):
    """Previous row per user, spelled out. Unknown users form one group, as SQL partitions do."""
    out = []
    known = sorted((r for r in rows if r["txn_time"]), key=lambda r: (r["txn_time"], r["txn_id"]))
    for user in {r["user_id"] for r in known}:
        for prev, cur in pairwise([r for r in known if r["user_id"] == user]):
            minutes = (cur["txn_time"] - prev["txn_time"]) // dt.timedelta(minutes=1)
            both = prev["country"] and cur["country"]
            if both and prev["country"] != cur["country"] and minutes < 120:
                out.append((prev, cur, round(minutes / 60, 2)))
    return out


@pytest.mark.parametrize("hot_share", [0.0, 0.2, 2.0])
@pytest.mark.parametrize("slice_seconds", [1, 10, 10**6])
@pytest.mark.parametrize("seed", [0])
@pytest.mark.parametrize("span", [300, 200_000])
def test_equals_lag(spark, seed, slice_seconds, span, hot_share):
    rows = random_rows(seed, n=250, span_s=span)
    expected = sorted(
        (
            (c["user_id"], c["txn_time"], p["txn_time"], h, c["country"], p["country"])
            for p, c, h in hops(rows)
        ),
        key=repr,
    )
    assert expected
    got = impossible_travel(frame(spark, rows), slice_seconds=slice_seconds, hot_share=hot_share)
    assert collected(got, *NAMES) == expected


@pytest.mark.parametrize(
    ("gap", "hours"),
    [
        (dt.timedelta(minutes=119, seconds=59), [1.98]),
        (dt.timedelta(minutes=120), []),
        (dt.timedelta(minutes=30), [0.5]),
        (dt.timedelta(seconds=59), [0.0]),
    ],
)
def test_two_hours(spark, gap, hours):
    df = made(spark, {"country": "UK"}, {"country": "UAE", "txn_time": NOON + gap})
    assert [r.hours_between_txn for r in impossible_travel(df).collect()] == hours


def test_only_the_row_before_counts(spark):
    minute = dt.timedelta(minutes=1)
    df = made(
        spark,
        {"country": "UK"},
        {"country": None, "txn_time": NOON + minute},
        {"country": "UAE", "txn_time": NOON + 2 * minute},
        {"country": "UAE", "txn_time": NOON + 3 * minute},
    )
    assert impossible_travel(df).collect() == []


def takeover(rows):
    return [
        r
        for r in rows
        if (r["failed_logins"] or 0) > 2
        and r["txn_type"] == "CNP"
        and r["amount"] is not None
        and r["amount"] > 500
        and r["kyc_verified"] == 0
    ]


def test_takeover_rows(spark):
    rows = random_rows(11, n=600)
    got = collected(ato_risk(frame(spark, rows)), "txn_id")
    assert got == sorted(((r["txn_id"],) for r in takeover(rows)), key=repr)


def test_takeover_bounds(spark):
    hit = {"failed_logins": 3, "txn_type": "CNP", "amount": 500.01, "kyc_verified": 0}
    misses = [{"failed_logins": 2}, {"txn_type": "CP"}, {"amount": 500}, {"kyc_verified": 1}, {"kyc_verified": None}]
    df = made(spark, hit, *[{**hit, **m} for m in misses])
    assert [r.txn_id for r in ato_risk(df).collect()] == [1]


@pytest.mark.parametrize(("hot_share", "cell_pairs"), [(0.0, 2_500), (0.2, 7), (2.0, 7)])
def test_takeover_with_travel(spark, hot_share, cell_pairs):
    rows = random_rows(5, n=500)
    expected = sorted(
        (
            (a["txn_id"], c["country"], p["country"], h)
            for a in takeover(rows)
            for p, c, h in hops(rows)
            if a["user_id"] is not None and a["user_id"] == c["user_id"]
        ),
        key=repr,
    )
    assert len(expected) > 100
    got = ato_geo_risk(frame(spark, rows), hot_share=hot_share, cell_pairs=cell_pairs)
    assert collected(got, "txn_id", "current_country", "prev_country", "hours_between") == expected


@pytest.mark.parametrize("cell_pairs", [2_500, 5])
@pytest.mark.parametrize(("before", "after"), [(24, 24), (0.5, 0), (0, 0)])
def test_takeover_near_travel(spark, cell_pairs, before, after):
    rows = random_rows(6, n=500)
    expected = sorted(
        (
            (a["txn_id"], c["txn_time"], p["country"], h)
            for a in takeover(rows)
            for p, c, h in hops(rows)
            if a["user_id"] is not None
            and a["txn_time"]
            and a["user_id"] == c["user_id"]
            and dt.timedelta(hours=-before) <= c["txn_time"] - a["txn_time"] <= dt.timedelta(hours=after)
        ),
        key=repr,
    )
    assert expected
    got = ato_travel_linked(frame(spark, rows), before, after, cell_pairs=cell_pairs)
    assert collected(got, "txn_id", "hop_time", "prev_country", "hours_between") == expected


def test_hops_keep_their_row(spark):
    df = made(spark, {"country": "UK"}, {"country": "UAE", "txn_time": NOON + dt.timedelta(minutes=5)})
    assert [r.txn_id for r in travel_hops(df).collect()] == [2]
