from collections import defaultdict

import pytest
from rows import collected, frame, made, random_rows

from riskweave.operators.card_testing import bin_attack
from riskweave.operators.merchants import merchant_chargebacks
from riskweave.operators.structuring import structuring


def cards(declines: list[bool], prefix="400001"):
    return [
        {"card_number": f"{prefix}{i:010d}", "status": "declined" if d else "approved"} for i, d in enumerate(declines)
    ]


@pytest.mark.parametrize(
    ("declines", "rate"),
    [
        ([True, True, True, False], [75.0]),
        ([True, True, True], []),
        ([True, True, True, False, False], []),
    ],
)
def test_bin_attack_bounds(spark, declines, rate):
    assert [r.decline_rate_pct for r in bin_attack(made(spark, *cards(declines))).collect()] == rate


def test_bin_attack_counts_a_card_once(spark):
    rows = cards([True, True, True, True]) + cards([True])
    row = bin_attack(made(spark, *rows)).first()
    assert (row.bin, row.unique_cards, row.total_attempts, row.decline_count) == ("400001", 4, 5, 5)


def test_bin_attack_on_random_rows(spark):
    rows = random_rows(2, n=800)
    groups = defaultdict(list)
    for r in rows:
        groups[(r["txn_time"] and r["txn_time"].date(), r["card_number"] and r["card_number"][:6])].append(r)
    expected = []
    for (day, digits), rs in groups.items():
        unique = len({r["card_number"] for r in rs} - {None})
        declined = sum(r["status"] == "declined" for r in rs)
        if unique > 3 and 100 * declined > 30 * len(rs):
            expected.append((day, digits, unique, len(rs), declined))
    got = collected(
        bin_attack(frame(spark, rows), min_decline_pct=30),
        "txn_date", "bin", "unique_cards", "total_attempts", "decline_count",
    )
    assert got == sorted(expected, key=repr)
    assert got


@pytest.mark.parametrize(
    ("amounts", "alert"),
    [((700, 899), True), ((700, 899.5), False), ((700, 899, 900), False), ((699.99, 899), False), ((700, 700, 899.99), True)],
)
def test_structuring_bounds(spark, amounts, alert):
    df = made(spark, *[{"amount": a} for a in amounts])
    assert bool(structuring(df).collect()) is alert


def test_structuring_reads_approved_rows_only(spark):
    df = made(spark, {"amount": 700}, {"amount": 899, "status": "declined"})
    assert structuring(df).collect() == []
    df = made(spark, {"amount": 700}, {"amount": 899}, {"amount": 5000, "status": "declined"})
    row = structuring(df).first()
    assert (row.txn_count, row.total_amount, row.near_threshold_count, row.max_single_txn) == (2, 1599.0, 2, 899.0)


def listing(spark, *rows):
    return spark.createDataFrame(
        list(rows), "merchant_id long, merchant_name string, merchant_cat string, risk_tier string"
    )


def test_merchant_status_and_repeated_listings(spark):
    changes = [{"merchant_id": 1, "is_chargeback": int(i < 2)} for i in range(100)]
    changes += [{"merchant_id": 2, "is_chargeback": int(i < 3), "is_fraud": int(i < 1)} for i in range(100)]
    changes += [{"merchant_id": 3, "is_chargeback": int(i < 1)} for i in range(100)]
    changes += [{"merchant_id": 9, "is_chargeback": 1}, {"merchant_id": None, "is_chargeback": 1}]
    merchants = listing(
        spark, (1, "a", "x", "Low"), (2, "b", "x", "Low"), (2, "b", "x", "Low"), (2, "c", "x", "Low"), (3, "d", "x", "Low")
    )
    df = made(spark, *changes)
    got = collected(
        merchant_chargebacks(df, merchants),
        "merchant_id", "merchant_name", "total_transactions", "chargeback_count", "chargeback_rate_pct", "fraud_rate_pct", "status",
    )
    assert got == [
        (1, "a", 100, 2, 2.0, 0.0, "WARNING"),
        (2, "b", 200, 6, 3.0, 1.0, "CRITICAL"),
        (2, "c", 100, 3, 3.0, 1.0, "CRITICAL"),
    ]
    safe = collected(merchant_chargebacks(df, merchants, include_safe=True), "merchant_id", "status")
    assert (3, "SAFE") in safe
