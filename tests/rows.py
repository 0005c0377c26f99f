"""Handmade and random transactions."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from riskweave.schema import TRANSACTIONS

NOON = dt.datetime(2024, 3, 5, 12, 0, 0)

QUIET = {
    "txn_id": 0,
    "user_id": 1,
    "txn_time": NOON,
    "amount": Decimal("100.00"),
    "txn_type": "CP",
    "status": "approved",
    "card_number": "4000001234567890",
    "merchant_id": 1,
    "failed_logins": 0,
    "kyc_verified": 1,
    "account_age": 500,
    "risk_segment": "Low",
    "country": "IN",
    "txn_location": "IN",
    "merchant_cat": "Grocery",
    "is_fraud": 0,
    "is_chargeback": 0,
}


def money(value) -> Decimal:
    return Decimal(str(value)).quantize(Decimal("0.01"))


def dicts(*changes: dict) -> list[dict]:
    """Quiet rows with changes; keys are numbered unless given."""
    rows = []
    for i, change in enumerate(changes, start=1):
        row = {**QUIET, "txn_id": i, **change}
        if row["amount"] is not None:
            row["amount"] = money(row["amount"])
        rows.append(row)
    return rows


def frame(spark, rows: list[dict]):
    names = TRANSACTIONS.fieldNames()
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], TRANSACTIONS)


def made(spark, *changes: dict):
    return frame(spark, dicts(*changes))


def random_rows(seed: int, n: int = 400, users: int = 6, hot_share: float = 0.4, span_s: int = 20_000):
    """Rows with a hot user, repeated times, unknown values and all signals."""
    rng = random.Random(seed)
    rows = []
    for i in range(1, n + 1):
        user = 1 if rng.random() < hot_share else rng.choice([None, *range(2, users + 1)])
        time = NOON + dt.timedelta(seconds=rng.randrange(span_s), microseconds=rng.choice([0, 0, 250_000]))
        rows.append(
            {
                "txn_id": i,
                "user_id": user,
                "txn_time": None if rng.random() < 0.02 else time,
                "amount": None if rng.random() < 0.02 else money(rng.choice([1, 50, 400, 750, 899, 900.5, 2500])),
                "txn_type": rng.choice(["CNP", "CP"]),
                "status": rng.choice(["approved", "approved", "declined"]),
                "card_number": rng.choice([None, *(f"40000{b}{c:010d}" for b in range(2) for c in range(9))]),
                "merchant_id": rng.choice([None, 1, 2, 3]),
                "failed_logins": rng.choice([None, 0, 0, 2, 3, 6]),
                "kyc_verified": rng.choice([None, 0, 1, 1]),
                "account_age": rng.choice([None, 0, 29, 30, 31, 400]),
                "risk_segment": rng.choice([None, "High", "Low", "Medium"]),
                "country": rng.choice([None, "IN", "UK", "UAE"]),
                "txn_location": rng.choice([None, "IN", "UK"]),
                "merchant_cat": rng.choice([None, "Crypto", "Gaming", "Grocery"]),
                "is_fraud": rng.choice([0, 0, 0, 1]),
                "is_chargeback": rng.choice([0, 0, 1]),
            }
        )
    return rows


def collected(df, *names) -> list[tuple]:
    names = names or df.columns
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
