"""Test mapping from the driver's tables to ``transactions`` and ``merchants``.

One SQL text serves Spark and the checking engine. Its constants only make every detector
find something; they carry no meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import MERCHANTS, TRANSACTIONS
from ..sources import conform

VIEW_SQL = """
WITH b AS (
  SELECT event_id, ts, user_id, event_type, CAST(value AS DECIMAL(10,2)) AS v,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
  FROM events),
t AS (
  SELECT event_id AS txn_id, user_id, ts AS txn_time,
         CAST(v * 8 AS DECIMAL(12,2)) AS amount,
         CASE WHEN event_type IN ('click','purchase','error') THEN 'CNP' ELSE 'CP' END AS txn_type,
         CASE WHEN event_type = 'error' THEN 'declined' ELSE 'approved' END AS status,
         CONCAT(CAST(400000 + CASE WHEN event_type = 'error' THEN k % 7 ELSE k % 40 END AS STRING),
                LPAD(CAST(user_id AS STRING), 10, '0')) AS card_number,
         (event_id * 7 + k) % (SELECT count(*) FROM supplier) AS merchant_id,
         CASE WHEN k >= 92 THEN k - 91 WHEN k >= 80 THEN 1 ELSE 0 END AS failed_logins,
         CASE WHEN user_id % 5 = 0 THEN 0 ELSE 1 END AS kyc_verified,
         CAST((user_id * 37) % 900 AS INT) AS account_age,
         CASE WHEN user_id % 10 IN (0, 3) THEN 'High' WHEN user_id % 10 < 6 THEN 'Medium' ELSE 'Low' END AS risk_segment,
         CASE WHEN k % 4 = 0 THEN 'UAE' WHEN user_id % 2 = 0 THEN 'UK' ELSE 'IN' END AS country,
         CASE WHEN k % 5 = 0 THEN 'US' WHEN user_id % 2 = 0 THEN 'UK' ELSE 'IN' END AS txn_location,
         k
  FROM b),
merchants AS (
  SELECT s_suppkey AS merchant_id, s_name AS merchant_name,
         CASE s_nationkey % 5 WHEN 0 THEN 'Crypto' WHEN 1 THEN 'Gaming' WHEN 2 THEN 'Ecommerce'
                              WHEN 3 THEN 'Travel' ELSE 'Grocery' END AS merchant_cat,
         CASE WHEN s_acctbal < 0 THEN 'High' WHEN s_acctbal < 5000 THEN 'Medium' ELSE 'Low' END AS risk_tier
  FROM supplier),
transactions AS (
  SELECT t.txn_id, t.user_id, t.txn_time, t.amount, t.txn_type, t.status, t.card_number, t.merchant_id,
         t.failed_logins, t.kyc_verified, t.account_age, t.risk_segment, t.country, t.txn_location, m.merchant_cat,
         CASE WHEN t.failed_logins > 5 AND t.k % 2 = 0 THEN 1
              WHEN t.failed_logins > 2 AND t.kyc_verified = 0 THEN 1
              WHEN m.merchant_cat = 'Crypto' AND t.k % 16 = 3 THEN 1
              WHEN t.k = 50 AND t.txn_type = 'CNP' THEN 1 ELSE 0 END AS is_fraud,
         CASE WHEN t.k = 97 THEN 1 ELSE 0 END AS is_chargeback
  FROM t JOIN merchants m ON t.merchant_id = m.merchant_id)
"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(_view(spark, sf_dir, "transactions"), TRANSACTIONS)


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(_view(spark, sf_dir, "merchants"), MERCHANTS)


# Definitions, not data: parsing the text and reading file footers once per session is enough.
_VIEWS: dict[tuple[str, str, str], DataFrame] = {}


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _VIEWS:
        _VIEWS[key] = _define(spark, sf_dir, name)
    return _VIEWS[key]


def _define(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # The tables are bound to this statement only, so that no session-wide view is left behind.
    text = VIEW_SQL.replace("FROM events", "FROM {events}").replace("FROM supplier", "FROM {supplier}")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "supplier")}
    return spark.sql(f"{text} SELECT * FROM {name}", **tables)
