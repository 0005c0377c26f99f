"""Column contracts of the two input tables."""

from pyspark.sql import types as T

# txn_time is a wall-clock time without a zone, so that results do not move with the
# session time zone.
TRANSACTIONS = T.StructType(
    [
        T.StructField("txn_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("txn_time", T.TimestampNTZType()),
        T.StructField("amount", T.DecimalType(12, 2)),
        T.StructField("txn_type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("card_number", T.StringType()),
        T.StructField("merchant_id", T.LongType()),
        T.StructField("failed_logins", T.IntegerType()),
        T.StructField("kyc_verified", T.IntegerType()),
        T.StructField("account_age", T.IntegerType()),
        T.StructField("risk_segment", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("txn_location", T.StringType()),
        T.StructField("merchant_cat", T.StringType()),
        T.StructField("is_fraud", T.IntegerType()),
        T.StructField("is_chargeback", T.IntegerType()),
    ]
)

MERCHANTS = T.StructType(
    [
        T.StructField("merchant_id", T.LongType()),
        T.StructField("merchant_name", T.StringType()),
        T.StructField("merchant_cat", T.StringType()),
        T.StructField("risk_tier", T.StringType()),
    ]
)
