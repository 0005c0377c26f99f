"""Load transactions and merchants from files, catalog tables or a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exact import percent
from ..schema import MERCHANTS, TRANSACTIONS

# Text formats carry no types, so they are read with the contract's schema.
_TEXT_FORMATS = ("csv", "json")


def load_transactions(
    spark: SparkSession, path: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Transactions from files, with the contract's names and types."""
    return _load(spark, path, fmt, TRANSACTIONS, options)


def load_merchants(
    spark: SparkSession, path: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Merchants from files, with the contract's names and types."""
    return _load(spark, path, fmt, MERCHANTS, options)


def read_table(
    spark: SparkSession, name: str, schema: T.StructType = TRANSACTIONS, database: str | None = None
) -> DataFrame:
    """A catalog table or view, optionally after choosing a database."""
    return conform(spark.table(f"{database}.{name}" if database else name), schema)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    partition_column: str,
    lower: int,
    upper: int,
    num_partitions: int,
    schema: T.StructType = TRANSACTIONS,
    fetch_size: int = 10_000,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A database table read by range slices of a numeric column.

    The bounds only place the slice edges: rows outside them are read by the first and the
    last slice. Credentials belong in ``properties``, never in code.
    """
    options = {
        "url": url,
        "dbtable": table,
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(num_partitions),
        "fetchsize": str(fetch_size),
        **(properties or {}),
    }
    return conform(spark.read.format("jdbc").options(**options).load(), schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Check that the contract's columns exist, and cast those whose type differs."""
    missing = [name for name in schema.fieldNames() if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    have = {field.name: field.dataType for field in df.schema.fields}
    return df.select(
        *[
            F.col(f.name) if have[f.name] == f.dataType else F.col(f.name).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def dataset_check(df: DataFrame) -> DataFrame:
    """Row count, label rate in percent, and columns with their types, one row."""
    columns = ", ".join(f"{name} {kind}" for name, kind in df.dtypes)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("is_fraud").alias("label_sum"),
        F.count("is_fraud").alias("label_count"),
    ).select(
        "row_count",
        percent(F.col("label_sum"), F.col("label_count")).alias("fraud_rate_pct"),
        F.lit(columns).alias("column_types"),
    )


def _load(
    spark: SparkSession, path: str, fmt: str, schema: T.StructType, options: dict[str, str]
) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    if fmt in _TEXT_FORMATS:
        reader = reader.schema(schema)
    return conform(reader.load(path), schema)
