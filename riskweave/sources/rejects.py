"""Text files with a verdict on every row: what fits the contract, and what does not and why."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TRANSACTIONS

_RAW = "_corrupt_record"


class Loaded(NamedTuple):
    """Rows with the contract's types, and the others with ``raw`` text and ``reasons``."""

    rows: DataFrame
    rejected: DataFrame


def load_checked(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: T.StructType = TRANSACTIONS,
    required: tuple[str, ...] = ("txn_id",),
    **options: str,
) -> Loaded:
    """Read csv or json so that loaded and rejected rows add up to all rows read.

    Cells are read as text and each is tried against its type, so that one bad cell neither stops
    the job nor turns into null unnoticed. A row is rejected if it is malformed (a broken record, too
    few or too many cells) or if a cell does not parse; missing cells are null, which only the columns
    in ``required`` may not be. ``reasons`` lists what is wrong, in the order of the columns.
    Times are read as they stand, without a zone; a number must fit its type exactly, so that
    ``12.345`` is no amount in cents. Both frames scan the files; neither is collected.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"csv or json, not {fmt}")
    texts = T.StructType([T.StructField(name, T.StringType()) for name in schema.fieldNames()])
    read = texts.add(_RAW, T.StringType())
    settings = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW}
    if fmt == "csv":
        settings["enforceSchema"] = "false" if str(options.get("header", "")).lower() == "true" else "true"
    else:
        settings["primitivesAsString"] = "true"
    raw = spark.read.format(fmt).options(**(settings | options)).schema(read).load(path)

    parsed = {f.name: _parsed(F.col(f.name), f.dataType) for f in schema.fields}
    wrong = [F.when(F.col(_RAW).isNotNull(), F.lit("malformed record"))]
    for field in schema.fields:
        cell, value = F.col(field.name), parsed[field.name]
        kind = field.dataType.simpleString()
        wrong.append(F.when(cell.isNotNull() & value.isNull(), F.lit(f"{field.name}: not a {kind}")))
        if field.name in required:
            wrong.append(F.when(cell.isNull(), F.lit(f"{field.name}: missing")))
    reasons = F.array_compact(F.array(*wrong))
    judged = raw.withColumn("reasons", reasons)
    good = F.size("reasons") == 0
    cells = F.to_json(F.struct(*schema.fieldNames()))
    return Loaded(
        judged.where(good).select(*[value.alias(name) for name, value in parsed.items()]),
        judged.where(~good).select(F.coalesce(F.col(_RAW), cells).alias("raw"), "reasons"),
    )


def reject_summary(rejected: DataFrame) -> DataFrame:
    """How often each reason occurs, most frequent first."""
    reasons = rejected.select(F.explode("reasons").alias("reason"))
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("rejected")).orderBy(F.desc("rejected"), "reason")


def _parsed(cell: Column, kind: T.DataType) -> Column:
    """The cell's value, or null if it is not one of that type."""
    if isinstance(kind, T.StringType):
        return cell
    text = F.trim(cell)
    if isinstance(kind, T.TimestampNTZType):
        return text.try_cast(kind)
    if isinstance(kind, T.DecimalType):
        # A cast would round digits away.
        exact = text.try_cast(T.DecimalType(38, 18))
        value = exact.try_cast(kind)
        return F.when(value == exact, value)
    if isinstance(kind, T.IntegralType):
        # A cast would read 1.9 as 1.
        return F.when(text.rlike(r"^[+-]?\d+$"), text).try_cast(kind)
    return text.try_cast(kind)
