"""Joins of rows whose times lie within a range of each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import epoch_micros, floor_div
from .skew import CELL_PAIRS, grid_join

_MICROS = 1_000_000


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    left_time: str,
    right_time: str,
    low_seconds: float,
    high_seconds: float,
    left_id: str,
    right_id: str,
    cell_pairs: int = CELL_PAIRS,
) -> DataFrame:
    """Pairs with equal keys and ``low <= right_time - left_time <= high``, both ends included.

    The range may lie before, around or after the left time. Time is cut into buckets as wide as
    the range. A right row is in its one bucket and a left row in the buckets that its range
    touches, one or two, so each pair meets exactly once, and what meets is at most twice the
    range away. Keys and bucket make the key of a grid join, which cuts hot buckets again.

    Rows without a key or a time match nothing. The sides share the names of the keys only. Times
    are compared to the microsecond and without a zone.
    """
    low, high = round(low_seconds * _MICROS), round(high_seconds * _MICROS)
    if low > high:
        raise ValueError("the range ends before it begins")
    shared = sorted((set(left.columns) & set(right.columns)) - set(keys))
    if shared:
        raise ValueError(f"columns on both sides: {', '.join(shared)}")
    width = max(1, high - low)

    def bucket(moment):
        return floor_div(moment, F.lit(width).cast("long"))

    begin = F.col("_moment")
    own = left.withColumn("_moment", epoch_micros(F.col(left_time)))
    spread = own.where(F.col("_moment").isNotNull()).withColumn(
        "_bucket", F.explode(F.sequence(bucket(begin + low), bucket(begin + high)))
    )
    there = right.withColumn("_there", epoch_micros(F.col(right_time)))
    placed = there.where(F.col("_there").isNotNull()).withColumn(
        "_bucket", bucket(F.col("_there"))
    )
    met = grid_join(
        spread,
        placed,
        [*keys, "_bucket"],
        left_id=left_id,
        right_id=right_id,
        cell_pairs=cell_pairs,
    )
    gap = F.col("_there") - F.col("_moment")
    return met.where(gap.between(low, high)).select(
        *left.columns, *[c for c in right.columns if c not in keys]
    )
