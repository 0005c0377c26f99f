"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more than this share of all rows is hot. Shares sum to one, so fewer than
# 1 / HOT_SHARE = 20,000 keys can be hot: that bounds every broadcast made here,
# however large the data is.
HOT_SHARE = 1 / 20_000

# Pairs that one cell of a grid join should have at most.
CELL_PAIRS = 2_500
_SALTS = 32


def row_total(df: DataFrame) -> Column:
    """Number of rows as a one-value subquery: a count over no columns, without a shuffle."""
    return df.agg(F.count(F.lit(1))).scalar()


def attach(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    *,
    rows: str,
    total: Column,
    spread_by: Sequence[str],
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Left-join per-key statistics onto rows without sending a hot key to one task.

    ``stats`` has one row per key and says in ``rows`` how many rows carry it, out of at most
    ``total``. Hot keys are looked up in a broadcast of bounded size; the other keys are joined
    by shuffle. Rows already answered, and rows without a key, take part in the shuffle under
    a key made from ``spread_by``, columns that differ between rows. The first key is a long.
    """
    packed = F.struct(*values)
    hot_bar = F.col(rows) > total * hot_share
    hot = stats.where(hot_bar).select(*keys, packed.alias("_hot"))
    cold = stats.where(~hot_bar).select(*[F.col(k).alias(f"_c_{k}") for k in keys], packed.alias("_cold"))
    open_row = F.col("_hot").isNull()
    for key in keys:
        open_row &= F.col(key).isNotNull()
    first, *others = keys
    marked = df.join(F.broadcast(hot), list(keys), "left").select(
        *df.columns,
        "_hot",
        open_row.alias("_open"),
        # Rows with nothing to look up would all meet at one key; a digest spreads them.
        F.when(open_row, F.col(first)).otherwise(F.xxhash64(*spread_by)).alias(f"_k_{first}"),
        *[F.col(k).alias(f"_k_{k}") for k in others],
    )
    match = F.col("_open")
    for key in keys:
        match &= F.col(f"_k_{key}") == F.col(f"_c_{key}")
    return marked.join(cold, match, "left").select(
        *df.columns,
        *[F.coalesce(F.col(f"_hot.{v}"), F.col(f"_cold.{v}")).alias(v) for v in values],
    )


def grid_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    left_id: str,
    right_id: str,
    cell_pairs: int = CELL_PAIRS,
) -> DataFrame:
    """Inner many-to-many join whose output per key is spread over several tasks.

    A key with many rows on either side yields their product, which may be large although
    neither side is. Rows are therefore counted per key on both sides, and a key with more than
    ``cell_pairs`` pairs is laid out as a grid: each side is dealt into parts by its id, and each
    pair of parts is a cell, a join key of its own. Cells are about square, which copies rows
    least, unless one side is shorter than that.

    Only keys with a grid are looked up for the rows, in a shuffle in which each of them stands
    under ``_SALTS`` keys, so that a hot key does not gather in one task there either. The ids
    should differ between the rows of a key: rows that share one stay in one part. Rows without
    a key match nothing. Names beginning with an underscore are taken.
    """
    known = F.lit(True)
    for key in keys:
        known &= F.col(key).isNotNull()
    left, right = left.where(known), right.where(known)
    sizes = _key_rows(left, keys, "_left").join(_key_rows(right, keys, "_right"), list(keys))
    pairs = F.col("_left").cast("double") * F.col("_right")
    side = float(cell_pairs) ** 0.5

    def parts(own: str, other: str) -> Column:
        """How many parts a side is dealt into."""
        alone = F.ceil(pairs / F.lit(float(cell_pairs)))
        square = F.ceil(F.col(own) / F.lit(side))
        one = F.lit(1).cast("long")
        return F.when(F.col(own) <= side, one).when(F.col(other) <= side, alone).otherwise(square)

    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long")))
    grid = sizes.where(pairs > cell_pairs).select(
        *keys,
        parts("_left", "_right").alias("_left_parts"),
        parts("_right", "_left").alias("_right_parts"),
        salts.alias("_salt"),
    )
    cells = [*keys, "_left_part", "_right_part"]
    return (
        _dealt(left, grid, keys, "_left", "_right", left_id)
        .join(_dealt(right, grid, keys, "_right", "_left", right_id), cells)
        .drop("_left_part", "_right_part")
    )


def _key_rows(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def _dealt(df: DataFrame, grid: DataFrame, keys: Sequence[str], own: str, other: str, row_id: str) -> DataFrame:
    """Rows with their own part, once for each part of the other side."""
    salt = F.pmod(F.xxhash64(F.lit("salt"), row_id), F.lit(_SALTS).cast("long"))
    sized = df.withColumn("_salt", salt).join(grid, [*keys, "_salt"], "left")
    one = F.lit(1).cast("long")
    mine = F.pmod(F.xxhash64(row_id), F.coalesce(f"{own}_parts", one))
    every = F.sequence(F.lit(0).cast("long"), F.coalesce(f"{other}_parts", one) - 1)
    return sized.select(*df.columns, mine.alias(f"{own}_part"), F.explode(every).alias(f"{other}_part"))
