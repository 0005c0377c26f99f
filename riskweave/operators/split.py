"""Reproducible stratified split and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .skew import HOT_SHARE, attach, row_total

# Leading hex digits of the row key that form a bucket: 16**5 buckets per class.
_PREFIX = 5


def stratified_split(
    df: DataFrame,
    label: str = "is_fraud",
    test_pct: int = 20,
    seed: int = 42,
    key: str = "txn_id",
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Rows plus ``part``: exactly ``test_pct`` percent (rounded) of each class are ``test``.

    Rows are ordered by a digest of seed and key, then by a hash of the whole row, and each class
    is cut at its quota. The cut is found from counts per digest prefix; only the one bucket that
    holds it is ranked. All rows are then compared with the cut of their class, which reaches
    them through ``attach``: classes may be few and large, or many.

    Quotas count the rows with a known key, null labels are a class of their own, and rows
    without a key are ``train``. Rows that repeat a key may be divided; where rows that are equal
    in every column would have to be, the split fails, as nothing tells them apart. Columns of a
    map type do not count for that.
    """
    hashed = [name for name, kind in df.dtypes if not kind.startswith("map")]
    keyed = df.withColumns(
        {
            "_class": F.to_json(F.struct(F.col(label).alias("c"))),
            "_key": _row_key(seed, key),
            "_tie": F.xxhash64(*hashed),
        }
    ).withColumn("_class_hash", F.xxhash64("_class"))
    cuts = _cuts(keyed, test_pct, hot_share)
    total = row_total(df)
    marked = attach(
        keyed,
        cuts,
        ["_class_hash", "_class"],
        ["_cut"],
        rows="_rows",
        total=total,
        spread_by=["_key", "_tie"],
        hot_share=hot_share,
    )
    test = F.struct("_key", "_tie") <= F.col("_cut")
    return marked.withColumn("part", F.when(F.col("_key").isNotNull() & test, "test").otherwise("train")).drop(
        "_class", "_class_hash", "_key", "_tie", "_cut"
    )


def _cuts(keyed: DataFrame, test_pct: int, hot_share: float) -> DataFrame:
    """Per class the last (key, tie) of the test part, and the number of its rows."""
    by = ["_class_hash", "_class"]
    slim = keyed.where(F.col("_key").isNotNull()).select(
        *by, "_key", "_tie", F.left("_key", F.lit(_PREFIX)).alias("_bucket")
    )
    buckets = slim.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ascending = Window.partitionBy(*by).orderBy("_bucket")
    upto = ascending.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = ascending.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("_n").over(whole)
    placed = buckets.select(
        *by,
        "_bucket",
        "_n",
        total.alias("_rows"),
        F.floor((total * test_pct + 50) / 100).alias("_quota"),
        F.sum("_n").over(upto).alias("_upto"),
    )
    before = F.col("_upto") - F.col("_n")
    holding = placed.where((F.col("_quota") > before) & (F.col("_quota") <= F.col("_upto"))).select(
        *by, "_rows", F.col("_bucket").alias("_held"), (F.col("_quota") - before).alias("_rest")
    )
    inside = attach(
        slim,
        holding,
        by,
        ["_held", "_rest", "_rows"],
        rows="_rows",
        total=row_total(keyed),
        spread_by=["_key", "_tie"],
        hot_share=hot_share,
    ).where(F.col("_held") == F.col("_bucket"))
    order = Window.partitionBy(*by).orderBy("_key", "_tie")
    same = F.struct("_key", "_tie")
    ranked = inside.select(
        *by, "_rows", "_rest", same.alias("_cut"), F.row_number().over(order).alias("_rank"),
        F.lead(same).over(order).alias("_next"),
    )
    alike = F.raise_error(F.lit("equal rows lie on both sides of the cut: no key tells them apart"))
    return ranked.where(F.col("_rank") == F.col("_rest")).select(
        *by,
        "_rows",
        F.when(F.col("_next") == F.col("_cut"), alike.cast("struct<_key:string,_tie:bigint>"))
        .otherwise(F.col("_cut"))
        .alias("_cut"),
    )


def _row_key(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def class_weights(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Negatives, positives and their ratio, one row; the weight of a positive row."""
    return df.agg(
        F.count(F.when(F.col(label) == 0, 1)).alias("negatives"),
        F.count(F.when(F.col(label) == 1, 1)).alias("positives"),
    ).select(
        "negatives",
        "positives",
        (F.col("negatives") / F.nullif(F.col("positives"), F.lit(0))).alias("pos_weight"),
    )
