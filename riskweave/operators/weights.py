"""From feature importances to signal weights, and back into the scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.signals import FEATURE_SIGNALS

# The range weights are scaled to.
MIN_WEIGHT = 5
MAX_WEIGHT = 35


def weights_linear(importance: DataFrame, low: int = MIN_WEIGHT, high: int = MAX_WEIGHT) -> DataFrame:
    """Share of the largest importance times ``high``, at least ``low``; 0 stays 0."""
    top = F.max("importance").over(_whole_table())
    scaled = _whole(F.col("importance") / F.nullif(top, F.lit(0.0).cast("double")) * high)
    weight = F.when(F.col("importance") == 0, 0).otherwise(F.greatest(scaled, F.lit(low)))
    return importance.select("feature", "importance", weight.alias("sql_weight")).orderBy(
        F.desc("importance"), "feature"
    )


def weights_minmax(importance: DataFrame, low: int = MIN_WEIGHT, high: int = MAX_WEIGHT) -> DataFrame:
    """Importances above zero spread over ``low`` to ``high``; the others get 0.

    Where all of them are equal there is no spread and each gets ``high``.
    """
    active = F.when(F.col("importance") > 0, F.col("importance"))
    smallest, largest = F.min(active).over(_whole_table()), F.max(active).over(_whole_table())
    spread = F.nullif(largest - smallest, F.lit(0.0).cast("double"))
    scaled = _whole(F.lit(low) + (F.col("importance") - smallest) / spread * (high - low))
    weight = F.when(F.col("importance") > 0, F.coalesce(scaled, F.lit(high))).otherwise(0)
    return importance.select("feature", "importance", weight.alias("sql_weight")).orderBy(
        F.desc("importance"), "feature"
    )


def signal_weights(weights: DataFrame, features: Mapping[str, str] = FEATURE_SIGNALS) -> dict[str, int]:
    """Weights keyed by signal, for the scoring operators. Reads one row per model feature."""
    rows = weights.where(F.col("feature").isin(*features)).select("feature", "sql_weight").collect()
    return {features[r.feature]: int(r.sql_weight) for r in rows if r.sql_weight > 0}


def _whole_table() -> WindowSpec:
    """Importance tables have one row per model feature, so this window is tiny."""
    return Window.partitionBy(F.lit(1))


def _whole(value: Column) -> Column:
    """Rounded to a whole number, halves to even."""
    return F.bround(value).cast("int")
