"""Hard rules and the takeover pattern on transactions as they arrive.

Both look at one row only, so a stream needs neither state nor a watermark, and the batch
and streaming plans are the same. Rules that compare rows stay batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signals import any_rule
from ..operators.scoring import keyed_rows
from ..operators.takeover import is_takeover


def screen(transactions: DataFrame) -> DataFrame:
    """Rows of a batch or a stream that a rule holds for, with the verdicts."""
    return (
        keyed_rows(transactions)
        .select(
            "txn_id",
            "user_id",
            "txn_time",
            F.when(any_rule(), "HARD_BLOCK").otherwise("SCORE").alias("hard_rule"),
            F.coalesce(is_takeover(), F.lit(False)).alias("ato_risk"),
        )
        .where((F.col("hard_rule") == "HARD_BLOCK") | F.col("ato_risk"))
    )
