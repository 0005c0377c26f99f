"""A table of user-day totals that new and corrected days are added to.

The table is an append-only log of partial totals, partitioned by day. Totals add up, so a batch of
new rows is aggregated by itself and appended: no earlier row is read, neither transactions nor
totals. A correction is a batch too, with the rows to take back and the rows to put in their place.
Reading adds up what a user and day has; ``compacted`` writes the sums to a new table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profiles import user_days

TOTALS = ("day_rows", "day_count", "day_amounts", "day_cents")
_SCHEMA = "user_id long, day_rows long, day_count long, day_amounts long, day_cents long, txn_date date"


class ProfileTable:
    """User-day totals under one path, in any file system that Spark reaches.

    Each change is written under a folder of its own name, ``batch=...``, and a batch that is
    written again under the same name replaces itself, so a failed or repeated load counts once.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, rows: DataFrame, batch: str, taken_back: DataFrame | None = None) -> None:
        """Add the totals of a batch of transactions, less those of rows that are ``taken_back``."""
        change = user_days(rows)
        if taken_back is not None:
            less = user_days(taken_back)
            change = change.unionByName(less.select("user_id", "txn_date", *[(-F.col(c)).alias(c) for c in TOTALS]))
            change = _summed(change)
        self._write(change, batch)

    def days(self) -> DataFrame:
        """One row per user and day that still has rows; what ``with_user_day`` takes."""
        return _summed(self._log()).where("day_rows > 0")

    def compacted(self, path: str) -> ProfileTable:
        """A table under another path that has the sums only; this one stays as it is."""
        out = ProfileTable(self.spark, path)
        out._write(self.days(), f"compacted-{uuid.uuid4().hex[:8]}")
        return out

    def _write(self, change: DataFrame, batch: str) -> None:
        if not batch or not all(c.isalnum() or c in "-_." for c in batch):
            raise ValueError("a batch is named by letters, digits, dots and dashes")
        # Sorted by day, a task writes one file per day it has, and rows of a day lie together.
        change.repartition("txn_date", F.pmod(F.xxhash64("user_id"), F.lit(8))).sortWithinPartitions(
            "txn_date", "user_id"
        ).write.mode("overwrite").partitionBy("txn_date").parquet(f"{self.path}/batch={batch}")

    def _log(self) -> DataFrame:
        if not self._batches():
            return self.spark.createDataFrame([], _SCHEMA)
        reader = self.spark.read.schema(f"{_SCHEMA}, batch string").option("basePath", self.path)
        return reader.parquet(self.path).drop("batch")

    def _files(self):
        context = self.spark.sparkContext
        return self._jvm_path("").getFileSystem(context._jsc.hadoopConfiguration())

    def _jvm_path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _batches(self) -> list[str]:
        files = self._files()
        if not files.exists(self._jvm_path("")):
            return []
        names = [s.getPath().getName() for s in files.listStatus(self._jvm_path(""))]
        return [n for n in names if n.startswith("batch=") and files.exists(self._jvm_path(f"{n}/_SUCCESS"))]


def _summed(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id", "txn_date").agg(*[F.sum(c).alias(c) for c in TOTALS])
