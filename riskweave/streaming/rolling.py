"""Transaction counts on a stream: per day by windows, and exactly per event over the last hour.

Both give what the batch operators give for the same rows, however the rows are cut into batches
and in whatever order they come, as long as none is later than the watermark allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.exact import cents, epoch_micros, money

HOUR = 3_600_000_000  # microseconds
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_OUT = (
    "kind string, user_id long, moment long, rows long, txns_last_1hr long, cents_last_1hr long, amounts long"
)


def daily_counts(transactions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """User-days with more than one transaction, each once its day is past the watermark.

    Spark's own windowed state: one row per user and open day. Later rows are left out and counted
    by Spark in the progress of the query; rows without a time have no day.
    """
    return (
        _timed(transactions)
        .withWatermark("event", delay)
        .groupBy("user_id", F.window("event", "1 day"))
        .agg(F.count(F.lit(1)).alias("daily_txn_count"), F.sum("cents").alias("_cents"))
        .where("daily_txn_count > 1")
        .select(
            "user_id",
            F.date_from_unix_date((F.unix_micros("window.start") / 86_400_000_000).cast("int")).alias("txn_date"),
            "daily_txn_count",
            money("_cents").alias("daily_amount"),
            F.lit("HIGH_VELOCITY").alias("fraud_flag"),
        )
    )


def rolling_counts(transactions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Per user and time, the transactions of the hour up to it; and the rows that came too late.

    A moment is answered when the watermark has passed it, since nothing that still counts for it
    can come then. Columns are those of ``rolling_velocity_1h`` with ``kind``: ``velocity`` for
    these, and ``late`` for moments of rows behind the watermark, with ``late_rows``; late rows
    change nothing else. One stream carries both, as a query has one sink: see ``only``.

    State per user is one entry per moment of the last hour and the delay, and one timer. It needs
    the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    # The processor sees late rows itself: without the watermark's column nothing is filtered.
    keyed = _timed(transactions).where("user_id IS NOT NULL")
    rows = keyed.withWatermark("event", delay).select("user_id", "moment", "cents")
    found = rows.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=_LastHour(), outputStructType=_OUT, outputMode="Append", timeMode="EventTime"
    )
    velocity = F.col("kind") == "velocity"
    return found.select(
        "kind",
        "user_id",
        # Without a zone, as it came.
        F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, moment / 1000000BD)").alias("txn_time"),
        "txns_last_1hr",
        F.when(F.col("amounts") > 0, money("cents_last_1hr")).alias("amount_last_1hr"),
        F.when(velocity, F.lit("HIGH_VELOCITY_1HR")).alias("fraud_flag"),
        F.when(~velocity, F.col("rows")).alias("late_rows"),
    )


def only(found: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind, for a sink that takes batches (``foreachBatch``)."""
    rows = found.where(F.col("kind") == kind)
    if kind == "late":
        return rows.select("user_id", "txn_time", "late_rows")
    return rows.drop("kind", "late_rows")


def _timed(transactions: DataFrame) -> DataFrame:
    """Rows with their time in microseconds, without a zone, and as an event time."""
    moment = epoch_micros(F.col("txn_time").cast("timestamp_ntz"))
    return transactions.where("txn_time IS NOT NULL").select(
        "user_id", moment.alias("moment"), F.timestamp_micros(moment).alias("event"), cents("amount").alias("cents")
    )


class _LastHour(StatefulProcessor):
    """Totals per moment of a user, answered and forgotten as the watermark moves on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # answered: whether the moment has gone out.
        self._moments = handle.getMapState(
            "moments", "moment long", "rows long, cents long, amounts long, answered boolean"
        )
        self._timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs() * 1000
        late: dict[int, int] = {}
        first = None
        for frame in rows:
            frame = frame.assign(known=frame["cents"].notna(), cents=frame["cents"].fillna(0).astype("int64"))
            sums = frame.groupby("moment").agg(n=("cents", "size"), cents=("cents", "sum"), known=("known", "sum"))
            for moment, n, total, known in sums.itertuples():
                if moment < past:
                    late[moment] = late.get(moment, 0) + int(n)
                    continue
                had = self._moments.getValue((moment,)) if self._moments.containsKey((moment,)) else (0, 0, 0)
                self._moments.updateValue(
                    (moment,), (had[0] + int(n), had[1] + int(total), had[2] + int(known), False)
                )
                first = moment if first is None else min(first, moment)
        if first is not None:
            self._wake(first // 1000 + 1)
        if late:
            yield pd.DataFrame(
                [("late", key[0], moment, n, None, None, None) for moment, n in sorted(late.items())],
                columns=["kind", "user_id", "moment", "rows", "txns_last_1hr", "cents_last_1hr", "amounts"],
            )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs() * 1000
        known = sorted((moment[0], tuple(value)) for moment, value in self._moments.iterator())
        out, start = [], 0
        rows = total = amounts = 0
        for moment, (n, cents_here, known_here, answered) in known:
            if moment >= past:
                break
            rows, total, amounts = rows + n, total + cents_here, amounts + known_here
            while known[start][0] < moment - HOUR:
                gone = known[start][1]
                rows, total, amounts = rows - gone[0], total - gone[1], amounts - gone[2]
                start += 1
            if not answered:
                self._moments.updateValue((moment,), (n, cents_here, known_here, True))
                if n * rows > 1:
                    out.append(("velocity", key[0], moment, n, n * rows, n * total, amounts))
        for moment, _ in known:
            if moment < past - HOUR:
                self._moments.removeKey((moment,))
        self._timer.clear()
        waiting = [moment for moment, _ in known if moment >= past]
        if waiting:
            self._wake(waiting[0] // 1000 + 1)
        elif known and known[-1][0] >= past - HOUR:
            self._wake((known[-1][0] + HOUR) // 1000 + 1)  # to forget the last ones
        if out:
            yield pd.DataFrame(
                out, columns=["kind", "user_id", "moment", "rows", "txns_last_1hr", "cents_last_1hr", "amounts"]
            )

    def _wake(self, at: int) -> None:
        """One timer per user, at the earliest time that anything is due."""
        if self._timer.exists():
            set_for = self._timer.get()[0]
            if set_for <= at:
                return
            self._handle.deleteTimer(set_for)
        self._handle.registerTimer(at)
        self._timer.update((at,))

    def close(self) -> None:
        pass
