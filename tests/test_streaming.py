import datetime as dt

import pytest
from rows import NOON, collected, dicts, frame, random_rows

from riskweave.operators.scoring import hard_rules
from riskweave.operators.takeover import ato_risk
from riskweave.schema import TRANSACTIONS
from riskweave.operators.velocity import daily_velocity, rolling_velocity_1h
from riskweave.streaming import daily_counts, only, rolling_counts, screen
from riskweave.streaming.rolling import ROCKSDB


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    df = frame(spark, random_rows(21, n=300))
    df.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(TRANSACTIONS).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        screen(stream)
        .writeStream.format("memory")
        .queryName("screened")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    got = collected(spark.table("screened"))
    assert got == collected(screen(df))
    blocked = {i for i, rule in collected(hard_rules(df), "txn_id", "hard_rule") if rule == "HARD_BLOCK"}
    assert {r[0] for r in got if r[3] == "HARD_BLOCK"} == blocked
    known = df.where("user_id IS NOT NULL AND txn_time IS NOT NULL")
    assert {r[0] for r in got if r[4]} == {i for (i,) in collected(ato_risk(known), "txn_id")}


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    yield
    spark.conf.set(name, before)


def replayed(spark, tmp_path, batches, build):
    """What a stream over files, a file a batch in the given order, has put out at its end."""
    for k, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03d}"))
    stream = (
        spark.readStream.schema(TRANSACTIONS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    )
    out = str(tmp_path / "out")
    query = (
        build(stream).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.read.schema(build(stream).schema).parquet(out)


def shuffled_days(seed):
    """Rows of some users in batches that go back and forth within an hour, and one that ends the stream."""
    rows = random_rows(seed, n=150, users=4, span_s=9_000)
    known = sorted((r for r in rows if r["txn_time"]), key=lambda r: (r["txn_time"].minute % 7, r["txn_id"]))
    known.sort(key=lambda r: (r["txn_time"] - NOON) // dt.timedelta(minutes=40))
    batches = [known[k : k + 30] for k in range(0, len(known), 30)]
    end = dicts({"txn_id": 10_000, "user_id": 99, "txn_time": NOON + dt.timedelta(days=3)})
    return known, [*batches, end, dicts({"txn_id": 10_001, "user_id": 99, "txn_time": NOON + dt.timedelta(days=3)})]


def test_rolling_counts_equal_the_batch(spark, rocksdb, tmp_path):
    rows, batches = shuffled_days(41)
    got = replayed(spark, tmp_path, batches, lambda s: rolling_counts(s, "2 hours"))
    assert only(got, "late").count() == 0
    want = rolling_velocity_1h(frame(spark, rows), ordered=False)
    names = want.columns
    assert collected(only(got, "velocity"), *names) == collected(want, *names)
    assert want.count() > 20


def test_late_rows_are_counted_and_change_nothing(spark, rocksdb, tmp_path):
    minute = dt.timedelta(minutes=1)
    row = lambda k, at: dicts({"txn_id": k, "user_id": 1, "txn_time": NOON + at})
    batches = [
        row(1, 0 * minute) + row(2, 1 * minute),
        row(3, 300 * minute),
        row(4, 301 * minute),
        row(5, 2 * minute) + row(6, 2 * minute) + row(7, 302 * minute),  # two come five hours late
        row(8, 900 * minute),
        row(9, 901 * minute),
    ]
    got = replayed(spark, tmp_path, batches, lambda s: rolling_counts(s, "10 minutes"))
    late = only(got, "late").collect()
    assert [(r.user_id, r.txn_time, r.late_rows) for r in late] == [(1, NOON + 2 * minute, 2)]
    counts = {r.txn_time: r.txns_last_1hr for r in only(got, "velocity").collect()}
    assert counts == {NOON + minute: 2, NOON + 301 * minute: 2, NOON + 302 * minute: 3}


def test_daily_counts_equal_the_batch(spark, rocksdb, tmp_path):
    rows, batches = shuffled_days(42)
    got = replayed(spark, tmp_path, batches, lambda s: daily_counts(s, "2 hours"))
    assert collected(got) == collected(daily_velocity(frame(spark, rows), ordered=False), *got.columns)
