"""Jobs with state in the store: several batches, restarts, and keys that leave."""

import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_traps import _plain_alerts

from millrace.operators import windows
from millrace.streaming import keyed, state


def timed(df, t="t"):
    return df.withColumn("ts", F.timestamp_seconds(t))


def test_alerts_over_batches_and_a_restart(spark):
    rows = [(k % 3, k, 5.0 + k * 10_000.0, float(k * k % 37)) for k in range(60)]
    df = timed(spark.createDataFrame(rows, "worker long, line long, t double, value double"))
    job = keyed.KeyedJob(spark, keyed.Degradation(86_400.0, 3, 20.0, 172_800.0), "worker", "worker long, line long, rate double")
    job.replay(df.where("line < 40"), "line", 20)
    job.run()
    again = keyed.KeyedJob(spark, keyed.Degradation(86_400.0, 3, 20.0, 172_800.0), "worker", job.schema, base=job.base)
    again.add(df.where("line >= 40").coalesce(1))
    got = sorted((r.worker, r.line, round(r.rate, 9)) for r in again.run().collect())
    assert got == _plain_alerts(rows) != []
    assert got == sorted((r.worker, r.line, round(r.rate, 9)) for r in state.degradation_alerts(spark, df).collect())


def test_idle_workers_leave_the_store(spark):
    at = [(1, 1.0), (3, 10.0), (2, 11.0), (1, 20.0), (2, 4000.0), (2, 9000.0), (2, 20_000.0), (1, 20_001.0), (2, 20_002.0), (1, 20_003.0)]
    calls = [(w, line, t) for line, (w, t) in enumerate(at)]
    df = timed(spark.createDataFrame(calls, "worker long, line long, t double"))
    job = keyed.KeyedJob(spark, keyed.Calls(3600.0, 5001.0), "worker", "worker long, line long, session long, n long")
    job.replay(df, "line", 2)
    got = sorted((r.line, r.session, r.n) for r in job.run().collect())
    # Worker 1 idles beyond 5,001 seconds and starts again with session 1.
    assert got == [(0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 2), (4, 2, 1), (5, 3, 1), (6, 1, 1), (7, 1, 1), (8, 1, 2), (9, 1, 2)]
    assert max(job.store_rows) == 3 and job.store_rows[-1] == 2  # worker 3 is gone


def test_rate_limits_equal_the_batch_form(spark):
    rows = [(k % 2, k, 1.0 + t) for k, t in enumerate([0, 0, 10, 10, 20, 30, 4000, 5000, 5100, 5200])]
    df = spark.createDataFrame(rows, "worker long, line long, t double")
    want = sorted(map(tuple, windows.rate_limited(df, "worker", "t", "line", 2, 3600.0).select("worker", "line", "session", "n", "allowed").collect()))
    assert sorted(map(tuple, keyed.rate_limits(spark, df, 2, 3600.0, batch_rows=4).collect())) == want


@pytest.mark.parametrize("batch_rows", [2, 100])
def test_states_are_forgotten(spark, batch_rows):
    day = 86_400_000_000
    rows = [(1, 5.0, "a", 10), (2, 1.0, "x", 11), (1, None, "b", day), (3, 2.0, "y", day + 1), (1, None, "c", 2 * day), (2, None, "z", 3 * day), (3, 7.0, "w", 3 * day + 1), (4, None, None, 3 * day + 2)]
    df = spark.createDataFrame(rows, "id long, bought double, state string, us long")
    got = {tuple(r) for r in keyed.kept_states(spark, df, day + 5, batch_rows).collect()}
    assert got == {(1, 5.0, "c", 2 * day, 3), (2, None, "z", 3 * day, 1), (3, 7.0, "w", 3 * day + 1, 1), (4, None, None, 3 * day + 2, 1)}


def test_many_workers_in_few_entries_and_times_that_repeat(spark):
    """The store has an entry a bucket, however many workers there are; copies of a table whose times begin anew are not late."""
    rows = [(100 * c + k % 100, 300 * c + k, 1.0 + 50.0 * k) for c in range(4) for k in range(300)]
    df = spark.createDataFrame(rows, "worker long, line long, t double")
    want = sorted(map(tuple, windows.rate_limited(df, "worker", "t", "line", 2, 6000.0).select("worker", "line", "session", "n", "allowed").collect()))
    assert sorted(map(tuple, keyed.rate_limits(spark, df, 2, 6000.0, batch_rows=300).collect())) == want
    job = keyed.KeyedJob(spark, keyed.Calls(6000.0, None), "worker", "worker long, line long, session long, n long")
    job.replay(timed(df), "ts", 600)
    assert job.run().count() == len(rows) and max(job.store_rows) <= keyed.BUCKETS


def test_many_states_in_few_entries(spark):
    rows = [(k % 400, float(k) if k % 3 else None, f"s{k}" if k % 2 else None, 1_000_000 * (k + 1)) for k in range(1200)]
    df = spark.createDataFrame(rows, "id long, bought double, state string, us long")
    want = sorted(map(str, state.kept_states(spark, df, 500_000_000).collect()))
    assert sorted(map(str, keyed.kept_states(spark, df, 500_000_000, 600).collect())) == want and len(want) == 400
    job = keyed.KeyedJob(spark, keyed.Patches(500_000_000), "id", "id long, bought double, state string, us long, n long, gone boolean")
    job.replay(df.withColumn("ts", F.timestamp_micros("us")), "us", 600)
    job.run()
    assert max(job.store_rows) <= keyed.BUCKETS


def test_alerts_of_many_workers_in_few_entries(spark):
    rows = [(300 * c + k % 300, 900 * c + k, 5.0 + k * 60.0, float(k * k % 37)) for c in range(2) for k in range(900)]
    df = spark.createDataFrame(rows, "worker long, line long, t double, value double")
    got = sorted((r.worker, r.line, round(r.rate, 9)) for r in keyed.degradation_alerts(spark, df, batch_rows=900).collect())
    assert got == _plain_alerts(rows) != []
    job = keyed.KeyedJob(spark, keyed.Degradation(86_400.0, 3, 20.0, 172_800.0), "worker", "worker long, line long, rate double")
    job.replay(timed(df), "ts", 900)
    job.run()
    assert max(job.store_rows) <= keyed.BUCKETS


def _stores(job):
    return len([p for p in Path(job.base.removeprefix("file:"), "state", "state", "0").iterdir() if p.name.isdigit()])


def test_a_store_for_few_partitions_whatever_the_session_has(spark):
    """Each partition opens and commits a store of its own in every micro-batch, so the session's 64 or 200 are not taken."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = [(k % 400, float(k) if k % 3 else None, f"s{k}", 1_000_000 * (k + 1)) for k in range(1200)]
        df = spark.createDataFrame(rows, "id long, bought double, state string, us long").withColumn("ts", F.timestamp_micros("us"))
        job = keyed.KeyedJob(spark, keyed.Patches(500_000_000), "id", "id long, bought double, state string, us long, n long, gone boolean")
        job.replay(df, "us", 600)
        states = keyed.current(job.run(), 500_000_000).count()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert states == 400 and _stores(job) <= 2 * spark.sparkContext.defaultParallelism


def test_many_workers_cost_no_more_than_their_rows():
    """A bucket of 20,000 workers with a row each is walked like one worker's 20,000 rows, not frame by frame."""
    job, n = keyed.Degradation(86_400.0, 3, 20.0, 172_800.0), 20_000

    def seconds(worker):
        frame = pd.DataFrame([(worker(k), k, 5.0 + k, float(k % 37)) for k in range(n)], columns=["worker", "line", "t", "value"]).sort_values(job.ORDER)
        began = time.perf_counter()
        job.step(frame, {})
        return time.perf_counter() - began

    seconds(lambda k: 0)
    assert min(seconds(lambda k: k) for _ in range(3)) < 5 * min(seconds(lambda k: 0) for _ in range(3))
