"""Streaming jobs whose state lies in the state store, one entry for a bucket of keys, with timers in event time that let idle keys leave it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from millrace.sources.scratch import shared_path
from millrace.streaming.state import Samples

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a replayed table in a micro-batch: what a key can have in a task's memory at most.
BATCH_ROWS = 500_000
#: Buckets of keys: so many calls a micro-batch at most, however many keys it has.  A job's state is bound to this number.
BUCKETS = 256


@contextmanager
def rocks(spark: SparkSession):
    """State processors need the RocksDB store, and no more partitions than two a core: each has a store and a Python worker of its own, which
    every micro-batch opens and commits, however few rows it has.  The session's settings come back afterwards."""
    few = min(int(spark.conf.get(PARTITIONS)), 2 * spark.sparkContext.defaultParallelism, BUCKETS)
    wanted = {PROVIDER: ROCKS, PARTITIONS: str(few)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class KeyedJob:
    """A processor over rows (key, ts and more) that arrive in a folder; its state outlives a run, so that a new run goes on.

    ts is the event time, after 1970; the watermark follows the latest by a second.  Rows of a micro-batch reach the processor by buckets
    of keys, in no order; a processor orders those of its bucket itself, which are no more than the batch's.
    """

    def __init__(self, spark: SparkSession, processor: StatefulProcessor, key: str, schema: str, files: int | None = None, base: str | None = None):
        self.spark, self.processor, self.key, self.schema, self.files = spark, processor, key, schema, files
        self.base = base or shared_path(spark)
        self.store_rows: list[int] = []

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.base}/in")

    def replay(self, rows: DataFrame, order: str, batch_rows: int = BATCH_ROWS) -> None:
        """Adds a table in ranges of ``order``, a file and a micro-batch each, one after another.  It is written first, so that
        counting and cutting don't make it anew."""
        whole, cut = f"{self.base}/whole", f"{self.base}/cut"
        rows.write.parquet(whole)
        rows = self.spark.read.schema(rows.schema).parquet(whole)
        parts = math.ceil(rows.count() / batch_rows)
        if parts <= 1:
            return self.add(rows)
        rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(cut)
        for k in range(parts):
            self.add(self.spark.read.schema(rows.schema).option("basePath", f"{cut}/_part={k}").parquet(f"{cut}/_part={k}").coalesce(1))
        self.files = 1

    def run(self) -> DataFrame:
        """Runs over what has not been seen; all output so far."""
        known = self.spark.read.parquet(f"{self.base}/in").schema
        reader = self.spark.readStream.schema(known)
        stream = (reader.option("maxFilesPerTrigger", self.files) if self.files else reader).parquet(f"{self.base}/in").withWatermark("ts", "1 second")
        stream = stream.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(BUCKETS)).cast("int"))
        out = stream.groupBy("bucket").transformWithStateInPandas(self.processor, self.schema, "append", "EventTime")
        with rocks(self.spark):
            sink = out.writeStream.format("parquet").option("path", f"{self.base}/out").option("checkpointLocation", f"{self.base}/state")
            query = sink.outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
        self.store_rows += [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/out")


def _millis(seconds: float) -> int:
    return math.ceil(seconds * 1000)


class Keyed(StatefulProcessor):
    """A processor over a bucket of keys: one entry of the store holds what is known of all of them, as a table in Arrow's format.

    A subclass names the table's columns (the key first) and those of its output, and gives ``step``: what it
    tells of a micro-batch's rows and what it then knows of their keys, each with the time in milliseconds at which it leaves (none: stays).
    A bucket has one timer, for the earliest of those times; it takes out what has left by then."""

    KNOWN: dict[str, pa.DataType]
    TOLD: dict[str, pa.DataType]
    ORDER: str | list[str] = "line"

    def init(self, handle) -> None:
        self.handle = handle
        self.table = handle.getValueState("table", "rows binary")
        self.schema = pa.schema([*self.KNOWN.items(), ("leaves", pa.int64())])

    def close(self) -> None:
        pass

    def step(self, frame: pd.DataFrame, known: dict) -> tuple[list[tuple], list[tuple]]:
        """Rows told, and rows known of the keys of ``frame`` (in order); known has those of them that were known before."""
        raise NotImplementedError

    def farewell(self, gone: pa.Table) -> pa.Table | None:
        """What is told of keys that leave."""

    def held(self) -> pa.Table:
        found = self.table.get() if self.table.exists() else None
        return pa.ipc.open_stream(bytes(found[0])).read_all() if found else self.schema.empty_table()

    def hold(self, rows: pa.Table) -> None:
        if rows.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as writer:
                writer.write_table(rows.combine_chunks())
            self.table.update((sink.getvalue().to_pybytes(),))
        else:
            self.table.clear()
        first = pc.min(rows["leaves"]).as_py()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if first is not None:
            self.handle.registerTimer(first)

    def shown(self, rows: pa.Table) -> pd.DataFrame:
        return rows.to_pandas(types_mapper={pa.bool_(): pd.BooleanDtype()}.get)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.ORDER, kind="stable")
        held, name = self.held(), self.schema.names[0]
        met = pc.is_in(held[name], value_set=pa.array(frame[name].unique(), held.schema.field(0).type))
        known = {r[0]: r[1:-1] for r in zip(*(c.to_pylist() for c in held.filter(met).columns), strict=True)}
        told, now = self.step(frame, known)
        self.hold(pa.concat_tables([held.filter(pc.invert(met)), _table(now, self.schema)]))
        yield self.shown(_table(told, pa.schema(list(self.TOLD.items()))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held()
        left = pc.fill_null(pc.less_equal(held["leaves"], timerValues.getCurrentWatermarkInMs()), False)
        self.hold(held.filter(pc.invert(left)))
        told = self.farewell(held.filter(left))
        yield self.shown(told if told is not None else pa.schema(list(self.TOLD.items())).empty_table())


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _lists(frame: pd.DataFrame, *names: str) -> Iterator[tuple]:
    return zip(*(frame[c].tolist() for c in names), strict=True)


class Degradation(Keyed):
    """Rows (worker, line, t, value, ts): an alert where the mean of the last ``span`` seconds is below ``floor`` with ``least`` samples
    or more.  It clears the samples and starts ``quiet`` seconds without another.  The store holds a worker's samples of the
    span as lists and the time until which it is quiet; both leave when they have lost their meaning."""

    KNOWN = {"worker": pa.int64(), "until": pa.float64(), "t": pa.list_(pa.float64()), "value": pa.list_(pa.float64())}
    TOLD = {"worker": pa.int64(), "line": pa.int64(), "rate": pa.float64()}
    ORDER = ["worker", "line"]

    def __init__(self, span: float, least: int, floor: float, quiet: float):
        self.span, self.least, self.floor, self.quiet = span, least, floor, quiet

    def step(self, frame: pd.DataFrame, known: dict) -> tuple[list[tuple], list[tuple]]:
        told, now = [], []
        for worker, rows in groupby(_lists(frame, "worker", "line", "t", "value"), itemgetter(0)):
            until, times, values = known.get(worker, (-math.inf, (), ()))
            window = Samples()
            for t, v in zip(times, values, strict=True):
                window.push(t, v)
            for _, line, t, v in rows:
                window.push(t, math.nan if v is None else v)
                window.forget(t - self.span)
                rate = window.mean()
                if len(window.rows) >= self.least and rate < self.floor and t >= until:
                    told.append((worker, line, rate))
                    until = t + self.quiet
                    window.clear()
            leaves = max(until, window.rows[-1][0] + self.span if window.rows else until)
            now.append((worker, until, [r[0] for r in window.rows], [r[1] for r in window.rows], _millis(leaves) + 1))
        return told, now


class Calls(Keyed):
    """Rows (worker, line, t, ts): a counter that each call raises and renews, and that falls to 0 after ``window`` idle seconds.

    The store holds a worker's last call, session and count, and forgets them ``forget`` seconds after the last call, if that is
    given: its sessions then count from 1 again.  Rows decide by their own times; timers only empty the store."""

    KNOWN = {"worker": pa.int64(), "last": pa.float64(), "session": pa.int64(), "n": pa.int64()}
    TOLD = {"worker": pa.int64(), "line": pa.int64(), "session": pa.int64(), "n": pa.int64()}

    def __init__(self, window: float, forget: float | None):
        self.window, self.forget = window, forget

    def step(self, frame: pd.DataFrame, known: dict) -> tuple[list[tuple], list[tuple]]:
        told, now, keep = [], {}, None if self.forget is None else max(self.forget, self.window)
        for worker, line, t in _lists(frame, "worker", "line", "t"):
            last, session, n = now.get(worker) or known.get(worker) or (None, 0, 0)
            if session and keep is not None and t - last >= keep:
                session, n = 0, 0
            if n == 0 or t - last >= self.window:
                session, n = session + 1, 0
            now[worker] = t, session, n + 1
            told.append((worker, line, session, n + 1))
        return told, [(w, *s, None if keep is None else _millis(s[0] + keep) + 2) for w, s in now.items()]


class Patches(Keyed):
    """Rows (id, bought, state, us, ts): later values that are not null win; a state leaves the store ``keep`` microseconds after its
    last patch, and a patch after that begins anew.  Gives a key's state after each micro-batch that patched it, and one
    row with ``gone`` when it leaves.  NaN counts as null."""

    KNOWN = {"id": pa.int64(), "bought": pa.float64(), "state": pa.string(), "us": pa.int64(), "n": pa.int64()}
    TOLD = {**KNOWN, "gone": pa.bool_()}
    ORDER = "us"

    def __init__(self, keep: int):
        self.keep = keep

    def step(self, frame: pd.DataFrame, known: dict) -> tuple[list[tuple], list[tuple]]:
        now: dict = {}
        for id_, new, told, us in _lists(frame, "id", "bought", "state", "us"):
            bought, state, last, n = now.get(id_) or known.get(id_) or (None, None, None, 0)
            if n and us - last > self.keep:
                bought, state, n = None, None, 0
            now[id_] = bought if pd.isna(new) else new, state if pd.isna(told) else told, us, n + 1
        return [(k, *s, False) for k, s in now.items()], [(k, *s, (s[2] + self.keep) // 1000 + 2) for k, s in now.items()]

    def farewell(self, gone: pa.Table) -> pa.Table:
        return gone.drop_columns("leaves").append_column("gone", pa.array([True] * gone.num_rows, pa.bool_()))


def degradation_alerts(spark: SparkSession, rows: DataFrame, span: float = 86_400.0, least: int = 3, floor: float = 20.0, quiet: float = 172_800.0, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """worker, line, rate of the alerts on rows (worker, line, t, value), by the store; a worker's lines and times rise together.
    Batches are ranges of time, so that no row comes after the watermark."""
    job = KeyedJob(spark, Degradation(span, least, floor, quiet), "worker", "worker long, line long, rate double")
    job.replay(rows.select("worker", "line", "t", "value", F.timestamp_seconds("t").alias("ts")), "ts", batch_rows)
    return job.run()


def rate_limits(spark: SparkSession, rows: DataFrame, most: int, window: float, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """worker, line, session, n, allowed for rows (worker, line, t) by the store, in batches by time as above."""
    job = KeyedJob(spark, Calls(window, None), "worker", "worker long, line long, session long, n long")
    job.replay(rows.select("worker", "line", "t", F.timestamp_seconds("t").alias("ts")), "ts", batch_rows)
    return job.run().withColumn("allowed", F.col("n") <= most)


def kept_states(spark: SparkSession, patches: DataFrame, keep: int, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """States (id, bought, state, us, n) left after a stream of patches (id, bought, state, us), by the store: what a reader of
    its output sees is the latest row of each id, unless that is gone or ``keep`` microseconds older than the latest patch."""
    job = KeyedJob(spark, Patches(keep), "id", "id long, bought double, state string, us long, n long, gone boolean")
    job.replay(patches.select("id", "bought", "state", "us", F.timestamp_micros("us").alias("ts")), "us", batch_rows)
    return current(job.run(), keep)


def current(states: DataFrame, keep: int) -> DataFrame:
    latest = states.groupBy("id").agg(F.max_by(F.struct("bought", "state", "us", "n", "gone"), F.struct("us", "n", "gone")).alias("s")).select("id", "s.*")
    now = latest.agg(F.max("us").alias("_now"))
    return latest.crossJoin(F.broadcast(now)).where(~F.col("gone") & (F.col("us") >= F.col("_now") - keep)).drop("_now", "gone")  # now: one row
