"""Stateful streaming jobs; each takes a table, streams it through and returns what the job wrote."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.dedup import dedup_first
from millrace.operators.filters import contains_any
from millrace.operators.windows import change_only, gap_sessions
from millrace.sources.scratch import shared_path
from millrace.streaming.growing import Growing, SeenKeys


def through_stream(spark: SparkSession, rows: DataFrame, job, mode: str = "append", close_after: str | None = None) -> DataFrame:
    """Write rows as files, run job (streaming DataFrame to streaming DataFrame) over all that is there, read its output.

    With ``close_after`` a marker row, that much later than the last one (column ts) and null otherwise, ends the
    input, so that the watermark passes all windows of the rows and each is written; the marker's own stays open.
    """
    base = shared_path(spark)
    if close_after:
        marker = rows.agg((F.max("ts") + F.expr(f"interval {close_after}")).alias("ts")).where("ts IS NOT NULL")
        rows = rows.unionByName(marker, allowMissingColumns=True)
    rows.write.parquet(f"{base}/in")
    return run_job(spark, base, job, mode)[0]


def run_job(spark: SparkSession, base: str, job, mode: str = "append") -> tuple[DataFrame, int]:
    """Run job over what base/in holds and it has not seen; its whole output so far, and how many rows it dropped as late
    (rows after partial aggregation, as the state operators count them)."""
    schema = spark.read.parquet(f"{base}/in").schema
    out = job(spark.readStream.schema(schema).parquet(f"{base}/in"))
    query = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    return spark.read.schema(out.schema).parquet(f"{base}/out"), late


def first_seen(spark: SparkSession, rows: DataFrame, words: list[str], files: int | None = None, buckets: int = 8, every: int = 16) -> DataFrame:
    """The first row (source, id, title, ord) of each (source, id), for good, with hit: whether its title holds a keyword.  An id is
    seen from its first row on, whether that was a hit or not.  Seen ids lie in buckets with a Bloom filter each (SeenKeys), and
    so do the results' folders grow together: a batch that runs again replaces its own."""
    base = shared_path(spark)
    rows.select("source", "id", "title", "ord").write.parquet(f"{base}/in")
    known = spark.read.parquet(f"{base}/in").schema
    marked = SeenKeys(spark, f"{base}/seen", {"source": "string", "id": "string"}, buckets, every)
    out = Growing(spark, f"{base}/out", "source string, id string, ord long, hit boolean", every)
    last = -1

    def run(batch: DataFrame, number: int) -> None:
        nonlocal last
        last = number
        first = dedup_first(batch, ["source", "id"], ["ord"])
        new = first.join(marked.lookup(first, number).select("source", "id"), ["source", "id"], "left_anti")
        out.settled(number)  # folds where it is due
        out.write(number, new.select("source", "id", "ord", contains_any(F.lower("title"), words).alias("hit")))
        marked.mark(first.withColumn("day", F.lit(0)), number)

    source = spark.readStream.schema(known)
    stream = (source.option("maxFilesPerTrigger", files) if files else source).parquet(f"{base}/in")
    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return out.before(last + 1)


def through_batches(spark: SparkSession, rows: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], schema: str, files: int | None = None, left: bool = False) -> DataFrame:
    """Stream rows through step, which gets a micro-batch and the state that the batch before left, and gives rows of one
    schema with a column kind: ``out`` for results, anything else for the state it leaves.

    Both are Parquet by batch number, so that a batch that runs again replaces its own output.  ``files`` bounds a
    batch; by default all that is there is one.  ``left`` returns the state after the last batch, not the results.
    """
    base = shared_path(spark)
    rows.write.parquet(f"{base}/in")
    known = spark.read.parquet(f"{base}/in").schema
    full = f"{schema}, batch int, kind string"
    spark.createDataFrame([], full).write.partitionBy("batch", "kind").parquet(f"{base}/out")
    done = lambda: spark.read.schema(full).parquet(f"{base}/out")

    def run(batch: DataFrame, number: int) -> None:
        before = done().where((F.col("batch") == number - 1) & (F.col("kind") != "out")).drop("batch")
        step(batch, before).write.mode("overwrite").partitionBy("kind").parquet(f"{base}/out/batch={number}")

    source = spark.readStream.schema(known)
    stream = (source.option("maxFilesPerTrigger", files) if files else source).parquet(f"{base}/in")
    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if left:
        last = done().agg(F.max("batch")).first()[0]
        return done().where((F.col("batch") == last) & (F.col("kind") != "out")).drop("batch", "kind")
    return done().where("kind = 'out'").drop("batch", "kind")


def status_changes(spark: SparkSession, rows: DataFrame, files: int | None = None) -> DataFrame:
    """Rows (worker, line, flag) whose flag differs from the worker's last emitted one; the state is each worker's last flag."""

    def step(batch: DataFrame, before: DataFrame) -> DataFrame:
        every = batch.select("worker", "line", "flag", F.lit(True).alias("_new")).unionByName(before.drop("kind").withColumn("_new", F.lit(False)))
        every = every.withColumn("_at", F.struct("_new", "line"))
        changed = change_only(every, "worker", "_at", F.col("flag")).where("_new").select("worker", "line", "flag", F.lit("out").alias("kind"))
        last = every.groupBy("worker").agg(F.max_by(F.struct("line", "flag"), "_at").alias("l"))
        return changed.unionByName(last.select("worker", "l.line", "l.flag", F.lit("last").alias("kind")))

    return through_batches(spark, rows, step, "worker long, line long, flag boolean", files)


class Samples:
    """A worker's times and values, with the sum of values kept exactly: in units of 2 ** -1074, the least float."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.rows: deque[tuple[float, float]] = deque()
        self.total, self.odd = 0, {"nan": 0, "inf": 0, "-inf": 0}

    def count(self, v: float, sign: int) -> None:
        if math.isfinite(v):
            n, d = v.as_integer_ratio()
            self.total += sign * (n << 1075 - d.bit_length())
        else:
            self.odd[str(v)] += sign

    def push(self, t: float, v: float) -> None:
        self.rows.append((t, v))
        self.count(v, 1)

    def forget(self, before: float) -> None:
        while self.rows[0][0] < before:
            self.count(self.rows.popleft()[1], -1)

    def mean(self) -> float:
        odd = [float(k) for k, n in self.odd.items() if n]
        try:
            return sum(odd) if odd else self.total / (1 << 1074) / len(self.rows)
        except OverflowError:
            return math.copysign(math.inf, self.total)


ALERTS = pa.schema([("worker", pa.int64()), ("line", pa.int64()), ("t", pa.float64()), ("value", pa.float64()), ("kind", pa.string())])
CHUNK = 10_000


def walk(batches: Iterator[pa.RecordBatch], span: float, least: int, floor: float, quiet: float) -> Iterator[pa.RecordBatch]:
    """Alerts and the state left, from chunks in the order of worker, state before rows, and line."""
    out: list[tuple] = []
    worker, until, samples = None, None, Samples()

    def ready(least_rows: int) -> Iterator[pa.RecordBatch]:
        while len(out) >= least_rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[:CHUNK], strict=True), ALERTS, strict=True)], schema=ALERTS)
            del out[:CHUNK]

    def leave() -> Iterator[pa.RecordBatch]:
        if until is not None:
            out.append((worker, None, until, None, "until"))
            for k, (t, v) in enumerate(samples.rows):
                out.append((worker, k, t, v, "sample"))
                yield from ready(CHUNK)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("worker", "kind", "line", "t", "value"))
        for w, kind, line, t, v in zip(*columns, strict=True):
            if until is None or w != worker:
                yield from leave()
                worker, until, samples = w, -1e18, Samples()
            if kind == "until":
                until = t
                continue
            samples.push(t, math.nan if v is None else v)
            if kind == "sample":
                continue
            samples.forget(t - span)
            rate = samples.mean()
            if len(samples.rows) >= least and rate < floor and t >= until:
                out.append((worker, line, None, rate, "out"))
                until = t + quiet
                samples.clear()
        yield from ready(CHUNK)
    yield from leave()
    yield from ready(1)


def degradation_alerts(
    spark: SparkSession, rows: DataFrame, span: float = 86_400.0, least: int = 3, floor: float = 20.0, quiet: float = 172_800.0, files: int | None = None
) -> DataFrame:
    """Alerts on rows (worker, line, t, value): the mean of the last ``span`` seconds is below ``floor`` with ``least`` samples or more.
    An alert clears the samples and starts ``quiet`` seconds without another.

    Spark sorts a batch by worker and line, and tasks walk it in chunks: a worker's rows never meet in memory, only the
    samples of its span do.  The state is those samples, one a row and numbered in ``line``, and the time until which it is quiet.
    """

    def step(batch: DataFrame, before: DataFrame) -> DataFrame:
        every = batch.select("worker", "line", "t", "value", F.lit("row").alias("kind")).unionByName(before)
        order = F.element_at(F.create_map(F.lit("until"), F.lit(0), F.lit("sample"), F.lit(1), F.lit("row"), F.lit(2)), F.col("kind"))
        return every.repartition("worker").sortWithinPartitions("worker", order, "line").mapInArrow(lambda b: walk(b, span, least, floor, quiet), "worker long, line long, t double, value double, kind string")

    return through_batches(spark, rows, step, "worker long, line long, t double, value double", files).select("worker", "line", F.col("value").alias("rate"))


def rate_limits(spark: SparkSession, rows: DataFrame, most: int, window: float, files: int | None = None) -> DataFrame:
    """worker, line, session, n, allowed for rows (worker, line, t): a counter that each call raises and renews, and that falls to
    0 only after ``window`` idle seconds.  The state is each worker's last call with its session and count."""

    def step(batch: DataFrame, before: DataFrame) -> DataFrame:
        fresh = batch.select("worker", "line", "t", F.lit(None).cast("long").alias("session"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("_new"))
        every = fresh.unionByName(before.drop("kind").withColumn("_new", F.lit(False))).withColumn("_at", F.struct("_new", "line"))
        w = Window.partitionBy("worker").orderBy("_at")
        begun = F.when(F.col("_new"), F.coalesce((F.col("t") - F.lag("t").over(w) >= window).cast("long"), F.lit(1))).otherwise(F.col("session"))
        every = every.withColumn("_begun", begun).withColumn("session", F.sum("_begun").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        inside = Window.partitionBy("worker", "session").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        every = every.withColumn("n", F.sum("n").over(inside))
        last = every.groupBy("worker").agg(F.max_by(F.struct("line", "t", "session", "n"), "_at").alias("l")).select("worker", "l.*", F.lit("last").alias("kind"))
        return every.where("_new").select("worker", "line", "t", "session", "n", F.lit("out").alias("kind")).unionByName(last)

    out = through_batches(spark, rows, step, "worker long, line long, t double, session long, n long", files)
    return out.select("worker", "line", "session", "n", (F.col("n") <= most).alias("allowed"))


def inactivity_sessions(spark: SparkSession, events: DataFrame, pause: str = "10 minutes") -> DataFrame:
    """Sessions of events (worker, ts) that a pause of activity ends: worker, ts (the first), n; written once the watermark passed them."""
    job = lambda s: s.withWatermark("ts", "1 minute").groupBy("worker", F.session_window("ts", pause).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("ts"))
    return through_stream(spark, events, lambda s: job(s).select("worker", "ts", "n"), close_after="2 days")


class Snapshots:
    """What an aggregation in update mode told of each key, batch by batch; a batch that runs again replaces its own rows."""

    def __init__(self, spark: SparkSession, base: str, keys: list[str], values: dict[str, str], schema: str, every: int = 16):
        self.keys, self.values = keys, list(values)
        full = f"{schema}, {', '.join(f'{c} {t}' for c, t in values.items())}, batch int"
        self.table, self.batches = Growing(spark, base, full, every, self._latest), 0

    def _latest(self, rows: DataFrame) -> DataFrame:
        last = F.max_by(F.struct(*self.values, "batch"), "batch").alias("s")
        return rows.groupBy(*self.keys).agg(last).select(*self.keys, "s.*")

    def write(self, batch: DataFrame, number: int) -> None:
        self.table.settled(number)
        self.table.write(number, batch.select(*self.keys, *self.values, F.lit(number).alias("batch")))
        self.batches = max(self.batches, number + 1)

    def since_fold(self) -> DataFrame:
        """Rows as the last batches told them, with their batch."""
        return self.table.recent(self.batches)

    def latest(self) -> DataFrame:
        """Each key as it was told last."""
        return self._latest(self.table.before(self.batches)).drop("batch")


def windowed(spark: SparkSession, events: DataFrame, width: str, slide: str | None = None, files: int | None = None, late: str = "1 minute") -> Snapshots:
    """Counts and sums of events (ts, bucket, value) per tumbling or sliding window, told in update mode: after each micro-batch
    those windows (ts, its start, and bucket) that it changed, with n and total.  The state holds the windows that the
    watermark has not passed; a sink by key needs no closing row."""
    base = shared_path(spark)
    events.write.parquet(f"{base}/in")
    sink = Snapshots(spark, f"{base}/out", ["ts", "bucket"], {"n": "long", "total": "double"}, "ts timestamp, bucket string")
    reader = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{base}/in")
    of = stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "bucket")
    out = of.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("ts"), "bucket", "n", "total")
    query = out.writeStream.foreachBatch(sink.write).outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return sink


def windowed_with_watermark(spark: SparkSession, parts: list[DataFrame], late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts per window of event time over parts (ts, event_type) that arrive one after another: rows later than the watermark are
    dropped, windows are written once they are closed.  late_rows tells whether any were dropped."""
    base, dropped = shared_path(spark), 0
    job = lambda s: s.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").count().select(F.col("window.start").alias("began"), "event_type", F.col("count").alias("n"))
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        out, n = run_job(spark, base, job)
        dropped += n
    return out.withColumn("late_rows", F.lit(dropped > 0))


def latest_state(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Batch twin of a patch merge: the latest value of each column that is not null, and the number of patches."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest], F.count("*").alias("n"))


def kept_states(spark: SparkSession, patches: DataFrame, keep: int, files: int | None = None) -> DataFrame:
    """States (id, bought, state, us, n) after a stream of patches (id, bought, state, us): later values that are not null win, and a
    state is forgotten ``keep`` microseconds after its last patch, so that a later patch begins anew."""

    def step(batch: DataFrame, before: DataFrame) -> DataFrame:
        every = batch.select("id", "bought", "state", "us", F.lit(1).cast("long").alias("n")).unionByName(before.drop("kind"))
        every = gap_sessions(every, "id", "us", "us", keep + 1)
        every = every.withColumn("_last", F.max("session").over(Window.partitionBy("id"))).where("session = _last")
        latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("us"))).alias(c)
        merged = every.groupBy("id").agg(latest("bought"), latest("state"), F.max("us").alias("us"), F.sum("n").alias("n"))
        now = every.agg(F.max("us").alias("_now"))
        return merged.crossJoin(F.broadcast(now)).where(F.col("us") >= F.col("_now") - keep).drop("_now").withColumn("kind", F.lit("last"))  # now: one row

    return through_batches(spark, patches, step, "id long, bought double, state string, us long, n long", files, left=True)
