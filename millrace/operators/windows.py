"""Operators over ordered rows of a worker, run, session or feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.scan import previous


def gap_attribution(log: DataFrame, markers: list[str], idle: float = 900.0, moved: dict[str, str] | None = None, uncounted: tuple[str, ...] = ()) -> DataFrame:
    """Seconds since the worker's previous line go to this line's bucket.  log: worker, line, t, bucket.

    Gaps of ``idle`` or more count 0.  Lines in ``markers`` use up their gap without credit, and those in ``uncounted`` without
    being counted; neither is ever idle.  ``moved`` names the bucket that gets another one's seconds.  Adds gap,
    idle, idle_seconds, credit, credited (the bucket that gets it) and counted.
    """
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("worker").orderBy("line"))
    log = log.withColumn("gap", gap)
    skipped = F.col("bucket").isin(*markers, *uncounted)
    long = F.coalesce(F.col("gap") >= idle, F.lit(False))
    credited = F.col("bucket")
    for name, to in (moved or {}).items():
        credited = F.when(F.col("bucket") == name, F.lit(to)).otherwise(credited)
    is_marker = F.col("bucket").isin(markers)
    return log.withColumns(
        {
            "idle": long & ~skipped, "idle_seconds": F.when(long & ~skipped, F.col("gap")).otherwise(0.0),
            "credit": F.when(F.col("gap").isNull() | long | is_marker, 0.0).otherwise(F.col("gap")),
            "credited": F.when(~is_marker, credited), "counted": ~skipped,
        }
    )


def episode_pairing(log: DataFrame, start: Column, end: Column, longest: float = 900.0, port: Column | None = None, ok: Column | None = None) -> DataFrame:
    """Each end with the worker's latest start since the previous end; longer episodes are dropped.  With ``port`` and ``ok``, the start
    line's port and whether the end line is a success."""
    order = Window.partitionBy("worker").orderBy("line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = log.withColumn("_ends", F.coalesce(F.sum(end.cast("int")).over(before), F.lit(0)))
    inside = Window.partitionBy("worker", "_ends").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    more = [port.alias("port")] if port is not None else []
    opened = F.last(F.when(start, F.struct("line", "t", *more)), ignorenulls=True).over(inside)
    paired = numbered.withColumn("_open", opened).where(end & F.col("_open").isNotNull())
    told = ([F.col("_open.port").alias("port")] if port is not None else []) + ([ok.alias("ok")] if ok is not None else [])
    paired = paired.select("worker", F.col("_open.line").alias("start_line"), F.col("line").alias("end_line"), (F.col("t") - F.col("_open.t")).alias("seconds"), *told)
    return paired.where(F.col("seconds") < longest)


def sessions_by_marker(log: DataFrame, marker: Column, key: str = "worker") -> DataFrame:
    """Adds session: the number of marker lines up to and with this one; 0 before the first."""
    return log.withColumn("session", F.sum(marker.cast("long")).over(Window.partitionBy(key).orderBy("line")))


def clock_rollover(lines: DataFrame, key: str, order: str, clock_s: str) -> DataFrame:
    """Adds day and seconds: a clock that goes back starts the next day."""
    w = Window.partitionBy(key).orderBy(order)
    back = F.coalesce((F.col(clock_s) < F.lag(clock_s).over(w)).cast("long"), F.lit(0))
    days = F.sum("_back").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("_back", back).withColumn("day", days).withColumn("seconds", F.col("day") * 86400 + F.col(clock_s)).drop("_back")


def gap_sessions(df: DataFrame, key: str, t: str, order: str, gap: float) -> DataFrame:
    """Adds session (from 1): a pause of ``gap`` seconds or more begins a new one."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.coalesce((F.col(t) - F.lag(t).over(w) >= gap).cast("long"), F.lit(1))
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def rate_limited(df: DataFrame, key: str, t: str, order: str, most: int, window: float) -> DataFrame:
    """Counter per key that each call raises and renews: it falls to 0 only after ``window`` idle seconds.  Adds n, allowed."""
    s = gap_sessions(df, key, t, order, window)
    n = F.row_number().over(Window.partitionBy(key, "session").orderBy(order)).cast("long")
    return s.withColumn("n", n).withColumn("allowed", F.col("n") <= most)


def change_only(df: DataFrame, key: str, order: str, payload: Column) -> DataFrame:
    """Rows whose payload differs from the key's previous row; the first counts.  Keys may have any number of rows."""
    found = previous(df.withColumn("_p", payload), key, order, F.col("_p"), "_prev")
    return found.where(F.col("_prev").isNull() | ~F.col("_p").eqNullSafe(F.col("_prev.v"))).drop("_p", "_prev")


def running_count(df: DataFrame, cond: Column, by: list[str], order: list) -> Column:
    return F.sum(cond.cast("long")).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def visit_cap(visits: DataFrame, cap: int = 3) -> DataFrame:
    """Verdict of each visit (run, turn, url, domain): duplicate of an exact URL, capped beyond ``cap`` pages of a domain, or fetch."""
    again = F.row_number().over(Window.partitionBy("run", "url").orderBy("turn")) > 1
    v = visits.withColumn("_dup", again)
    nth = F.sum((~F.col("_dup")).cast("int")).over(Window.partitionBy("run", "domain").orderBy("turn"))
    return v.withColumn("verdict", F.when(F.col("_dup"), "duplicate").when(nth > cap, "capped").otherwise("fetch")).drop("_dup")


def repeat_query(df: DataFrame, norm: Column) -> DataFrame:
    """Adds repeated: the run had the same normalised query before; blank ones never are."""
    w = Window.partitionBy("run", "_norm").orderBy("turn")
    return df.withColumn("_norm", norm).withColumn("repeated", (F.col("_norm") != "") & (F.row_number().over(w) > 1)).drop("_norm")
