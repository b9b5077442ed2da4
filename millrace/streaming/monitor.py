"""The monitor's sweep, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.aggregates import count_if
from millrace.operators.filters import contains_any, only_new
from millrace.sources.scratch import remove, shared_path
from millrace.streaming.growing import SeenKeys

TTL_DAYS = 7


def sweep_counts(rows: DataFrame, seen: DataFrame, words: list[str]) -> DataFrame:
    """Per source: rows collected, matched by the keywords, and new among those."""
    matched = contains_any(F.lower("title"), words)
    joined = rows.join(seen.select("source", "id").withColumn("_seen", F.lit(True)), ["source", "id"], "left")
    return joined.groupBy("source").agg(F.count("*").alias("collected"), count_if(matched).alias("matched"), count_if(matched & F.col("_seen").isNull()).alias("new"))


def sweep_sources(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], seen: DataFrame, words: list[str]) -> DataFrame:
    """sweep_counts of each source, read in turn; a source that fails gives a row with its error and doesn't stop the others."""
    out = []
    for name, read in sources.items():
        try:
            found = sweep_counts(read(), seen, words).where(F.col("source") == name).first()
            out.append((name, *((found["collected"], found["matched"], found["new"]) if found else (0, 0, 0)), None))
        except Exception as e:
            out.append((name, 0, 0, 0, type(e).__name__))
    return spark.createDataFrame(out, "source string, collected long, matched long, new long, error string")


def run_sweeps(spark: SparkSession, rows: DataFrame, seen: DataFrame, words: list[str], day: int = 0, files: int | None = None, buckets: int = 8, every: int = 16) -> DataFrame:
    """Stream rows (source, id, title, ord, and day if they span several) through sweeps: each micro-batch is one, emits matched
    rows whose (source, id) was not seen, then marks all matched ids.  ``files`` bounds a micro-batch.

    A source's ids are forgotten together, TTL_DAYS after its last sweep with a match: a table of one row a source keeps the
    day of that sweep and the day since which its ids count.  Seen ids lie in ``buckets`` with a Bloom filter each and are
    folded together every ``every`` batches (SeenKeys).  All folders bear the batch number, so that a batch that runs
    again after a failure replaces its own output.
    """
    base = shared_path(spark)
    rows = rows if "day" in rows.columns else rows.withColumn("day", F.lit(day))
    rows.write.parquet(f"{base}/in")
    marked = SeenKeys(spark, f"{base}/seen", {"source": "string", "id": "string"}, buckets, every)
    marked.begin(seen.select("source", "id").withColumn("day", F.lit(day)))
    sources = "source string, born int, last int"
    ages = lambda n: f"{base}/ages-{n}"
    seen.select("source").distinct().select("source", F.lit(day).alias("born"), F.lit(day).alias("last")).write.parquet(ages(-1))
    known = spark.read.parquet(f"{base}/in").schema

    def sweep(batch: DataFrame, number: int) -> None:
        today = batch.agg(F.max("day")).first()[0]
        if today is None:
            today = day
        live = spark.read.schema(sources).parquet(ages(number - 1)).where(F.col("last") >= today - TTL_DAYS)
        matched = batch.where(contains_any(F.lower("title"), words))
        ids = marked.lookup(matched, number).join(live, "source").where("day >= born").select("source", "id")
        only_new(matched, ids).drop("day").write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        marked.mark(matched.select("source", "id").distinct().withColumn("day", F.lit(today)), number)
        touched = matched.select("source").distinct().withColumn("_hit", F.lit(True))
        now = live.join(touched, "source", "full_outer").select("source", F.coalesce("born", F.lit(today)).alias("born"), F.when(F.col("_hit"), F.lit(today)).otherwise(F.col("last")).alias("last"))
        now.write.mode("overwrite").parquet(ages(number))
        remove(spark, ages(number - 2))

    source = spark.readStream.schema(known)
    stream = (source.option("maxFilesPerTrigger", files) if files else source).parquet(f"{base}/in")
    query = stream.writeStream.foreachBatch(sweep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(known).parquet(f"{base}/out").drop("day", "batch")
