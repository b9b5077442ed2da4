"""Readers and writers of the formats in which records are collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.scratch import exists, remove


def read_records(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of a folder of JSON documents: what can't be parsed is set aside, not fatal."""
    raw = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.where("_corrupt IS NULL").drop("_corrupt"), raw.where("_corrupt IS NOT NULL").select("_corrupt")


def file_key(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, group)


def read_jsonl(spark: SparkSession, path: str, schema: str, key_pattern: str) -> DataFrame:
    """JSON lines with the key that the path of each file holds, as column key."""
    fields = [f.strip().split(" ")[0] for f in schema.split(",")]
    return spark.read.schema(schema).json(path).select(*fields, file_key(key_pattern).alias("key"))


def read_cells(expected: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Expected cells with what was found; a cell without a record gets the error ``missing``."""
    joined = expected.join(found.withColumn("_found", F.lit(True)), on, "left")
    return joined.withColumn("error", F.when(F.col("_found").isNull(), "missing").otherwise(F.col("error"))).drop("_found")


def read_log(spark: SparkSession, path: str, pattern: str, fields: list[str], between: tuple[str, str] | None = None) -> DataFrame:
    """Fields of the lines that match a pattern with one group per field; other lines are dropped.  A field ts is a time without zone;
    ``between`` keeps the lines from the first of two such times to the second, both included."""
    lines = spark.read.text(path).where(F.regexp_like("value", F.lit(pattern)))
    found = lines.select(*[F.regexp_extract("value", pattern, i + 1).alias(f) for i, f in enumerate(fields)])
    if "ts" in fields:
        found = found.withColumn("ts", F.col("ts").try_cast("timestamp_ntz"))
    if between:
        first, last = (F.lit(t).cast("timestamp_ntz") for t in between)
        found = found.where(F.col("ts").between(first, last))
    return found


def read_feed_xml(spark: SparkSession, path: str) -> DataFrame:
    """link, title, pub_date, description (300 characters at most) of the items of RSS feeds."""
    raw = spark.read.format("xml").option("rowTag", "item").schema("link string, title string, pubDate string, description string").load(path)
    return raw.select("link", "title", F.col("pubDate").alias("pub_date"), F.substring("description", 1, 300).alias("description"))


def read_router_events(spark: SparkSession, path: str) -> DataFrame:
    """Tagged events with their time."""
    schema = "ev string, ts double, worker string, clean boolean, latency_ms long, source string"
    return spark.read.schema(schema).json(path).withColumn("at", F.timestamp_seconds("ts"))


def append_hits(df: DataFrame, path: str, run_at: Column) -> None:
    df.withColumn("run_at", run_at).write.mode("append").json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Replaces the summary at path; small tables come out in one file by adaptive coalescing, large ones in many."""
    df.write.mode("overwrite").json(path)


def upsert_cards(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Target after updates on (oid, model_key): unchanged mtime and rows under review status ``edited`` stay as they are."""
    keys, rest = ["oid", "model_key"], [c for c in target.columns if c not in ("oid", "model_key")]
    t = target.select(*keys, F.struct(*rest).alias("t"))
    u = updates.select(*keys, F.struct(*rest).alias("u"))
    keep = F.col("u").isNull() | (F.col("t").isNotNull() & ((F.col("t.review_status") == "edited") | (F.col("t.mtime") == F.col("u.mtime"))))
    row = F.when(keep, F.col("t")).otherwise(F.col("u"))
    return t.join(u, keys, "full_outer").select(*keys, row.alias("r")).select(*keys, "r.*")


class CardTable:
    """Cards by (oid, model_key) in a folder of buckets by a hash of both; an upsert rewrites the buckets it touches, no others.

    Each upsert writes its buckets' new rows beside the table first and then replaces the buckets from there, so that it can be
    repeated after a failure at any point: what was staged is complete and is put in place again.
    """

    KEYS = ("oid", "model_key")

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 16):
        self.spark, self.path, self.schema, self.buckets = spark, path, f"{schema}, bucket int", buckets

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.KEYS), F.lit(self.buckets)).cast("int"))

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/cards")

    def _replace(self, rows: DataFrame, path: str) -> None:
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    def create(self, rows: DataFrame) -> None:
        self._replace(self._bucketed(rows), f"{self.path}/cards")

    def upsert(self, updates: DataFrame, name: str) -> None:
        """Updates of one run, under a name of its own; a run that is repeated changes nothing more."""
        staged = f"{self.path}/staged-{name}"
        if not exists(self.spark, f"{staged}/_SUCCESS"):
            remove(self.spark, staged)
            news = self._bucketed(updates)
            touched = [r[0] for r in news.select("bucket").distinct().collect()]  # at most as many as buckets
            merged = upsert_cards(self.read().where(F.col("bucket").isin(touched)).drop("bucket"), news.drop("bucket"))
            self._replace(self._bucketed(merged), staged)
        kept = self.spark.read.schema(self.schema).parquet(staged)
        self._replace(kept, f"{self.path}/cards")
