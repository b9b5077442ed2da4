"""Order over few keys: a table cut into ranges of (key, order), scanned in each, and what crosses a border carried over.

Only a range's first key can go on from the range before, so at most one row a range is carried, however many rows a
key has.  No window is by key alone but that over the borders, which has a row for each range of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import shared_path


def cut(df: DataFrame, key: str, order: str, parts: int | None = None) -> DataFrame:
    """df with _part, the number of its range of (key, order); written, so that the ranges stay as they are."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, key, order).withColumn("_part", F.spark_partition_id())
    path = shared_path(spark)
    ranged.write.parquet(path)
    return spark.read.schema(ranged.schema).parquet(path)


def previous(df: DataFrame, key: str, order: str, value: Column, name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: a struct with v, the value of the key's previous row; null for the key's first row."""
    ranged = cut(df.withColumn("_v", F.struct(value.alias("v"))), key, order, parts)
    lasts = ranged.groupBy(key, "_part").agg(F.max_by("_v", order).alias("_last"))
    carried = lasts.withColumn("_carry", F.lag("_last").over(Window.partitionBy(key).orderBy("_part"))).where("_carry IS NOT NULL").select(key, "_part", "_carry")
    before = F.lag("_v").over(Window.partitionBy("_part", key).orderBy(order))
    found = ranged.withColumn("_before", before).join(F.broadcast(carried), [key, "_part"], "left")  # one row a range at most
    return found.withColumn(name, F.coalesce("_before", "_carry")).drop("_part", "_v", "_before", "_carry")


def running(df: DataFrame, key: str, order: str, value: Column, name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of value over the key's rows up to and with this one."""
    ranged = cut(df.withColumn("_v", value), key, order, parts)
    totals = ranged.groupBy(key, "_part").agg(F.sum("_v").alias("_t"))
    earlier = F.sum("_t").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.withColumn("_carry", earlier).where("_carry IS NOT NULL").select(key, "_part", "_carry")
    inside = F.sum("_v").over(Window.partitionBy("_part", key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    found = ranged.withColumn("_inside", inside).join(F.broadcast(carried), [key, "_part"], "left")  # one row a range at most
    return found.withColumn(name, F.coalesce("_carry", F.lit(0)) + F.col("_inside")).drop("_part", "_v", "_inside", "_carry")
