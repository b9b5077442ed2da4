"""Tables that grow by micro-batches, whose files stay few, and sets of seen keys over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.scratch import exists, remove

#: Bits of a bucket's filter, and how many of them a key sets.
FILTER_BITS, FILTER_HASHES = 32_768, 3


class Growing:
    """A table of batches: a batch that runs again replaces its own rows.

    Before each ``every``-th batch, what is there is folded into one generation by ``fold``.  A reader names the generation
    and the batches after it, fewer than ``every``; older folders are never listed, and are removed one generation
    later, when no batch that may run again needs them.
    """

    def __init__(self, spark: SparkSession, base: str, schema: str, every: int = 16, fold: Callable[[DataFrame], DataFrame] | None = None, by: list[str] | None = None):
        self.spark, self.base, self.schema, self.every = spark, base, schema, every
        self.fold, self.by = fold or (lambda df: df), by or []

    def _batch(self, n: int) -> str:
        return f"{self.base}/batch-{n}"

    def generation(self, g: int) -> str:
        return f"{self.base}/generation-{g}"

    def _read(self, paths: list[str]) -> DataFrame:
        out = self.spark.createDataFrame([], self.schema)
        for p in paths:
            out = out.unionByName(self.spark.read.schema(self.schema).option("basePath", p).parquet(p))
        return out

    def _save(self, df: DataFrame, path: str) -> None:
        if self.by:
            df = df.repartition(*self.by)  # one file a bucket
        df.write.mode("overwrite").partitionBy(*self.by).parquet(path)

    def start(self, rows: DataFrame) -> None:
        """Rows that are there before the first batch."""
        self._save(self.fold(rows), self.generation(0))

    def write(self, n: int, rows: DataFrame) -> None:
        self._save(rows, self._batch(n))

    def recent(self, n: int) -> DataFrame:
        """Rows of the batches before n that no generation holds yet."""
        first = n // self.every * self.every
        return self._read([self._batch(k) for k in range(first, n) if exists(self.spark, f"{self._batch(k)}/_SUCCESS")])

    def settled(self, n: int) -> DataFrame:
        """Rows of the generation that batch n reads; makes it where it is not there."""
        g = n // self.every
        if g == 0:
            return self._read([self.generation(0)] if exists(self.spark, f"{self.generation(0)}/_SUCCESS") else [])
        if not exists(self.spark, f"{self.generation(g)}/_SUCCESS"):
            last = (g - 1) * self.every
            batches = [self._batch(k) for k in range(last, last + self.every) if exists(self.spark, f"{self._batch(k)}/_SUCCESS")]
            old = [self.generation(g - 1)] if exists(self.spark, f"{self.generation(g - 1)}/_SUCCESS") else []
            self._save(self.fold(self._read(old + batches)), self.generation(g))
            for k in range(max(0, last - self.every), last):
                remove(self.spark, self._batch(k))
            if g >= 2:
                remove(self.spark, self.generation(g - 2))
        return self._read([self.generation(g)])

    def before(self, n: int) -> DataFrame:
        """All rows of the batches before n."""
        return self.settled(n).unionByName(self.recent(n))

    def paths(self, n: int) -> list[str]:
        """Folders that a reader before batch n names."""
        g = n // self.every
        return [p for p in [self.generation(g), *(self._batch(k) for k in range(g * self.every, n))] if exists(self.spark, f"{p}/_SUCCESS")]


class SeenKeys:
    """Keys that were seen, each with its latest day, for years.

    Keys lie in buckets by hash.  A bucket of a generation has a Bloom filter; of a batch's keys only those that a filter lets
    through are looked up, in their buckets only.  Keys since the generation are few and are joined as they are.
    """

    def __init__(self, spark: SparkSession, base: str, keys: dict[str, str], buckets: int = 32, every: int = 16):
        self.spark, self.base, self.keys, self.buckets = spark, base, list(keys), buckets
        schema = ", ".join(f"{k} {t}" for k, t in keys.items())
        latest = lambda df: df.groupBy(*self.keys, "bucket").agg(F.max("day").alias("day"))
        self.table = Growing(spark, f"{base}/keys", f"{schema}, day int, bucket int", every, latest, ["bucket"])

    def _places(self) -> Column:
        return F.array(*[F.pmod(F.xxhash64(*self.keys, F.lit(i)), F.lit(FILTER_BITS)) for i in range(FILTER_HASHES)])

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def filters(self, n: int) -> DataFrame:
        """bucket, bits of the generation that batch n reads: one row of 4 KB a bucket."""
        keys = self.table.settled(n)
        path = f"{self.base}/filters-{n // self.table.every}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            bits = keys.select("bucket", F.explode(self._places()).alias("at"))
            bits.groupBy("bucket").agg(F.bitmap_construct_agg(F.col("at")).alias("bits")).write.mode("overwrite").parquet(path)
        return self.spark.read.schema("bucket int, bits binary").parquet(path)

    def begin(self, rows: DataFrame) -> None:
        """What is known before the first batch."""
        self.table.start(self._bucketed(rows.select(*self.keys, F.col("day").cast("int").alias("day"))))

    def mark(self, rows: DataFrame, n: int) -> None:
        """Keys and days that batch n saw."""
        self.table.write(n, self._bucketed(rows.select(*self.keys, F.col("day").cast("int").alias("day"))))

    def passing(self, rows: DataFrame, n: int) -> DataFrame:
        """The distinct keys of rows that the filters let through, with their buckets."""
        asked = self._bucketed(rows.select(*self.keys).distinct())
        held = asked.join(F.broadcast(self.filters(n)), "bucket")  # as many rows of 4 KB as buckets
        byte = lambda at: F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        return held.where(F.forall(self._places(), lambda at: F.getbit(byte(at), (at % 8).cast("int")) == 1)).drop("bits")

    def lookup(self, rows: DataFrame, n: int) -> DataFrame:
        """Keys of rows that batches before n saw, with their latest day."""
        maybe = self.passing(rows, n)
        touched = [r[0] for r in maybe.select("bucket").distinct().collect()]  # at most as many as buckets
        old = self.table.settled(n).where(F.col("bucket").isin(touched)).join(maybe, ["bucket", *self.keys], "left_semi")
        new = self.table.recent(n).join(rows.select(*self.keys).distinct(), self.keys, "left_semi")
        return old.unionByName(new).groupBy(*self.keys).agg(F.max("day").alias("day"))
