"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, the folder that the driver and all executors see.

    Only where that setting is absent (tests, a local session) a temporary folder stands in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage is cut, lost executors cost nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text):
    """Number of words in a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Memo(dict):
    """Word -> row number of ``table``, filled by ``make(word, row)`` at first sight.

    Two generations are kept: drop() makes a full one the old one, from which words that occur again are taken over,
    so that frequent words are made once and ``limit`` words are held at most between texts.
    """

    def __init__(self, make, width: int, dtype="float32", limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit
        self.table = self._new_table(width, dtype)
        self.old: dict = {}
        self.old_table = self.table

    @staticmethod
    def _new_table(width: int, dtype) -> np.ndarray:
        return np.zeros((1 << 14, width), dtype)

    def __missing__(self, word):
        i = len(self)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        before = self.old.get(word)
        if before is None:
            self.table[i] = 0
            self.make(word, self.table[i])
        else:
            self.take_over(before, i)
        self[word] = i
        return i

    def take_over(self, before: int, i: int) -> None:
        self.table[i] = self.old_table[before]

    def ids(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def rows(self, words: list) -> np.ndarray:
        ids = self.ids(words)  # may make the table anew
        return self.table[ids]

    def drop(self) -> None:
        """Call between texts: row numbers given out before are void afterwards."""
        if len(self) > self.limit // 2:
            self.retire()
            self.old, self.old_table = dict(self), self.table
            self.clear()
            self.table = self._new_table(self.table.shape[1], self.table.dtype)

    def retire(self) -> None:
        """What else is to be set aside with a generation."""


def sampled(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of df, chosen by a hash of the key: the same rows in each run, whatever the partitioning."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_000)) < int(1_000_000 * rows / n))


class Ragged(Memo):
    """Memo whose rows are runs of int32 in one flat array; the table holds (start, length, note(word, run))."""

    def __init__(self, make, limit: int = 300_000, note=None):
        super().__init__(self._put, 3, np.int64, limit)
        self.parts, self.note = make, note
        self.flat = self.old_flat = np.zeros(1 << 17, np.int32)
        self.used = 0

    def _store(self, found) -> int:
        at = self.used
        while at + len(found) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[at : at + len(found)] = found
        self.used += len(found)
        return at

    def _put(self, word, row) -> None:
        found = self.parts(word)
        row[:] = self._store(found), len(found), self.note(word, found) if self.note else 0

    def take_over(self, before: int, i: int) -> None:
        start, length, note = self.old_table[before].tolist()
        self.table[i] = self._store(self.old_flat[start : start + length]), length, note

    def gather(self, words: list) -> np.ndarray:
        """The runs of all words, one after another."""
        return self.runs_of(self.rows(words))

    def runs_of(self, rows: np.ndarray) -> np.ndarray:
        """The runs of rows of the table."""
        if not len(rows):
            return np.zeros(0, np.int32)
        ends = np.cumsum(rows[:, 1])
        return self.flat[np.arange(ends[-1]) + np.repeat(rows[:, 0] - ends + rows[:, 1], rows[:, 1])]

    def retire(self) -> None:
        self.old_flat, self.flat, self.used = self.flat, np.zeros(1 << 17, np.int32), 0


def runs(batches, *keys: str):
    """Consecutive rows with equal keys, as one Arrow table each, from an iterator of record batches sorted by them."""
    held: list[pa.Table] = []
    mark = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(len(table) - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(table)]])
        for at, to in zip(starts[:-1], starts[1:], strict=True):
            here = tuple(c[at] for c in columns)
            if held and here != mark:
                yield pa.concat_tables(held)
                held = []
            mark = here
            held.append(table.slice(at, to - at))
    if held:
        yield pa.concat_tables(held)


#: A side of so many rows is broadcast; a larger one is joined under salts.
BROADCAST_ROWS = 100_000


def hot_join(left: DataFrame, hot: DataFrame, key: str, how: str = "inner", spread: list[str] | None = None, salts: int = 64) -> DataFrame:
    """left joined with hot, which has one row for each of the keys that very many rows of left share.

    hot is counted: if it is small it is broadcast, else its rows are repeated under salts and the rows of a key are dealt
    to as many tasks by a hash of the columns in ``spread`` (all by default), which repeats if a task does.  Either way no
    key's rows meet in one task.
    """
    if hot.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(hot), key, how)
    every = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*(spread or left.columns)), F.lit(salts)).cast("int"))
    return dealt.join(every, [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame, rounds: int = 50, hub: int = 10_000) -> DataFrame:
    """(id, component) of all ids in edges (a, b): component is the smallest id that can be reached.

    Alternates large-star and small-star steps: each links a node's neighbours to their smallest, with joins on
    node minima, so that no neighbourhood is gathered; nodes with over ``hub`` neighbours are joined apart, so that none is
    dealt to one task.  Each step is written to the shared folder.
    """

    def with_least(sym: DataFrame) -> DataFrame:
        """Rows (u, v) with m, the smallest of u and its neighbours."""
        least = sym.groupBy("u").agg(F.min("v").alias("_v"), F.count("*").alias("_n")).select("u", F.least("u", "_v").alias("m"), "_n")
        least = materialise(least)
        hubs = least.where(F.col("_n") > hub).select("u", "m")
        rest = least.where(F.col("_n") <= hub).select("u", "m")
        if hubs.isEmpty():
            return sym.join(rest, "u")
        return hot_join(sym, hubs, "u").unionByName(hot_join(sym, hubs.select("u"), "u", "left_anti").join(rest, "u"))

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")

    # An edge runs from its larger end a to its smaller end b.
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        large = with_least(both(now)).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = with_least(materialise(large).select(F.col("a").alias("u"), F.col("b").alias("v")))
        # Each neighbour is linked to the smallest, and the node itself as well.
        small = down.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = materialise(small.where("a <> b").distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = now.groupBy("a").agg(F.min("b").alias("b"))
    return ids.join(found, F.col("id") == F.col("a"), "left").select("id", F.coalesce("b", "id").alias("component"))
