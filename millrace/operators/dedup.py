"""Deduplication and entity grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import norm_title


def _filled(keys: list[str]) -> Column:
    ok = F.lit(True)
    for k in keys:
        ok &= F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    return ok


def dedup_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key in the given order; rows with a null or empty key are dropped."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.where(_filled(keys)).withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def dedup_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row of each key, in the position (column pos) of the key's first."""
    rest = [c for c in df.columns if c not in keys]
    agg = df.where(_filled(keys)).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"), F.min(order).alias("pos"))
    return agg.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest], "pos")


def title_key(df: DataFrame, generic: str = r"^(?:shop|store|магазин)\b") -> DataFrame:
    """Adds key to (oid, title, category, dist): the normalised title, told apart by category where it is empty or generic."""
    title = norm_title(F.coalesce("title", F.lit("")))
    is_generic = (title == "") | F.regexp_like(title, F.lit(generic))
    return df.withColumn("key", F.when(is_generic, F.concat_ws("::", F.lit("generic"), title, F.coalesce("category", F.lit("")))).otherwise(F.concat(F.lit("named::"), title)))


def dedup_title(keyed: DataFrame) -> DataFrame:
    """key, oid, size of each title: oid is the nearest (missing distance last), ties to the smaller oid."""
    nearness = F.struct(F.coalesce("dist", F.lit(1e9)).alias("d"), F.col("oid").alias("o"))
    return keyed.groupBy("key").agg(F.min_by("oid", nearness).alias("oid"), F.count("*").alias("size"))


def title_members(keyed: DataFrame, salts: int = 32) -> DataFrame:
    """(member, oid) for each row: titles are repeated under salts, so that a title with very many members is dealt to many tasks."""
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    groups = dedup_title(keyed).select("key", "oid", every)
    rows = keyed.select("key", F.col("oid").alias("member"), F.pmod(F.xxhash64("oid"), F.lit(salts)).cast("int").alias("_salt"))
    return rows.join(groups, ["key", "_salt"]).select("member", "oid")


def duplicate_groups(groups: DataFrame, n: int) -> DataFrame:
    """The n largest groups of more than one, larger first, then by key from the end."""
    return groups.where("size > 1").orderBy(F.desc("size"), F.desc("key")).limit(n)


def page_union(df: DataFrame, key: str, page: str, group: list[str], stop_after: int | None = None) -> DataFrame:
    """First sighting of each key over pages, with the number of keys that its page brought.  With ``stop_after``, pages beyond
    so many in a row without a new key are not seen."""
    first = df.groupBy(*group, key).agg(F.min(page).alias(page))
    if stop_after:
        novelty = page_novelty(df, key, page, group)  # a row for each page of a group
        w = Window.partitionBy(*group).orderBy(page).rowsBetween(1 - stop_after, 0)
        ended = novelty.withColumn("_empty", F.sum((F.col("n_new") == 0).cast("int")).over(w)).where(F.col("_empty") == stop_after)
        first = first.join(ended.groupBy(*group).agg(F.min(page).alias("_stop")), group, "left").where(F.col("_stop").isNull() | (F.col(page) <= F.col("_stop"))).drop("_stop")
    return first.withColumn("brought", F.count("*").over(Window.partitionBy(*group, page)))


def page_novelty(df: DataFrame, key: str, page: str, group: list[str]) -> DataFrame:
    """Per page: rows, and rows whose key no earlier page has (repeats within the page each count)."""
    first = df.groupBy(*group, key).agg(F.min(page).alias("_first"))
    flagged = df.join(first, [*group, key])
    return flagged.groupBy(*group, page).agg(F.count("*").alias("n_rows"), F.sum((F.col(page) == F.col("_first")).cast("long")).alias("n_new"))
