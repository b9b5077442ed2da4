"""Joins of arms, versions, decisions and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_arms(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of both arms side by side, columns with _a and _b; keys of one arm only are dropped."""
    left = a.select(key, *[F.col(c).alias(f"{c}_a") for c in a.columns if c != key])
    right = b.select(key, *[F.col(c).alias(f"{c}_b") for c in b.columns if c != key])
    return left.join(right, key)


def paired_wins(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: sums of both arms, and how often b is above, below, or equal."""
    rows = pairs.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_a").alias("a"), F.col(f"{f}_b").alias("b")) for f in fields])).alias("r")).select("r.*")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return rows.groupBy("field").agg(
        F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"), n(F.col("b") > F.col("a")).alias("b_more"), n(F.col("b") < F.col("a")).alias("b_less"), n(F.col("a") == F.col("b")).alias("ties")
    )


def richness(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """Fields in which b is better or worse, and a verdict."""
    which = lambda op: F.filter(F.array(*[F.when(op(F.col(f"{f}_b"), F.col(f"{f}_a")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    p = pairs.withColumns({"better": which(lambda b, a: b > a), "worse": which(lambda b, a: b < a)})
    up, down = F.size("better"), F.size("worse")
    verdict = F.when((up > 0) & (down == 0), "better").when((down > 0) & (up == 0), "worse").when((up == 0) & (down == 0), "same").otherwise("mixed")
    return p.withColumns({"better": F.array_join("better", ","), "worse": F.array_join("worse", ","), "verdict": verdict})


def attach(df: DataFrame, other: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Left join with defaults for what is missing."""
    return df.join(other, key, "left").fillna(defaults)


def stitch(listing: DataFrame, entities: DataFrame, *extras: DataFrame, key: str = "id") -> DataFrame:
    """Listing (id, pos) and entities by id: listed ones in their order, then leftovers; extras joined to both."""
    out = listing.join(entities, key, "full_outer")
    for e in extras:
        out = out.join(e, key, "left")
    return out.withColumn("listed", F.col("pos").isNotNull())


def leftover_append(canonical: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """All of the canonical list, then found ids that it lacks."""
    extra = found.select(key).distinct().join(canonical.select(key), key, "left_anti")
    return canonical.select(key, F.lit(0).alias("extra")).unionByName(extra.withColumn("extra", F.lit(1)))


def cell_match(points: DataFrame, steps: list[int]) -> DataFrame:
    """Rows of points (i, j, ...) repeated for each step k whose sub-lattice holds their cell."""
    k = F.explode(F.array(*[F.lit(s) for s in steps])).alias("k")
    return points.select("*", k).where((F.pmod("i", F.col("k")) == 0) & (F.pmod("j", F.col("k")) == 0))
