"""Distances and lattices on the globe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.scratch import shared_path

EARTH_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; null if a coordinate is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def grid_points(spark: SparkSession, lat: float, lon: float, radius_m: float, step_m: float) -> DataFrame:
    """Lattice points within the radius: i (north), j (east), lat, lon, dist."""
    n = int(radius_m // step_m) + 1
    axis = lambda name: spark.range(-n, n + 1).withColumnRenamed("id", name)
    points = axis("i").crossJoin(axis("j"))
    points = points.withColumns(
        {
            "lat": F.lit(lat) + F.col("i") * (step_m / METRES_PER_DEGREE),
            "lon": F.lit(lon) + F.col("j") * (step_m / METRES_PER_DEGREE) / F.cos(F.radians(F.lit(lat))),
        }
    )
    return points.withColumn("dist", haversine_m(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).where(F.col("dist") <= radius_m)


#: A side of so many rows is broadcast.
BROADCAST_ROWS = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def celled(left: DataFrame, right: DataFrame, radius_m: float, most: int = 5_000, depth: int = 8) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cells (_l, _y, _x) and shares (_b, _s) in which pairs within the radius meet.

    The plane is a quadtree: cells of level 0 are as large as the radius at least (up to latitudes of 75 degrees either way), and
    one with more than ``most`` points of the right side is split, down to level ``depth``.  A right row is in its
    leaf; a left row in all leaves that its circle's box touches.  Where a leaf still holds more than ``most`` rows of a side
    (many points in one place), each side is dealt to shares and repeated over those of the other.
    """
    size = radius_m / METRES_PER_DEGREE / 0.2588
    at = lambda c, level: F.floor(F.col(c) / (size / 2**level)).cast("long")
    points = right.select(at("lat2", depth).alias("_y"), at("lon2", depth).alias("_x")).groupBy("_y", "_x").count()
    grown = points.select(F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("_l"), "_y", "_x", "count")
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.lit(depth) - F.col("_l"))).cast("long")
    splits = grown.groupBy("_l", up("_y").alias("_y"), up("_x").alias("_x")).agg(F.sum("count").alias("_n")).where(F.col("_n") > most).drop("_n")
    path = shared_path(left.sparkSession)
    splits.write.parquet(path)  # one row for each ``most`` rows of a level at most
    splits = left.sparkSession.read.schema("_l int, _y long, _x long").parquet(path)
    levels = [r[0] for r in splits.select("_l").distinct().collect()]  # no more than there are levels
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    a = left.withColumn("_dy", near).withColumn("_dx", near).withColumns({"_l": F.lit(0), "_y": at("lat", 0) + F.col("_dy"), "_x": at("lon", 0) + F.col("_dx")}).drop("_dy", "_dx")
    b = right.withColumns({"_l": F.lit(0), "_y": at("lat2", 0), "_x": at("lon2", 0)})
    reach = radius_m / METRES_PER_DEGREE * 1.01
    for level in range(max(levels, default=-1) + 1):
        split = _small(splits.where(F.col("_l") == level).withColumn("_split", F.lit(True)))
        half = size / 2 ** (level + 1)
        child = lambda dy, dx: F.struct(F.lit(level + 1).alias("_l"), (2 * F.col("_y") + dy).alias("_y"), (2 * F.col("_x") + dx).alias("_x"))  # noqa: B023,E731
        stay = F.array(F.struct("_l", "_y", "_x"))
        parts = F.when(F.col("_split"), F.array(*[child(dy, dx) for dy in (0, 1) for dx in (0, 1)])).otherwise(stay)
        wide = reach / F.greatest(F.cos(F.radians(F.abs(F.col("lat")) + reach)), F.lit(0.2))
        touches = lambda c: (c["_y"] * half <= F.col("lat") + reach) & ((c["_y"] + 1) * half >= F.col("lat") - reach) & (c["_x"] * half <= F.col("lon") + wide) & ((c["_x"] + 1) * half >= F.col("lon") - wide)  # noqa: B023,E731
        a = a.join(split, ["_l", "_y", "_x"], "left").withColumn("_c", F.explode(F.filter(parts, lambda c: touches(c) | (c["_l"] != level + 1)))).drop("_l", "_y", "_x", "_split").select("*", "_c.*").drop("_c")  # noqa: B023
        mine = F.struct(F.lit(level + 1).alias("_l"), at("lat2", level + 1).alias("_y"), at("lon2", level + 1).alias("_x"))
        b = b.join(split, ["_l", "_y", "_x"], "left").withColumn("_c", F.when(F.col("_split"), mine).otherwise(F.struct("_l", "_y", "_x"))).drop("_l", "_y", "_x", "_split").select("*", "_c.*").drop("_c")
    cell = ["_l", "_y", "_x"]
    sizes = a.groupBy(*cell).agg(F.count("*").alias("_na")).join(b.groupBy(*cell).agg(F.count("*").alias("_nb")), cell, "full_outer")
    number = lambda c: F.ceil(F.coalesce(F.col(c), F.lit(1)) / most).cast("int")
    shares = sizes.select(*cell, number("_na").alias("_ka"), number("_nb").alias("_kb")).where("_ka > 1 OR _kb > 1")
    shares = _small(shares)
    deal = lambda df, own: F.pmod(F.xxhash64(*df.columns), F.coalesce(F.col(own), F.lit(1))).cast("int")
    every = lambda other: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
    own_a, own_b = deal(a, "_ka"), deal(b, "_kb")
    a = a.join(shares, cell, "left").withColumn("_s", own_a).withColumn("_b", every("_kb")).drop("_ka", "_kb")
    b = b.join(shares, cell, "left").withColumn("_b", own_b).withColumn("_s", every("_ka")).drop("_ka", "_kb")
    return a, b


def radius_join(left: DataFrame, right: DataFrame, radius_m: float, most: int = 5_000) -> DataFrame:
    """Pairs of left (lat, lon, ...) and right (lat2, lon2, ...) within the radius, with dist: an equal join on cells that adapt to
    the points' density, then the exact distance as a filter."""
    a, b = celled(left, right, radius_m, most)
    joined = a.join(b, ["_l", "_y", "_x", "_b", "_s"]).drop("_l", "_y", "_x", "_b", "_s")
    return joined.withColumn("dist", haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).where(F.col("dist") <= radius_m)
