"""Exact quantiles by index rules, without gathering a group's values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Index of the wanted element among n sorted values, by rule; low and high are the two middle ones.
RULES = {
    "rint": lambda n, p: F.rint((n - 1) * F.lit(p)).cast("long"),
    "floor": lambda n, p: F.least(n - 1, F.floor(n * F.lit(p)).cast("long")),
    "mid": lambda n, p: F.floor(n / 2).cast("long"),
    "low": lambda n, p: F.floor((n - 1) / 2).cast("long"),
    "high": lambda n, p: F.floor(n / 2).cast("long"),
}
MIDDLE = {"_low": ("low", 0.5), "_high": ("high", 0.5)}
#: Bins of a group's values; an estimate of their borders only spreads the work, the counts decide.
BINS = 64


def value_counts(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Rows per group and value, as _c: what all statistics of the values can be taken from."""
    return df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("_c"))


def _below(borders: Column, value: Column, low: int, high: int) -> Column:
    """How many of the borders, in order, are less than a value, known to be between low and high: a search by halves in generated code."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(borders[mid] < value, _below(borders, value, mid + 1, high)).otherwise(_below(borders, value, low, mid))


def exact_quantiles(df: DataFrame, by: list[str], col: str, specs: dict, stats: dict[str, Column] | None = None, counted: bool = False) -> DataFrame:
    """One row per group: n, and for each name in specs the element that (rule, p) picks; null values and groups with a null key don't count.

    A spec may also be a function from n to an index, 0 for the first; null where no element has it.  ``stats`` are further
    aggregates over the values and their counts ``_c``, which such functions may use.  With ``counted``, df is value_counts already.

    Equal values are counted first (partial aggregation).  The distinct values of a group are dealt to bins by approximate
    percentiles and the bins are counted, so that the running count goes over few rows a group; only within the
    bin that holds an index are its values put in order.  So no group's values meet in one task, not even those of the whole table.
    """
    stats = stats or {}
    none = not by
    keys = by or ["_all"]
    rows = df.withColumn("_all", F.lit(1)) if none else df
    counts = rows if counted else value_counts(rows, keys, col)
    percentiles = F.percentile_approx(col, F.array(*[F.lit(k / BINS) for k in range(1, BINS)]), 4 * BINS)
    groups = counts.groupBy(*keys).agg(percentiles.alias("_b"), F.sum("_c").alias("_n"), *[c.alias(name) for name, c in stats.items()])
    # A value's bin is the number of borders below it: equal values share one, and bins follow the order of values.
    binned = counts.join(F.broadcast(groups) if none else groups, keys).withColumn("_bin", _below(F.col("_b"), F.col(col), 0, BINS - 1)).drop("_b")
    whole = ["_n", *stats]
    bins = binned.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_k"), F.min(col).alias("_from"), F.max(col).alias("_to"), *[F.first(c).alias(c) for c in whole])
    bins = bins.withColumn("_before", F.sum("_k").over(Window.partitionBy(*keys).orderBy("_bin")) - F.col("_k"))
    index = {name: RULES[spec[0]](F.col("_n"), spec[1]) if isinstance(spec, tuple) else spec(F.col("_n")) for name, spec in specs.items()}
    held = {name: (F.col("_before") <= i) & (i < F.col("_before") + F.col("_k")) for name, i in index.items()}
    # Values are found again by a bin's ends: borders made a second time may differ, as approximate percentiles depend on the order of rows.
    wanted = bins.where(reduce(lambda a, b: a | b, held.values())).drop("_bin")
    inside = Window.partitionBy(*keys, "_from").orderBy(col)
    upto = F.col("_before") + F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    picks = [F.min(F.when(held[name] & (F.col("_upto") > i), F.col(col))).alias(name) for name, i in index.items()]
    found = counts.join(F.broadcast(wanted) if none else wanted, keys).where(F.col(col).between(F.col("_from"), F.col("_to"))).withColumn("_upto", upto)
    found = found.groupBy(*keys).agg(F.first("_n").alias("n"), *picks, *[F.first(c).alias(c) for c in stats])
    return found.drop("_all") if none else found


def with_median(quantiles: DataFrame, name: str, digits: int | None = None, half_even: bool = False) -> DataFrame:
    """Replaces the two middle elements of exact_quantiles (specs MIDDLE) by their mean."""
    m = (F.col("_low") + F.col("_high")) / 2
    m = m if digits is None else F.bround(m, digits) if half_even else F.round(m, digits)
    return quantiles.withColumn(name, m).drop("_low", "_high")


def true_median(df: DataFrame, by: list[str], col: str, name: str, digits: int | None = None, half_even: bool = False) -> DataFrame:
    """The median of each group (mean of the middle two), without a group's values in one buffer."""
    return with_median(exact_quantiles(df, by, col, MIDDLE), name, digits, half_even).drop("n")


def of_array(values: Column, rule: str, p: float = 0.5) -> Column:
    """The same on an array column of few values; null if it is empty."""
    s = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(s).cast("long")
    return F.when(n > 0, F.element_at(s, (RULES[rule](n, p) + 1).cast("int")))
