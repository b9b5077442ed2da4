"""Distributions, buckets and shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.quantiles import RULES, exact_quantiles
from millrace.functions.text import STOP


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def share(part: Column, whole: Column, scale: float = 1.0, digits: int = 6) -> Column:
    return F.round(F.when(whole > 0, scale * part / whole).otherwise(0.0), digits)


def price_stats(counts: DataFrame, by: list[str], col: str = "price", low: int = 500) -> DataFrame:
    """n, min, p25, median, p75, p90 (rounded index), max, share up to ``low``, median above it, mean; 0 and below don't count.

    counts is value_counts of the prices; the indices are found by exact_quantiles, the one above ``low`` from the count up to it.
    """
    c, price = F.col("_c"), F.col(col)
    stats = {"low": F.min(col), "high": F.max(col), "_low": F.coalesce(F.sum(F.when(price <= low, c)), F.lit(0)), "_sum": F.sum(price * c)}
    specs = {name: ("rint", p) for name, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9))}
    specs["median_above"] = lambda n: F.col("_low") + RULES["rint"](n - F.col("_low"), 0.5)
    found = exact_quantiles(counts.where(price > 0), by, col, specs, stats, counted=True)
    return found.select(
        *by, "n", "low", "high", "p25", "median", "p75", "p90", share(F.col("_low"), F.col("n")).alias("share_low"), "median_above",
        F.bround(F.col("_sum") / F.col("n")).cast("long").alias("mean"),
    )


def labelled_buckets(df: DataFrame, col: str, edges: list[tuple[str, float | None]], by: list[str]) -> DataFrame:
    """Counts per bucket: edges are (label, upper end) in order, None without end; empty buckets stay, with 0."""
    label = reduce(
        lambda when, e: when.when(F.lit(True) if e[1] is None else F.col(col) <= e[1], F.lit(e[0])),
        edges[1:],
        F.when(F.col(col) <= edges[0][1], F.lit(edges[0][0])),
    )
    tallies = [count_if(label == e[0]).alias(e[0]) for e in edges]
    wide = df.where(F.col(col).isNotNull()).groupBy(*by).agg(*tallies)
    return wide.select(*by, F.explode(F.array(*[F.struct(F.lit(e[0]).alias("bucket"), F.col(f"`{e[0]}`").alias("n")) for e in edges])).alias("b")).select(*by, "b.bucket", "b.n")


def top_by_count(df: DataFrame, by: list[str], key: str, n: int, count: str = "n") -> DataFrame:
    """The n most frequent keys of each group, ties by key."""
    counts = df.groupBy(*by, key).agg(F.count("*").alias(count))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(count), key)).cast("long")
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def terms(tokens: Column, generic: list[str], stop: list[str] = STOP) -> tuple[Column, Column]:
    """Unigrams without generic words, and bigrams of neighbours before generic words go."""
    kept = F.filter(tokens, lambda w: ~w.isin(stop))
    pairs = F.zip_with(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(kept, lambda w: ~w.isin(generic)), pairs


def occurrences(text: Column, term: str) -> Column:
    """Occurrences of a term in a text that don't overlap."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def fill_rate(df: DataFrame, fields: list[str]) -> DataFrame:
    """Percentage of rows in which a field counts more than 0, one decimal (half to even)."""
    rates = df.agg(*[F.bround(F.avg((F.coalesce(F.col(f), F.lit(0)) > 0).cast("double")) * 100, 1).alias(f) for f in fields])
    return rates.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("rate")) for f in fields])).alias("r")).select("r.field", "r.rate")


def day_sketches(df: DataFrame, by: list[str], day: str, of: str, lg_k: int = 14) -> DataFrame:
    """One row of a group and day: visits (rows) and a mergeable sketch of the distinct values of a column, 16 KB at most."""
    return df.groupBy(*by, day).agg(F.count("*").alias("visits"), F.hll_sketch_agg(of, lg_k).alias("sketch"))


def united_sketches(days: DataFrame, by: list[str]) -> DataFrame:
    """Visits and distinct values of each group over any days, from their sketches; the rows themselves aren't read again."""
    return days.groupBy(*by).agg(F.sum("visits").alias("visits"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


#: What counts as yes.
YES = ["true", "1", "yes", "да"]


def flagged(df: DataFrame, flags: list[str], keep: list[str]) -> DataFrame:
    """A row for each flag that a row raises: flag and the columns in ``keep``."""
    raised = F.filter(F.array(*[F.when(F.lower(F.trim(F.col(f))).isin(YES), F.lit(f)) for f in flags]), lambda f: f.isNotNull())
    return df.select(F.explode(raised).alias("flag"), *keep)
