"""Mixing sources to target weights: whole copies, then Pareto order sampling for the rest.

DataFrame expressions only.  A document's expected number of copies in its source is
target / source size.  The whole part is allotted for certain.  For the fractional part p, documents
are ranked by (u / (1 - u)) / (p / (1 - p)) with a uniform u that depends on the id and the seed, and
the sample is fixed in words: ranks are taken until the source's remaining words are used up (the last
document is in if at least half of it fits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise, word_count

BINS = 1 << 14
#: A source's row is repeated so often for joins with documents, so that no join deals a source to one task.
SPREAD = 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Target words of each source.

    sizes has (source, size).  Sources, ordered by code point with null last, weigh ``weights`` in turn
    and share all words in that proportion.  A target stops at ``cap`` times its source's words; the
    excess is shared out by weight until none is above (water filling: sources ordered by cap per weight
    are closed one after another, the first that stays below its cap sets the level of the rest).
    Returns (no_source, skey, source_size, target).  An empty input gives no rows.
    """
    per = sizes.groupBy("no_source", "skey").agg(F.sum("size").alias("source_size"))
    # One row for each source from here on: windows without a partition key hold that list only.
    turn = (F.row_number().over(Window.orderBy("no_source", "skey")) - 1) % F.lit(len(weights)) + 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int")).cast("long"))
    per = per.withColumn("limit", F.lit(cap).cast("long") * F.col("source_size"))
    whole = Window.orderBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "no_source", "skey")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "*",
        F.row_number().over(by_limit).alias("pos"),
        (
            (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
            / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        ).alias("level"),
    )
    is_open = F.col("limit") / F.col("weight") > F.col("level")
    first_open = F.min(F.when(is_open, F.struct("pos", "level"))).over(whole)
    per = per.withColumn("open", first_open)
    return per.select(
        "no_source",
        "skey",
        "source_size",
        F.coalesce(F.least(F.col("limit").cast("double"), F.col("open.level") * F.col("weight")), F.col("limit").cast("double")).alias("target"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "") -> DataFrame:
    """Words that a mix takes of each row of documents (doc_id, text, source; other columns are ignored).

    Returns doc_id, size, source_size, target, taken: one row for each input row.  A null or empty text
    has size 0 and takes 0.  Rows with a null source are a source of their own, the last.  Rows that
    share a doc_id share their random number; ties in rank go to the smaller doc_id, then to the smaller size.  Repeated rows each
    count.  The random numbers are functions of doc_id and seed, so that reruns agree.
    No source's rows need to meet in a task: words are summed by rank bin, and only the bin in which a
    source's sample ends is ordered row by row.
    """
    return _mixed(docs, weights, cap, seed).drop("no_source", "skey")


def _mixed(docs: DataFrame, weights: tuple[int, ...], cap: int, seed: str) -> DataFrame:
    """The rows of mix with their source as (no_source, skey)."""
    sizes = materialise(
        docs.select(
            F.col("doc_id"),
            F.col("source").isNull().alias("no_source"),
            F.coalesce(F.col("source"), F.lit("")).alias("skey"),
            word_count(F.col("text")).alias("size"),
            F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("int").alias("salt"),
        )
    )
    salts = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt")
    targets = source_targets(sizes, weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = (
        targets.withColumn("rate", rate)
        .withColumn("copies", F.floor("rate").cast("long"))
        .withColumn("p", F.col("rate") - F.col("copies"))
        .withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
    )
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    odds = F.when(F.col("p") > 0, (u / (1.0 - u)) / (F.col("p") / (1.0 - F.col("p")))).otherwise(u / (1.0 - u))
    ranked = (
        sizes.join(targets.select("*", salts), ["no_source", "skey", "salt"])
        .withColumn("q", odds)
        .withColumn("bin", F.floor(F.col("q") / (1.0 + F.col("q")) * BINS).cast("int"))
    )
    bins = ranked.groupBy("no_source", "skey", "bin").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    upto = Window.partitionBy("no_source", "skey").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    last = bins.where((F.col("before") <= F.col("need")) & (F.col("need") < F.col("before") + F.col("words"))).select(
        "no_source", "skey", F.col("bin").alias("last_bin"), "before"
    )
    ranked = ranked.join(last.select("*", salts), ["no_source", "skey", "salt"], "left")
    inside = Window.partitionBy("no_source", "skey").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = ranked.where(F.col("bin") == F.col("last_bin")).withColumn(
        "chosen", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2.0 <= F.col("need")
    )
    rest = ranked.where(F.col("last_bin").isNull() | (F.col("bin") != F.col("last_bin"))).withColumn(
        "chosen", F.col("last_bin").isNull() | (F.col("bin") < F.col("last_bin"))
    )
    return edge.unionByName(rest).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("copies") + F.col("chosen").cast("long"))).alias("taken"),
        "no_source",
        "skey",
    )


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "") -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, columns unchanged.

    Rows are matched with what the mix takes by doc_id; those without one, and those that share one, are told apart by
    source, words and a number among rows that agree in all of these, in the order of their texts' hashes.
    """
    mixed = materialise(_mixed(docs, weights, cap, seed).withColumn("_times", F.when(F.col("taken") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")))
    again = materialise(mixed.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    plain, odd = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    taken, rest = mixed.where("doc_id IS NOT NULL"), mixed.where("doc_id IS NULL")
    if not again.isEmpty():
        odd, rest = (d.unionByName(p.join(again, "doc_id", "left_semi")) for d, p in ((odd, plain), (rest, taken)))
        plain, taken = (p.join(again, "doc_id", "left_anti") for p in (plain, taken))
    found = plain.join(taken.where("_times > 0").select("doc_id", "_times"), "doc_id").select(*docs.columns, "_times")
    keys = ["_id", "_none", "_source", "_words"]
    nth = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id")
    times = rest.select(named, F.col("no_source").alias("_none"), F.col("skey").alias("_source"), F.col("size").alias("_words"), "_times")
    times = times.withColumn("_nth", nth(F.desc("_times"))).where("_times > 0")
    odd = odd.select("*", named, F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), word_count(F.col("text")).alias("_words"))
    odd = odd.withColumn("_nth", nth(F.xxhash64("text"))).join(times, [*keys, "_nth"]).select(*docs.columns, "_times")
    return found.unionByName(odd).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


#: The same rows from plain windows over each source.  {docs} is the name of the documents table.
MIX_SQL = """
WITH sizes AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS skey,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM {docs}),
per AS (SELECT no_source, skey, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY ALL),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY no_source, skey) - 1) % 3 + 1 AS weight, 3 * source_size AS lim FROM per),
levels AS (
  SELECT *, row_number() OVER w AS pos,
         CAST((SELECT sum(source_size) FROM weighed) - coalesce(sum(lim) OVER b, 0) AS DOUBLE)
         / CAST((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM weighed
  WINDOW w AS (ORDER BY CAST(lim AS DOUBLE) / weight, no_source, skey),
         b AS (ORDER BY CAST(lim AS DOUBLE) / weight, no_source, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (SELECT arg_min(level, pos) AS level FROM levels WHERE CAST(lim AS DOUBLE) / weight > level),
targets AS (
  SELECT l.no_source, l.skey, l.source_size,
         coalesce(least(CAST(lim AS DOUBLE), (SELECT level FROM opened) * weight), CAST(lim AS DOUBLE)) AS target
  FROM levels l),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM targets),
parts AS (
  SELECT *, CAST(floor(rate) AS BIGINT) AS copies, rate - floor(rate) AS p,
         target - CAST(floor(rate) AS BIGINT) * source_size AS need FROM rates),
drawn AS (
  SELECT s.doc_id, s.size, p.*, (CAST(('0x' || substr(md5(CAST(s.doc_id AS VARCHAR)), 1, 12)) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM sizes s JOIN parts p ON s.no_source = p.no_source AND s.skey = p.skey),
ranked AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) ELSE u / (1.0::DOUBLE - u) END AS q FROM drawn)
SELECT doc_id, size, source_size, target,
       size * (copies + CASE WHEN coalesce(sum(size) OVER r, 0)::DOUBLE + size / 2.0::DOUBLE <= need THEN 1 ELSE 0 END) AS taken
FROM ranked
WINDOW r AS (PARTITION BY no_source, skey ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""
