"""Supply-catalog queries: prices, sellers, terms, pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.quantiles import exact_quantiles, true_median, value_counts
from millrace.functions.text import tokenize
from millrace.operators import aggregates as A
from millrace.operators import dedup as D
from millrace.plans import views as V
from millrace.plans.registry import query
from millrace.sources.scratch import shared_path

Q_SQL = "list_sort(list({c}))[CAST({rule} AS BIGINT) + 1]"


def q(c: str, rule: str, p: float, cond: str = "") -> str:
    """DuckDB expression of an exact quantile of column c."""
    of = f"list({c})" + (f" FILTER ({cond})" if cond else "")
    n = "count(*)" + (f" FILTER ({cond})" if cond else "")
    index = {"rint": f"round_even(({n} - 1) * {p}::DOUBLE, 0)", "floor": f"least({n} - 1, floor({n} * {p}::DOUBLE))", "mid": f"floor({n} / 2)"}[rule]
    return f"list_sort({of})[CAST({index} AS BIGINT) + 1]"


PRICE = f"""count(*) AS n, min(price) AS low, {q('price', 'rint', .25)} AS p25, {q('price', 'rint', .5)} AS median, {q('price', 'rint', .75)} AS p75,
 {q('price', 'rint', .9)} AS p90, max(price) AS high, round(count(*) FILTER (price <= 20000)::DOUBLE / count(*), 6) AS share_low,
 {q('price', 'rint', .5, 'price > 20000')} AS median_above, CAST(round_even(avg(price), 0) AS BIGINT) AS mean"""


@query(f"SELECT leaf, {PRICE} FROM v_gigs WHERE price > 0 GROUP BY leaf")
def agg1_price_stats(spark, d):
    return A.price_stats(value_counts(V.gigs(spark, d), ["leaf"], "price"), ["leaf"], low=20000)


@query(f"""SELECT leaf, {PRICE} FROM v_gigs WHERE price > 0 GROUP BY leaf
 UNION ALL SELECT '*' AS leaf, {PRICE} FROM v_gigs WHERE price > 0""")
def agg7_per_category_and_global(spark, d):
    counts = value_counts(V.gigs(spark, d), ["leaf"], "price")
    both = counts.select(F.explode(F.array("leaf", F.lit("*"))).alias("leaf"), "price", "_c").groupBy("leaf", "price").agg(F.sum("_c").alias("_c"))
    return A.price_stats(both, ["leaf"], low=20000)


SELLERS = """count(*) AS n, count(*) FILTER (reviews <= 0) AS r0, count(*) FILTER (reviews BETWEEN 1 AND 10) AS r1_10,
 count(*) FILTER (reviews BETWEEN 11 AND 50) AS r11_50, count(*) FILTER (reviews BETWEEN 51 AND 200) AS r51_200, count(*) FILTER (reviews > 200) AS r200,
 count(*) FILTER (reviews >= 200) AS heavy, count(*) FILTER (reviews BETWEEN 1 AND 50) AS mass, count(*) FILTER (reviews = 0) AS fresh,
 count(*) FILTER (level = 'A') AS level_a, count(*) FILTER (level = 'N') AS level_n, count(*) FILTER (level = 'R') AS level_r,
 round(count(*) FILTER (reviews >= 200)::DOUBLE / greatest(count(*), 1), 6) AS heavy_share,
 round(count(*) FILTER (reviews BETWEEN 1 AND 50)::DOUBLE / greatest(count(*), 1), 6) AS mass_share, round(count(*) FILTER (reviews = 0)::DOUBLE / greatest(count(*), 1), 6) AS fresh_share"""


@query(f"SELECT leaf, {SELLERS} FROM v_gigs GROUP BY leaf")
def agg2_seller_structure(spark, d):
    r = F.col("reviews")
    n = A.count_if
    return V.gigs(spark, d).groupBy("leaf").agg(
        F.count("*").alias("n"), n(r <= 0).alias("r0"), n(r.between(1, 10)).alias("r1_10"), n(r.between(11, 50)).alias("r11_50"),
        n(r.between(51, 200)).alias("r51_200"), n(r > 200).alias("r200"), n(r >= 200).alias("heavy"), n(r.between(1, 50)).alias("mass"),
        n(r == 0).alias("fresh"), *[n(F.col("level") == x).alias(f"level_{x.lower()}") for x in "ANR"], A.share(n(r >= 200), F.count("*")).alias("heavy_share"),
        A.share(n(r.between(1, 50)), F.count("*")).alias("mass_share"), A.share(n(r == 0), F.count("*")).alias("fresh_share"),
    )


EDGES = [("0-0", 0), ("1-10", 10), ("11-50", 50), ("51-200", 200), ("201-999", 999), ("1000+", None)]


@query("""WITH b(bucket, lo, hi) AS (VALUES ('0-0', -1e9, 0), ('1-10', 0, 10), ('11-50', 10, 50), ('51-200', 50, 200), ('201-999', 200, 999), ('1000+', 999, 1e18))
 SELECT l.leaf, b.bucket, count(g.id) AS n FROM (SELECT DISTINCT leaf FROM v_gigs) l CROSS JOIN b
 LEFT JOIN v_gigs g ON g.leaf = l.leaf AND g.reviews > b.lo AND g.reviews <= b.hi GROUP BY l.leaf, b.bucket""")
def agg3_bucketize(spark, d):
    return A.labelled_buckets(V.gigs(spark, d), "reviews", EDGES, ["leaf"])


@query(f"""SELECT leaf, count(*) AS n, min(reviews) AS low, {q('reviews', 'floor', .25)} AS p25, {q('reviews', 'floor', .5)} AS median,
 {q('reviews', 'floor', .75)} AS p75, {q('reviews', 'floor', .9)} AS p90, max(reviews) AS high FROM v_gigs GROUP BY leaf""")
def agg4_dist_floor(spark, d):
    spec = {"p25": ("floor", 0.25), "median": ("floor", 0.5), "p75": ("floor", 0.75), "p90": ("floor", 0.9), "low": ("floor", 0.0), "high": ("floor", 1.0)}
    return exact_quantiles(V.gigs(spark, d), ["leaf"], "reviews", spec)


@query("""SELECT leaf, round_even(avg(price), 1) AS mean, round_even(median(price), 1) AS median, min(price) AS low, max(price) AS high FROM v_gigs GROUP BY leaf""")
def agg5_dist_true(spark, d):
    g = V.gigs(spark, d).select("leaf", "price")
    base = g.groupBy("leaf").agg(F.bround(F.avg("price"), 1).alias("mean"), F.min("price").alias("low"), F.max("price").alias("high"))
    return base.join(true_median(g, ["leaf"], "price", "median", 1, half_even=True), "leaf")


DIST = {"low": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "high": 1.0}
DISTS = {"": "reviews", "deals_": "price"}


@query(f"""SELECT parent AS profession, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (level = 'A') / count(*), 4) AS pro_share, round(100.0::DOUBLE * count(*) FILTER (seller % 3 = 0) / count(*), 4) AS verified_share,
 count(*) FILTER (reviews = 0) AS b0, count(*) FILTER (reviews BETWEEN 1 AND 10) AS b1, count(*) FILTER (reviews BETWEEN 11 AND 50) AS b2, count(*) FILTER (reviews BETWEEN 51 AND 200) AS b3, count(*) FILTER (reviews > 200) AS b4,
 round(100.0::DOUBLE * count(*) FILTER (reviews = 0) / count(*), 4) AS fresh_share, round(100.0::DOUBLE * count(*) FILTER (reviews > 200) / count(*), 4) AS heavy_share,
 {', '.join(f"{q(c, 'floor', p)} AS {pre}{name}" for pre, c in DISTS.items() for name, p in DIST.items())} FROM v_gigs GROUP BY parent""")
def agg6_profession_profile(spark, d):
    g, r = V.gigs(spark, d).withColumnRenamed("parent", "profession"), F.col("reviews")
    n = F.count("*")
    base = g.groupBy("profession").agg(
        A.share(A.count_if(F.col("level") == "A"), n, 100.0, 4).alias("pro_share"), A.share(A.count_if(F.col("seller") % 3 == 0), n, 100.0, 4).alias("verified_share"),
        A.count_if(r == 0).alias("b0"), A.count_if(r.between(1, 10)).alias("b1"), A.count_if(r.between(11, 50)).alias("b2"), A.count_if(r.between(51, 200)).alias("b3"), A.count_if(r > 200).alias("b4"),
        A.share(A.count_if(r == 0), n, 100.0, 4).alias("fresh_share"), A.share(A.count_if(r > 200), n, 100.0, 4).alias("heavy_share"),
    )
    for pre, col in DISTS.items():
        told = exact_quantiles(g, ["profession"], col, {f"{pre}{name}": ("floor", p) for name, p in DIST.items()})
        base = base.join(told if pre == "" else told.drop("n"), "profession")
    return base


TOKENS = r"list_filter(regexp_extract_all(replace(lower(p_name), 'ё', 'е'), '[\p{L}\p{N}][\p{L}\p{N}.+-]+'), lambda w: len(w) > 2)"
RANKED = "SELECT *, row_number() OVER (ORDER BY n DESC, term) AS rank FROM c QUALIFY rank <= 20"


@query(f"""WITH t AS (SELECT {TOKENS} AS w FROM part), c AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM t) WHERE term <> 'blue' GROUP BY term)
 {RANKED}""")
def agg8_top_terms(spark, d):
    one, _ = A.terms(tokenize(F.col("p_name")), ["blue"])
    return A.top_by_count(V.read(spark, d, "part").select(F.explode(one).alias("term")), [], "term", 20)


@query(f"""WITH t AS (SELECT {TOKENS} AS w FROM part), c AS (SELECT term, count(*) AS n FROM
 (SELECT unnest(list_transform(generate_series(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1])) AS term FROM t) GROUP BY term) {RANKED}""")
def agg8_top_bigrams(spark, d):
    _, two = A.terms(tokenize(F.col("p_name")), ["blue"])
    return A.top_by_count(V.read(spark, d, "part").select(F.explode(two).alias("term")), [], "term", 20)


@query(r"""WITH c AS (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(gtitle), '[\p{L}]{3,}')) AS term FROM v_gigs WHERE level = 'A') GROUP BY term)
 SELECT *, row_number() OVER (ORDER BY n DESC, term) AS rank FROM c QUALIFY rank <= 30""")
def agg9_name_words(spark, d):
    words = F.regexp_extract_all(F.lower("gtitle"), F.lit(r"[\p{L}]{3,}"), F.lit(0))
    return A.top_by_count(V.gigs(spark, d).where("level = 'A'").select(F.explode(words).alias("term")), [], "term", 30)


TERMS = ["blue", "th", "red", "an a"]


@query("""SELECT term, CAST(sum((len(text) - len(replace(text, term, ''))) // len(term)) AS BIGINT) AS n
 FROM (SELECT lower(coalesce(text, '')) AS text FROM v_text), (SELECT unnest(['blue', 'th', 'red', 'an a']) AS term) GROUP BY term""")
def agg10_term_coverage(spark, d):
    low = F.lower(F.coalesce("text", F.lit("")))
    sums = V.texts(spark, d).agg(*[F.sum(A.occurrences(low, t)).alias(t) for t in TERMS])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"`{t}`").alias("n")) for t in TERMS])).alias("x")).select("x.*")


@query(f"""WITH e AS (SELECT o_orderkey AS card, o_orderpriority AS leaf, l_linenumber, p_name, CAST(round(l_extendedprice) AS BIGINT) AS price
 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey),
 t AS (SELECT leaf, unnest({TOKENS}) AS term FROM e WHERE p_name IS NOT NULL), c AS (SELECT leaf, term, count(*) AS k FROM t GROUP BY leaf, term QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY count(*) DESC, term) <= 5),
 b AS (SELECT leaf, string_agg(term, ' ' ORDER BY k DESC, term) AS top_terms FROM c GROUP BY leaf)
 SELECT e.leaf, any_value(top_terms) AS top_terms, count(DISTINCT card) FILTER (price IS NOT NULL) AS with_extras, count(price) AS n, min(price) AS low, {q('price', 'rint', .5, 'price IS NOT NULL')} AS median,
 {q('price', 'rint', .9, 'price IS NOT NULL')} AS p90, max(price) AS high FROM e LEFT JOIN b ON e.leaf = b.leaf GROUP BY e.leaf""")
def agg11_extras_stats(spark, d):
    """Cards with extras, the extras' prices, and the five terms that their names hold most.

    Lines meet their cards once: what is counted of them, prices and parts of a leaf, is written and read for the figures.
    """
    cards = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("card"), F.col("o_orderpriority").alias("leaf"))
    lines = V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("card"), F.col("l_partkey").alias("part"), F.round("l_extendedprice").cast("long").alias("price"))
    facts = F.explode(F.array(F.struct(F.lit(True).alias("priced"), F.col("price").alias("value")), F.struct(F.lit(False).alias("priced"), F.col("part").alias("value"))))
    tally = lines.join(cards, "card").select("leaf", facts.alias("x")).groupBy("leaf", "x.priced", "x.value").agg(F.count("*").alias("_c"))
    path = shared_path(spark)
    tally.write.parquet(path)
    tally = spark.read.parquet(path).where("value IS NOT NULL")
    spec = {"low": ("floor", 0.0), "median": ("rint", 0.5), "p90": ("rint", 0.9), "high": ("floor", 1.0)}
    prices = exact_quantiles(tally.where("priced").select("leaf", F.col("value").alias("price"), "_c"), ["leaf"], "price", spec, counted=True)
    names = V.read(spark, d, "part").select(F.col("p_partkey").alias("value"), "p_name")
    terms = tally.where("NOT priced").join(names, "value").select("leaf", F.explode(tokenize(F.col("p_name"))).alias("term"), "_c").groupBy("leaf", "term").agg(F.sum("_c").alias("k"))
    best = terms.withColumn("rank", F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("k"), "term"))).where("rank <= 5")
    best = best.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t")).select("leaf", F.array_join("t.term", " ").alias("top_terms"))
    filled = cards.join(lines.where("price IS NOT NULL").select("card"), "card", "left_semi")
    with_extras = cards.groupBy("leaf").agg(F.lit(0).alias("z")).join(filled.groupBy("leaf").agg(F.count("*").alias("k")), "leaf", "left")
    with_extras = with_extras.select("leaf", F.coalesce("k", F.lit(0)).alias("with_extras"))
    return with_extras.join(prices, "leaf", "left").withColumn("n", F.coalesce("n", F.lit(0))).join(best, "leaf", "left")


@query(f"SELECT leaf, count(*) AS n, min(price) AS low, {q('price', 'mid', .5)} AS median, max(price) AS high FROM v_gigs GROUP BY leaf")
def agg43_catalog_summary(spark, d):
    spec = {"low": ("floor", 0.0), "median": ("mid", 0.5), "high": ("floor", 1.0)}
    return exact_quantiles(V.gigs(spark, d), ["leaf"], "price", spec)


@query("""WITH g AS (SELECT leaf, level, id, seller % 13 AS page FROM v_gigs)
 SELECT leaf, max(page) + CASE WHEN count(*) > 20 THEN 1 ELSE 0 END AS est_pages, 40 * (max(page) + CASE WHEN count(*) > 20 THEN 1 ELSE 0 END) AS est_total,
 count(*) AS scraped, count(*) FILTER (level = 'A') AS pro FROM g GROUP BY leaf""")
def agg44_catalog_estimate(spark, d):
    g = V.gigs(spark, d).withColumn("page", F.col("seller") % 13)
    est = F.max("page") + F.when(F.count("*") > 20, 1).otherwise(0)
    return g.groupBy("leaf").agg(est.alias("est_pages"), (40 * est).alias("est_total"), F.count("*").alias("scraped"), A.count_if(F.col("level") == "A").alias("pro"))


def _ranked(df, by, order, n):
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


@query("""SELECT leaf, id, substr(gtitle, 1, 60) AS title, reviews, row_number() OVER (PARTITION BY leaf ORDER BY reviews DESC, id) AS rank
 FROM v_gigs QUALIFY rank <= 6""")
def top2_top_players(spark, d):
    g = V.gigs(spark, d).select("leaf", "id", F.substring("gtitle", 1, 60).alias("title"), "reviews")
    return _ranked(g, ["leaf"], [F.desc("reviews"), "id"], 6)


@query("""SELECT parent, id, reviews, row_number() OVER (PARTITION BY parent ORDER BY reviews DESC, id) AS rank FROM v_gigs WHERE gtitle <> '' QUALIFY rank <= 3""")
def top3_top_sample(spark, d):
    g = V.gigs(spark, d).where("gtitle <> ''").select("parent", "id", F.coalesce("reviews", F.lit(0)).alias("reviews"))
    return _ranked(g, ["parent"], [F.desc("reviews"), "id"], 3)


@query("""WITH f AS (SELECT seller, reviews, id, row_number() OVER (PARTITION BY seller ORDER BY reviews DESC, id) AS rn FROM v_gigs)
 SELECT seller, reviews, id, row_number() OVER (ORDER BY reviews DESC, id) AS rank FROM f WHERE rn = 1 QUALIFY rank <= 15""")
def top4_top_unique(spark, d):
    first = D.dedup_first(V.gigs(spark, d).select("seller", "reviews", "id"), ["seller"], [F.desc("reviews"), "id"])
    best = first.orderBy(F.desc("reviews"), "id").limit(15)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("reviews"), "id")).cast("long"))


PAGES = """WITH g AS (SELECT leaf, seller, CASE WHEN id % 40 = 0 THEN 8 + id % 3 ELSE id % 5 END + CASE WHEN seller % 2 = 0 THEN 0 ELSE 1 END AS page FROM v_gigs), f AS (SELECT leaf, seller, min(page) AS page FROM g GROUP BY ALL),
 n AS (SELECT g.leaf, g.page, count(*) FILTER (g.page = f.page) AS n_new FROM g JOIN f ON g.leaf = f.leaf AND g.seller = f.seller GROUP BY ALL),
 z AS (SELECT *, coalesce(sum((n_new = 0)::INT) OVER w, 0) AS empty, count(*) OVER w AS k FROM n WINDOW w AS (PARTITION BY leaf ORDER BY page ROWS BETWEEN {0} PRECEDING AND CURRENT ROW)),
 s AS (SELECT leaf, min(page) AS stop FROM z WHERE k > {0} AND empty > {0} GROUP BY leaf)
 SELECT f.leaf, f.seller, f.page, count(*) OVER (PARTITION BY f.leaf, f.page) AS brought FROM f LEFT JOIN s ON s.leaf = f.leaf WHERE stop IS NULL OR f.page <= stop"""


def _sheets(spark, d):
    page = F.when(F.col("id") % 40 == 0, 8 + F.col("id") % 3).otherwise(F.col("id") % 5) + F.when(F.col("seller") % 2 == 0, 0).otherwise(1)
    return V.gigs(spark, d).withColumn("page", page)


@query(PAGES.format(1))
def ded8_page_union(spark, d):
    """Sellers over pages, as a crawl that ends with the second page in a row without a new one sees them."""
    return D.page_union(_sheets(spark, d), "seller", "page", ["leaf"], 2)


@query(PAGES.format(0))
def ded8_page_union_first_stop(spark, d):
    """The same for a crawl that ends with the first page without a new one."""
    return D.page_union(_sheets(spark, d), "seller", "page", ["leaf"], 1)


@query("""WITH g AS (SELECT leaf, seller, id % 7 AS page FROM v_gigs), f AS (SELECT leaf, seller, min(page) AS first FROM g GROUP BY leaf, seller)
 SELECT g.leaf, g.page, count(*) AS n_rows, count(*) FILTER (g.page = f.first) AS n_new FROM g JOIN f ON g.leaf = f.leaf AND g.seller = f.seller GROUP BY g.leaf, g.page""")
def win18_page_novelty(spark, d):
    return D.page_novelty(V.gigs(spark, d).withColumn("page", F.col("id") % 7), "seller", "page", ["leaf"])


@query("""SELECT p_brand AS leaf, p_size AS size, count(*) AS n, any_value(r.parts) AS parts_of_brand FROM part
 LEFT JOIN (SELECT p_brand AS b, count(*) AS parts FROM part GROUP BY p_brand HAVING count(*) % 2 = 0) r ON r.b = p_brand GROUP BY p_brand, p_size""")
def joi5_attach_category_meta(spark, d):
    part = V.read(spark, d, "part")
    meta = part.groupBy(F.col("p_brand").alias("leaf")).agg(F.count("*").alias("parts_of_brand")).where("parts_of_brand % 2 = 0")
    return part.groupBy(F.col("p_brand").alias("leaf"), F.col("p_size").alias("size")).agg(F.count("*").alias("n")).join(meta, "leaf", "left")
