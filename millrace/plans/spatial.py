"""Map queries: distances, coverage of a crawl grid, entities over cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.geo import grid_points, haversine_m, radius_join
from millrace.functions.quantiles import exact_quantiles
from millrace.operators import aggregates as A
from millrace.operators import dedup as D
from millrace.operators import filters as L
from millrace.operators.joins import cell_match
from millrace.operators.scan import running
from millrace.plans import views as V
from millrace.plans.catalog import q
from millrace.plans.registry import query

HAVERSINE = "2 * 6371000 * asin(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))"


@query("SELECT oid, round(dist, 1) AS dist FROM v_org_dist")
def sca23_haversine(spark, d):
    return V.org_dist(spark, d).select("oid", F.round("dist", 1).alias("dist"))


@query("SELECT oid, title, round(dist, 1) AS dist FROM v_org_dist WHERE dist <= 2500 ORDER BY dist, oid")
def top1_nearest_first(spark, d):
    return V.org_dist(spark, d).where("dist <= 2500").orderBy("dist", "oid").select("oid", "title", F.round("dist", 1).alias("dist"))


@query(f"""WITH c AS (SELECT n_nationkey AS k, 59.88 + n_nationkey * 0.003 AS lat, 30.28 + n_nationkey * 0.004 AS lon FROM nation)
 SELECT c.k, o.oid, round({HAVERSINE.format(a='c.lat', b='o.lat', c='c.lon', d='o.lon')}, 1) AS dist FROM c JOIN v_orgs o ON {HAVERSINE.format(a='c.lat', b='o.lat', c='c.lon', d='o.lon')} <= 900""")
def joi8_radius_join(spark, d):
    k = F.col("n_nationkey")
    c = V.read(spark, d, "nation").select(k.alias("k"), (59.88 + k * 0.003).alias("lat"), (30.28 + k * 0.004).alias("lon"))
    o = V.orgs(spark, d).select("oid", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return radius_join(c, o, 900).select("k", "oid", F.round("dist", 1).alias("dist"))


GRID = f"""WITH a AS (SELECT unnest(generate_series(-6, 6)) AS i), g AS (SELECT a.i, b.i AS j, 59.914403 + a.i * (500 / 111320.0::DOUBLE) AS lat,
 30.327319 + b.i * (500 / 111320.0::DOUBLE) / cos(radians(59.914403)) AS lon FROM a, a AS b),
 p AS (SELECT *, {HAVERSINE.format(a='59.914403', b='lat', c='30.327319', d='lon')} AS dist FROM g) """


@query(GRID + """, cells AS (SELECT i, j FROM p WHERE dist <= 2500), calls AS (SELECT i, j, category, count(*) AS n FROM v_sightings GROUP BY ALL)
 SELECT c.i, c.j, s.category, coalesce(n, 0) AS n FROM cells c CROSS JOIN (SELECT DISTINCT c_mktsegment AS category FROM customer) s LEFT JOIN calls ON calls.i = c.i AND calls.j = c.j AND calls.category = s.category""")
def joi7_grid_x_category(spark, d):
    cells = grid_points(spark, *V.CENTER, 2500, 500).select("i", "j")
    categories = V.read(spark, d, "customer").select(F.col("c_mktsegment").alias("category")).distinct()
    calls = V.sightings(spark, d).groupBy("i", "j", "category").agg(F.count("*").alias("n"))
    return categories.crossJoin(F.broadcast(cells)).join(calls, ["i", "j", "category"], "left").fillna(0, ["n"])  # a grid has as many rows as its radius holds


@query(GRID + ", n AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ALL) SELECT i, j, round(dist, 1) AS dist, coalesce(n, 0) AS orgs FROM p LEFT JOIN n ON nation = i + 12 WHERE dist <= 2500")
def sca24_grid_points(spark, d):
    n = V.read(spark, d, "customer").groupBy((F.col("c_nationkey") - 12).alias("i")).agg(F.count("*").alias("orgs"))
    return grid_points(spark, *V.CENTER, 2500, 500).join(n, "i", "left").select("i", "j", F.round("dist", 1).alias("dist"), F.coalesce("orgs", F.lit(0)).alias("orgs"))


TITLES = """WITH t AS (SELECT o.oid, category, dist, CASE WHEN oid % 9 = 0 THEN 'Shop ' || oid % 2 ELSE p_name END AS title FROM v_org_dist o JOIN part ON p_partkey = oid % 100 + 1),
 k AS (SELECT *, CASE WHEN title LIKE 'Shop%' THEN 'generic::' || lower(title) || '::' || category ELSE 'named::' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) END AS key FROM t),
 g AS (SELECT key, arg_min(oid, (dist, oid)) AS oid, count(*) AS size FROM k GROUP BY key) """


def _titled(spark, d):
    part = V.read(spark, d, "part").select(F.col("p_partkey"), "p_name")
    o = V.org_dist(spark, d).drop("title").withColumn("p_partkey", F.col("oid") % 100 + 1).join(part, "p_partkey")
    title = F.when(F.col("oid") % 9 == 0, F.concat(F.lit("Shop "), (F.col("oid") % 2).cast("string"))).otherwise(F.col("p_name"))
    return D.title_key(o.select("oid", title.alias("title"), "category", "dist"))


@query(TITLES + "SELECT * FROM g")
def ded3_dedup_title(spark, d):
    return D.dedup_title(_titled(spark, d))


@query(TITLES + "SELECT k.oid AS member, g.oid FROM k JOIN g ON k.key = g.key")
def ded3_title_members(spark, d):
    """Which organisation stands for which, one row a member: no list of a common title's members is made."""
    return D.title_members(_titled(spark, d))


@query(TITLES + "SELECT key, size FROM g WHERE size > 1 ORDER BY size DESC, key DESC LIMIT 10")
def ded5_duplicate_groups(spark, d):
    return D.duplicate_groups(_titled(spark, d).groupBy("key").agg(F.count("*").alias("size")), 10)


@query("""WITH f AS (SELECT oid, category, min(struct_pack(i := i, j := j, rank := rank, sid := sid)) AS s FROM v_sightings GROUP BY oid, category)
 SELECT oid, min(s).i AS i, min(s).j AS j, array_to_string(list_sort(list(DISTINCT category)), ',') AS queries FROM f GROUP BY oid""")
def ded4_merge_sightings(spark, d):
    s = V.sightings(spark, d).groupBy("oid").agg(F.min(F.struct("i", "j", "rank", "sid")).alias("s"), F.array_sort(F.collect_set("category")).alias("q"))
    return s.select("oid", "s.i", "s.j", F.array_join("q", ",").alias("queries"))


CALLS = "WITH s AS (SELECT v.*, o.dist FROM v_sightings v JOIN v_org_dist o ON v.oid = o.oid) "


def _near(spark, d):
    return V.sightings(spark, d).join(V.org_dist(spark, d).select("oid", "dist"), "oid")


@query(CALLS + """, c AS (SELECT i, j, category, min(rank) AS best FROM s GROUP BY ALL), k AS (SELECT count(*) AS calls, round(100.0::DOUBLE * count(*) FILTER (best < 20) / count(*), 4) AS ok_pct, round(100.0::DOUBLE * count(*) FILTER (best >= 20) / count(*), 4) AS err_pct FROM c)
 SELECT any_value(calls) AS calls, any_value(ok_pct) AS ok_pct, any_value(err_pct) AS err_pct, count(*) AS instances, count(DISTINCT oid) AS ids, count(DISTINCT oid) FILTER (dist <= 2500) AS inside,
 count(*) - count(DISTINCT oid) AS duplicates, count(DISTINCT oid) FILTER (dist > 2500) AS outside, round(count(*)::DOUBLE / greatest(1, count(DISTINCT oid) FILTER (dist <= 2500)), 6) AS overlap FROM s, k""")
def agg29_coverage_summary(spark, d):
    s = _near(spark, d)
    per = s.groupBy("oid").agg(F.count("*").alias("n"), F.first("dist").alias("dist"))
    inside = A.count_if(F.col("dist") <= 2500)
    n = F.sum("n")
    one = per.agg(n.alias("instances"), F.count("*").alias("ids"), inside.alias("inside"), (n - F.count("*")).alias("duplicates"), A.count_if(F.col("dist") > 2500).alias("outside"), F.round(n / F.greatest(F.lit(1), inside), 6).alias("overlap"))
    good = A.count_if(F.col("best") < 20)
    calls = s.groupBy("i", "j", "category").agg(F.min("rank").alias("best")).agg(
        F.count("*").alias("calls"), A.share(good, F.count("*"), 100.0, 4).alias("ok_pct"), A.share(F.count("*") - good, F.count("*"), 100.0, 4).alias("err_pct")
    )
    return one.crossJoin(calls)  # one row each


@query("SELECT coalesce(CASE WHEN oid % 3 = 0 THEN nullif('q' || oid % 5, 'q0') END, category, 'other') AS class, count(*) AS n FROM v_orgs GROUP BY class")
def agg30_class_counts(spark, d):
    first = F.when(F.col("oid") % 3 == 0, F.nullif(F.concat(F.lit("q"), (F.col("oid") % 5).cast("string")), F.lit("q0")))
    return V.orgs(spark, d).groupBy(F.coalesce(first, "category", F.lit("other")).alias("class")).agg(F.count("*").alias("n"))


CELLS = f"""WITH c AS (SELECT v.oid, v.rank, {HAVERSINE.format(a='o.lat', b='59.914403 + v.i * 0.005', c='o.lon', d='30.327319 + v.j * 0.01')} AS m FROM v_sightings v JOIN v_orgs o ON v.oid = o.oid),
 r AS (SELECT oid, max(m) AS r_all, max(m) FILTER (rank < 25) AS r_top FROM c GROUP BY oid) """


@query(CELLS + f"SELECT count(*) AS n, round({q('r_all', 'floor', .5)}, 1) AS p50, round({q('r_all', 'floor', .9)}, 1) AS p90, round(max(r_all), 1) AS far, count(r_top) AS n_top, round(max(r_top), 1) AS far_top FROM r")
def agg31_r_catch(spark, d):
    o = V.orgs(spark, d).select("oid", "lat", "lon")
    m = haversine_m(F.col("lat"), F.col("lon"), F.lit(V.CENTER[0]) + F.col("i") * 0.005, F.lit(V.CENTER[1]) + F.col("j") * 0.01)
    r = V.sightings(spark, d).join(o, "oid").select("oid", "rank", m.alias("m")).groupBy("oid").agg(F.max("m").alias("r_all"), F.max(F.when(F.col("rank") < 25, F.col("m"))).alias("r_top"))
    quant = exact_quantiles(r, [], "r_all", {"p50": ("floor", 0.5), "p90": ("floor", 0.9)}).select("n", F.round("p50", 1).alias("p50"), F.round("p90", 1).alias("p90"))
    return quant.crossJoin(r.agg(F.round(F.max("r_all"), 1).alias("far"), F.count("r_top").alias("n_top"), F.round(F.max("r_top"), 1).alias("far_top")))  # one row each


RECALL = """WITH k AS (SELECT unnest(generate_series(1, 7)) AS k), m AS (SELECT v.oid, v.rank, k.k FROM v_sightings v JOIN k ON (v.i % k.k) = 0 AND (v.j % k.k) = 0),
 t AS (SELECT count(DISTINCT oid) AS n FROM v_sightings) """


@query(RECALL + "SELECT k, round(100.0::DOUBLE * count(DISTINCT oid) / any_value(n), 4) AS recall, round(100.0::DOUBLE * count(DISTINCT oid) FILTER (rank < 25) / any_value(n), 4) AS recall_top FROM m, t GROUP BY k")
def agg32_recall_by_step(spark, d):
    s = V.sightings(spark, d)
    total = s.agg(F.countDistinct("oid").alias("n"))
    per = cell_match(s, list(range(1, 8))).groupBy("k", "oid").agg(F.min("rank").alias("best"))
    found = per.groupBy("k").agg(F.count("*").alias("a"), A.count_if(F.col("best") < 25).alias("b"))
    return found.crossJoin(total).select(F.col("k").cast("long").alias("k"), F.round(100.0 * F.col("a") / F.col("n"), 4).alias("recall"), F.round(100.0 * F.col("b") / F.col("n"), 4).alias("recall_top"))  # seven rows


@query(RECALL + "SELECT k, oid, count(*) AS n FROM m GROUP BY k, oid")
def joi9_sublattice_match(spark, d):
    return cell_match(V.sightings(spark, d), list(range(1, 8))).groupBy(F.col("k").cast("long").alias("k"), "oid").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT category, i, j, count(*) AS n FROM v_sightings GROUP BY ALL) SELECT category, round(avg(n), 6) AS mean, max(n) AS top, max(n) >= 30 AS ceiling FROM n GROUP BY category""")
def agg33_category_ceiling(spark, d):
    n = V.sightings(spark, d).groupBy("category", "i", "j").agg(F.count("*").alias("n"))
    return n.groupBy("category").agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("top"), (F.max("n") >= 30).alias("ceiling"))


BATCHES = CALLS + """, f AS (SELECT oid, category, min(sid) AS first FROM s GROUP BY oid, category), r AS (SELECT s.*, s.sid = f.first AS is_new, s.sid // 1000 AS batch FROM s JOIN f ON s.oid = f.oid AND s.category = f.category),
 b AS (SELECT category, batch, count(*) AS total, count(*) FILTER (dist <= 2500) AS inside, count(*) FILTER (is_new) AS n_new, count(*) FILTER (rank < 25) AS ok, round(avg(dist), 3) AS mean_dist FROM r GROUP BY category, batch) """


def _batches(spark, d):
    s = _near(spark, d)
    first = s.groupBy("oid", "category").agg(F.min("sid").alias("first"))
    r = s.join(first, ["oid", "category"]).withColumn("batch", F.floor(F.col("sid") / 1000))
    return r.groupBy("category", "batch").agg(
        F.count("*").alias("total"), A.count_if(F.col("dist") <= 2500).alias("inside"), A.count_if(F.col("sid") == F.col("first")).alias("n_new"), A.count_if(F.col("rank") < 25).alias("ok"), F.round(F.avg("dist"), 3).alias("mean_dist")
    )


@query(BATCHES + "SELECT * FROM b")
def win9_batch_density(spark, d):
    return _batches(spark, d)


@query(BATCHES + """, n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY batch) AS up, row_number() OVER (PARTITION BY category ORDER BY batch DESC) AS down FROM b)
 SELECT category, round(avg(n_new) FILTER (up <= 100), 6) AS first_new, round(avg(n_new) FILTER (down <= 100), 6) AS last_new, max(batch) FILTER (ok > 0) AS last_ok FROM n GROUP BY category""")
def win9_batch_ends(spark, d):
    """New ids of the first and the last 100 batches in the mean, and the last batch with a good call."""
    w = Window.partitionBy("category")
    n = _batches(spark, d).withColumns({"up": F.row_number().over(w.orderBy("batch")), "down": F.row_number().over(w.orderBy(F.desc("batch")))})
    mean = lambda c: F.round(F.avg(F.when(c <= 100, F.col("n_new"))), 6)
    return n.groupBy("category").agg(mean(F.col("up")).alias("first_new"), mean(F.col("down")).alias("last_new"), F.max(F.when(F.col("ok") > 0, F.col("batch"))).alias("last_ok"))


@query(BATCHES + "SELECT category, batch, CAST(sum(n_new) OVER (PARTITION BY category ORDER BY batch) AS BIGINT) AS uniq FROM b")
def win10_cumulative_unique(spark, d):
    return running(_batches(spark, d), "category", "batch", F.col("n_new"), "uniq").select("category", "batch", "uniq")


#: Categories of organisations, dealt by oid, on which the classification is tried.
SAMPLES = [
    "Юридические услуги", "Банк", "Аптека и магазин", "Салон красоты", "Автосервис", "Фитнес-клуб", "Агентство недвижимости", "Типография", "Школа", "Ремонт обуви",
    "Кафе-пекарня", "Супермаркет", "Разработка ПО", "Web-студия", "Музей", "Склад",
]
CATS = f"(SELECT oid, lower(({SAMPLES})[oid % {len(SAMPLES)} + 1] || ' ' || category) AS cats FROM v_orgs)"
TYPE_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(cats, '{w}')" for w in words) + f" THEN '{name}'" for name, words in L.ARCHETYPES) + " ELSE 'other' END"


def _categories():
    return F.array(F.element_at(F.array(*[F.lit(x) for x in SAMPLES]), (F.col("oid") % len(SAMPLES) + 1).cast("int")), F.col("category"))


@query(f"SELECT oid, {TYPE_SQL} AS archetype FROM {CATS}")
def flt5_classify_archetype(spark, d):
    return V.orgs(spark, d).select("oid", L.archetype(_categories()).alias("archetype"))


@query(f"SELECT oid, {' OR '.join(f"contains(cats, '{h}')" for h in L.TECH_HINTS)} AS tech, {TYPE_SQL} IN ({', '.join(f"'{x}'" for x in L.LEGAL_ARCHETYPES)}) AS legal FROM {CATS}")
def flt6_classify_tech(spark, d):
    return V.orgs(spark, d).select("oid", L.is_tech(_categories()).alias("tech"), L.wants_legal(L.archetype(_categories())).alias("legal"))


@query("""SELECT oid, CASE WHEN b >= 3 OR title LIKE '%77%' THEN 'chain' WHEN b = 2 OR title LIKE '%88%' THEN 'mid' ELSE 'micro' END AS size FROM
 (SELECT *, CASE WHEN coalesce(nation % 5, 0) = 0 THEN 1 ELSE nation % 5 END AS b FROM v_orgs)""")
def flt7_classify_size(spark, d):
    return V.orgs(spark, d).select("oid", L.size_class(F.col("nation") % 5, F.col("title"), ["77"], ["88"]).alias("size"))


TAGGED = r"""WITH t AS (SELECT oid, category, coalesce('regex:atm:' || nullif(regexp_extract(lower(title), '0000[1-4][0-9]*'), ''), 'regex:stop:' || nullif(regexp_extract(lower(title), '[0-9]*77$'), '')) AS tag FROM v_orgs) """
PATTERNS = [("atm", "0000[1-4][0-9]*"), ("stop", "[0-9]*77$")]


@query(TAGGED + "SELECT oid, tag, tag IS NOT NULL AS dropped FROM t")
def flt3_tag_patterns(spark, d):
    return V.orgs(spark, d).select("oid", L.tag_patterns(F.lower("title"), PATTERNS).alias("tag")).withColumn("dropped", F.col("tag").isNotNull())


@query(TAGGED + "SELECT CASE WHEN tag IS NULL THEN 'keep' ELSE 'drop' END AS decision, category, count(*) AS n FROM t GROUP BY ALL")
def flt4_split_keep_drop(spark, d):
    tag = L.tag_patterns(F.lower("title"), PATTERNS)
    return V.orgs(spark, d).groupBy(F.when(tag.isNull(), "keep").otherwise("drop").alias("decision"), "category").agg(F.count("*").alias("n"))


@query("SELECT oid FROM v_orgs WHERE title IS NOT NULL AND title <> '' AND (oid % 3 = 0 OR nation > 10)")
def flt14_is_business_item(spark, d):
    perma = F.when(F.col("oid") % 3 == 0, F.col("oid"))
    seo = F.when(F.col("nation") > 10, F.col("title"))
    return V.orgs(spark, d).where(F.coalesce(perma.cast("string"), seo).isNotNull() & (F.col("title") != "")).select("oid")


@query("""SELECT o.oid, CASE WHEN o.nation = 7 THEN 'ignored' WHEN c.oid IS NOT NULL THEN 'skipped' WHEN coalesce(o.nation, 0) < 5 THEN 'low_count' ELSE 'todo' END AS route
 FROM v_orgs o LEFT JOIN (SELECT DISTINCT o_custkey AS oid FROM orders WHERE o_orderkey % 40 = 0) c ON c.oid = o.oid""")
def flt21_review_todo(spark, d):
    cached = V.read(spark, d, "orders").where("o_orderkey % 40 = 0").select(F.col("o_custkey").alias("oid")).distinct().withColumn("cached", F.lit(True))
    route = L.first_rule([("ignored", F.col("nation") == 7), ("skipped", F.col("cached").isNotNull()), ("low_count", F.coalesce("nation", F.lit(0)) < 5)], "todo")
    return V.orgs(spark, d).join(cached, "oid", "left").select("oid", route.alias("route"))
