"""Research-artefact queries: fill rates, paired arms, decisions, nested records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import nested as N
from millrace.functions.quantiles import MIDDLE, exact_quantiles, of_array, true_median, with_median
from millrace.functions.text import WHITE, first_word
from millrace.operators import aggregates as A
from millrace.operators import filters as L
from millrace.operators import joins as J
from millrace.plans import views as V
from millrace.plans.catalog import q
from millrace.plans.registry import query
from millrace.sources.normalise import SOURCES, normalise, selected

FIELDS = ["emails", "phones", "links"]


@query("".join(f"{' UNION ALL ' if i else ''}SELECT '{f}' AS field, round_even(avg(({f} > 0)::INT) * 100, 1) AS rate FROM v_cards" for i, f in enumerate(FIELDS)))
def agg12_fill_rate(spark, d):
    return A.fill_rate(V.cards(spark, d), FIELDS)


#: Platforms that links are told apart by, as patterns.
PLATFORMS = {"org": r"https?://[^ \n/]*\.org\b", "com": r"https?://[^ \n/]*\.com\b", "telegram": r"https?://t\.me/"}


@query("""WITH p AS (SELECT *, """ + ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}')) AS on_{n}" for n, p in PLATFORMS.items()) + """ FROM v_cards)
 SELECT zone, count(*) FILTER (emails > 0) AS with_email, count(*) FILTER (phones > 0) AS with_phone, count(*) FILTER (phones > 0 AND emails = 0) AS only_phone,
 count(*) FILTER (links > 0) AS with_link, count(*) FILTER (emails + phones + links = 0) AS no_contact, CAST(sum(links) AS BIGINT) AS links, """
 + ", ".join(f"CAST(sum(on_{n}) AS BIGINT) AS on_{n}" for n in PLATFORMS) + " FROM p GROUP BY zone")
def agg13_contact_mix(spark, d):
    e, p, k = F.col("emails"), F.col("phones"), F.col("links")
    on = [F.sum(F.coalesce(F.regexp_count("text", F.lit(x)), F.lit(0)).cast("long")).alias(f"on_{n}") for n, x in PLATFORMS.items()]
    return V.cards(spark, d).groupBy("zone").agg(
        A.count_if(e > 0).alias("with_email"), A.count_if(p > 0).alias("with_phone"), A.count_if((p > 0) & (e == 0)).alias("only_phone"), A.count_if(k > 0).alias("with_link"),
        A.count_if(e + p + k == 0).alias("no_contact"), F.sum("links").alias("links"), *on,
    )


@query("""SELECT zone, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (emails > 0) / count(*), 4) AS email_rate, round_even(avg(n_chars), 1) AS mean, round_even(median(n_chars), 1) AS median, min(n_chars) AS low, max(n_chars) AS high
 FROM v_cards WHERE zone IS NOT NULL GROUP BY zone""")
def agg14_by_zone(spark, d):
    c = V.cards(spark, d).where("zone IS NOT NULL")
    base = c.groupBy("zone").agg(
        F.count("*").alias("n"), A.share(A.count_if(F.col("emails") > 0), F.count("*"), 100.0, 4).alias("email_rate"), F.bround(F.avg("n_chars"), 1).alias("mean"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high")
    )
    return base.join(true_median(c, ["zone"], "n_chars", "median", 1, half_even=True), "zone", "left")


@query(r"""WITH t AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}]{5,}'))) AS tag, n_chars FROM v_cards),
 c AS (SELECT tag, count(*) AS n, count(*) FILTER ((n_chars + len(tag)) % 3 = 2) AS severe FROM t GROUP BY tag)
 SELECT tag, n, severe, row_number() OVER (ORDER BY n DESC, tag) AS rank FROM c QUALIFY rank <= 25""")
def agg15_tag_tally(spark, d):
    """Tags of nested records (tag, severity): how often each occurs, and how often with the highest severity."""
    tags = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{5,}"), F.lit(0)))
    level = F.element_at(F.array(F.lit("low"), F.lit("mid"), F.lit("high")), ((F.col("n_chars") + F.char_length("x")) % 3 + 1).cast("int"))
    records = V.cards(spark, d).select("n_chars", F.explode(tags).alias("x")).select(F.struct(F.col("x").alias("tag"), level.alias("severity")).alias("r"))
    counts = records.groupBy("r.tag").agg(F.count("*").alias("n"), A.count_if(F.col("r.severity") == "high").alias("severe"))
    top = counts.orderBy(F.desc("n"), "tag").limit(25)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "tag")).cast("long"))


@query("SELECT coalesce(zone, '?') AS zone, CASE WHEN score IS NULL THEN 'none' WHEN score > 0 THEN 'good' ELSE 'bad' END AS overall, count(*) AS n FROM v_cards GROUP BY ALL")
def agg16_overall_by_zone(spark, d):
    verdict = F.when(F.col("score").isNull(), "none").when(F.col("score") > 0, "good").otherwise("bad")
    return V.cards(spark, d).groupBy(F.coalesce("zone", F.lit("?")).alias("zone"), verdict.alias("overall")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT oid, zone, CASE oid % 6 WHEN 0 THEN ' TRUE' WHEN 1 THEN '1' WHEN 2 THEN 'yes ' WHEN 3 THEN 'Да' WHEN 4 THEN 'no' END AS flag FROM v_cards)
 SELECT zone, count(*) AS n, min(oid) AS first_oid FROM f WHERE lower(trim(flag)) IN ('true', '1', 'yes', 'да') GROUP BY zone""")
def agg17_flag_lists(spark, d):
    k = F.col("oid") % 6
    flag = F.when(k == 0, " TRUE").when(k == 1, "1").when(k == 2, "yes ").when(k == 3, "Да").when(k == 4, "no")
    loose = F.lower(F.trim(flag)).isin("true", "1", "yes", "да")
    return V.cards(spark, d).where(loose).groupBy("zone").agg(F.count("*").alias("n"), F.min("oid").alias("first_oid"))


@query("SELECT CASE oid % 3 WHEN 0 THEN 'multi_branch' WHEN 1 THEN 'is_government' ELSE 'is_chain_or_brand' END AS flag, oid, zone FROM v_cards WHERE oid % 3 < 2 OR oid % 4 = 0")
def agg17_flagged(spark, d):
    """The lists themselves, as rows: which card is on which flag's list."""
    k = F.col("oid")
    told = V.cards(spark, d).select("oid", "zone", F.when(k % 3 == 0, " Yes").alias("multi_branch"), F.when(k % 3 == 1, "1").otherwise("0").alias("is_government"), F.when((k % 3 == 2) & (k % 4 == 0), "да").otherwise("no").alias("is_chain_or_brand"))
    return A.flagged(told, ["multi_branch", "is_government", "is_chain_or_brand"], ["oid", "zone"])


ASSESSED = "CASE oid % 7 WHEN 0 THEN NULL WHEN 1 THEN 'High-risk, see notes' WHEN 2 THEN '  ' || text ELSE text END"


@query(rf"""WITH a AS (SELECT coalesce(nullif({ASSESSED}, ''), '?') AS t FROM v_cards), w AS (SELECT regexp_extract(t, '^{WHITE}*([^{WHITE[1:]}+)', 1) AS w FROM a)
 SELECT lower(regexp_replace(CASE WHEN w = '' THEN '?' ELSE w END, '^[ ,.;—-]+|[ ,.;—-]+$', '', 'g')) AS word, count(*) AS n FROM w GROUP BY 1""")
def agg18_first_word_tally(spark, d):
    k = F.col("oid") % 7
    told = F.when(k == 0, F.lit(None)).when(k == 1, "High-risk, see notes").when(k == 2, F.concat(F.lit("  "), "text")).otherwise(F.col("text"))
    return V.cards(spark, d).groupBy(first_word(told).alias("word")).agg(F.count("*").alias("n"))


PAIRS = "WITH p AS (SELECT a.key, a.m1 AS m1_a, b.m1 AS m1_b, a.m2 AS m2_a, b.m2 AS m2_b, a.m3 AS m3_a, b.m3 AS m3_b FROM v_arms a JOIN v_arms b ON a.key = b.key AND a.arm = 'A' AND b.arm = 'R') "
METRICS = ["m1", "m2", "m3"]


def _pairs(spark, d):
    arms = V.arms(spark, d)
    return J.pair_arms(arms.where("arm = 'A'").drop("arm"), arms.where("arm = 'R'").drop("arm"), "key")


@query(PAIRS + "SELECT * FROM p")
def joi1_pair_arms(spark, d):
    return _pairs(spark, d)


@query(PAIRS + " UNION ALL ".join(f"""SELECT '{m}' AS field, CAST(sum({m}_a) AS BIGINT) AS sum_a, CAST(sum({m}_b) AS BIGINT) AS sum_b, count(*) FILTER ({m}_b > {m}_a) AS b_more,
 count(*) FILTER ({m}_b < {m}_a) AS b_less, count(*) FILTER ({m}_a = {m}_b) AS ties FROM p""" for m in METRICS))
def agg23_paired_wins(spark, d):
    return J.paired_wins(_pairs(spark, d), METRICS)


RICH = PAIRS + """, r AS (SELECT key, list_filter([CASE WHEN m1_b > m1_a THEN 'm1' END, CASE WHEN m2_b > m2_a THEN 'm2' END, CASE WHEN m3_b > m3_a THEN 'm3' END], lambda x: x IS NOT NULL) AS up,
 list_filter([CASE WHEN m1_b < m1_a THEN 'm1' END, CASE WHEN m2_b < m2_a THEN 'm2' END, CASE WHEN m3_b < m3_a THEN 'm3' END], lambda x: x IS NOT NULL) AS down FROM p),
 v AS (SELECT key, array_to_string(up, ',') AS better, array_to_string(down, ',') AS worse,
 CASE WHEN len(up) > 0 AND len(down) = 0 THEN 'better' WHEN len(down) > 0 AND len(up) = 0 THEN 'worse' WHEN len(up) = 0 THEN 'same' ELSE 'mixed' END AS verdict FROM r) """


@query(RICH + "SELECT * FROM v")
def joi3_compare_versions(spark, d):
    return J.richness(_pairs(spark, d), METRICS).select("key", "better", "worse", "verdict")


@query(RICH + ", t AS (SELECT v.verdict, p.* FROM v JOIN p ON v.key = p.key) SELECT verdict, count(*) AS n, " + ", ".join(f"CAST(sum({m}_{x}) AS BIGINT) AS {m}_{x}" for m in METRICS for x in "ab") + " FROM t GROUP BY verdict")
def agg24_richness_verdict(spark, d):
    totals = [F.sum(f"{m}_{x}").alias(f"{m}_{x}") for m in METRICS for x in "ab"]
    return J.richness(_pairs(spark, d), METRICS).groupBy("verdict").agg(F.count("*").alias("n"), *totals)


@query("""WITH p AS (SELECT p_partkey AS key, p_size FROM part), c AS (SELECT l_partkey AS key, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45 GROUP BY 1)
 SELECT p.key, p_size AS size, coalesce(n, 0) AS n FROM p LEFT JOIN c ON p.key = c.key""")
def joi2_attach_context(spark, d):
    c = V.read(spark, d, "lineitem").where("l_returnflag = 'A' AND l_quantity > 45").groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").alias("n"))
    p = V.read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size"))
    return J.attach(p, c, "key", {"n": 0})


RETENTION = """WITH u AS (SELECT key, m2 * 10 AS old_words, m1 % 60 AS new_words, m1 * 1000 AS old_b, m3 * 100 AS new_b, key % 20 AS org FROM v_arms WHERE arm = 'A' AND key % 9 > 0) """


def _retention(spark, d):
    u = V.arms(spark, d).where("arm = 'A' AND key % 9 <> 0")
    return u.select("key", (F.col("m2") * 10).alias("old"), (F.col("m1") % 60).alias("new"), (F.col("m1") * 1000).alias("old_b"), (F.col("m3") * 100).alias("new_b"), (F.col("key") % 20).alias("org"))


@query(RETENTION + """SELECT org, count(*) FILTER (old_words >= 40 AND new_words >= 40) AS retained, count(*) FILTER (old_words >= 40 AND new_words < 40) AS regressed, round(sum(old_b) / 1e6::DOUBLE, 6) AS old_mb,
 round(sum(new_b) / 1e6::DOUBLE, 6) AS new_mb, round(sum(old_b)::DOUBLE / nullif(sum(new_b), 0), 6) AS factor FROM u GROUP BY org""")
def agg26_content_retention(spark, d):
    old, new = F.col("old"), F.col("new")
    return _retention(spark, d).groupBy("org").agg(
        A.count_if((old >= 40) & (new >= 40)).alias("retained"), A.count_if((old >= 40) & (new < 40)).alias("regressed"), F.round(F.sum("old_b") / 1e6, 6).alias("old_mb"), F.round(F.sum("new_b") / 1e6, 6).alias("new_mb"),
        F.round(F.sum("old_b") / F.nullif(F.sum("new_b"), F.lit(0)), 6).alias("factor"),
    )


@query(RETENTION + "SELECT org, 'http://p/' || key AS url, old_words, new_words FROM u WHERE old_words >= 40 AND new_words < 40")
def agg26_regressed_urls(spark, d):
    """The pages that lost their text, one row each."""
    r = _retention(spark, d).where("old >= 40 AND new < 40")
    return r.select("org", F.concat(F.lit("http://p/"), F.col("key").cast("string")).alias("url"), F.col("old").alias("old_words"), F.col("new").alias("new_words"))


@query("SELECT c.oid, c.zone, CASE WHEN l.quality IS NULL THEN 'error' WHEN l.quality = 1 THEN 'keep' ELSE 'drop' END AS decision FROM v_cards c LEFT JOIN labels l ON l.doc_id = c.oid")
def joi4_apply_decisions(spark, d):
    dec = V.read(spark, d, "labels").select(F.col("doc_id").alias("oid"), F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("decision"))
    return J.attach(V.cards(spark, d).select("oid", "zone"), dec, "oid", {"decision": "error"})


STITCH = """WITH l AS (SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders WHERE o_orderkey % 3 > 0), e AS (SELECT o_orderkey AS id, o_orderpriority AS title FROM orders WHERE o_orderkey % 4 > 0),
 s AS (SELECT o_orderkey AS id, CAST(round(o_totalprice) AS BIGINT) AS salary FROM orders WHERE o_orderkey % 5 = 0) """


@query(STITCH + "SELECT coalesce(l.id, e.id) AS id, pos, title, salary, pos IS NOT NULL AS listed FROM l FULL JOIN e ON l.id = e.id LEFT JOIN s ON s.id = coalesce(l.id, e.id)")
def joi6_stitch_entities(spark, d):
    o = V.read(spark, d, "orders")
    k = F.col("o_orderkey").alias("id")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("pos")
    return J.stitch(o.where("o_orderkey % 3 > 0").select(k, pos), o.where("o_orderkey % 4 > 0").select(k, F.col("o_orderpriority").alias("title")), o.where("o_orderkey % 5 = 0").select(k, F.round("o_totalprice").cast("long").alias("salary")))


@query("SELECT o_custkey AS id, 0 AS extra FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1 UNION ALL SELECT DISTINCT o_custkey, 1 FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def set4_leftover_append(spark, d):
    o = V.read(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    return J.leftover_append(o.where("o_orderkey % 3 = 0").select("id").distinct(), o, "id")


def _reviews(undated: str):
    sql = "coalesce(ts >= 1738540800 - 24 * 30.4 * 86400, true)" if undated == "keep" else "ts >= 1738540800 - 24 * 30.4 * 86400"
    view = "(SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 > 0 THEN epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 1000000 + 852076800 END AS ts FROM orders)"

    def run(spark, d):
        ts = F.when(F.col("o_orderkey") % 7 > 0, F.floor(V.micros(F.col("o_orderdate").cast("timestamp_ntz")) / 1000000) + 852076800)
        recent = ts >= 1738540800 - 24 * 30.4 * 86400
        return V.read(spark, d, "orders").where(F.coalesce(recent, F.lit(undated == "keep"))).select(F.col("o_orderkey").alias("id"))

    run.__name__ = f"flt15_reviews_since_{undated}"
    query(f"SELECT id FROM {view} WHERE {sql}")(run)


_reviews("keep")
_reviews("drop")


@query("""SELECT oid, score FROM v_cards WHERE contains(lower(coalesce(text, '')), 'th') AND (score IS NULL OR score < 1 OR toxic = 1 OR oid % 10 = 0)""")
def flt16_review_queue(spark, d):
    need = F.col("score").isNull() | (F.col("score") < 1) | F.coalesce(F.col("toxic") == 1, F.lit(False)) | (F.col("oid") % 10 == 0)
    return L.review_queue(V.cards(spark, d), need, F.col("text"), "Th", "score").select("oid", "score")


@query("SELECT oid FROM v_cards WHERE oid NOT IN (SELECT doc_id FROM labels)")
def flt17_exclude_done(spark, d):
    return L.exclude_done(V.cards(spark, d).select("oid"), V.read(spark, d, "labels").select(F.col("doc_id").alias("oid")), "oid")


@query("SELECT oid, text IS NOT NULL AND trim(text) <> '' AND NOT starts_with(trim(lower(text)), 'the ') AND NOT starts_with(trim(lower(text)), 'le ') AS filled FROM v_cards")
def flt18_is_filled(spark, d):
    return V.cards(spark, d).select("oid", L.is_filled(F.col("text"), ["the ", "le "]).alias("filled"))


@query("SELECT oid FROM v_cards ORDER BY oid LIMIT 50 OFFSET 25")
def flt19_slice_batch(spark, d):
    return L.slice_batch(V.cards(spark, d).select("oid"), "oid", 25, 50)


@query("""SELECT count(*) AS total, count(*) FILTER (score IS NULL) AS fresh, count(*) FILTER (score = 0) AS flagged, count(*) FILTER (score = 1) AS passed,
 count(*) FILTER (score IS NULL OR score < 1 OR toxic = 1) AS need_review FROM v_cards""")
def agg45_status_counts(spark, d):
    s = F.col("score")
    return V.cards(spark, d).agg(F.count("*").alias("total"), A.count_if(s.isNull()).alias("fresh"), A.count_if(s == 0).alias("flagged"), A.count_if(s == 1).alias("passed"), A.count_if(s.isNull() | (s < 1) | (F.col("toxic") == 1)).alias("need_review"))


@query("SELECT zone, " + ", ".join(f"count(*) FILTER ({f} > 0) || '/' || count(*) AS {f}" for f in FIELDS) + " FROM v_cards GROUP BY zone")
def agg42_field_coverage(spark, d):
    return V.cards(spark, d).groupBy("zone").agg(*[F.concat(A.count_if(F.col(f) > 0).cast("string"), F.lit("/"), F.count("*").cast("string")).alias(f) for f in FIELDS])


@query("SELECT o_custkey AS g, count(*) AS n, max(o_orderkey) AS last_id FROM orders WHERE o_custkey % 3 > 0 GROUP BY 1")
def sca25_first_array(spark, d):
    o = V.read(spark, d, "orders").where("o_custkey % 3 > 0").groupBy(F.col("o_custkey").alias("g")).agg(F.to_json(F.collect_list(F.struct(F.col("o_orderkey").alias("id")))).alias("a"))
    path = F.when(F.col("g") % 3 == 1, F.concat(F.lit('{"data":{"items":'), "a", F.lit("}}"))).otherwise(F.concat(F.lit('{"data":null,"items":'), "a", F.lit("}")))
    return o.select("g", F.explode(N.first_array(path, ["$.data.items", "$.items"], "struct<id:long>")).alias("r")).groupBy("g").agg(F.count("*").alias("n"), F.max("r.id").alias("last_id"))


@query("""SELECT CAST(oid AS VARCHAR) AS oid, CASE WHEN oid % 4 = 0 THEN 's' || oid ELSE title END AS title, lat, lon, CASE WHEN oid % 3 = 0 THEN nation::DOUBLE ELSE 1.5::DOUBLE END AS rating,
 CASE WHEN oid % 5 = 0 THEN 'http://site' || oid ELSE 'http://link' || oid END AS site FROM v_orgs WHERE oid % 6 <> 5""")
def sca26_org_from_raw(spark, d):
    k, s = F.col("oid"), F.col("oid").cast("string")
    raw = F.to_json(
        F.struct(
            F.when(k % 6 < 3, s).alias("id"), F.when((k % 6 >= 3) & (k % 6 < 5), s).alias("permalink"), F.when(k % 4 == 0, "").otherwise(F.col("title")).alias("title"),
            F.concat(F.lit("s"), s).alias("seoname"), F.array("lon", "lat").alias("coordinates"), F.when(k % 3 == 0, F.struct(F.col("nation").cast("double").alias("ratingValue"))).alias("ratingData"),
            F.lit(1.5).alias("rating"), F.when(k % 5 == 0, F.concat(F.lit("http://site"), s)).alias("site"), F.array(F.struct(F.concat(F.lit("http://link"), s).alias("href"))).alias("links"),
        )
    )
    return V.orgs(spark, d).select(N.org_from_raw(raw).alias("o")).select("o.*").where("oid IS NOT NULL")


@query("SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS id, CAST(l_linenumber AS BIGINT) AS rating, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE '' END AS text, CAST(CASE WHEN l_linenumber % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS translations FROM lineitem")
def sca27_review_from_raw(spark, d):
    n = F.col("l_linenumber")
    raw = F.to_json(
        F.struct(
            (F.col("l_orderkey") * 10 + n).cast("string").alias("reviewId"), n.alias("rating"), F.when(n % 2 == 0, F.col("l_returnflag")).alias("text"),
            F.when(n % 3 == 0, F.create_map(F.lit("en"), F.lit("a"), F.lit("de"), F.lit("b"))).alias("textTranslations"),
        )
    )
    return V.read(spark, d, "lineitem").select(N.review_from_raw(raw).alias("r")).select("r.id", "r.rating", "r.text", "r.translations")


@query("SELECT page_id, CAST(CASE WHEN page_id % 4 IN (1, 2) THEN 1 ELSE 0 END + 1 AS BIGINT) AS n, len(url) AS note FROM pages")
def sca28_sanitize_sources(spark, d):
    k = F.col("page_id") % 4
    bad = F.when(k == 0, "ftp://a.b/c").when(k == 3, "http://localhost/x").otherwise("https://a.example/y")
    s = N.sanitize_sources(F.array(F.struct(F.col("url").alias("url"), F.col("url").alias("note")), F.struct(bad.alias("url"), F.lit("n").alias("note"))))
    return V.read(spark, d, "pages").select("page_id", F.size(s).cast("long").alias("n"), F.char_length(F.get(s, F.lit(0))["note"]).cast("long").alias("note"))


@query("""SELECT o_custkey AS oid, count(*) AS vacancies, CAST(sum(o_orderkey % 4) AS BIGINT) AS links, count(*) FILTER (o_orderkey % 9 > 0) AS filled,
 regexp_matches(CAST(o_custkey * 7654321 AS VARCHAR), '^([0-9]{10}|[0-9]{12})$') AS tax_ok FROM orders GROUP BY o_custkey""")
def sca29_card_field_sizes(spark, d):
    o = V.read(spark, d, "orders")
    social = F.map_from_entries(F.collect_list(F.struct(F.col("o_orderkey").cast("string"), F.sequence(F.lit(0), F.col("o_orderkey") % 4))))
    cards = o.groupBy(F.col("o_custkey").alias("oid")).agg(social.alias("social"), F.collect_list(F.nullif(F.col("o_orderkey") % 9, F.lit(0))).alias("ym"), F.collect_list("o_orderkey").alias("vac"))
    links = F.aggregate(F.transform(F.map_values("social"), lambda x: F.size(x) - 1), F.lit(0), lambda a, x: a + x)
    tax = F.regexp_like((F.col("oid") * 7654321).cast("string"), F.lit("^([0-9]{10}|[0-9]{12})$"))
    return cards.select("oid", F.size("vac").cast("long").alias("vacancies"), links.cast("long").alias("links"), F.size("ym").cast("long").alias("filled"), tax.alias("tax_ok"))


@query("""WITH r AS (SELECT conv_id AS oid, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
 SELECT oid, array_to_string(list_transform(list_filter(t[1:4], lambda x: x IS NOT NULL AND trim(x) <> ''), lambda x: substr(x, 1, 300))[1:2], '|') AS snippets FROM r""")
def sca30_review_snippets(spark, d):
    w = V.read(spark, d, "conversations").groupBy(F.col("conv_id").alias("oid")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return w.select("oid", F.array_join(N.review_snippets(F.col("t.text"), 2), "|").alias("snippets"))


@query("""SELECT oid, 'name: ' || CASE WHEN oid % 3 = 0 THEN 's' || oid ELSE title END || chr(10) || 'address: ' || CASE WHEN oid % 4 = 0 THEN '—' WHEN oid % 4 = 1 THEN 'a ' || nation ELSE 'full ' || nation END || chr(10)
 || 'categories: ' || CASE WHEN oid % 8 = 0 THEN '—' ELSE array_to_string(list_transform(range(least(oid % 8, 5)), lambda i: CASE WHEN i = 1 THEN '?' ELSE category || i END), ', ') END || chr(10) || 'site: ' || CASE WHEN oid % 2 = 0 THEN 'http://x/' || oid ELSE '—' END || chr(10)
 || 'yandex_rating: ' || CASE WHEN oid % 5 = 0 THEN '—' ELSE '4.5' END || ' (' || CASE WHEN oid % 7 = 0 THEN 0 ELSE oid END || ' reviews)' AS brief FROM v_orgs""")
def sca31_org_brief(spark, d):
    """Raw organisations with up to seven categories, one of them without a name, and missing names, addresses, sites and ratings."""
    k, s = F.col("oid"), F.col("oid").cast("string")
    name = lambda i: F.struct(F.when(i != 1, F.concat("category", i.cast("string"))).alias("name"))
    raw = F.to_json(
        F.struct(
            F.when(k % 3 == 0, "").otherwise(F.col("title")).alias("title"), F.concat(F.lit("s"), s).alias("seoname"), F.when(k % 8 > 0, F.transform(F.sequence(F.lit(0), k % 8 - 1), name)).alias("categories"),
            F.when(k % 4 > 1, F.concat(F.lit("full "), "nation")).alias("fullAddress"), F.when(k % 4 > 0, F.concat(F.lit("a "), "nation")).alias("address"),
            F.when(k % 2 == 0, F.concat(F.lit("http://x/"), s)).alias("site"), F.when(k % 5 > 0, 4.5).alias("rating"), F.when(k % 7 > 0, k).alias("reviewsCount"),
        ),
    )
    return V.orgs(spark, d).select("oid", N.org_brief(raw).alias("brief"))


@query("""SELECT oid, CASE WHEN oid % 6 = 0 THEN NULL ELSE title END AS title, CASE WHEN oid % 6 = 0 OR oid % 3 = 0 THEN NULL ELSE category END AS description, CASE WHEN oid % 6 = 0 THEN NULL WHEN oid % 2 = 0 THEN 'http://t.me/' || oid ELSE '' END AS socials,
 CASE WHEN oid % 6 = 0 THEN NULL ELSE '+7' || oid END AS phones, CASE WHEN oid % 6 > 0 AND oid % 4 = 0 THEN 'daily' END AS hours, CASE WHEN oid % 6 > 0 AND oid % 5 > 0 THEN nation / 10.0::DOUBLE END AS rating, CASE WHEN oid % 6 > 0 AND oid % 5 > 0 THEN oid END AS reviews_count FROM v_orgs""")
def sca27_card_from_raw(spark, d):
    """Card items with empty links and numbers, without hours or ratings; every sixth is no object."""
    k, s = F.col("oid"), F.col("oid").cast("string")
    href = F.when(k % 2 == 0, F.concat(F.lit("http://t.me/"), s))
    item = F.to_json(
        F.struct(
            "title", F.when(k % 3 == 0, "").otherwise(F.col("category")).alias("description"), F.array(F.struct(F.lit("").alias("href")), F.struct(href.alias("href"))).alias("socialLinks"),
            F.array(F.struct(F.concat(F.lit("+7"), s).alias("number")), F.struct(F.lit("").alias("number"))).alias("phones"), F.when(k % 4 == 0, F.struct(F.lit("daily").alias("text"))).alias("workingTime"),
            F.when(k % 5 > 0, F.struct((F.col("nation") / 10.0).alias("ratingValue"), k.alias("reviewCount"))).alias("ratingData"),
        ),
    )
    c = V.orgs(spark, d).select("oid", N.card_from_raw(F.when(k % 6 == 0, "[]").otherwise(item)).alias("c")).select("oid", "c.*")
    return c.withColumns({"socials": F.array_join("socials", ","), "phones": F.array_join("phones", ",")})


@query(f"SELECT event_type AS name, count(*) AS n, {q('value', 'rint', .5)} AS q_rint, {q('value', 'floor', .5)} AS q_floor, {q('value', 'mid', .5)} AS q_mid, median(value) AS q_true FROM events GROUP BY event_type")
def udf3_quantile_rules(spark, d):
    e = V.read(spark, d, "events").select(F.col("event_type").alias("name"), "value")
    quant = exact_quantiles(e, ["name"], "value", {"q_rint": ("rint", 0.5), "q_floor": ("floor", 0.5), "q_mid": ("mid", 0.5), **MIDDLE})
    return with_median(quant, "q_true")


@query(f"SELECT user_id AS worker, {q('value', 'rint', .9)} AS q_rint, {q('value', 'mid', .5)} AS q_mid FROM events WHERE event_type = 'error' GROUP BY user_id")
def udf3_quantile_arrays(spark, d):
    e = V.read(spark, d, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("worker")).agg(F.collect_list("value").alias("v"))
    return e.select("worker", of_array(F.col("v"), "rint", 0.9).alias("q_rint"), of_array(F.col("v"), "mid").alias("q_mid"))


NAMES = sorted(SOURCES)


@query(f"SELECT ({NAMES})[o_custkey % {len(NAMES)} + 1] AS source, count(*) AS n, max(o_orderkey) AS last_id FROM orders WHERE o_custkey % {len(NAMES)} < 3 AND (o_custkey % {len(NAMES)} > 0 OR o_custkey % 8 < 7 AND (o_custkey % 3 > 0 OR o_orderkey % 2 = 0)) GROUP BY 1")
def udf1_source_registry(spark, d):
    """Rows of three registered sources, chosen by name and dispatched to their functions; an unknown name raises KeyError."""
    from millrace.plans.monitoring import packed

    chosen = ", ".join(selected(None)[:3])
    return normalise(packed(spark, d), chosen).groupBy("source").agg(F.count("*").alias("n"), F.max(F.col("id").cast("long")).alias("last_id"))
