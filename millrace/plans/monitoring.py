"""Demand-monitor queries: feeds, seen sets, sweeps, sources and sinks."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import aggregates as A
from millrace.operators import dedup as D
from millrace.operators import filters as L
from millrace.operators import windows as W
from millrace.operators.scan import running
from millrace.plans import views as V
from millrace.plans.registry import query
from millrace.sources import normalise as N
from millrace.sources import readers as R
from millrace.sources.scratch import shared_path
from millrace.streaming import keyed as K
from millrace.streaming import monitor as M
from millrace.streaming import state as S

HALF = 1_705_276_800_000_000  # 2024-01-15 in microseconds
WORDS = ["click", '"k": 7', "error"]
MATCH = "(contains(lower(title), 'click') OR contains(lower(title), '\"k\": 7') OR contains(lower(title), 'error'))"


def _split(spark, d):
    items = V.items(spark, d)
    return items.where(F.col("us") >= HALF), items.where(F.col("us") < HALF).select("source", "id").distinct()


@query(f"""WITH seen AS (SELECT DISTINCT source, id FROM v_items WHERE us < {HALF}), n AS (SELECT * FROM v_items WHERE us >= {HALF})
 SELECT n.source, count(*) AS collected, count(*) FILTER ({MATCH}) AS matched, count(*) FILTER ({MATCH} AND s.id IS NULL) AS new
 FROM n LEFT JOIN seen s ON s.source = n.source AND s.id = n.id GROUP BY n.source""")
def sweep_summary(spark, d):
    """One sweep: per source rows collected, matched by keywords, and new against the first half of the month."""
    now, seen = _split(spark, d)
    return M.sweep_counts(now, seen, WORDS)


@query(f"SELECT ord, source, title FROM v_items WHERE {MATCH}")
def flt1_keyword_any(spark, d):
    return L.keyword_any(V.items(spark, d).select("ord", "source", "title"), ["title"], WORDS)


@query(r"""WITH t AS (SELECT key, list_sort(list_distinct(regexp_extract_all(lower(text), '(?:^|[^\p{L}\p{N}_])((?:th|ver|customer)[\p{L}\p{N}_]*)', 1))) AS w FROM v_text)
 SELECT key, array_to_string(w, ' ') AS words FROM t WHERE len(w) > 0""")
def flt2_keyword_tokens(spark, d):
    t = V.texts(spark, d).select("key", L.keyword_tokens(F.col("text"), ["th", "ver", "customer"]).alias("w"))
    return t.where(F.size("w") > 0).select("key", F.array_join("w", " ").alias("words"))


@query(f"""SELECT n.source, n.id, n.ord FROM v_items n WHERE us >= {HALF} AND NOT EXISTS
 (SELECT 1 FROM v_items s WHERE s.us < {HALF} AND s.source = n.source AND s.id = n.id)""")
def joi10_only_new(spark, d):
    now, seen = _split(spark, d)
    return L.only_new(now.select("source", "id", "ord"), seen)


@query("SELECT source, id, min(ord) AS ord FROM v_items GROUP BY source, id")
def ded1_dedup_first(spark, d):
    return D.dedup_first(V.items(spark, d).select("source", "id", "ord"), ["source", "id"], ["ord"])


@query("SELECT source, id, arg_max(value, ord) AS value, max(ord) AS ord, min(ord) AS pos FROM v_items GROUP BY source, id")
def ded2_dedup_last(spark, d):
    return D.dedup_last(V.items(spark, d).select("source", "id", "value", "ord"), ["source", "id"], "ord").select("source", "id", "value", "ord", "pos")


@query("""WITH u AS (SELECT id, ord FROM v_items WHERE source IN ('click', 'view')) SELECT id, min(ord) AS ord FROM u GROUP BY id""")
def set1_union_feeds(spark, d):
    items = V.items(spark, d).select("source", "id", "ord")
    return D.dedup_first(items.where("source = 'click'").unionByName(items.where("source = 'view'")).drop("source"), ["id"], ["ord"])


@query("SELECT DISTINCT source, id FROM v_items")
def set2_seen_union(spark, d):
    now, seen = _split(spark, d)
    return seen.union(now.select("source", "id")).distinct()


@query("SELECT ord, source, id FROM v_items ORDER BY us DESC, ord DESC LIMIT 500")
def top6_recent_capped(spark, d):
    return V.items(spark, d).orderBy(F.desc("us"), F.desc("ord")).limit(500).select("ord", "source", "id")


@query("""WITH f AS (SELECT source, id, min(ord) AS ord FROM v_items WHERE value > 10 GROUP BY source, id)
 SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY ord) AS position FROM f QUALIFY position <= 20""")
def win1_position(spark, d):
    first = D.dedup_first(V.items(spark, d).where("value > 10").select("source", "id", "ord"), ["source", "id"], ["ord"])
    return running(first, "source", "ord", F.lit(1), "position").where("position <= 20").select("source", "id", F.col("position").cast("long").alias("position"))


@query("""WITH i AS (SELECT source, id, us // 86400000000 AS run FROM v_items), f AS (SELECT source, id, min(run) AS first FROM i GROUP BY source, id)
 SELECT i.source, i.run, count(*) AS n_rows, count(DISTINCT i.id) FILTER (i.run = f.first) AS n_new FROM i JOIN f ON i.source = f.source AND i.id = f.id GROUP BY i.source, i.run""")
def win17_feed_churn(spark, d):
    i = V.items(spark, d).select("source", "id", F.floor(F.col("us") / 86400000000).alias("run"))
    first = i.groupBy("source", "id").agg(F.min("run").alias("first"))
    new = first.groupBy("source", F.col("first").alias("run")).agg(F.count("*").alias("n_new"))
    rows = i.groupBy("source", "run").agg(F.count("*").alias("n_rows"))
    return rows.join(new, ["source", "run"], "left").fillna(0, ["n_new"])


@query("""WITH p AS (SELECT source, id, us, value > 20 AS flag, ord FROM v_items), c AS (SELECT *, row_number() OVER w AS rn, lag(flag) OVER w AS before FROM p WINDOW w AS (PARTITION BY source ORDER BY ord))
 SELECT source, ord, flag FROM c WHERE rn = 1 OR flag IS DISTINCT FROM before""")
def win16_change_only(spark, d):
    i = V.items(spark, d).withColumn("flag", F.col("value") > 20)
    return W.change_only(i, "source", "ord", F.col("flag")).select("source", "ord", "flag")


@query("SELECT user_id AS id, arg_max(CASE WHEN source = 'purchase' THEN value END, ord) AS bought, arg_max(source, ord) AS state, count(*) AS n FROM v_items GROUP BY user_id")
def str9_task_state_latest(spark, d):
    return S.latest_state(V.items(spark, d).select(F.col("user_id").alias("id"), F.when(F.col("source") == "purchase", F.col("value")).alias("bought"), F.col("source").alias("state"), "ord"), "id", "ord")


@query("""WITH p AS (SELECT user_id AS id, max(CASE WHEN source = 'purchase' THEN value END) AS bought, max(source) AS state, us, count(*) AS k FROM v_items GROUP BY user_id, us),
 g AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY id ORDER BY us) > 86400000000)::INT, 1) AS new FROM p), s AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY us) AS session FROM g),
 l AS (SELECT * FROM s QUALIFY session = max(session) OVER (PARTITION BY id)), m AS (SELECT id, arg_max(bought, us) FILTER (bought IS NOT NULL) AS bought, arg_max(state, us) AS state, max(us) AS us, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY id)
 SELECT * FROM m WHERE us >= (SELECT max(us) FROM v_items) - 86400000000""")
def str9_task_state_stream(spark, d):
    """The same as a stream through the state store, with a retention of 24 hours after a task's last patch."""
    p = V.items(spark, d).groupBy(F.col("user_id").alias("id"), "us").agg(F.max(F.when(F.col("source") == "purchase", F.col("value"))).alias("bought"), F.max("source").alias("state"))
    return K.kept_states(spark, p.select("id", "bought", "state", "us"), 86_400_000_000)


HOSTS = "CASE user_id % 23 WHEN 0 THEN 'maps.yandex.ru' WHEN 1 THEN 'yandex.ru' ELSE 's' || user_id % 23 || '.example.com' END"


@query(f"""WITH r AS (SELECT event_id, {HOSTS} AS host FROM events), rules AS (SELECT n_nationkey AS ord, n_nationkey % 6 <> 5 AS enabled,
 CASE n_nationkey % 3 WHEN 0 THEN '*.yandex.*' WHEN 1 THEN 's' || n_nationkey || '.*' ELSE '[st]' || n_nationkey || '([.]example)+[.]com' END AS pattern FROM nation),
 m AS (SELECT host, min_by(pattern, ord) AS rule FROM (SELECT DISTINCT host FROM r) JOIN rules ON enabled AND CASE WHEN contains(pattern, '*') THEN host GLOB pattern ELSE regexp_full_match(host, pattern) END GROUP BY host)
 SELECT event_id, r.host, rule FROM r LEFT JOIN m ON m.host = r.host""")
def joi11_first_rule(spark, d):
    """Rules from nations: globs and regular expressions in order, every sixth one switched off."""
    k, n = F.col("user_id") % 23, F.col("n_nationkey")
    host = F.when(k == 0, "maps.yandex.ru").when(k == 1, "yandex.ru").otherwise(F.concat(F.lit("s"), k.cast("string"), F.lit(".example.com")))
    pattern = F.when(n % 3 == 0, "*.yandex.*").when(n % 3 == 1, F.concat(F.lit("s"), n.cast("string"), F.lit(".*"))).otherwise(F.concat(F.lit("[st]"), n.cast("string"), F.lit("([.]example)+[.]com")))
    rules = V.read(spark, d, "nation").select(n.alias("ord"), pattern.alias("pattern"), (n % 6 != 5).alias("enabled"))
    return L.first_rules(V.read(spark, d, "events").select("event_id", host.alias("host")), "host", rules)


@query("SELECT event_id, user_id, event_type AS key FROM events")
def src2_read_jsonl(spark, d):
    path = shared_path(spark)
    V.read(spark, d, "events").select("event_id", "user_id", "event_type").write.partitionBy("event_type").json(path)
    return R.read_jsonl(spark, path, "event_id long, user_id long", "event_type=([^/]+)/")


@query("""WITH e AS (SELECT DISTINCT user_id, event_type FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT event_type FROM events)),
 f AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 5 GROUP BY ALL)
 SELECT e.user_id, e.event_type, f.n, CASE WHEN f.n IS NULL THEN 'missing' WHEN f.n < 3 THEN 'few' END AS error FROM e LEFT JOIN f ON e.user_id = f.user_id AND e.event_type = f.event_type""")
def src3_read_cells(spark, d):
    path = shared_path(spark)
    e = V.read(spark, d, "events")
    e.where("value > 5").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("error", F.when(F.col("n") < 3, "few")).write.json(path)
    expected = e.select("user_id").distinct().crossJoin(e.select("event_type").distinct())
    return R.read_cells(expected, spark.read.schema("user_id long, event_type string, n long, error string").json(path), ["user_id", "event_type"])


@query("""SELECT CAST(event_id AS VARCHAR) AS line, event_type AS level, CAST(user_id AS VARCHAR) AS worker, epoch_us(date_trunc('second', ts)) AS us FROM events
 WHERE event_type <> 'view' AND date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""")
def src4_read_log(spark, d):
    """Lines of a log between two times, both included; others and those of another form are dropped."""
    path = shared_path(spark)
    e = V.read(spark, d, "events")
    known = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.format_string(" | %d | %s | w%d | %s", "event_id", "event_type", "user_id", "props"))
    e.select(F.when(F.col("event_type") == "view", F.concat(F.lit("~ "), "props")).otherwise(known).alias("value")).write.text(path)
    pattern = r"^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}) \| ([0-9]+) \| ([a-z]+) \| w([0-9]+) \| .*$"
    log = R.read_log(spark, path, pattern, ["ts", "line", "level", "worker"], ("2024-01-05 00:00:00", "2024-01-20 12:00:00"))
    return log.select("line", "level", "worker", V.micros(F.col("ts")).alias("us"))


@query("SELECT 'http://x/projects/' || o_orderkey || '/' AS link, 'Order ' || o_orderkey AS title, o_orderstatus AS pub_date, substr(rtrim(repeat(o_orderpriority || ' ', 40)), 1, 300) AS description FROM orders")
def src5_read_feed_xml(spark, d):
    path = shared_path(spark)
    o = V.read(spark, d, "orders")
    item = F.concat(
        F.lit("<item><link>http://x/projects/"), F.col("o_orderkey").cast("string"), F.lit("/</link><title>Order "), F.col("o_orderkey").cast("string"), F.lit("</title><pubDate>"),
        "o_orderstatus", F.lit("</pubDate><description>"), F.repeat(F.concat("o_orderpriority", F.lit(" ")), F.lit(40)), F.lit("</description></item>"),
    )
    feed = F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>"))
    feeds = o.groupBy(F.floor(F.col("o_orderkey") / 4000).alias("g")).agg(feed.alias("value"))
    feeds.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return R.read_feed_xml(spark, path)


@query("SELECT event_type AS ev, CAST(user_id AS VARCHAR) AS worker, value > 30 AS clean, count(*) AS n FROM events GROUP BY ALL")
def src6_read_router_events(spark, d):
    path = shared_path(spark)
    e = V.read(spark, d, "events")
    e.select(F.col("event_type").alias("ev"), (V.micros(F.col("ts")) / 1e6).alias("ts"), F.col("user_id").cast("string").alias("worker"), (F.col("value") > 30).alias("clean")).write.json(path)
    return R.read_router_events(spark, path).groupBy("ev", "worker", "clean").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 <> 0")
def src1_read_records(spark, d):
    path = shared_path(spark)
    o = V.read(spark, d, "orders")
    doc = F.when(F.col("o_orderkey") % 10 == 0, F.lit('{"id": ')).otherwise(F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))))
    o.select(doc.alias("value")).write.text(path)
    return R.read_records(spark, path, "id long, status string", multi_line=False)[0]


@query(f"""SELECT ord, source, 'run1' AS run_at, array_to_string(list_filter(['click', '"k": 7', 'error'], lambda w: contains(lower(title), w)), ',') AS keywords FROM v_items WHERE {MATCH}
 UNION ALL SELECT ord, source, 'run2', '' FROM v_items WHERE source = 'view'""")
def snk1_append_hits(spark, d):
    """Two runs' hits in one folder, each with the keywords that its title holds."""
    path = shared_path(spark)
    items = V.items(spark, d).select("ord", "source", "title")
    R.append_hits(L.keyword_any(items, ["title"], WORDS).withColumn("keywords", L.matched(F.lower("title"), WORDS)).drop("title"), path, F.lit("run1"))
    R.append_hits(items.where("source = 'view'").withColumn("keywords", F.array().cast("array<string>")).drop("title"), path, F.lit("run2"))
    return spark.read.schema("ord long, source string, run_at string, keywords array<string>").json(path).withColumn("keywords", F.array_join("keywords", ","))


@query("SELECT source, count(*) AS n, count(DISTINCT id) AS ids FROM v_items GROUP BY source")
def snk2_write_summary(spark, d):
    path = shared_path(spark)
    per = V.items(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))
    R.write_summary(per.select("source", F.struct("n", "ids").alias("stats")), path)
    return spark.read.schema("source string, stats struct<n:long,ids:long>").json(path).select("source", "stats.n", "stats.ids")


@query("""WITH t AS (SELECT o_orderkey AS oid, 'm' || o_orderkey % 3 AS model_key, o_custkey AS mtime, CASE WHEN o_orderkey % 5 = 0 THEN 'edited' ELSE 'new' END AS review_status FROM orders WHERE o_orderkey % 2 = 0),
 u AS (SELECT o_orderkey AS oid, 'm' || o_orderkey % 3 AS model_key, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey ELSE -1 END AS mtime, 'updated' AS review_status FROM orders WHERE o_orderkey % 3 <> 0)
 SELECT coalesce(t.oid, u.oid) AS oid, coalesce(t.model_key, u.model_key) AS model_key,
 CASE WHEN u.oid IS NULL OR t.review_status = 'edited' OR t.mtime = u.mtime THEN t.mtime ELSE u.mtime END AS mtime,
 CASE WHEN u.oid IS NULL OR t.review_status = 'edited' OR t.mtime = u.mtime THEN t.review_status ELSE u.review_status END AS review_status
 FROM t FULL JOIN u ON t.oid = u.oid AND t.model_key = u.model_key""")
def snk3_upsert_cards(spark, d):
    o = V.read(spark, d, "orders")
    key = F.concat(F.lit("m"), (F.col("o_orderkey") % 3).cast("string")).alias("model_key")
    t = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("oid"), key, F.col("o_custkey").alias("mtime"), F.when(F.col("o_orderkey") % 5 == 0, "edited").otherwise("new").alias("review_status"))
    u = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("oid"), key, F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey")).otherwise(-1).alias("mtime"), F.lit("updated").alias("review_status"))
    table = R.CardTable(spark, shared_path(spark), "oid long, model_key string, mtime long, review_status string")
    table.create(t.withColumn("mtime", F.col("mtime").cast("long")))
    for _ in range(2):  # the second time changes nothing
        table.upsert(u.withColumn("mtime", F.col("mtime").cast("long")), "run1")
    return table.read().drop("bucket")


def packed(spark, d, only: str | None = None):
    """Payloads of all sources, or of one, as their pages hold them, packed from orders: a customer is a page, an order an item.
    Feeds that repeat ids show each item twice, with another title the second time.  Payloads of all sources are stored
    by source, as a collector would, so that each branch reads its own."""
    names = sorted(N.SOURCES)
    o = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("page"), F.col("o_orderpriority").alias("p"), F.round("o_totalprice").cast("long").alias("lo"))
    o = o.withColumn("source", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("page") % len(names) + 1).cast("int")))
    o = o.where(F.col("source") == only) if only else o
    rows = o.groupBy("source", "page").agg(F.array_sort(F.collect_list(F.struct("k", "p", "lo"))).alias("rows"))

    def fill(template: str, x, twice: str = ""):
        """The template with <k>, <p>, <lo>, <hi>, <ms> and <again> of an item."""
        at = x["k"]
        values = {"k": at.cast("string"), "p": x["p"], "lo": x["lo"].cast("string"), "hi": (2 * x["lo"]).cast("string"), "ms": ((1_704_067_200 + at) * 1000).cast("string"), "again": F.lit(twice)}
        parts = re.split(r"<(k|p|lo|hi|ms|again)>", template)
        return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])

    def joined(form, sep: str = "", where=None):
        items = F.filter("rows", where) if where else F.col("rows")
        return F.array_join(F.transform(items, form), sep)

    def twice(form, sep: str = ""):
        return F.concat(joined(lambda x: form(x, ""), sep), F.lit(sep), joined(lambda x: form(x, " again"), sep))

    pick = lambda x, m, at, yes, no="": F.when(x["k"] % m == at, yes).otherwise(no)
    gap = " " * 1600
    hh = lambda x, a: F.concat(
        fill('"vacancyId":<k>,"name":"<p> &amp; co<again>","compensation":{', x, a), pick(x, 5, 0, '"noCompensation":{', fill('"from":<lo>,' , x)), pick(x, 2, 0, fill('"to":<hi>,', x)), F.lit('"currencyCode":"RUR"}'),
        fill(',"publicationTime":{"@timestamp":1,"$":"D<k>"}', x), pick(x, 7, 0, " " * 900), fill(',"company":{"visibleName":"C &amp; <k>"}' + gap, x),
    )
    zarplata = lambda x, a: F.concat(
        fill('"vacancyId" : <k>, "name": "<p><again>", "publicationTime": "x", "@timestamp": <ms>', x, a), pick(x, 3, 0, "", fill(', "visibleName":"Z<k>"', x)), pick(x, 5, 0, "", fill(', "from": <lo>, "currencyCode":"RUR"', x)), F.lit("}" + gap)
    )
    entity = lambda body, where=None: joined(lambda x: F.concat(fill('"<k>":{"attributes":{', x), body(x), F.lit("}}")), ",", where)
    superjob = F.concat(
        F.lit('<script type="application/ld+json">{"@type":"BreadcrumbList","itemListElement":[{"url":"https://russia.superjob.ru/vakansii/crumb-1.html"}]}</script><script type="application/ld+json">{"@type":"ItemList","itemListElement":['),
        joined(lambda x: fill('{"url":"https://russia.superjob.ru/vakansii/slug-<k>.html"}', x), ",", lambda x: x["k"] % 4 == 0), F.lit(']}</script><script type="application/ld+json">{"@type":"ItemList","itemListElement":['),
        joined(lambda x: fill('{"url":"https://russia.superjob.ru/vakansii/slug-<k>.html"}', x), ",", lambda x: x["k"] % 4 == 2),
        F.lit(']}</script><script>window.APP_STATE={"ids":{"VACANCY_SEARCH_RESULT":['), joined(lambda x: fill("<k>", x), ",", lambda x: x["k"] % 3 > 0), F.lit(']},"entities":{"vacancyMainInfo":{'),
        entity(lambda x: F.concat(fill('"profession":"<p>","publishedAt":"P<k>","updatedAt":"', x), pick(x, 10, 1, "", fill("U<k>", x)), F.lit('"')), lambda x: x["k"] % 4 < 2), F.lit('},"vacancySalary":{'),
        entity(lambda x: F.concat(F.lit('"minSalary":'), F.when(x["k"] % 6 % 2 == 1, x["lo"]).otherwise(0).cast("string"), F.lit(',"maxSalary":'), F.when((x["k"] % 6).isin(2, 3), 2 * x["lo"]).otherwise(0).cast("string"), F.lit(',"paymentAgreement":'), pick(x, 6, 4, "true", "false"))),
        F.lit('},"vacancyCompanyInfo":{'), entity(lambda x: fill('"name":"S<k>"', x), lambda x: x["k"] % 5 > 0), F.lit("}}}</script>"),
    )
    habr = joined(lambda x: F.concat(fill('{"id":<k>,"href":"/v/<k>","title":"<p>","company":{"title":"H<k>"},"publishedDate":{"date":"D<k>"},"salary":', x), pick(x, 2, 0, fill('{"formatted":"<lo> r"}', x), "null"), F.lit(',"remoteWork":'), pick(x, 3, 0, "true", "false"), F.lit("}")), ",")
    listed = F.when(F.col("page") % 2 == 0, F.concat(F.lit('{"list":['), habr, F.lit('],"meta":{}}'))).otherwise(F.concat(F.lit("["), habr, F.lit("]")))
    avito = joined(lambda x: F.concat(fill('{"id":<k>,"title":"<p>","urlPath":"/x/<k>?c=1","sortTimeStamp":<ms>,"location":{"name":"L<k>"},"description":"', x), pick(x, 2, 0, "Python dev", "cook"), F.lit('","priceDetailed":{'), pick(x, 3, 0, fill('"fullString":"","string":"<lo>"', x), fill('"fullString":"<lo> full"', x)), F.lit("}}")), ",")
    fl = lambda x, a: fill("<item><link>https://www.fl.ru/projects/<k>/a&amp;b.html</link><title> <p><again> </title><pubDate>D<k></pubDate><description>d &lt;<k>&gt;</description></item>", x, a)
    kwork = lambda x, a: F.concat(pick(x, 3, 0, fill('{"want_id":<k>', x), fill('{"id":<k>', x)), fill(',"name":" <p><again> ","description":"d<k>"', x, a), pick(x, 4, 0, ',"priceLimit":0', fill(',"priceLimit":"<lo>"', x)), fill(',"possiblePriceLimit":"<hi>"}', x))
    wants = twice(kwork, ",")
    youdo = joined(lambda x: F.concat(fill('{"Id":<k>,"Name":"<p>","BudgetDescription":"<lo>","DateTimeString":"D<k>","CategoryFlag":"c","OffersCount":3', x), pick(x, 2, 0, fill(',"Url":"/u<k>"}', x), "}")), ",")
    gigs = joined(lambda x: fill('{"id":<k>,"url":"/g/<k>","gtitle":"<p>","price":<lo>,"days":2,"userId":7,"userName":"n","sellerLevel":"1","rating":"4.5"}', x), ",")
    card = lambda x: F.concat(
        F.lit('<tr data-id="qa-content-tr" class="cf-line '), pick(x, 2, 0, "limited-card"), F.lit('">'), pick(x, 3, 0, fill("<i uid<k>></i>", x), fill("<i><k>,4 deal,9 reviews</i>", x)), pick(x, 4, 0, "", fill('<a href="/users/u<k>/"></a>', x)),
        fill('<b class="cf-title-card-new">', x), pick(x, 5, 0, "Фрилансер", fill("<p> &amp; N", x)), fill('</b><a href="/freelancers/web-dev/" data-id="qa-content-tr-td-cf-spec">Web <k></a><i>Опыт: 5 лет</i><i>12 работ</i></tr>', x),
    )
    profiles = joined(lambda x: F.concat(fill('{"state":{"userProfileName":"<k>","userProfileFullName":"<p>","userProfileAddTime":"D<k>","userProfileDescription":"<h2>a &amp; b</h2><div>c</div>","userRating":"5","totalReviewsCount":8,"totalKworks":3,"userSkills":[{"name":"a"},{"name":"b"}]},"gigs":[', x), fill('{"id":"<k>","price":"<lo>","categoryId":7,"conversion":0.5,"queueCount":2}', x), pick(x, 2, 0, fill(',{"id":"0"}', x)), F.lit("]}")), ",")
    deep = (F.col("page") % 8).cast("int")  # levels above the catalog: with seven it is out of reach
    wrap = lambda head, body, tail: F.concat(F.lit(head), body, F.lit(tail))
    per = {
        "hh": wrap("<html>", twice(hh), "</html>"), "zarplata": wrap("<html>", twice(zarplata), "</html>"), "superjob": superjob, "habr": wrap('<script id=x data-ssr-state="true">{"vacancies":', listed, "}</script>"),
        "avito": F.concat(
            F.lit('<script type="mime/invalid" data-mfe-state="true">{"state":'), F.repeat(F.lit('{"list":[{"catalog":{"items":[]}}],"w":'), deep), F.lit('{"catalog":{"items":['), avito, F.lit(']},"a":{"catalog":{"items":[]}}}'), F.repeat(F.lit("}"), deep), F.lit("}</script>")
        ),
        "fl": wrap("<?xml version='1.0'?><rss><channel>", twice(fl), "</channel></rss>"),
        "kwork": F.concat(F.lit('{"data":'), F.when(F.col("page") % 2 == 0, wrap('{"pagination":{"data":[', wants, "]}}")).otherwise(wrap('{"wants":[', wants, "]}")), F.lit("}")),
        "youdo": wrap('{"ResultObject":{"Items":[', youdo, "]}}"), "kwork_catalog": wrap('{"parent":"it","leaf":"web","data":{"stateData":{"viewData":{"kworks":{"posts":{"data":[', gigs, "]}}}}}}"),
        "fl_catalog": wrap("<h1>Web</h1><table>", joined(card), "</table>"), "kwork_profiles": wrap('{"profiles":[', profiles, "]}"),
    }
    chain = F.when(F.lit(False), F.lit(""))
    for n, c in per.items():
        chain = chain.when(F.col("source") == n, c) if only in (None, n) else chain
    payloads = rows.select("source", "page", chain.alias("payload"), (F.col("page") % 3 == 0).alias("fallback"))
    if only:
        return payloads
    path = shared_path(spark)
    payloads.write.partitionBy("source").parquet(path)
    return spark.read.schema("page long, payload string, fallback boolean, source string").parquet(path)


# What each branch must give of an order: title, url, amount, date, extra, and which orders it keeps.
_NAMES = sorted(N.SOURCES)
_ISO = "strftime(make_timestamp((1704067200 + k) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00'"
EXPECTED = {
    "hh": ("p || ' & co'", "'https://hh.ru/vacancy/' || k", "CASE WHEN k % 5 > 0 THEN 'от ' || lo || CASE WHEN k % 2 = 0 THEN ' до ' || hi ELSE '' END || ' RUR' END", "'D' || k", "'company=' || CASE WHEN k % 7 = 0 THEN '' ELSE 'C & ' || k END", "true"),
    "zarplata": ("p", "'https://www.zarplata.ru/vacancy/' || k", "CASE WHEN k % 5 > 0 THEN 'от ' || lo || ' RUR' END", _ISO, "'company=' || CASE WHEN k % 3 = 0 THEN '' ELSE 'Z' || k END", "true"),
    "superjob": (
        "CASE WHEN k % 4 < 2 THEN p ELSE '' END", "'https://russia.superjob.ru/vakansii/' || CASE WHEN k % 2 = 0 THEN 'slug-' ELSE '' END || k || '.html'",
        "CASE k % 6 WHEN 1 THEN 'от ' || lo WHEN 5 THEN 'от ' || lo WHEN 2 THEN 'до ' || hi WHEN 3 THEN lo || '–' || hi || ' RUB' WHEN 4 THEN 'по договорённости' END",
        "CASE WHEN k % 4 >= 2 THEN '' WHEN k % 10 = 1 THEN 'P' || k ELSE 'U' || k END", "'company=' || CASE WHEN k % 5 > 0 THEN 'S' || k ELSE '' END || ';slug=' || CASE WHEN k % 2 = 0 THEN 'slug' ELSE '' END", "k % 4 < 3",
    ),
    "habr": ("p", "'https://career.habr.com/v/' || k", "CASE WHEN k % 2 = 0 THEN lo || ' r' END", "'D' || k", "'company=H' || k || ';remote=' || (k % 3 = 0)", "true"),
    "avito": ("p", "'https://www.avito.ru/x/' || k", "lo || CASE WHEN k % 3 = 0 THEN '' ELSE ' full' END", _ISO, "'desc=' || CASE WHEN k % 2 = 0 THEN 'Python dev' ELSE 'cook' END || ';location=L' || k", "g % 8 < 7 AND (g % 3 > 0 OR k % 2 = 0)"),
    "fl": ("p", "'https://www.fl.ru/projects/' || k || '/a&b.html'", "NULL", "'D' || k", "'desc=d <' || k || '>'", "true"),
    "kwork": ("p || ' again'", "'https://kwork.ru/projects/' || k", "CASE WHEN k % 4 = 0 THEN hi ELSE lo END", "''", "'desc=d' || k", "true"),
    "youdo": ("p", "'https://youdo.com/' || CASE WHEN k % 2 = 0 THEN 'u' ELSE 't' END || k", "lo", "'D' || k", "'category=c;offers=3;status='", "true"),
    "kwork_catalog": ("p", "'/g/' || k", "lo", "''", "'baseVolume=;baseVolumeShortName=;convertedUserRating=;days=2;gtitle=' || p || ';id=' || k || ';leaf=web;parent=it;price=' || lo || ';queueCount=;rating=4.5;sellerLevel=1;topBadge=;url=/g/' || k || ';userId=7;userName=n;userRating=;userRatingCount='", "true"),
    "fl_catalog": (
        "CASE WHEN k % 4 > 0 AND k % 5 > 0 THEN p || ' & N' ELSE '' END", "CASE WHEN k % 4 > 0 THEN 'https://www.fl.ru/users/u' || k || '/' ELSE '' END", "NULL", "''",
        "'anonymized=' || (k % 4 = 0 OR k % 5 = 0) || ';deals=' || CASE WHEN k % 3 > 0 THEN '4' ELSE '' END || ';experience=5;is_pro=' || (k % 2 > 0) || ';is_verified=false;login=' || CASE WHEN k % 4 > 0 THEN 'u' || k ELSE '' END || ';portfolio=12;profession=Web;reviews=' || CASE WHEN k % 3 > 0 THEN '9' ELSE '' END || ';spec_group=;spec_slug=web-dev;spec_text=Web ' || k", "true",
    ),
    "kwork_profiles": (
        "p", "'https://kwork.ru/user/' || k", "NULL", "'D' || k",
        """'description=a & b' || chr(10) || chr(10) || 'c;fullName=' || p || ';gig_count=' || CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END || ';gigs=[{"id":"' || k || '","price":"' || lo || '","categoryId":"7","conversion":"0.5","queueCount":"2"}' || CASE WHEN k % 2 = 0 THEN ',{"id":"0"}' ELSE '' END || '];location=;profession=;rating=5;sellerLevel=;skills=a,b;totalKworks=3;totalReviews=8'""", "true",
    ),
}


def _expected(name: str) -> str:
    title, url, amount, date, extra, kept = EXPECTED[name]
    return f"""SELECT '{name}' AS source, CAST(k AS VARCHAR) AS id, {title} AS title, {url} AS url, {amount} AS amount, {date} AS date, {extra} AS extra
 FROM (SELECT o_orderkey AS k, o_custkey AS g, o_orderpriority AS p, CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) AS lo, CAST(2 * CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) AS hi FROM orders)
 WHERE g % {len(_NAMES)} = {_NAMES.index(name)} AND ({kept})"""


def _shown(items):
    pairs = F.transform(F.map_entries("extra"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return items.withColumn("extra", F.array_join(F.array_sort(pairs), ";"))


@query(" UNION ALL ".join(_expected(n) for n in _NAMES))
def nrm_all_sources(spark, d):
    return _shown(N.normalise(packed(spark, d)))


def _one_source(number: int, name: str):
    def run(spark, d):
        return _shown(N.normalise(packed(spark, d, name), name))

    run.__name__ = f"nrm{number}_{name}"
    query(_expected(name))(run)


for _k, _n in enumerate(["hh", "zarplata", "superjob", "habr", "avito", "fl", "kwork", "youdo", "kwork_catalog", "fl_catalog", "kwork_profiles"], 1):
    _one_source(_k, _n)


@query(f"SELECT o_custkey AS g, count(*) AS n, max(o_orderkey) AS last_id FROM orders WHERE o_custkey % {len(_NAMES)} = {_NAMES.index('habr')} GROUP BY o_custkey")
def udf4_explode_payloads(spark, d):
    """Payloads exploded to their items, a page's items stay with its key."""
    state = F.regexp_extract("payload", r"(?s)>(\{.+\})</script>", 1)
    listed = F.coalesce(*[F.from_json(F.get_json_object(state, p), "array<struct<id:long>>") for p in ("$.vacancies.list", "$.vacancies")])
    rows = packed(spark, d, "habr").select(F.col("page").alias("g"), F.explode(listed["id"]).alias("id"))
    return rows.groupBy("g").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


@query(f"""WITH seen AS (SELECT DISTINCT source, id FROM v_items WHERE us < {HALF})
 SELECT n.source, n.id, n.ord FROM v_items n LEFT JOIN seen s ON s.source = n.source AND s.id = n.id WHERE us >= {HALF} AND {MATCH} AND s.id IS NULL""")
def str1_monitor_sweep(spark, d):
    """The sweep as a stream: the first half of the month is in the seen table, the second arrives as a stream."""
    now, seen = _split(spark, d)
    return M.run_sweeps(spark, now, seen, WORDS).select("source", "id", "ord")


@query(f"""WITH f AS (SELECT source, id, min(ord) AS ord FROM v_items GROUP BY source, id)
 SELECT f.source, count(*) AS n, count(*) FILTER ({MATCH}) AS hits, max(f.ord) FILTER ({MATCH}) AS last_hit FROM f JOIN v_items i ON i.ord = f.ord GROUP BY f.source""")
def str3_first_seen_stream(spark, d):
    """First sightings and hits among them: a keyword counts at first sight only."""
    seen = S.first_seen(spark, V.items(spark, d).select("source", "id", "title", "ord"), WORDS)
    return seen.groupBy("source").agg(F.count("*").alias("n"), A.count_if(F.col("hit")).alias("hits"), F.max(F.when(F.col("hit"), F.col("ord"))).alias("last_hit"))


@query(f"""WITH seen AS (SELECT DISTINCT source, id FROM v_items WHERE us < {HALF}), n AS (SELECT * FROM v_items WHERE us >= {HALF})
 SELECT n.source, count(*) AS collected, count(*) FILTER ({MATCH}) AS matched, count(*) FILTER ({MATCH} AND s.id IS NULL) AS new, CAST(NULL AS VARCHAR) AS error
 FROM n LEFT JOIN seen s ON s.source = n.source AND s.id = n.id GROUP BY n.source UNION ALL SELECT 'gone', 0, 0, 0, 'AnalysisException'""")
def str2_sweep_isolated(spark, d):
    """A sweep over sources that are read one by one; one of them is gone, and the others still report."""
    now, seen = _split(spark, d)
    names = [r[0] for r in now.select("source").distinct().collect()]  # the kinds of sources
    sources = {n: (lambda n=n: now.where(F.col("source") == n)) for n in names} | {"gone": lambda: spark.read.parquet(f"{d}/no_such_feed.parquet")}
    return M.sweep_sources(spark, sources, seen, WORDS)


@query()
def str8_degradation_alert(spark, d):
    """Through the state store: samples in a list, the quiet time ended by a timer."""
    return K.degradation_alerts(spark, V.log(spark, d).select("worker", "line", "t", "value"))


@query()
def str8_degradation_alert_sorted(spark, d):
    """The same with a worker's rows sorted by Spark and walked in chunks, so that no batch bounds them."""
    return S.degradation_alerts(spark, V.log(spark, d).select("worker", "line", "t", "value"))


@query("""WITH c AS (SELECT worker, line, value > 20 AS flag, row_number() OVER w AS rn, lag(value > 20) OVER w AS before FROM v_log WINDOW w AS (PARTITION BY worker ORDER BY line))
 SELECT worker, line, flag FROM c WHERE rn = 1 OR flag IS DISTINCT FROM before""")
def str10_status_changes(spark, d):
    return S.status_changes(spark, V.log(spark, d).select("worker", "line", (F.col("value") > 20).alias("flag")))


@query(f"""WITH h AS (SELECT event_type, us - us % 3600000000 AS w FROM (SELECT event_type, epoch_us(ts) AS us FROM events) WHERE us >= {HALF})
 SELECT w AS began, event_type, count(*) AS n, (SELECT count(*) > 0 FROM events WHERE epoch_us(ts) < {HALF}) AS late_rows FROM h WHERE w + 3600000000 <= (SELECT max(epoch_us(ts)) FROM events) - 3600000000 GROUP BY ALL""")
def str11_late_data(spark, d):
    """The second half of the month arrives first; the first half is then too late and dropped, which the metric shows."""
    e = V.read(spark, d, "events").withColumn("us", V.micros(F.col("ts")))
    row = lambda cond: e.where(cond).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = S.windowed_with_watermark(spark, [row(F.col("us") >= HALF), row(F.col("us") < HALF)])
    return out.select(V.micros(F.col("began").cast("timestamp_ntz")).alias("began"), "event_type", "n", "late_rows")
