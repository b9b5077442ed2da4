"""Log, run and router queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.quantiles import MIDDLE, exact_quantiles, of_array, true_median, with_median
from millrace.operators import aggregates as A
from millrace.operators import filters as L
from millrace.operators import windows as W
from millrace.plans import views as V
from millrace.plans.catalog import q
from millrace.plans.registry import query
from millrace.streaming import keyed as K
from millrace.streaming import state as S

GAPS = """WITH g AS (SELECT *, t - lag(t) OVER (PARTITION BY worker ORDER BY line) AS gap FROM v_log),
 a AS (SELECT *, coalesce(gap >= 14400, false) AS idle, CASE WHEN gap IS NULL OR gap >= 14400 OR bucket = 'signup' THEN 0 ELSE gap END AS credit FROM g) """


@query("""WITH g AS (SELECT *, t - lag(t) OVER (PARTITION BY worker ORDER BY line) AS gap FROM v_log),
 a AS (SELECT *, CASE WHEN bucket = 'signup' THEN NULL WHEN bucket = 'error' THEN 'view' WHEN bucket = 'click' THEN 'dispatch' ELSE bucket END AS credited, CASE WHEN gap < 14400 THEN gap ELSE 0 END AS credit,
 bucket NOT IN ('signup', 'error') AS counted FROM g), s AS (SELECT credited AS bucket, round(sum(credit), 3) AS seconds FROM a WHERE credited IS NOT NULL GROUP BY 1),
 n AS (SELECT bucket, count(*) AS n, count(*) FILTER (gap >= 14400) AS idle, round(coalesce(sum(gap) FILTER (gap >= 14400), 0), 3) AS idle_seconds FROM a WHERE counted GROUP BY bucket)
 SELECT coalesce(s.bucket, n.bucket) AS bucket, coalesce(n, 0) AS n, coalesce(seconds, 0.0::DOUBLE) AS seconds, coalesce(idle, 0) AS idle, coalesce(idle_seconds, 0.0::DOUBLE) AS idle_seconds FROM s FULL JOIN n ON s.bucket = n.bucket""")
def win2_gap_attribution(spark, d):
    """Markers are signups; errors hand their seconds to views and aren't counted; clicks begin an enrichment, whose seconds are dispatch."""
    g = W.gap_attribution(V.log(spark, d), ["signup"], 14400.0, {"error": "view", "click": "dispatch"}, ("error",))
    seconds = g.where("credited IS NOT NULL").groupBy(F.col("credited").alias("bucket")).agg(F.round(F.sum("credit"), 3).alias("seconds"))
    lines = g.where("counted").groupBy("bucket").agg(F.count("*").alias("n"), A.count_if(F.col("idle")).alias("idle"), F.round(F.sum("idle_seconds"), 3).alias("idle_seconds"))
    return seconds.join(lines, "bucket", "full_outer").fillna(0, ["n", "seconds", "idle", "idle_seconds"])


@query(GAPS + """, s AS (SELECT bucket, sum(credit) AS seconds FROM a GROUP BY bucket), w AS (SELECT sum(hi - lo) AS wall FROM (SELECT max(t) AS hi, min(t) AS lo FROM v_log GROUP BY worker)),
 u AS (SELECT bucket, seconds FROM s UNION ALL SELECT '(unaccounted)', any_value(wall) - sum(seconds) FROM s, w)
 SELECT bucket, round(seconds, 3) AS seconds, round(100 * seconds / wall, 4) AS share FROM u, w""")
def agg34_time_shares(spark, d):
    """Seconds of each bucket and of what no bucket accounts for, as shares of all workers' time from first to last line."""
    log = V.log(spark, d)
    s = W.gap_attribution(log, ["signup"], 14400.0).groupBy("bucket").agg(F.sum("credit").alias("_s"))
    wall = log.groupBy("worker").agg((F.max("t") - F.min("t")).alias("w")).agg(F.sum("w").alias("_w"))
    rest = s.agg(F.sum("_s").alias("_s")).crossJoin(wall).select(F.lit("(unaccounted)").alias("bucket"), (F.col("_w") - F.col("_s")).alias("_s"))  # one row each
    every = s.unionByName(rest).crossJoin(F.broadcast(wall))  # one row
    return every.select("bucket", F.round("_s", 3).alias("seconds"), F.round(100 * F.col("_s") / F.col("_w"), 4).alias("share"))


@query("""WITH n AS (SELECT *, coalesce(sum((bucket = 'purchase')::INT) OVER (PARTITION BY worker ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM v_log),
 o AS (SELECT *, last_value(CASE WHEN bucket = 'click' THEN line END IGNORE NULLS) OVER w AS sl, last_value(CASE WHEN bucket = 'click' THEN t END IGNORE NULLS) OVER w AS st
 FROM n WINDOW w AS (PARTITION BY worker, e ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT worker, sl AS start_line, line AS end_line, round(t - st, 3) AS seconds FROM o WHERE bucket = 'purchase' AND sl IS NOT NULL AND t - st < 90000""")
def win3_episode_pairing(spark, d):
    p = W.episode_pairing(V.log(spark, d), F.col("bucket") == "click", F.col("bucket") == "purchase", 90000.0)
    return p.withColumn("seconds", F.round("seconds", 3))


@query("""WITH n AS (SELECT *, coalesce(sum((bucket = 'purchase')::INT) OVER (PARTITION BY worker ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM v_log),
 o AS (SELECT *, last_value(CASE WHEN bucket = 'click' THEN line END IGNORE NULLS) OVER w AS sl, last_value(CASE WHEN bucket = 'click' THEN t END IGNORE NULLS) OVER w AS st
 FROM n WINDOW w AS (PARTITION BY worker, e ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT sl % 8 AS port, count(*) FILTER (value > 20) AS ok, count(*) FILTER (value <= 20) AS fail, round(sum(t - st), 3) AS seconds FROM o WHERE bucket = 'purchase' AND sl IS NOT NULL AND t - st < 90000 GROUP BY 1""")
def win3_port_stats(spark, d):
    """Successes, failures and time of the episodes of each port, that of their start."""
    p = W.episode_pairing(V.log(spark, d), F.col("bucket") == "click", F.col("bucket") == "purchase", 90000.0, F.col("line") % 8, F.col("value") > 20)
    return p.groupBy("port").agg(A.count_if(F.col("ok")).alias("ok"), A.count_if(~F.col("ok")).alias("fail"), F.round(F.sum("seconds"), 3).alias("seconds"))


SESSIONS = "WITH s AS (SELECT *, CAST(sum((bucket = 'signup')::INT) OVER (PARTITION BY worker ORDER BY line) AS BIGINT) AS session FROM v_log) "


@query(SESSIONS + "SELECT worker, session, count(*) AS n, min(line) AS first_line, max(line) AS last_line FROM s GROUP BY worker, session")
def win4_sessions_by_marker(spark, d):
    s = W.sessions_by_marker(V.log(spark, d), F.col("bucket") == "signup")
    return s.groupBy("worker", "session").agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))


@query(SESSIONS + f""", g AS (SELECT worker, session, count(*) AS n, round(sum(value), 4) AS total, round(sum(value) FILTER (bucket = 'view'), 4) AS view_total,
 {q('value', 'floor', .5)} AS p50, {q('value', 'floor', .9)} AS p90 FROM s GROUP BY worker, session HAVING count(*) >= 5)
 SELECT *, round(100 * coalesce(view_total, 0) / total, 4) AS view_share FROM g WHERE total > 0""")
def agg38_server_session_summary(spark, d):
    s = W.sessions_by_marker(V.log(spark, d), F.col("bucket") == "signup")
    by = ["worker", "session"]
    base = s.groupBy(*by).agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.sum(F.when(F.col("bucket") == "view", F.col("value"))), 4).alias("view_total"), F.count("*").alias("_n"))
    quant = exact_quantiles(s, by, "value", {"p50": ("floor", 0.5), "p90": ("floor", 0.9)})
    both = base.where("_n >= 5 AND total > 0").drop("_n").join(quant, by)
    return both.withColumn("view_share", F.round(100 * F.coalesce("view_total", F.lit(0.0)) / F.col("total"), 4))


@query("""WITH c AS (SELECT user_id AS worker, event_id AS line, (epoch_us(ts) // 1000000) % 86400 AS clock FROM events),
 b AS (SELECT *, coalesce((clock < lag(clock) OVER (PARTITION BY worker ORDER BY line))::BIGINT, 0) AS back FROM c)
 SELECT worker, line, CAST(sum(back) OVER w AS BIGINT) AS day, CAST(sum(back) OVER w * 86400 + clock AS BIGINT) AS seconds FROM b WINDOW w AS (PARTITION BY worker ORDER BY line)""")
def win5_clock_rollover(spark, d):
    e = V.read(spark, d, "events").select(F.col("user_id").alias("worker"), F.col("event_id").alias("line"), (F.floor(V.micros(F.col("ts")) / 1000000) % 86400).alias("clock"))
    return W.clock_rollover(e, "worker", "line", "clock").drop("clock")


@query("""WITH c AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS ctx, line % 40 AS pre, line % 7 + 1 AS ms FROM v_log), r AS (SELECT worker, line, list(ctx) OVER w AS l, sum(ctx) OVER w AS s, sum(pre) OVER w AS pre, sum(ms) OVER w AS ms, count(*) OVER w AS n, max(ctx) OVER w AS top FROM c
 WINDOW w AS (PARTITION BY worker ORDER BY line ROWS BETWEEN 399 PRECEDING AND CURRENT ROW)), q AS (SELECT *, list_sort(l) AS o FROM r)
 SELECT worker, line, s::DOUBLE / n AS mean, top, n, (o[(n - 1) // 2 + 1] + o[n // 2 + 1]) / 2.0::DOUBLE AS med, o[CAST(least(n - 1, floor(n * 0.9::DOUBLE)) AS BIGINT) + 1] AS p90,
 round(CASE WHEN s > 0 THEN 100 - 100 * pre::DOUBLE / s END, 6) AS reuse, round(1000 * s::DOUBLE / ms, 4) AS per_second FROM q""")
def win6_rolling_last_n(spark, d):
    """Size, median, mean, p90 and top of the worker's last 400 rows, the share that did not need computing, and the rate."""
    w = Window.partitionBy("worker").orderBy("line").rowsBetween(-399, 0)
    c = V.log(spark, d).select("worker", "line", F.round(F.col("value") * 100).cast("long").alias("ctx"), (F.col("line") % 40).alias("pre"), (F.col("line") % 7 + 1).alias("ms"))
    total = lambda x: F.sum(x).over(w)
    r = c.select("worker", "line", F.sort_array(F.collect_list("ctx").over(w)).alias("o"), total("ctx").alias("s"), total("pre").alias("p"), total("ms").alias("ms"), F.count("*").over(w).alias("n"), F.max("ctx").over(w).alias("top"))
    at = lambda k: F.get("o", k.cast("int"))
    n, s = F.col("n"), F.col("s")
    med = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    return r.select(
        "worker", "line", (s / n).alias("mean"), "top", "n", med.alias("med"), at(F.least(n - 1, F.floor(n * 0.9))).alias("p90"),
        F.round(F.when(s > 0, 100 - 100 * F.col("p") / s), 6).alias("reuse"), F.round(1000 * s / F.col("ms"), 4).alias("per_second"),
    )


@query("""WITH r AS (SELECT worker, line, count(*) OVER w AS n, sum(value) OVER w AS total FROM v_log
 WINDOW w AS (PARTITION BY worker ORDER BY CAST(floor(t) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW))
 SELECT worker, line, n, round(total / n, 6) AS rate, n >= 3 AND total / n < 20 AS alert FROM r""")
def win7_rolling_rate_alert(spark, d):
    w = Window.partitionBy("worker").orderBy(F.floor("t").cast("long")).rangeBetween(-86400, 0)
    r = V.log(spark, d).select("worker", "line", F.count("*").over(w).alias("n"), F.sum("value").over(w).alias("total"))
    rate = F.col("total") / F.col("n")
    return r.select("worker", "line", "n", F.round(rate, 6).alias("rate"), ((F.col("n") >= 3) & (rate < 20)).alias("alert"))


@query("""WITH g AS (SELECT *, CAST(floor(t) AS BIGINT) AS s FROM v_log), r AS (SELECT worker, line, list(bucket <> 'error') OVER a AS clean, list(CAST(round(value) AS BIGINT)) OVER b AS lat,
 count(*) FILTER (bucket = 'click') OVER p AS picks, count(*) FILTER (bucket = 'view') OVER c AS opened FROM g
 WINDOW a AS (PARTITION BY worker ORDER BY line ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (PARTITION BY worker ORDER BY line ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
 p AS (PARTITION BY worker ORDER BY s RANGE BETWEEN 300 PRECEDING AND CURRENT ROW), c AS (PARTITION BY worker ORDER BY s RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)),
 p AS (SELECT *, list_sort(list_filter(lat, lambda x: x > 0)) AS s FROM r)
 SELECT worker, line, round(100.0::DOUBLE * len(list_filter(clean, lambda x: x)) / len(clean), 4) AS clean_pct, s[len(s) // 2 + 1] AS p50,
 s[CAST(round_even((len(s) - 1) * 0.95::DOUBLE, 0) AS BIGINT) + 1] AS p95, picks, round(least(opened, 600) / 60.0::DOUBLE, 6) AS connects FROM p""")
def win8_probe_windows(spark, d):
    """Clean share of the last 20 probes, latencies of the last 50, picks in 300 s, connects a second over 60 s (of the latest 600)."""
    w = Window.partitionBy("worker").orderBy("line")
    by_time = Window.partitionBy("worker").orderBy(F.floor("t").cast("long"))
    within = lambda bucket, s: F.count(F.when(F.col("bucket") == bucket, 1)).over(by_time.rangeBetween(-s, 0))
    lat = F.collect_list(F.round("value").cast("long")).over(w.rowsBetween(-49, 0))
    r = V.log(spark, d).select(
        "worker", "line", F.avg((F.col("bucket") != "error").cast("double")).over(w.rowsBetween(-19, 0)).alias("clean"), lat.alias("lat"), within("click", 300).alias("picks"), within("view", 60).alias("opened")
    )
    positive = F.filter("lat", lambda x: x > 0)
    return r.select(
        "worker", "line", F.round(100 * F.col("clean"), 4).alias("clean_pct"), of_array(positive, "mid").alias("p50"), of_array(positive, "rint", 0.95).alias("p95"), "picks", F.round(F.least("opened", F.lit(600)) / 60.0, 6).alias("connects")
    )


RUNS = """count(*) AS n, count(*) FILTER (ok) AS n_ok, round(100.0::DOUBLE * count(*) FILTER (ok) / count(*), 4) AS success, round(avg(seconds), 6) AS mean,
 round(median(seconds), 6) AS median, round(avg(organic) FILTER (ok), 6) AS organic, round(avg(attempts), 6) AS attempts"""


@query(f"""SELECT name, {RUNS}, {q('seconds', 'rint', .95)} AS p95 FROM v_runs GROUP BY name UNION ALL SELECT 'TOTAL', {RUNS}, {q('seconds', 'rint', .95)} FROM v_runs""")
def agg19_run_summary(spark, d):
    r = V.run_results(spark, d)
    r = r.withColumn("name", F.explode(F.array("name", F.lit("TOTAL"))))
    ok = F.col("ok")
    base = r.groupBy("name").agg(
        A.count_if(ok).alias("n_ok"), A.share(A.count_if(ok), F.count("*"), 100.0, 4).alias("success"), F.round(F.avg("seconds"), 6).alias("mean"),
        F.round(F.avg(F.when(ok, F.col("organic"))), 6).alias("organic"), F.round(F.avg("attempts"), 6).alias("attempts"),
    )
    quant = exact_quantiles(r, ["name"], "seconds", {"p95": ("rint", 0.95), **MIDDLE})
    return base.join(with_median(quant, "median", 6), "name")


@query("SELECT attempts, count(*) AS n FROM v_runs GROUP BY attempts")
def agg20_value_dist(spark, d):
    return V.run_results(spark, d).groupBy("attempts").agg(F.count("*").alias("n"))


SITE = "CAST(round(seconds * 1000) AS BIGINT)"


@query(f"""WITH s AS (SELECT name AS site, ok, {SITE} AS bytes, attempts, organic, seconds, CASE WHEN ok THEN 200 WHEN attempts > 2 THEN 503 ELSE 403 END AS status FROM v_runs),
 c AS (SELECT site, string_agg(status || ':' || n, ',' ORDER BY status) AS statuses FROM (SELECT site, status, count(*) AS n FROM s GROUP BY ALL) GROUP BY site)
 SELECT s.site, count(*) AS n, round(count(*) FILTER (ok)::DOUBLE / count(*), 6) AS success, round(count(*) FILTER (ok AND organic > 50)::DOUBLE / count(*), 6) AS content,
 CAST(sum(bytes) FILTER (bytes > 0) AS BIGINT) AS bytes_total, CAST(floor(avg(bytes) FILTER (ok)) AS BIGINT) AS bytes_mean, {q('bytes', 'floor', .5, 'ok')} AS p50, {q('bytes', 'floor', .95, 'ok')} AS p95,
 round(avg(attempts), 6) AS attempts, round(avg(seconds), 6) AS latency, any_value(statuses) AS statuses FROM s JOIN c ON s.site = c.site GROUP BY s.site""")
def agg21_site_scale_summary(spark, d):
    status = F.when(F.col("ok"), 200).when(F.col("attempts") > 2, 503).otherwise(403)
    s = V.run_results(spark, d).withColumns({"bytes": F.round(F.col("seconds") * 1000).cast("long"), "status": status}).withColumnRenamed("name", "site")
    base = s.groupBy("site").agg(
        F.count("*").alias("n"), A.share(A.count_if(F.col("ok")), F.count("*")).alias("success"), A.share(A.count_if(F.col("ok") & (F.col("organic") > 50)), F.count("*")).alias("content"),
        F.sum(F.when(F.col("bytes") > 0, F.col("bytes"))).alias("bytes_total"), F.floor(F.avg(F.when(F.col("ok"), F.col("bytes")))).alias("bytes_mean"), F.round(F.avg("attempts"), 6).alias("attempts"), F.round(F.avg("seconds"), 6).alias("latency"),
    )
    pairs = F.array_sort(F.collect_list(F.struct("status", "c")))  # a handful of statuses
    statuses = s.groupBy("site", "status").agg(F.count("*").alias("c")).groupBy("site").agg(
        F.array_join(F.transform(pairs, lambda x: F.concat(x["status"].cast("string"), F.lit(":"), x["c"].cast("string"))), ",").alias("statuses")
    )
    quant = exact_quantiles(s.where("ok"), ["site"], "bytes", {"p50": ("floor", 0.5), "p95": ("floor", 0.95)}).drop("n")
    return base.join(quant, "site", "left").join(statuses, "site")


@query("""SELECT name, count(*) FILTER (organic > 0) AS with_data, count(*) FILTER (seconds < 0.5) AS captcha, count(*) FILTER (NOT ok) AS bad,
 round(avg(organic) FILTER (organic > 0), 6) AS mean_items, round(sum(seconds) / 1000, 6) AS mb_total, round(1000 * avg(seconds), 4) AS kb_per_request FROM v_runs GROUP BY name""")
def agg22_fetch_reliability(spark, d):
    some = F.col("organic") > 0
    return V.run_results(spark, d).groupBy("name").agg(
        A.count_if(some).alias("with_data"), A.count_if(F.col("seconds") < 0.5).alias("captcha"), A.count_if(~F.col("ok")).alias("bad"),
        F.round(F.avg(F.when(some, F.col("organic"))), 6).alias("mean_items"), F.round(F.sum("seconds") / 1000, 6).alias("mb_total"), F.round(1000 * F.avg("seconds"), 4).alias("kb_per_request"),
    )


@query("""WITH l AS (SELECT worker, worker % 3 AS pool, arg_max(bucket, line) AS state, count(*) FILTER (bucket IN ('view', 'error') AND value > 5) AS probes, count(*) FILTER (bucket = 'view' AND value > 5) AS clean,
 greatest(0, count(*) FILTER (bucket = 'click') - count(*) FILTER (bucket = 'purchase')) AS inflight FROM v_log GROUP BY worker)
 SELECT pool, state, count(*) AS workers, round(avg(100.0::DOUBLE * clean / probes) FILTER (probes > 0), 6) AS mean_clean, CAST(sum(probes) AS BIGINT) AS probes, CAST(sum(inflight) AS BIGINT) AS inflight FROM l GROUP BY pool, state
 UNION ALL SELECT pool, '*', count(*), round(avg(100.0::DOUBLE * clean / probes) FILTER (probes > 0), 6), CAST(sum(probes) AS BIGINT), CAST(sum(inflight) AS BIGINT) FROM l GROUP BY pool""")
def agg39_pool_snapshot(spark, d):
    """Workers by latest state in each pool and in all states: mean clean share of those with probes, probes, and what is in flight."""
    b, high = F.col("bucket"), F.col("value") > 5
    latest = V.log(spark, d).groupBy("worker").agg(
        F.max_by("bucket", "line").alias("state"), A.count_if((b == "view") & high).alias("clean"), A.count_if(b.isin("view", "error") & high).alias("n"),
        F.greatest(F.lit(0), A.count_if(b == "click") - A.count_if(b == "purchase")).alias("inflight"),
    )
    rows = latest.select((F.col("worker") % 3).alias("pool"), F.explode(F.array("state", F.lit("*"))).alias("state"), "clean", "n", "inflight")
    share = F.avg(F.when(F.col("n") > 0, 100.0 * F.col("clean") / F.col("n")))
    return rows.groupBy("pool", "state").agg(F.count("*").alias("workers"), F.round(share, 6).alias("mean_clean"), F.sum("n").alias("probes"), F.sum("inflight").alias("inflight"))


@query(f"""SELECT count(*) AS n, count(*) FILTER (bucket IN ('click', 'purchase')) AS main, count(*) FILTER (bucket = 'view') AS probes, count(*) FILTER (bucket = 'error' AND line % 3 = 0) AS rejects_503,
 count(*) FILTER (bucket = 'error' AND line % 3 <> 0) AS rejects_502, round(coalesce(count(*) FILTER (bucket = 'view' AND value > 20)::DOUBLE / nullif(count(*) FILTER (bucket = 'view'), 0), 0), 6) AS clean, {q('value', 'rint', .95)} AS p95 FROM v_log""")
def agg40_router_totals(spark, d):
    """Requests, probes, rejects by kind, and the share of clean probes among probes."""
    log = V.log(spark, d)
    is_, probe, gateway = (lambda *b: F.col("bucket").isin(*b)), F.col("bucket") == "view", F.col("line") % 3 == 0
    base = log.agg(
        A.count_if(is_("click", "purchase")).alias("main"), A.count_if(probe).alias("probes"), A.count_if(is_("error") & gateway).alias("rejects_503"), A.count_if(is_("error") & ~gateway).alias("rejects_502"),
        A.share(A.count_if(probe & (F.col("value") > 20)), A.count_if(probe)).alias("clean"),
    )
    return base.crossJoin(exact_quantiles(log, [], "value", {"p95": ("rint", 0.95)}))  # one row each


@query("""WITH p AS (SELECT worker, line, CASE WHEN bucket <> 'error' THEN bucket END AS ip, lag(bucket) OVER (PARTITION BY worker ORDER BY line) = bucket AND bucket <> 'error' AS same FROM v_log)
 SELECT worker, count(DISTINCT ip) AS uniq, count(ip) AS n, count(*) FILTER (same) AS repeats, coalesce(bool_or(ip = 'signup'), false) AS leak,
 CASE count(DISTINCT ip) WHEN 0 THEN 'down' WHEN 1 THEN 'sticky' ELSE 'changed ' || (count(DISTINCT ip) - 1) END AS verdict FROM p GROUP BY worker""")
def agg41_rotation_stats(spark, d):
    """Addresses that a worker's requests came from (failed ones have none): distinct, repeats of the request before, whether the
    own address (``signup`` here) leaked, and whether the session kept one address."""
    same = (F.lag("bucket").over(Window.partitionBy("worker").orderBy("line")) == F.col("bucket")) & (F.col("bucket") != "error")
    p = V.log(spark, d).withColumns({"same": same, "ip": F.when(F.col("bucket") != "error", F.col("bucket"))})
    g = p.groupBy("worker").agg(F.countDistinct("ip").alias("uniq"), F.count("ip").alias("n"), A.count_if(F.col("same")).alias("repeats"), F.coalesce(F.bool_or(F.col("ip") == "signup"), F.lit(False)).alias("leak"))
    verdict = F.when(F.col("uniq") == 0, "down").when(F.col("uniq") == 1, "sticky").otherwise(F.concat(F.lit("changed "), (F.col("uniq") - 1).cast("string")))
    return g.withColumn("verdict", verdict)


@query("""WITH p AS (SELECT 9000 + attempts AS port, ok, seconds FROM v_runs)
 SELECT port, count(*) AS n, count(*) FILTER (ok) AS n_ok, round(100.0::DOUBLE * count(*) FILTER (ok) / count(*), 4) AS pct, round(avg(seconds), 6) AS mean_all, round(avg(seconds) FILTER (ok), 6) AS mean_ok,
 round(median(seconds), 6) AS median_all, round(median(seconds) FILTER (ok), 6) AS median_ok, min(seconds) AS low, max(seconds) AS high, min(seconds) FILTER (ok) AS low_ok, max(seconds) FILTER (ok) AS high_ok FROM p GROUP BY port""")
def agg46_probe_port_summary(spark, d):
    p = V.run_results(spark, d).withColumn("port", 9000 + F.col("attempts")).withColumn("good", F.when(F.col("ok"), F.col("seconds")))
    base = p.groupBy("port").agg(
        F.count("*").alias("n"), A.count_if(F.col("ok")).alias("n_ok"), A.share(A.count_if(F.col("ok")), F.count("*"), 100.0, 4).alias("pct"), F.round(F.avg("seconds"), 6).alias("mean_all"),
        F.round(F.avg("good"), 6).alias("mean_ok"), F.min("seconds").alias("low"), F.max("seconds").alias("high"), F.min("good").alias("low_ok"), F.max("good").alias("high_ok"),
    )
    return base.join(true_median(p, ["port"], "seconds", "median_all", 6), "port").join(true_median(p, ["port"], "good", "median_ok", 6), "port", "left")


@query("""WITH l AS (SELECT max(t) AS now FROM v_log), c AS (SELECT worker, count(*) AS picks FROM v_log, l WHERE bucket = 'click' AND t >= now - 864000 GROUP BY worker)
 SELECT worker, picks, row_number() OVER (ORDER BY picks DESC, worker) AS rank FROM c QUALIFY rank <= 10""")
def agg46_top_workers(spark, d):
    """The ten workers with most picks in the last ten days of the log."""
    log = V.log(spark, d)
    c = log.where("bucket = 'click'").crossJoin(F.broadcast(log.agg(F.max("t").alias("now")))).where("t >= now - 864000").groupBy("worker").agg(F.count("*").alias("picks"))  # now: one row
    best = c.orderBy(F.desc("picks"), "worker").limit(10)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("picks"), "worker")).cast("long"))


ERRORS = ["net::ERR_PROXY_AUTH_UNSUPPORTED at x", "Timeout 30000ms exceeded", "net::ERR_TIMED_OUT", "net::ERR_TUNNEL_CONNECTION_FAILED", "SmartCaptcha shown", "timeout", ""]


@query(f"""WITH e AS (SELECT event_id AS line, CASE WHEN user_id % 9 = 8 THEN NULL ELSE ({ERRORS})[event_id % {len(ERRORS)} + 1] || ' ' || props END AS error FROM events)
 SELECT line, CASE WHEN contains(error, 'ERR_PROXY_AUTH_UNSUPPORTED') THEN 'proxy_auth' WHEN contains(error, 'Timeout') OR contains(error, 'ERR_TIMED_OUT') THEN 'timeout'
 WHEN contains(error, 'ERR_TUNNEL_CONNECTION_FAILED') THEN 'tunnel_failed' WHEN contains(lower(error), 'captcha') THEN 'captcha' ELSE 'other' END AS kind FROM e""")
def flt10_error_kind(spark, d):
    text = F.concat(F.element_at(F.array(*[F.lit(x) for x in ERRORS]), (F.col("event_id") % len(ERRORS) + 1).cast("int")), F.lit(" "), "props")
    return V.read(spark, d, "events").select(F.col("event_id").alias("line"), L.error_kind(F.when(F.col("user_id") % 9 != 8, text)).alias("kind"))


#: Lines on which the classification is tried: logger, message, and what is expected of them: bucket, url, port, ok, fail_kind, empty.
LINES = [
    ("httpx", "HTTP Request: POST http://localhost:20022/v1 ok", "llm", None, None, None, None, None),
    ("httpx", "HTTP Request: GET http://localhost:8080/search?q=a ok", "serp", None, None, None, None, None),
    ("httpx", "HTTP Request: GET https://a.example/x?y=1 ok", "scrape_httpx", "https://a.example/x?y=1", None, None, None, None),
    ("httpx", "closing", "other", None, None, None, None, None),
    ("openai._base_client", "Retrying request", "llm_retry_wait", None, None, None, None, None),
    ("app.searxng_client", "empty organic for q", "serp_meta", None, None, None, None, True),
    ("app.searxng_client", "10 results", "serp_meta", None, None, None, None, False),
    ("app.site_enricher", "Starting site enrichment proxy=socks5://h:9051", "enrich_start", None, "9051", None, None, None),
    ("app.site_enricher", "Starting site enrichment", "enrich_start", None, "?", None, None, None),
    ("app.site_enricher", "Extracted 40 words", "scrape_browser", None, None, True, None, None),
    ("app.site_enricher", "Site enrichment failed: net::ERR_TUNNEL", "scrape_browser", None, None, False, "proxy", None),
    ("app.site_enricher", "Site enrichment failed: no body", "scrape_browser", None, None, False, "other", None),
    ("app.site_enricher", "idle", "other", None, None, None, None, None),
    ("app.research.tools", "submit", "marker", None, None, None, None, None),
    ("app.research.agent", "forced", "llm", None, None, None, None, None),
    ("taskiq", "GET https://a.example/", "other", None, None, None, None, None),
]


def _value(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'"


@query(f"""WITH x(k, bucket, url, port, ok, fail_kind, empty) AS (VALUES {', '.join(f"({k}, {', '.join(_value(v) for v in line[2:])})" for k, line in enumerate(LINES))})
 SELECT event_id AS line, x.* EXCLUDE (k) FROM events JOIN x ON event_id % {len(LINES)} = k""")
def flt11_log_bucket(spark, d):
    of = lambda i: F.element_at(F.array(*[F.lit(line[i]) for line in LINES]), (F.col("event_id") % len(LINES) + 1).cast("int"))
    m = V.read(spark, d, "events").select(F.col("event_id").alias("line"), of(0).alias("logger"), F.concat(of(1), F.when(F.col("event_id") % 16 == 1, F.concat(F.lit(" "), "props")).otherwise("")).alias("msg"))
    return m.select("line", L.log_bucket(F.col("logger"), F.col("msg")).alias("b")).select("line", "b.*")


@query("""WITH p AS (SELECT run, CASE WHEN ok THEN 200 ELSE 503 END AS http, organic, CASE WHEN organic % 4 = 0 THEN ['google', 'duckduckgo'] WHEN organic % 4 = 1 THEN ['google'] ELSE [] END AS bad FROM v_runs)
 SELECT run, CASE WHEN http >= 400 THEN 'http' WHEN len(bad) = 2 THEN 'engines' WHEN organic < 10 THEN 'few' ELSE 'clean' END AS verdict, len(bad) AS n_bad FROM p""")
def flt12_probe_verdict(spark, d):
    k = F.col("organic") % 4
    bad = F.when(k == 0, F.array(F.lit("google"), F.lit("duckduckgo"))).when(k == 1, F.array(F.lit("google"))).otherwise(F.array().cast("array<string>"))
    p = V.run_results(spark, d).select("run", F.when(F.col("ok"), 200).otherwise(503).alias("http"), "organic", bad.alias("bad"))
    both = F.size(F.array_intersect("bad", F.array(F.lit("google"), F.lit("duckduckgo"))))
    return p.select("run", F.when(F.col("http") >= 400, "http").when(both == 2, "engines").when(F.col("organic") < 10, "few").otherwise("clean").alias("verdict"), F.size("bad").cast("long").alias("n_bad"))


@query("""WITH w AS (SELECT worker, list_sort(list(DISTINCT bucket)) AS states FROM v_log GROUP BY worker)
 SELECT worker, len(list_intersect(states, ['click', 'error', 'none'])) AS common, len(list_filter(['click', 'error', 'none'], lambda x: NOT list_contains(states, x))) AS missing FROM w""")
def set3_array_set_checks(spark, d):
    wanted = F.array(F.lit("click"), F.lit("error"), F.lit("none"))
    w = V.log(spark, d).groupBy("worker").agg(F.collect_set("bucket").alias("states"))
    return w.select("worker", F.size(F.array_intersect("states", wanted)).cast("long").alias("common"), F.size(F.array_except(wanted, F.col("states"))).cast("long").alias("missing"))


LIMITED = """WITH g AS (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY worker ORDER BY line) >= 36000)::BIGINT, 1) AS new FROM v_log),
 s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY worker ORDER BY line) AS BIGINT) AS session FROM g)
 SELECT worker, line, session, row_number() OVER (PARTITION BY worker, session ORDER BY line) AS n, row_number() OVER (PARTITION BY worker, session ORDER BY line) <= 3 AS allowed FROM s"""


@query(LIMITED)
def str4_rate_limit_batch(spark, d):
    return W.rate_limited(V.log(spark, d), "worker", "t", "line", 3, 36000.0).select("worker", "line", "session", "n", "allowed")


@query(LIMITED)
def str4_rate_limit_stream(spark, d):
    return K.rate_limits(spark, V.log(spark, d).select("worker", "line", "t"), 3, 36000.0)


SESSIONS_600 = """WITH g AS (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY worker ORDER BY t) >= 600)::BIGINT, 1) AS new FROM v_log),
 s AS (SELECT *, sum(new) OVER (PARTITION BY worker ORDER BY t) AS session FROM g)
 SELECT worker, count(*) AS n, CAST(floor(min(t)) AS BIGINT) AS began FROM s GROUP BY worker, session"""


def _seconds(ts):
    return F.floor(V.micros(ts.cast("timestamp_ntz")) / 1e6).cast("long")


def _timed(spark, d):
    return V.read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("worker"), F.col("event_type").alias("bucket"), "value")


@query(SESSIONS_600)
def str5_inactivity_sessions(spark, d):
    s = _timed(spark, d).groupBy("worker", F.session_window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("ts"))
    return s.select("worker", "n", _seconds(F.col("ts")).alias("began"))


@query(SESSIONS_600)
def str5_inactivity_stream(spark, d):
    s = S.inactivity_sessions(spark, _timed(spark, d).select("worker", "ts"))
    return s.select("worker", "n", _seconds(F.col("ts")).alias("began"))


HEARTBEAT = "SELECT CAST(floor(t / 3600) AS BIGINT) * 3600 AS began, bucket, count(*) AS n, round(sum(value), 4) AS total FROM v_log GROUP BY ALL"


@query(HEARTBEAT)
def str6_heartbeat_window(spark, d):
    w = _timed(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "bucket").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(_seconds(F.col("w.start")).alias("began"), "bucket", "n", "total")


@query(HEARTBEAT)
def str6_heartbeat_stream(spark, d):
    w = S.windowed(spark, _timed(spark, d).select("ts", "bucket", "value"), "1 hour").latest()
    return w.select(_seconds(F.col("ts")).alias("began"), "bucket", "n", F.round("total", 4).alias("total"))


SLIDING = """WITH s AS (SELECT CAST(floor(t / 1800) AS BIGINT) * 1800 - unnest([0, 1800]) AS began, bucket FROM v_log)
 SELECT began, bucket, count(*) AS n, round(count(*) / 3600.0::DOUBLE, 8) AS per_second FROM s GROUP BY ALL"""


@query(SLIDING)
def str7_sliding_rate(spark, d):
    w = _timed(spark, d).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "bucket").agg(F.count("*").alias("n"))
    return w.select(_seconds(F.col("w.start")).alias("began"), "bucket", "n", F.round(F.col("n") / 3600.0, 8).alias("per_second"))


@query(SLIDING)
def str7_sliding_stream(spark, d):
    w = S.windowed(spark, _timed(spark, d).select("ts", "bucket", "value"), "1 hour", "30 minutes").latest()
    return w.select(_seconds(F.col("ts")).alias("began"), "bucket", "n", F.round(F.col("n") / 3600.0, 8).alias("per_second"))


@query("SELECT CAST(floor(t / 10) AS BIGINT) * 10 AS began, bucket, count(*) AS n, round(sum(value), 4) AS total FROM v_log GROUP BY ALL")
def str6_heartbeat_10s_stream(spark, d):
    """A snapshot every ten seconds."""
    w = S.windowed(spark, _timed(spark, d).select("ts", "bucket", "value"), "10 seconds").latest()
    return w.select(_seconds(F.col("ts")).alias("began"), "bucket", "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT CAST(floor(t / 10) AS BIGINT) * 10 - unnest([0, 10, 20, 30, 40, 50]) AS began, bucket FROM v_log)
 SELECT began, bucket, count(*) AS n, round(count(*) / 60.0::DOUBLE, 8) AS per_second FROM s GROUP BY ALL""")
def str7_sliding_60s_stream(spark, d):
    """The rate over the last sixty seconds, every ten."""
    w = S.windowed(spark, _timed(spark, d).select("ts", "bucket", "value"), "60 seconds", "10 seconds").latest()
    return w.select(_seconds(F.col("ts")).alias("began"), "bucket", "n", F.round(F.col("n") / 60.0, 8).alias("per_second"))
