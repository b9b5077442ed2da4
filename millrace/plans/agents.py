"""Queries over runs of turns: repeated queries, visit caps, call times."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.nested import strip_reasoning
from millrace.functions.quantiles import exact_quantiles
from millrace.functions.text import norm_query
from millrace.operators import aggregates as A
from millrace.operators import filters as L
from millrace.operators import windows as W
from millrace.plans import views as V
from millrace.plans.catalog import q
from millrace.plans.registry import query

NORM = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g'))"


def _norm():
    return norm_query(F.coalesce("text", F.lit("")))


@query(f"""WITH n AS (SELECT run, {NORM} AS norm FROM v_turns), r AS (SELECT run, count(*) AS n, count(DISTINCT norm) AS uniq FROM n GROUP BY run)
 SELECT run, n, round((n - uniq)::DOUBLE / n, 6) AS fraction, (n - uniq)::DOUBLE / n >= 0.3 AS repetitive FROM r""")
def ded7_dup_query_fraction(spark, d):
    r = V.turns(spark, d).select("run", _norm().alias("norm")).groupBy("run").agg(F.count("*").alias("n"), F.countDistinct("norm").alias("uniq"))
    f = (F.col("n") - F.col("uniq")) / F.col("n")
    return r.select("run", "n", F.round(f, 6).alias("fraction"), (f >= 0.3).alias("repetitive"))


@query(f"WITH n AS (SELECT run, turn, {NORM} AS norm FROM v_turns) SELECT run, turn, norm <> '' AND row_number() OVER (PARTITION BY run, norm ORDER BY turn) > 1 AS repeated FROM n")
def win12_repeat_query(spark, d):
    return W.repeat_query(V.turns(spark, d), _norm()).select("run", "turn", "repeated")


VISITS = """WITH v AS (SELECT user_id AS run, event_id AS turn, 'p' || (event_id % 23) || '.' || (event_id % 3) AS url, 'p' || (event_id % 3) AS domain, value > 30 AS failed FROM events),
 u AS (SELECT *, row_number() OVER (PARTITION BY run, url ORDER BY turn) > 1 AS dup FROM v),
 c AS (SELECT *, CASE WHEN dup THEN 'duplicate' WHEN sum((NOT dup)::INT) OVER (PARTITION BY run, domain ORDER BY turn) > 3 THEN 'capped' ELSE 'fetch' END AS verdict FROM u) """


def _visits(spark, d):
    k = F.col("event_id")
    s = lambda c: c.cast("string")
    return V.read(spark, d, "events").select(
        F.col("user_id").alias("run"), k.alias("turn"), F.concat(F.lit("p"), s(k % 23), F.lit("."), s(k % 3)).alias("url"), F.concat(F.lit("p"), s(k % 3)).alias("domain"), (F.col("value") > 30).alias("failed")
    )


@query(VISITS + "SELECT run, turn, verdict FROM c")
def win11_visit_cap(spark, d):
    return W.visit_cap(_visits(spark, d)).select("run", "turn", "verdict")


@query(VISITS + "SELECT run, domain, count(*) AS failures FROM c WHERE failed AND domain <> 'p0' GROUP BY run, domain HAVING count(*) >= 3")
def win14_blocked_domains(spark, d):
    never = _visits(spark, d).select("domain").distinct().where("domain = 'p0'")
    return _visits(spark, d).where("failed").join(never, "domain", "left_anti").groupBy("run", "domain").agg(F.count("*").alias("failures")).where("failures >= 3")


@query("""WITH s AS (SELECT user_id AS run, event_id AS turn, event_type, row_number() OVER (PARTITION BY user_id, value > 20, event_type ORDER BY event_id) > 4 AS dup FROM events),
 r AS (SELECT *, sum((event_type IN ('view', 'click'))::INT) OVER w AS searches, sum((event_type = 'purchase')::INT) OVER w AS scrapes FROM s WINDOW w AS (PARTITION BY run ORDER BY turn))
 SELECT run, turn, searches >= 4 AND 2 * scrapes < searches AND NOT dup AS flagged FROM r WHERE event_type IN ('view', 'click')""")
def win13_search_balance(spark, d):
    e = V.read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("turn"), "event_type", "value")
    dup = F.row_number().over(Window.partitionBy("run", F.col("value") > 20, "event_type").orderBy("turn")) > 4
    search = F.col("event_type").isin("view", "click")
    e = e.withColumn("dup", dup)
    r = e.withColumns({"s": W.running_count(e, search, ["run"], ["turn"]), "p": W.running_count(e, F.col("event_type") == "purchase", ["run"], ["turn"])})
    return r.where(search).select("run", "turn", ((F.col("s") >= 4) & (2 * F.col("p") < F.col("s")) & ~F.col("dup")).alias("flagged"))


@query("SELECT run, arg_max(kind, turn) AS last_kind, arg_min(kind, turn) AS first_kind, max(turn) AS last_turn FROM v_turns GROUP BY run")
def win15_last_event(spark, d):
    return V.turns(spark, d).groupBy("run").agg(F.max_by("kind", "turn").alias("last_kind"), F.min_by("kind", "turn").alias("first_kind"), F.max("turn").alias("last_turn"))


@query("""WITH s AS (SELECT run, turn, len(coalesce(text, '')) % 11 AS score, CASE WHEN len(coalesce(text, '')) % 13 = 0 THEN 'pass' ELSE 'rework' END AS verdict FROM v_turns)
 SELECT run, turn, score >= 7 OR verdict = 'pass' OR turn >= 3 AS accepted FROM s""")
def flt20_accept_submission(spark, d):
    n = F.char_length(F.coalesce("text", F.lit("")))
    return V.turns(spark, d).select("run", "turn", L.accepted(n % 11, F.when(n % 13 == 0, "pass").otherwise("rework"), F.col("turn"), 7, 2).alias("accepted"))


CALLS = """WITH c AS (SELECT run, turn, CASE WHEN len(coalesce(text, '')) % 9 = 0 THEN kind || '_failed' ELSE kind END AS kind, len(coalesce(text, '')) AS ctx, len(coalesce(text, '')) % 97 AS s, host FROM v_turns) """


def _calls(spark, d):
    n = F.char_length(F.coalesce("text", F.lit(""))).cast("long")
    failed = F.when(n % 9 == 0, F.concat("kind", F.lit("_failed"))).otherwise(F.col("kind"))
    return V.turns(spark, d).select("run", "turn", failed.alias("kind"), n.alias("ctx"), (n % 97).alias("s"), "host")


@query(CALLS + f""", t AS (SELECT *, CASE WHEN kind NOT LIKE '%_failed' THEN ctx END AS prompt, CASE WHEN kind NOT LIKE '%_failed' THEN turn END AS completion FROM c),
 w AS (SELECT kind, count(*) AS n, CAST(sum(s) AS BIGINT) AS total, {q('s', 'floor', .5)} AS med, {q('s', 'floor', .9)} AS p90, coalesce(max(prompt), 0) AS ctx_max FROM t GROUP BY kind),
 p AS (SELECT kind, {q('ctx', 'floor', .5)} AS ctx_med, {q('ctx', 'floor', .9)} AS ctx_p90, {q('turn', 'floor', .5)} AS out_med, {q('turn', 'floor', .9)} AS out_p90 FROM c WHERE kind NOT LIKE '%_failed' GROUP BY kind)
 SELECT w.*, coalesce(ctx_med, 0) AS ctx_med, coalesce(ctx_p90, 0) AS ctx_p90, coalesce(out_med, 0) AS out_med, coalesce(out_p90, 0) AS out_p90 FROM w LEFT JOIN p ON p.kind = w.kind""")
def agg35_call_kind_dist(spark, d):
    """Seconds of all calls; context and completion tokens of those that didn't fail (a kind of failed calls has none)."""
    c = _calls(spark, d)
    done = c.where(~F.endswith("kind", F.lit("_failed")))
    base = c.groupBy("kind").agg(F.sum("s").alias("total"), F.max(F.when(~F.endswith("kind", F.lit("_failed")), F.col("ctx"))).alias("ctx_max"))
    out = base.join(exact_quantiles(c, ["kind"], "s", {"med": ("floor", 0.5), "p90": ("floor", 0.9)}), "kind")
    for col, name in (("ctx", "ctx"), ("turn", "out")):
        out = out.join(exact_quantiles(done, ["kind"], col, {f"{name}_med": ("floor", 0.5), f"{name}_p90": ("floor", 0.9)}).drop("n"), "kind", "left")
    tokens = ["ctx_max", "ctx_med", "ctx_p90", "out_med", "out_p90"]
    return out.select("kind", "n", "total", "med", "p90", *[F.coalesce(t, F.lit(0)).cast("long").alias(t) for t in tokens])


@query(CALLS + f"SELECT host AS method, count(*) AS n, {q('s', 'floor', .5)} AS med, {q('s', 'floor', .9)} AS p90, CAST(sum(s) AS BIGINT) AS total, round(count(*) FILTER (ctx = 0)::DOUBLE / count(*), 6) AS zero_share FROM c GROUP BY host")
def agg36_method_dist(spark, d):
    c = _calls(spark, d)
    base = c.groupBy(F.col("host").alias("method")).agg(F.sum("s").alias("total"), A.share(A.count_if(F.col("ctx") == 0), F.count("*")).alias("zero_share"))
    return base.join(exact_quantiles(c.withColumnRenamed("host", "method"), ["method"], "s", {"med": ("floor", 0.5), "p90": ("floor", 0.9)}), "method")


@query(CALLS + f"SELECT count(*) AS n, count(*) FILTER (ctx % 7 = 0) AS zero, CAST(round(100.0::DOUBLE * count(*) FILTER (ctx % 7 = 0) / greatest(1, count(*))) AS BIGINT) AS zero_percent, {q('s', 'floor', .5)} AS med, {q('s', 'floor', .9)} AS p90, CAST(sum(s) AS BIGINT) AS total FROM c WHERE kind = 'user'")
def agg36_serp_walls(spark, d):
    """Search calls (the users' turns): how many gave nothing, and their seconds."""
    c = _calls(spark, d).where("kind = 'user'")
    zero = A.count_if(F.col("ctx") % 7 == 0)
    base = c.agg(zero.alias("zero"), F.round(100.0 * zero / F.greatest(F.lit(1), F.count("*"))).cast("long").alias("zero_percent"), F.sum("s").alias("total"))
    return base.crossJoin(exact_quantiles(c, [], "s", {"med": ("floor", 0.5), "p90": ("floor", 0.9)}))  # one row each


@query(CALLS + "SELECT split_part('10.0.0.1:' || ascii(host), ':', -1) AS port, count(*) AS n FROM c WHERE s > 5 GROUP BY 1")
def agg36_waste_ports(spark, d):
    port = F.substring_index(F.concat(F.lit("10.0.0.1:"), F.ascii("host").cast("string")), ":", -1)
    return _calls(spark, d).where("s > 5").groupBy(port.alias("port")).agg(F.count("*").alias("n"))


@query(CALLS + """SELECT run, CAST(coalesce(sum(s) FILTER (kind = 'user'), 0) AS BIGINT) AS user_s, CAST(coalesce(sum(s) FILTER (kind = 'assistant'), 0) AS BIGINT) AS assistant_s, CAST(coalesce(sum(s) FILTER (kind LIKE '%failed'), 0) AS BIGINT) AS failed_s,
 CAST(coalesce(sum(s) FILTER (host < '8'), 0) AS BIGINT) AS serp_s, CAST(coalesce(sum(s) FILTER (host >= '8'), 0) AS BIGINT) AS scrape_s, CAST(coalesce(sum(s) FILTER (host >= '8' AND s > 5 AND kind LIKE '%failed'), 0) AS BIGINT) AS waste_s,
 CAST(sum(s) AS BIGINT) AS accounted, CAST(max(turn) * 100 - sum(s) AS BIGINT) AS unaccounted FROM c GROUP BY run""")
def agg37_run_perf_totals(spark, d):
    of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("s"))), F.lit(0)).cast("long")
    kind = F.col("kind")
    return _calls(spark, d).groupBy("run").agg(
        of(kind == "user").alias("user_s"), of(kind == "assistant").alias("assistant_s"), of(F.endswith(kind, F.lit("failed"))).alias("failed_s"),
        of(F.col("host") < "8").alias("serp_s"), of(F.col("host") >= "8").alias("scrape_s"), of((F.col("host") >= "8") & (F.col("s") > 5) & F.endswith(kind, F.lit("failed"))).alias("waste_s"), F.sum("s").alias("accounted"), (F.max("turn") * 100 - F.sum("s")).alias("unaccounted")
    )


@query(r"""SELECT run, turn, regexp_replace(CASE turn % 4 WHEN 0 THEN 'b' || 'a' WHEN 1 THEN 'ba' || coalesce(text, '') WHEN 2 THEN 'c' ELSE coalesce(text, '') END, '^\s+|\s+$', '', 'g') AS text FROM v_turns""")
def sca32_strip_reasoning(spark, d):
    t, k = F.coalesce("text", F.lit("")), F.col("turn") % 4
    flat = F.regexp_replace(t, r"\s+", " ")
    raw = F.when(k == 0, F.concat(F.lit("b<think>"), flat, F.lit("</think>a"))).when(k == 1, F.concat(F.lit("b<Thinking x=1>"), flat, F.lit("\n \t\na"), t))
    raw = raw.when(k == 2, F.concat(F.lit("c<think>"), flat)).otherwise(t)
    return V.turns(spark, d).select("run", "turn", strip_reasoning(raw).alias("text"))


@query("""WITH o AS (SELECT run, list(kind ORDER BY turn) AS kinds, list_sort(list(DISTINCT host)) AS hosts, count(*) AS n, arg_min(host, turn) AS anchor, CAST(sum(len(coalesce(text, ''))) AS BIGINT) AS chars FROM v_turns GROUP BY run)
 SELECT run, substr('{"anchor":{"name":"' || anchor || '","chars":' || chars || '},"turns":' || n || ',"critic":"' || kinds[-1] || '","queries_history":[' || array_to_string(list_transform(kinds[1:40], lambda x: '"' || x || '"'), ',')
 || '],"visited_domains":[' || array_to_string(list_transform(hosts[1:25], lambda x: '"' || x || '"'), ',') || ']}', 1, 14000) AS digest FROM o""")
def sca34_run_digest(spark, d):
    """Anchor fields, last event, first 40 queries and 25 sorted domains of a run, as JSON of 14,000 characters at most."""
    o = V.turns(spark, d).groupBy("run").agg(
        F.array_sort(F.collect_list(F.struct("turn", "kind"))).alias("t"), F.array_sort(F.collect_set("host")).alias("hosts"), F.count("*").alias("turns"),
        F.min_by("host", "turn").alias("name"), F.sum(F.char_length(F.coalesce("text", F.lit(""))).cast("long")).alias("chars"),
    )
    digest = F.struct(
        F.struct("name", "chars").alias("anchor"), "turns", F.element_at("t.kind", -1).alias("critic"), F.slice("t.kind", 1, 40).alias("queries_history"), F.slice("hosts", 1, 25).alias("visited_domains")
    )
    return o.select("run", F.substring(F.to_json(digest), 1, 14_000).alias("digest"))
