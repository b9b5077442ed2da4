"""Small hand-made rows for each rule that is easy to get wrong."""

import random
import statistics
import time
import weakref

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import nested, quantiles, text
from millrace.functions.quantiles import exact_quantiles, of_array
from millrace.operators import aggregates, dedup, filters, windows
from millrace.plans import registry
from millrace.sources import normalise, page_text, readers
from millrace.streaming import monitor, state


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(col.alias("x")).first()["x"]


def test_quantile_rules(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 9)], "v int")
    got = exact_quantiles(df, [], "v", {"rint": ("rint", 0.5), "floor": ("floor", 0.5), "mid": ("mid", 0.5)}).first()
    assert tuple(got) == (8, 5, 5, 5)
    for values, want in (([], None), ([3], 3), ([1, 2], 1)):
        assert one(spark, of_array(F.lit(values).cast("array<int>") if not values else F.array(*map(F.lit, values)), "rint")) == want


def test_unicode_norms(spark):
    assert one(spark, text.norm_query(F.col("t")), t="Über die 3 Straßen: l'été—niño_x") == "über die 3 straßen l été niño_x"
    assert one(spark, text.norm_query(F.col("t")), t="Привет, мир_1!") == "привет мир_1"


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([("a", "one", 1), ("a", "two", 2), ("", "none", 3), (None, "null", 4), ("b", "x", 5)], "id string, title string, ord int")
    assert [tuple(r) for r in dedup.dedup_first(df, ["id"], ["ord"]).orderBy("ord").collect()] == [("a", "one", 1), ("b", "x", 5)]
    assert [(r.id, r.title, r.pos) for r in dedup.dedup_last(df, ["id"], "ord").orderBy("pos").collect()] == [("a", "two", 1), ("b", "x", 5)]


def test_only_new_keeps_repeats_in_a_batch(spark):
    df = spark.createDataFrame([("s", "1"), ("s", "1"), ("s", "2"), ("s", "")], "source string, id string")
    seen = spark.createDataFrame([("s", "2")], "source string, id string")
    assert filters.only_new(df, seen).count() == 2


def test_sweep_stream_matches_and_forgets(spark, tmp_path):
    items = [("a", "1", "python job", 1), ("a", "2", "cook", 2), ("a", "3", "Python dev", 3), ("b", "4", "python", 4)]
    rows = spark.createDataFrame(items, "source string, id string, title string, ord int")
    seen = spark.createDataFrame([("a", "3"), ("b", "4")], "source string, id string")
    assert {r.id for r in monitor.run_sweeps(spark, rows, seen, ["python"]).collect()} == {"1"}
    sweeps = [(0, "a", "1"), (3, "a", "1"), (10, "a", "1"), (10, "b", "4"), (18, "a", "1"), (19, "a", "1"), (19, "b", "4"), (19, "a", "2")]
    for day in sorted({s[0] for s in sweeps}):  # a file a sweep, one after the other
        part = spark.createDataFrame([(s, i, "python", 10 * day + int(i), d) for d, s, i in sweeps if d == day], "source string, id string, title string, ord int, day int")
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/sweeps")
        time.sleep(0.05)
    stream = spark.read.parquet(f"file://{tmp_path}/sweeps").repartitionByRange(5, "day").sortWithinPartitions("ord")
    got = monitor.run_sweeps(spark, stream.coalesce(1), seen.limit(0), ["python"]).collect()
    assert {(r.source, r.id) for r in got} == {("a", "1"), ("b", "4"), ("a", "2")}  # one sweep
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 1)
    try:
        got = monitor.run_sweeps(spark, stream.coalesce(1), seen.limit(0), ["python"], files=1).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted(r.ord for r in got) == [1, 104, 181, 192, 194]  # a: days 0, 18 and new 19; b: days 10 and 19
    counts = {r.source: tuple(r)[1:] for r in monitor.sweep_counts(rows, seen, ["python"]).collect()}
    assert counts == {"a": (3, 2, 1), "b": (1, 1, 0)}


def test_rate_counter_resets_only_after_idle_window(spark):
    at = [0.0, 10.0, 20.0, 30.0, 3629.0, 7229.0]
    df = spark.createDataFrame([("k", t, i) for i, t in enumerate(at)], "k string, t double, i int")
    got = windows.rate_limited(df, "k", "t", "i", 3, 3600.0).orderBy("i").collect()
    assert [(r.n, r.allowed) for r in got] == [(1, True), (2, True), (3, True), (4, False), (5, False), (1, True)]


def test_globs(spark):
    got = spark.createDataFrame([("maps.yandex.ru",), ("yandex.ru",)], "h string").select(filters.first_glob(F.col("h"), ["*.yandex.*", "*"])).collect()
    assert [r[0] for r in got] == ["*.yandex.*", "*"]


def test_gap_boundary_and_episodes(spark):
    df = spark.createDataFrame([(1, 1, 0.0, "a"), (1, 2, 899.0, "b"), (1, 3, 1799.0, "m"), (1, 4, 1800.0, "c")], "worker int, line int, t double, bucket string")
    got = windows.gap_attribution(df, ["m"]).orderBy("line").collect()
    assert [(r.idle, r.credit) for r in got] == [(False, 0.0), (False, 899.0), (False, 0.0), (False, 1.0)]  # markers are never idle
    runs = spark.createDataFrame([(1, 1, 0.0, "s"), (1, 2, 5.0, "s"), (1, 3, 9.0, "e"), (1, 4, 10.0, "e")], "worker int, line int, t double, bucket string")
    pairs = windows.episode_pairing(runs, F.col("bucket") == "s", F.col("bucket") == "e").collect()
    assert [(r.start_line, r.end_line, r.seconds) for r in pairs] == [(2, 3, 4.0)]


def test_buckets_keep_empty_ones(spark):
    df = spark.createDataFrame([("x", v) for v in (0, 10, 11, 50, 200, 201)], "k string, v int")
    edges = [("0", 0), ("1-10", 10), ("11-50", 50), ("51-200", 200), ("201-300", 300), ("301+", None)]
    assert {r.bucket: r.n for r in aggregates.labelled_buckets(df, "v", edges, ["k"]).collect()} == {"0": 1, "1-10": 1, "11-50": 2, "51-200": 1, "201-300": 1, "301+": 0}


def test_titles(spark):
    rows = [(1, "Brand «X»", "a", 5.0), (2, "brand x", "b", None), (3, "Магазин №1", "a", 1.0), (4, "Магазин №1", "b", 1.0), (5, "", "c", 2.0), (6, None, "c", 2.0)]
    got = {r.key: (r.oid, r.size) for r in dedup.dedup_title(dedup.title_key(spark.createDataFrame(rows, "oid int, title string, category string, dist double"))).collect()}
    assert got["named::brand x"] == (1, 2)
    assert len([k for k in got if k.startswith("generic::магазин")]) == 2 and got["generic::::c"] == (5, 2)


def test_html_functions(spark):
    assert one(spark, text.clean_html(F.col("h")), h="<p>a</p><p>b</p>") == "ab"
    assert one(spark, text.html_to_text(F.col("h")), h="<p>a</p><p>b</p>") == "a\n\nb"
    assert one(spark, text.html_to_text(F.col("h")), h="<head><title>t</title></head><h1>T</h1><button>b</button><div>c</div>d<br>e") == "T\n\nbc\nd\ne"
    assert one(spark, text.clean_html(F.col("h")), h="x<!-- y --><nav>n</nav> &amp;lt;") == "x &lt;"
    assert page_text.markdown('<h2>T</h2><p>a <a href="/u">l</a><img src="i" alt="A"></p><script>x</script>') == "## T\n\na [l](/u)![A](i)"
    assert page_text.first_json('x {bad} {"a": {"b": 1}} {') == '{"a": {"b": 1}}'
    assert page_text.first_json('{"z": 0} ```json\n[1, 2]\n```') == "[1, 2]" and page_text.first_json("see [1] and {2}") == "[1]" and page_text.first_json("none") is None


def test_truncate(spark):
    assert [one(spark, text.truncate_words(F.col("t"), 3), t=t) for t in ("a b c", "a b c d", "a b c. d", "a b , d e")] == ["a b c", "a b c...", "a b c...", "a b..."]


def test_goal_spans_merge(spark):
    for gap, n in ((850, 1), (851, 2)):
        t = "x" * 500 + "KEY" + "y" * gap + "KEY" + "z" * 500
        assert one(spark, text.goal_extract(F.col("t"), "KEY", 9_999), t=t).count("‖") == n - 1
    assert one(spark, text.goal_extract(F.col("t"), "KEY", 5), t="nothing here") == "nothi"


def test_domains_and_handles(spark):
    assert [one(spark, text.norm_domain(F.col("u")), u=u) for u in ("http://WWW.A.org:80/x", "https://m.b.de", "no scheme")] == ["a.org:80", "b.de", ""]


def test_nested(spark):
    assert one(spark, nested.strip_reasoning(F.col("t")), t="a<think>b</think>c") == "ac"
    assert one(spark, nested.strip_reasoning(F.col("t")), t="a<think>b\n\nc") == "ac"
    assert one(spark, nested.strip_reasoning(F.col("t")), t="a<THINKING x>b\n \t\nc\n\nd") == "ac\n\nd"
    got = one(spark, nested.org_from_raw(F.col("r")), r='{"permalink":"7","coordinates":[1.0,2.0],"ratingData":{},"rating":4.0}')
    assert (got.oid, got.lat, got.lon, got.rating) == ("7", 2.0, 1.0, None)


def test_upsert(spark):
    ddl = "oid int, model_key string, mtime int, review_status string"
    t = spark.createDataFrame([(1, "m", 1, "new"), (2, "m", 1, "edited"), (3, "m", 1, "new")], ddl)
    u = spark.createDataFrame([(1, "m", 2, "u"), (2, "m", 2, "u"), (3, "m", 1, "u"), (4, "m", 1, "u")], ddl)
    assert {r.oid: (r.mtime, r.review_status) for r in readers.upsert_cards(t, u).collect()} == {1: (2, "u"), 2: (1, "edited"), 3: (1, "new"), 4: (1, "u")}


def test_unknown_source(spark):
    with pytest.raises(KeyError):
        normalise.selected("hh,nowhere")


def test_corrupt_records_are_set_aside(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}')
    (tmp_path / "b.json").write_text('{"id": ')
    good, bad = readers.read_records(spark, f"file://{tmp_path}", "id long")
    assert [r.id for r in good.collect()] == [1]


def test_stream_twins(spark):
    rows = spark.createDataFrame([(1, i, float(i), f) for i, f in enumerate([True, True, False, False, True])], "worker long, line long, t double, flag boolean")
    got = sorted(r.line for r in state.status_changes(spark, rows.select("worker", "line", "flag")).collect())
    assert got == [0, 2, 4] == sorted(r.line for r in windows.change_only(rows, "worker", "line", F.col("flag")).collect())
    slow = spark.createDataFrame([(1, i, i * 100.0, 1.0) for i in range(6)], "worker long, line long, t double, value double")
    assert [r.line for r in state.degradation_alerts(spark, slow).collect()] == [2]


def test_repeats_compare_whole_texts(spark, tmp_path):
    turns = ["Where is Oslo?", "Where is Rome?", "where is -- OSLO", None, " ", "Where is Oslo, and where is it not?"]
    rows = [(1, k, "user", t) for k, t in enumerate(turns)] + [(2, k, "user", "Summary of day " + str(k)) for k in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    run = lambda name: registry.QUERIES[name](spark, f"file://{tmp_path}").collect()
    assert [(r.run, r.turn) for r in run("win12_repeat_query") if r.repeated] == [(1, 2)]
    assert {(r.run, r.n, r.fraction, r.repetitive) for r in run("ded7_dup_query_fraction")} == {(1, 6, 0.333333, True), (2, 4, 0.0, False)}


def _plain_alerts(rows, span=86_400.0, least=3, floor=20.0, quiet=172_800.0):
    out, of = [], {}
    for worker, line, t, v in sorted(rows, key=lambda r: r[1]):
        seen, until = of.get(worker, ([], -1e18))
        seen = [x for x in [*seen, (t, v)] if x[0] >= t - span]
        rate = sum(x[1] for x in seen) / len(seen)
        if len(seen) >= least and rate < floor and t >= until:
            out.append((worker, line, round(rate, 9)))
            seen, until = [], t + quiet
        of[worker] = (seen, until)
    return sorted(out)


def test_alerts_hold_one_chunk_at_a_time(spark):
    live, most = [], 0

    def chunks():
        nonlocal most
        for k in range(0, 60_000, 1_000):
            most = max(most, sum(r() is not None for r in live))
            n = range(k, k + 1_000)
            cols = {"worker": [1] * 1_000, "line": n, "t": [i * 500.0 for i in n], "value": [float(i * i % 61) for i in n], "kind": ["row"] * 1_000}
            live.append(weakref.ref(b := pa.RecordBatch.from_pydict(cols, schema=state.ALERTS)))
            yield b
            del b

    got = [r for b in state.walk(chunks(), 86_400.0, 3, 20.0, 172_800.0) for r in b.to_pylist()]
    rows = [(1, i, i * 500.0, float(i * i % 61)) for i in range(60_000)]
    assert sorted((r["worker"], r["line"], round(r["value"], 9)) for r in got if r["kind"] == "out") == _plain_alerts(rows) != []
    assert most <= 3 and sum(r["kind"] == "sample" for r in got) <= 173


def test_streams_carry_state_over_batches(spark):
    rows = [(k % 3, k, k * 10_000.0, float(k * k % 37)) for k in range(60)]
    df = spark.createDataFrame(rows, "worker long, line long, t double, value double").coalesce(1)
    flags = df.select("worker", "line", (F.col("value") > 20).alias("flag"))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 20)  # three files, one after the other
    try:
        alerts, changes = (sorted(map(tuple, f(spark, x, files=1).collect())) for f, x in ((state.degradation_alerts, df), (state.status_changes, flags)))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert [(w, n, round(r, 9)) for w, n, r in alerts] == _plain_alerts(rows) != []
    assert changes == sorted(map(tuple, windows.change_only(flags, "worker", "line", F.col("flag")).collect()))


def test_status_changes_tell_null_from_false(spark):
    rows = spark.createDataFrame([(1, i, f) for i, f in enumerate([False, None, None, False, True])], "worker long, line long, flag boolean")
    assert sorted(r.line for r in state.status_changes(spark, rows).collect()) == [0, 1, 3, 4]


def test_expected_cells_of_many_categories(spark, tmp_path):
    d = f"file://{tmp_path}"
    k = F.col("id")
    e = spark.range(150).select((k % 2).alias("user_id"), F.concat(F.lit("t"), k.cast("string")).alias("event_type"), (k % 10).cast("double").alias("value"))
    e.write.parquet(f"{d}/events.parquet")
    assert registry.QUERIES["src3_read_cells"](spark, d).count() == 2 * 150
    segment = F.concat(F.lit("s"), k.cast("string")).alias("c_mktsegment")
    spark.range(1100).select(k.alias("c_custkey"), segment).write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([], "o_orderkey long, o_custkey long").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([], "l_orderkey long, l_partkey long, l_linenumber long").write.parquet(f"{d}/lineitem.parquet")
    cells = registry.QUERIES["joi7_grid_x_category"](spark, d)
    assert cells.select("category").distinct().count() == 1100 and cells.count() % 1100 == 0


def test_rate_limit_stream_carries_counts(spark):
    rows = [(k % 2, k, float(t)) for k, t in enumerate([0, 0, 10, 10, 20, 5000, 30, 5100, 4000, 5200])]
    df = spark.createDataFrame(rows, "worker long, line long, t double").coalesce(1)
    want = sorted(map(tuple, windows.rate_limited(df, "worker", "t", "line", 2, 3600.0).select("worker", "line", "session", "n", "allowed").collect()))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 4)
    try:
        got = sorted(map(tuple, state.rate_limits(spark, df, 2, 3600.0, files=1).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert got == want


def test_task_states_are_forgotten(spark):
    day = 86_400_000_000
    rows = [(1, 5.0, "a", 0), (2, 1.0, "x", 0), (1, None, "b", day), (3, 2.0, "y", day), (2, None, "z", 3 * day), (1, None, "c", 2 * day), (3, 7.0, "w", 3 * day)]
    df = spark.createDataFrame(sorted(rows, key=lambda r: r[3]), "id long, bought double, state string, us long").coalesce(1)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 2)
    try:
        got = {tuple(r) for r in state.kept_states(spark, df, day, files=1).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert got == {(1, 5.0, "c", 2 * day, 3), (2, None, "z", 3 * day, 1), (3, 7.0, "w", 3 * day, 1)}


def test_exact_quantiles_by_bins(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([rng.random(), 0.5, float(rng.randint(0, 3))])) for g in "aab" for _ in range(700)] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    spec = {"low": ("floor", 0.0), "p25": ("rint", 0.25), "p50": ("floor", 0.5), "p99": ("rint", 0.99), "high": ("floor", 1.0)}
    for by in (["g"], []):
        got = {r["g"] if by else "*": r for r in quantiles.exact_quantiles(df, by, "v", spec).collect()}
        for g, r in got.items():
            v = sorted(x for k, x in rows if x is not None and (k == g or g == "*"))
            n = len(v)
            assert (r.n, r.low, r.p25, r.p50, r.p99, r.high) == (n, v[0], v[round((n - 1) * 0.25)], v[n // 2], v[round((n - 1) * 0.99)], v[-1])
        assert set(got) == ({"a", "b", "c"} if by else {"*"})
    assert {r.g: r.m for r in quantiles.true_median(df, ["g"], "v", "m").collect()} == {g: statistics.median([x for k, x in rows if k == g and x is not None]) for g in "abc"}


def test_antibot_and_log_rules(spark):
    verdict = lambda **k: one(spark, filters.antibot_verdict(F.col("status"), F.col("server"), F.col("ray"), F.col("body")), **k)
    base = {"status": "200", "server": "nginx", "ray": "", "body": "fine"}
    assert verdict(**base) == "CLEAN" == verdict(**base | {"body": "Just a moment"}) and verdict(**base | {"body": "just a moment", "ray": "x"}) == "CLOUDFLARE"
    assert verdict(**base | {"body": "the DDoS-Guard page"}) == "DDOS-GUARD" and verdict(**base | {"status": "429"}) == "BLOCKED" and verdict(**base | {"body": ""}) == "CLEAN"
    assert one(spark, filters.error_kind(F.col("e")), e="") == "other" and one(spark, filters.error_kind(F.col("e")), e="a timeout") == "other"


def test_price_stats_against_sorted_lists(spark):
    from millrace.operators.aggregates import price_stats

    rows = [("a", (k * k) % 911) for k in range(700)] + [("b", 5)] * 40 + [("b", 7)] + [("c", 600), ("d", 0), ("e", None), ("d", -3)] + [("f", 900)] * 3 + [("f", 501)]
    df = spark.createDataFrame(rows, "g string, price long")
    got = {r.g: r for r in price_stats(quantiles.value_counts(df, ["g"], "price"), ["g"], low=500).collect()}
    assert sorted(got) == ["a", "b", "c", "f"]  # groups without a price above 0 have no row
    for g, r in got.items():
        v = sorted(p for k, p in rows if k == g and p and p > 0)
        over = [p for p in v if p > 500]
        pick = lambda values, p: values[round((len(values) - 1) * p)]
        assert (r.n, r.low, r.high, r.p25, r.median, r.p75, r.p90) == (len(v), v[0], v[-1], *(pick(v, p) for p in (0.25, 0.5, 0.75, 0.9)))
        assert r.median_above == (pick(over, 0.5) if over else None) and r["mean"] == round(sum(v) / len(v)) and abs(r.share_low - 1 + len(over) / len(v)) < 1e-6


def test_hosts_in_a_list(spark):
    from millrace.operators.filters import host_in_list

    rows = [(1, "a.b.com"), (2, "B.com"), (3, "xb.com"), (4, None), (5, "www.c.org"), (6, "c.org.uk"), (7, ""), (8, "a.b.com"), (8, "d.net")]
    df = spark.createDataFrame(rows, "k int, site string")
    hosts = spark.createDataFrame([("b.com",), ("c.org",), ("c.org",), (None,)], "host string")
    assert sorted(r.k for r in host_in_list(df, "k", "site", hosts).collect()) == [1, 2, 5, 8]
    assert host_in_list(df, "k", "site", hosts.limit(0)).count() == 0


def test_references_without_a_semicolon(spark):
    """Decoded as browsers do, unless the caller takes only what a semicolon ends for a reference, as the page queries do."""
    cut = "<p>a&amp</p><p>b &amp;lt; &eacute; &#x41; &#65 &nosuch; &notit; c&lt</p>"
    assert one(spark, text.html_to_text(F.col("h")), h=cut) == "a&\n\nb &lt; é A A &nosuch; ¬it; c<"
    assert one(spark, text.html_to_text(F.col("h"), bare=False), h=cut) == "a&amp\n\nb &lt; é A &#65 &nosuch; &notit; c&lt"
    assert one(spark, text.clean_html(F.col("h"), bare=False), h=cut) == "a&ampb &lt; é A &#65 &nosuch; &notit; c&lt"


@pytest.mark.parametrize("name", ["sca4_clean_html", "sca5_html_to_text", "sca10_enrich_pages"])
def test_pages_with_a_cut_reference(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT * FROM (VALUES (1, 'http://a.b/', '<p>x &amp</p><p>y &lt; &#39;&quot; &amp;copy;</p>'), (2, 'http://a.b/', NULL), (3, 'http://a.b/', '<div>&nbsp;z &copy</div>')) t(page_id, url, html)")
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    got, want = registry.QUERIES[name](spark, str(tmp_path)), con.execute(registry.SQL[name])
    assert sorted(map(tuple, got.select([c[0] for c in want.description]).collect())) == sorted(want.fetchall())


def test_extracts_read_texts_one_by_one(spark, monkeypatch):
    """Texts stay Arrow's but for the one at hand: no column of Python strings is made of a batch."""
    monkeypatch.setattr(text.F, "pandas_udf", None)
    df = spark.createDataFrame([("-" * 500 + "x" + "é" * 500,), (None,), ("y" * 3000,)], "h string")
    assert [len(r[0]) for r in df.select(text.goal_extract(F.col("h"), "x")).collect()] == [801, 0, 2000]
