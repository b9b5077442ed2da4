"""Scans over few keys, rules in order, dense places, sketches, and values that are easy to read wrongly."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_traps import one

from millrace.functions import geo, text
from millrace.operators import aggregates, filters, scan, windows


@pytest.mark.parametrize("parts", [1, 5])
def test_scans_with_one_key_holding_most_rows(spark, parts):
    rng = random.Random(parts)
    rows = [("a" if rng.random() < 0.8 else rng.choice("bcd"), k, rng.choice([None, 1, 2])) for k in range(200)]
    df = spark.createDataFrame(rows, "key string, ord long, v int").repartition(4)
    before, total, want = {}, Counter(), {}
    for key, k, v in rows:
        total[key] += v or 0
        want[k] = (key in before, before.get(key), total[key])
        before[key] = v
    got = scan.previous(df, "key", "ord", F.col("v"), "p", parts)
    assert {r.ord: (r.p is not None, r.p.v if r.p else None) for r in got.collect()} == {k: w[:2] for k, w in want.items()}
    got = scan.running(df, "key", "ord", F.coalesce("v", F.lit(0)), "s", parts)
    assert {r.ord: r.s for r in got.collect()} == {k: w[2] for k, w in want.items()}
    changed = {r.ord for r in windows.change_only(df, "key", "ord", F.col("v")).collect()}
    values = {k: v for _, k, v in rows}
    assert changed == {k for k, (had, prev, _) in want.items() if not had or prev != values[k]}


@pytest.mark.parametrize("block", [1, 2_000])
def test_rules_in_order(spark, block):
    rules = [(1, "*.yandex.*", False), (2, "m?ps.*", True), (3, r"s\d+\.example\.com", True), (4, "s1.example.com", True), (5, "a+b.(x)", True), (6, "*.yandex.*", True)]
    hosts = ["maps.yandex.ru", "yandex.ru", "ya.yandex.ru", "s1.example.com", "xs1.example.com", "a+b.(x)", "aab.x", None]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host: r.rule for r in filters.first_rules(df, "host", spark.createDataFrame(rules, "ord int, pattern string, enabled boolean"), block).collect()}
    assert got == {"maps.yandex.ru": "m?ps.*", "yandex.ru": None, "ya.yandex.ru": "*.yandex.*", "s1.example.com": r"s\d+\.example\.com", "xs1.example.com": None, "a+b.(x)": None, "aab.x": "a+b.(x)", None: None}
    assert filters.first_rules(df, "host", spark.createDataFrame([], "ord int, pattern string, enabled boolean"), block).where("rule IS NOT NULL").count() == 0


def test_dense_places_are_split(spark):
    rng = random.Random(1)
    near = lambda n, spread: [(k, 59.9 + rng.uniform(-spread, spread), 30.3 + rng.uniform(-spread, spread)) for k in range(n)]
    a, b = near(150, 0.0) + near(150, 0.02), near(150, 0.0) + near(250, 0.02)
    left = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(a)], "i long, lat double, lon double")
    right = spark.createDataFrame([(j, *r[1:]) for j, r in enumerate(b)], "j long, lat2 double, lon2 double")
    plain = left.crossJoin(right).where(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= 700).select("i", "j")
    got = geo.radius_join(left, right, 700, most=40).select("i", "j").collect()
    assert len(got) == len(set(got)) and set(got) == set(plain.collect())
    keys = ["_l", "_y", "_x", "_b", "_s"]
    for side in geo.celled(left, right, 700, most=40):
        assert side.groupBy(*keys).count().agg(F.max("count")).first()[0] <= 80
    assert geo.celled(left, right, 700, most=40)[1].agg(F.max("_l")).first()[0] > 2


def test_united_sketches(spark):
    rows = spark.range(20_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 5).alias("day"), (F.col("id") % 4_000).alias("v"))
    told = aggregates.united_sketches(aggregates.day_sketches(rows, ["g"], "day", "v"), ["g"])
    assert all(abs(r["distinct"] - 4_000) <= 120 and 6_666 <= r.visits <= 6_667 for r in told.collect())


@pytest.mark.parametrize("shown,want", [
    ("2024-01-01T10:00:00+03:00", 1704092400.0), ("2024-01-01T10:00:00Z", 1704103200.0), ("2024-01-01T10:00:00.250-0530", 1704123000.25), ("2024-01-01", 1704067200.0), ("2024-01-01 10:00", 1704103200.0),
    ("1704103200", 1704103200.0), ("1704103200000", 1704103200.0), ("2024-01-01T", None), ("2024-01-01Tx", None), ("2024-13-01", None), ("soon", None), ("", None), (None, None), ("x 2024-01-01", None),
])
def test_times(spark, shown, want):
    df = spark.createDataFrame([(shown,)], "t string")
    assert df.select(text.parse_when(F.col("t")).alias("x")).first()["x"] == want


def test_keywords_keep_their_first_form(spark):
    assert one(spark, text.keywords(F.col("t")), t="Oslo Hotels oslo HOTELS of a_b_c Рим Римский римский") == ["Oslo", "Hotels", "a_b_c", "Римский"]
    assert one(spark, text.keywords(F.col("t"), 3, ["price", "OSLO", "name"]), t="Oslo prices") == ["Oslo", "prices", "price"]


def test_first_words(spark):
    for shown, want in (("High-risk, yes", "high-risk"), ("  deep — x", "deep"), ("—", ""), ("", "?"), (None, "?"), (" Ärger.", "ärger"), (" \n", "?")):
        df = spark.createDataFrame([(shown,)], "t string")
        assert df.select(text.first_word(F.col("t")).alias("x")).first()["x"] == want


def test_gaps_of_markers_and_handed_on_seconds(spark):
    log = [(1, 1, 0.0, "a"), (1, 2, 5.0, "meta"), (1, 3, 905.0, "meta"), (1, 4, 910.0, "start"), (1, 5, 2000.0, "a"), (1, 6, 2001.0, "mark"), (1, 7, 2003.0, "a")]
    got = windows.gap_attribution(spark.createDataFrame(log, "worker int, line int, t double, bucket string"), ["mark"], 900.0, {"meta": "serp", "start": "dispatch"}, ("meta",)).orderBy("line").collect()
    assert [(r.credited, r.credit, r.idle, r.idle_seconds, r.counted) for r in got] == [
        ("a", 0.0, False, 0.0, True), ("serp", 5.0, False, 0.0, False), ("serp", 0.0, False, 0.0, False), ("dispatch", 5.0, False, 0.0, True), ("a", 0.0, True, 1090.0, True), (None, 0.0, False, 0.0, False), ("a", 2.0, False, 0.0, True),
    ]
