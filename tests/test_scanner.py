"""JSON in texts without recursion, and pages whose blocks are never closed, in linear time."""

import json
import random
import time

from pyspark.sql import functions as F
from test_traps import one

from millrace.functions import text
from millrace.sources import page_text


def plain(t, opener):
    at = t.find(opener)
    while at >= 0:
        try:
            return t[at : json.JSONDecoder().raw_decode(t, at)[1]]
        except ValueError:
            at = t.find(opener, at + 1)
    return None


def test_scanner_against_the_decoder():
    rng = random.Random(4)
    pieces = ["{", "}", "[", "]", '"', '"a"', ":", ",", "1", "-0.5e+3", "01", "true", "nul", "NaN", "-Infinity", " ", "\n", "\\", '"\\u00e9"', '"\\x"', '{"k":', "[1,", '"\t"', "é"]
    hits = 0
    for _ in range(20_000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        scanner = page_text.Scanner(t)
        for opener in "{[":
            got = scanner.first(opener)
            assert got == plain(t, opener), repr(t)
            hits += got is not None
        try:
            whole = json.loads(t) is not ...
        except ValueError:
            whole = False
        assert page_text.is_json(t.strip(" \n")) == whole or not t.strip(" \n"), repr(t)
    assert hits > 500


def test_deep_and_unclosed_brackets():
    began = time.perf_counter()
    assert page_text.first_json("[" * 200_000) is None
    assert page_text.first_json('{"a":' * 100_000) is None
    deep = "[" * 200_000 + "]" * 200_000
    assert page_text.first_json("x " + deep) == deep
    assert page_text.first_json("[" * 100_000 + '{"a": [1]}') == '{"a": [1]}'
    assert page_text.first_json("```json\n" + deep + "\n```") == deep
    assert time.perf_counter() - began < 10


def test_embedded_json_of_hard_pages(spark):
    pages = [(1, "<script>x = " + "[" * 200_000 + "</script>"), (2, '<script>var s = {"a": 1};</script><script type="text/x">{}</script>'), (3, None), (4, "")]
    got = page_text.embedded_json(spark.createDataFrame(pages, "page_id long, html string")).collect()
    assert [tuple(r) for r in got] == [(2, 0, "state", '{"a": 1}')]


def test_blocks_that_are_never_closed(spark):
    page = "<form>" * 16_000 + "<p>text</p>" + "<!--" * 5_000
    began = time.perf_counter()
    assert page_text.markdown(page).startswith("text")
    assert time.perf_counter() - began < 1
    began = time.perf_counter()
    assert one(spark, text.clean_html(F.col("h")), h=page).startswith("text")
    assert time.perf_counter() - began < 10


def test_noise_goes_up_to_the_first_closing(spark):
    for page, want in (
        ("a<NAV x>b<nav>c</nav>d</nav>e", "ad</nav>e"), ("a</form>b<form>c</FORM>d", "a</form>bd"), ("<script>1</script >x", "x"), ("a<!-->b-->c<!-- d", "ac<!-- d"), ("<header>a<header>b</header>c", "c"),
        ("<style>a<!-- </style>b -->c", "b -->c"), ("<formx>a</form>b", "<formx>a</form>b"),
    ):
        assert page_text.without_noise(page) == want
    assert one(spark, text.clean_html(F.col("h")), h="a<Nav x>b<nav>c</nav>d<form>e</FORM>f</form>g") == "adfg"
    assert one(spark, text.clean_html(F.col("h")), h="<header>a</header>b<header>c") == "bc"
