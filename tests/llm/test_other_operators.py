"""Nearest neighbours, SentencePiece, mixing, page text, WARC, and the pipeline."""

import random
import time

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from millrace.llm import lineblocks, mih, mixing, warc, wfst
from millrace.llm.queries import TOKENIZERS

PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"


def test_neighbours_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 24)).astype("float32")
    x[::3] *= 2
    x[500:560] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = mih.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=10).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    y, hits = x.astype("float64"), 0
    for q in range(0, 600, 20):
        s = y @ y[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s.round(12)))[:10]
        rows = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 11))
        assert all(abs(r.score - y[q] @ y[r.vec_id]) < 1e-9 and r.vec_id != q for r in rows)
        assert all((a.score, -a.vec_id) >= (b.score, -b.vec_id) for a, b in zip(rows, rows[1:], strict=False))
        hits += len({r.vec_id for r in rows} & set(want.tolist()))
    assert hits / 300 >= 0.9


def test_pigeonhole_retrieves_all_within_the_radius_and_little_else(spark):
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 63, (3000, 4), dtype=np.uint64)
    codes[::7] = codes[:429]
    index = mih.Index(codes)
    near = codes[rng.integers(0, 3000, 40)].copy()
    for k in range(40):
        near[k, rng.integers(0, 4)] ^= np.uint64(rng.integers(0, 1 << 40))
    for radius in (0, 3, 20, 60, 100, 108):
        who, what = index.within(near, radius)
        full = np.bitwise_count(near[:, None, :] ^ codes[None]).sum(2, dtype=int) <= radius
        assert set(zip(who.tolist(), what.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(full)), strict=True))
    assert index.probe(near, 100).mean() < 0.3


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_neighbours_of_the_given_vectors(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = mih.search(table, F.col("vec_id") % 20 == 0).collect()
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    ids, x = np.array(list(rows)), np.stack(list(rows.values()))
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = np.where(ids == q, -np.inf, x @ rows[q])
        want = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits, total = hits + len(want & {r.vec_id for r in got if r.query_id == q}), total + len(want)
    assert hits / total >= 0.9


def test_neighbours_odd_rows(spark):
    ddl = "vec_id long, embedding array<float>, score string, rank string"
    rows = [(0, [1.0, 0.0], "a", "b"), (1, [0.5, 0.5], "a", "b"), (2, None, "a", "b"), (3, [0.0, 0.0], "a", "b"), (4, [float("nan"), 1.0], "a", "b"), (5, [1.0, None], "a", "b"), (20, [1.0, 0.0], "a", "b"), (40, [float("inf"), 1.0], "a", "b")]
    got = mih.search(spark.createDataFrame(rows, ddl), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]
    assert mih.search(spark.createDataFrame([], ddl), F.col("vec_id") % 20 == 0).collect() == []
    assert mih.search(spark.createDataFrame(rows[:1], ddl), F.col("vec_id") % 20 == 0).collect() == []


def encoded(machine, texts):
    ids, n = wfst.Segments(machine, limit=600).encode(texts)
    ends = np.cumsum(n)
    return [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)]


def test_pieces_against_the_library():
    machine, sp, rng = wfst.PieceTransducer.compile(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(1)
    letters = "ab c▁\n\té日🎉eetthhin'\x00  --==/<s>"
    texts = ["", " ", "  a", "a  ", "\n\na", "<s> </s> <unk> <0x41>", open(__file__).read(), "".join(rng.choice("etaé🎉") for _ in range(500))]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    for t, ids in zip(texts, encoded(machine, texts), strict=True):
        assert ids == sp.encode(t), repr(t)
        assert machine.decode(ids) == t.replace("▁", " ")


def hand_made(kind, rule, remove, fallback, rng):
    """A serialised model with the library's normaliser of that rule and random pieces."""
    proto, spec = sentencepiece_model_pb2.ModelProto(), None
    if rule:
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        proto.normalizer_spec.CopyFrom(spec.normalizer_spec)
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.escape_whitespaces = remove, True, True
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = kind, fallback
    pieces = [("<unk>", 0, 2)] + [(f"<0x{b:02X}>", 0, 6) for b in range(256 if fallback else 0)]
    vocab = [*"▁abcdeé"]
    while len(vocab) < 90:
        t = rng.choice(vocab) + rng.choice(vocab[1:])
        if "▁" not in t[1:] and len(t) < 6 and t not in vocab:
            vocab.append(t)
    pieces += [(t, -rng.random() * 8 - len(t) if kind == 1 else -float(i if len(t) > 1 else i + 100), 1) for i, t in enumerate(vocab)]
    for t, score, piece_kind in pieces:
        p = proto.pieces.add()
        p.piece, p.score, p.type = t, score, piece_kind
    return proto.SerializeToString()


@pytest.mark.parametrize("kind,rule", [(1, ""), (1, "nmt_nfkc"), (2, ""), (2, "nfkc_cf")])
@pytest.mark.parametrize("remove", [False, True])
@pytest.mark.parametrize("fallback", [False, True])
def test_normalisers_and_paths_against_the_library(kind, rule, remove, fallback):
    rng = random.Random(kind + 10 * remove + 20 * fallback)
    data = hand_made(kind, rule, remove, fallback, rng)
    machine, sp = wfst.PieceTransducer.of_model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    letters = "aabbccddeeé  Ａｂ①ﬁ½ 　日🎉\tＥ́é\n▁カﾞ"
    texts = ["", " ", "  ", " a ", "abcde" * 30] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    weight = lambda ids: sum(float(machine.weights[i]) for i in ids)
    for t, ids in zip(texts, encoded(machine, texts), strict=True):
        want = sp.encode(t)
        # Equal paths of a unigram model may be told apart by rounding only.
        assert ids == want or (kind == 1 and len(ids) == len(want) and abs(weight(ids) - weight(want)) < 1e-4), repr(t)
        assert not rule or machine.normaliser.apply(t) == sp.normalize(t)


def test_unigram_path_is_the_best():
    pieces = {"a": -1.0, "b": -1.2, "ab": -1.5, "ba": -3.0, "aba": -2.4}
    weights = -np.array([*pieces.values()], np.float32)
    machine = wfst.PieceTransducer([*pieces], [p.encode() for p in pieces], weights, wfst.Normaliser(prefix=False), [], ranks={p: (0.0, i) for i, p in enumerate(pieces)}).build()
    assert [machine.texts[i] for i in encoded(machine, ["abab"])[0]] == ["ab", "ab"]
    assert [machine.texts[i] for i in encoded(machine, ["aba"])[0]] == ["aba"]


def test_pieces_odd_rows(odd_docs, no_docs):
    machine = wfst.PieceTransducer.compile(PIECES)
    rows = wfst.encode(odd_docs, machine).collect()
    assert len(rows) == odd_docs.count() and all(r.round_trip for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[2].ids == [] == by[3].ids and by[5].n_pieces == 200_001 and by[6].n_bytes_fallback > 0
    assert wfst.encode(no_docs, machine).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_against_sql_and_bounds(spark, seed, tmp_path):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randint(0, 50))) if rng.random() > 0.1 else None, rng.choice(["a", "a", "a", "a", "b", "é", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    path = str(tmp_path / "d")
    docs.write.parquet(f"file://{path}")
    want = sorted(duckdb.sql(mixing.MIX_SQL.replace("{docs}", f"'{path}/*.parquet'")).fetchall())
    got = sorted(tuple(r) for r in mixing.mix(docs).collect())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])
    assert got == sorted(tuple(r) for r in mixing.mix(docs.repartition(7)).collect())
    source = {i: s for i, _, s in rows}
    for s in {source[i] for i in source}:
        mine = [g for g in got if source[g[0]] == s]
        assert abs(sum(g[4] for g in mine) - mine[0][3]) <= max(g[1] for g in mine)
        assert all(g[4] <= 3 * g[1] and (not g[1] or g[4] % g[1] == 0) for g in mine)
    assert sum({(g[2], g[3]) for g in got} and [x[1] for x in {(source[g[0]], g[3]) for g in got}]) == pytest.approx(sum(g[1] for g in got))


def test_mix_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r.taken for r in rows if r.size == 0} == {0}
    assert mixing.mix(no_docs).collect() == [] == mixing.apply_mix(no_docs).collect()
    assert len(mixing.mix(odd_docs.unionByName(odd_docs)).collect()) == 2 * len(rows)
    one = odd_docs.where("doc_id = 6")
    assert [r.taken for r in mixing.mix(one).collect()] == [mixing.mix(one).first()["size"]]


def test_applied_mix_keeps_rows_that_share_an_id(spark):
    rows = [(k // 2, "w " * (k % 4 + 1), "ab"[k % 3 > 0]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = sum(r.taken for r in mixing.mix(docs).collect())
    assert sum(len(r.text.split()) for r in mixing.apply_mix(docs).collect()) == taken > 0


def test_applied_mix_keeps_rows_without_id(spark):
    rows = [(k if k % 3 else None, "w " * (k % 5 + 1), "ab"[k % 2] if k % 7 else None) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = lambda d: sum(len(r.text.split()) for r in d.collect())
    want = {(r.doc_id is None): r.t for r in mixing.mix(docs).groupBy(F.col("doc_id").isNull()).agg(F.first("doc_id").alias("doc_id"), F.sum("taken").alias("t")).collect()}
    got = mixing.apply_mix(docs)
    assert got.columns == docs.columns and words(got.where("doc_id IS NULL")) == want[True] > 0
    assert words(got.where("doc_id IS NOT NULL")) == want[False]


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Top</header>
<nav><ul><li><a href="/x">Menu item</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy!</div><article><header><h1>Head &amp; line</h1></header>
<p>First   paragraph<br>goes on.<p>Second <b>one. <aside>Related</aside><p>Short.</article><section id="comments"><p>I disagree with all of this.</p></section>
<form><p>Sign up</p></form><footer>&copy; me</footer>"""


def test_page_text():
    assert lineblocks.main_text(PAGE) == "Head & line\nFirst paragraph goes on.\nSecond one.\nShort."
    para = "<p>" + "Plain words of an article without marks. " * 5 + "</p>"
    loose = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div class='page-header'>Hi</div>{para * 3}<p>End.</p><div id=footer>Contact</div>"
    got = lineblocks.main_text(loose).split("\n")
    assert len(got) == 4 and got[-1] == "End." and "Home" not in got[0]
    assert lineblocks.main_text("<p title='a>b'>x &lt;y&gt; &#233;</p") == "x <y> é"
    assert lineblocks.main_text("<script>never closed <p>x</p>") == "" == lineblocks.main_text(None) == lineblocks.main_text("")
    assert len(lineblocks.main_text("<article>" + "<p>word</p>" * 50_000)) == 50_000 * 5 - 1


def test_page_text_keeps_whole_articles():
    para = "Plain words of an article without marks. " * 5
    want, art = f"Title\n{para.strip()}", f"<article><h1>Title</h1><p>{para}</p></article>"
    text = lineblocks.main_text
    assert text(f"<html><head><title>No</title><meta charset=utf8><script>1</script>{art}") == want
    assert text(f"<head><title>No</title><noframes>No</noframes><body>{art}") == text(f"<head><style>p</style></head>{art}") == want
    for empty in ("<svg/>", "<svg width='1' />", "<iframe/>", "<iframe src='a>b' />", "<script src='x'/>", "<math/>"):
        assert text(f"{empty}{art}") == text(f"{empty}{art}<svg>no</svg><iframe>no</iframe><script>no</script>") == want, empty
    assert text(f"<iframe src=http://x/>no</iframe><script src='x'/>no</script><button>Off{art}").endswith(want)
    for marks in ("content has-sidebar", "no-sidebar", "with-header", "page-header-wrap", "social"):
        assert text(f"<div class='{marks}'><div>{art}</div></div>") == want, marks
        assert text(f"<main class='{marks}'><div class='{marks}'>{art}</div></main>") == want, marks
    assert text(f"<form>{art}</form>") == text(f"<div class='no-sidebar'><p>Title<p>{para}</div>") == want
    assert text(f"<article><header class='article-header'><h1>Title</h1></header><p>{para}</p></article>") == want
    assert text(f"<article><h1><a href=1>Title</a></h1><p>{para}</p></article>") == want
    assert text(f"<article><h1>Title</h1><p>{para}</p><div class=comments><article>No</article></div></article><div class=sidebar>No</div>") == want


def test_page_text_implied_ends_and_whole_tokens():
    text = lineblocks.main_text
    assert text("<article><p>First.<p class='share'>Share<p>Second.</article>") == "First.\nSecond."
    assert text("<article><ul><li class='social'>x<li>One<ul><li class='ad'>y<li>Two</ul><li>Three</ul></article>") == "One\nTwo\nThree"
    assert text("<article><div class='search-results-intro'>Intro</div><div class='siteAdBox'>Buy</div><dl><dt class=related>R<dd>D</dl></article>") == "Intro\nD"
    para = "Plain words of an article without marks, and rather many of them in a line. " * 4
    assert text(f"<main><p>We use cookies.</p></main><div><p>{para}<p>{para}</div>").split("\n") == [para.strip()] * 2
    assert text(f"<article><p>{para}</article><div>{para[:200]}</div>") == para.strip()
    assert text(f"<body><table><tr><td class=sidebar>Menu<td><p>{para}<tr><td class=ad>x</table>") == para.strip()


def plain_runs(weights, marked, window, surge):
    """The rule line by line: a line belongs to the run of the line before it unless the sums between reached 0."""
    n = len(weights)
    sums = [sum(weights[i : i + window]) for i in range(n)]
    if not any(weights):
        return []
    top = sums.index(max(sums))
    kind = marked[next(i for i in range(top, n) if weights[i])]
    runs = []
    for i in [i for i in range(n) if weights[i]]:
        if runs and all(sums[k] for k in range(runs[-1][-1], i)):
            runs[-1].append(i)
        else:
            runs.append([i])
    least = lambda r: min(surge, max(sums) / 2) if marked[r[0]] == kind else max(sums) / 2
    return [(r[0], r[-1] + 1) for r in runs if max(sums[r[0] : r[-1] + 1]) >= least(r)]


def test_surge_and_dive_against_the_plain_rule():
    rng = random.Random(8)
    for _ in range(3000):
        n, window = rng.randint(0, 25), rng.randint(1, 4)
        weights = [rng.choice([0, 0, rng.randint(1, 30), rng.randint(1, 300)]) for _ in range(n)]
        marked = [rng.random() < 0.4 for _ in range(n)]
        assert lineblocks.chosen(weights, marked, window, 80) == plain_runs(weights, marked, window, 80)


PARA = "Plain words of a story that somebody wrote, with a few more of them. " * 4


def test_page_text_weighs_blocks():
    text, para = lineblocks.main_text, PARA.strip()
    story = f"<h1>T</h1><p>{PARA}</p>"
    talk = f"<div><b>Ann</b><p>{PARA}</p></div>"
    for page in (
        f"<article>{story}<div class='discussion'>{talk}<p>I disagree.</p></div></article>",
        f"<article>{story}</article><ul class='responses'>{talk}</ul>",
        f"<article>{story}<h2>Comments (3)</h2>{talk}</article>",
        f"<div>{story}<h2>3 comments</h2>{talk}</div><div class=footer>x</div>",
        f"<article>{story}<article class='comment'>{talk}</article></article>",
        f"<body><div class='gdpr-bar'><p>{PARA[:120]}</p></div>{story}",
        f"<body>{story}<p>\u00a9 2020 me</p><ul><li><a href=1>Imprint</a></ul>",
        f"<article>{story}<div class='related'><p><a href=1>{PARA}</a></p></div></article>",
        f"<article>{story}<div class='search'><p>{PARA}</p><form><p>Find</p></form></div></article>",
    ):
        assert text(page) == f"T\n{para}", page
    assert text(f"<article>{story}<h2>Comments</h2>{talk}<h2>Method</h2><p>{PARA}</p></article>") == f"T\n{para}\nMethod\n{para}"
    assert text(f"<article>{story}<section id='discussion'><h2>Discussion</h2><p>So.</p></section></article>") == f"T\n{para}\nDiscussion\nSo."
    for kind in ("class='search'", "id='related'"):
        assert text(f"<article>{story}<section {kind}><p>{PARA}</p></section><p>End.</p></article>") == f"T\n{para}\n{para}\nEnd."
    links = "".join(f"<li><a href={k}>Link {k}</a>" for k in range(5))
    assert text(f"<body>{story}<ul>{links}</ul><p>The end.</p>").split("\n") == ["T", para, *[f"Link {k}" for k in range(5)], "The end."]
    assert text(f"<body><ul>{links}</ul>{story}<ul>{links}</ul>") == f"T\n{para}"
    assert text(f"<body><h1>T</h1><nav><a href=1>x</a></nav><p>Intro.</p><div class=ad>Buy it</div><p>{PARA}</p>") == f"T\nIntro.\n{para}"
    assert text(f"<nav><a href=1>Menu</a></nav><footer>{PARA}</footer>") == text(f"<div class=comments>{talk * 30}</div>") == ""


def plain_page(lines, window, surge):
    """Lines kept, each judged by itself: in a strong run, in the block of one, or between two lines of such a block."""
    weights = [x.weight() for x in lines]
    n = len(lines)
    sums = [sum(weights[i : i + window]) for i in range(n)]
    tops = [sum(w for w, x in zip(weights[i : i + window], lines[i : i + window]) if x.marked is not None) for i in range(n)]
    half = max(tops, default=0) / 2
    at = tops.index(max(tops)) if n else 0
    kind = next((lines[i].marked for i in range(at, n) if weights[i]), False)
    groups = []
    for i in [i for i in range(n) if weights[i]]:
        if groups and all(sums[k] for k in range(groups[-1][-1], i)):
            groups[-1].append(i)
        else:
            groups.append([i])

    def strong(g):
        of = lines[g[0]].marked
        top = max(sums[g[0] : g[-1] + 1])
        return top >= surge and top >= half if of is None else top >= half or (of == kind and top >= surge)

    core = [i for g in groups if strong(g) for i in range(g[0], g[-1] + 1)]
    weak = [i for g in groups if not strong(g) for i in range(g[0], g[-1] + 1)]
    prose = [i for i in core if lines[i].text and lines[i].marked is not None]
    homes = {lines[i].home for i in prose}
    kept = set(core) | {i for i in weak if lines[i].marked is not None and lines[i].home in homes}
    same = lambda i, j: lines[i].home == lines[j].home and lines[j].marked is not None
    for i in range(n):
        if lines[i].marked is not None and any(j < i and same(i, j) for j in prose) and any(j > i and same(i, j) for j in set(kept)):
            kept.add(i)
    return [lines[i].text for i in sorted(kept) if lines[i].text]


def test_lines_kept_against_the_plain_rule():
    rng = random.Random(9)
    removed = 0
    for _ in range(3000):
        window, lines = rng.randint(1, 4), []
        for _ in range(rng.randint(0, 9)):  # blocks of one kind, with gaps at their borders
            marked, home = rng.choice([None, False, False, True]), rng.randint(0, 2)
            lines += [lineblocks.Line() for _ in range(window)]
            for _ in range(rng.randint(1, 5)):
                text = f"{len(lines)}:" + "x" * rng.choice([0, 5, 60, 500, 9000 if marked is None else 90])
                lines.append(lineblocks.Line(text, rng.choice([0, 0, 0, len(text)]), marked, home + 10 * (marked is True)))
        got = lineblocks.kept_lines(lines, window, 80)
        assert got == plain_page(lines, window, 80)
        removed += len(got) < sum(1 for x in lines if x.text)
    assert removed > 2000


def test_page_text_takes_linear_time():
    for page in ("<h2>Comments</h2><p>x", "<article><div class=search><p>x", "<p class=ad>x", "<p>x</q>", "<div><li>", "<ul><li>", "</p></div>", "<a b='>"):
        begin = time.process_time()
        lineblocks.main_text(page * 20_000)
        assert time.process_time() - begin < 5, page


@pytest.fixture(scope="module")
def odd_pages(spark):
    big = "x" * 150
    rows = [(5, "http://www.B.org/a?q=1#f", big, 1), (3, "http://b.org:80/a", big, 1), (9, None, big, 1), (4, "bad url [", None, 1), (6, "http://c.org/\r\nX", "", 1), (7, "http://b.org/a", "short", 1), (8, "http://b.org/a", "short", 1), (10, "http://d.org", "a\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\nü" * 9, 1), (11, "http://d.org", "a\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\nü" * 9, 1)]
    rows += [(None, "http://e.org", big, 1), (None, None, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest int")


@pytest.mark.parametrize("most", [100_000, 0])
def test_archives_round_trip(spark, odd_pages, monkeypatch, most):
    monkeypatch.setattr("millrace.llm.common.BROADCAST_ROWS", most)
    rows = warc.archive_and_index(odd_pages).collect()
    want = {3: ("response", None), 5: ("revisit", 3), 9: ("revisit", 3), 4: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("response", None), 10: ("response", None), 11: ("revisit", 10)}
    assert len(rows) == odd_pages.count() and {r.page_id: (r.record_type, r.refers_to) for r in rows if r.page_id is not None} == want
    sizes = {r.page_id: r.payload_bytes for r in rows}
    assert sizes[4] == 0 == sizes[6] and sizes[10] == len("a\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\nü".encode()) * 9
    assert [r.capture_no for r in sorted((r for r in rows if r.urlkey == "org,b)/a"), key=lambda r: r.ts)] == [1, 2]
    assert warc.archive_and_index(odd_pages.limit(0)).collect() == []
    for r in rows:  # an offset leads to its record
        with open(r.archive.removeprefix("file:").replace("///", "/"), "rb") as f:
            f.seek(r.offset)
            assert f.read(9) == b"WARC/1.1\r"[:9] and f"<urn:page:{'' if r.page_id is None else r.page_id}>".encode() in f.read(200)


def test_histories_over_many_ranges(spark):
    rows = [(i, f"http://h{i % 3 if i % 2 else 0}.org/", "p" * (i % 7)) for i in range(300)]
    index = warc.archive_and_index(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    order = sorted(index, key=lambda r: (r.urlkey, r.ts, r.page_id))
    counts = {}
    for r in order:
        counts[r.urlkey] = counts.get(r.urlkey, 0) + 1
        assert r.capture_no == counts[r.urlkey]


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        lists = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree(lists, lambda x: x)) == sorted(x for s in lists for x in s)


def test_pipeline_stages(spark, odd_docs, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(9)
    words = {"en": "the and of that with from".split(), "de": "der und das nicht über schön".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + str(rng.randint(0, 99)) + rng.choice("abc") for _ in range(n))
    rows = [(i, text(lang := rng.choice(["en", "de"]), 60), lang, rng.choice(["a", "b", None]), 0) for i in range(80)]
    passage = text("en", 40)
    rows += [(100, rows[0][1], "en", "a", 0), (101, rows[1][1] + " more", "en", "b", 0), (102, None, "en", "a", 0), (103, "123", None, "a", 0)]
    rows += [(k, f"{text('en', 20)} {passage} {text('en', 20)}", "en", "a", 0) for k in (110, 111)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(stage(spark, out[-1], str(tmp_path)).cache())
    ids = [{r.doc_id for r in d.collect()} for d in out]
    assert ids[0] - ids[1] == {102, 103}
    assert ids[1] - ids[2] == {100, 101}
    lengths = {r.doc_id: len(r.text) for r in out[3].collect()}
    assert ids[3] == ids[2] and lengths[111] < lengths[110]
    assert all(d.columns == docs.columns for d in out[1:-1])
    assert out[5].count() == out[4].count() and out[5].where("NOT round_trip").count() == 0
    assert P.run(spark, f"file://{tmp_path}").count() == out[5].count()
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, str(tmp_path)).cache()
    assert empty.count() == 0
    odd = odd_docs.select(*docs.columns, "score")
    for _, stage in P.STAGES:
        odd = stage(spark, odd, str(tmp_path)).cache()
    assert {r.doc_id for r in odd.collect()} <= {1, 5, 6, None}
    twice = docs.unionByName(spark.createDataFrame([(0, text("de", 50), "de", "a", 0)] * 2, docs.schema))
    kept = P.drop_near_copies(spark, twice, "").collect()
    assert sum(r.doc_id == 0 for r in kept) == 1 and len(kept) == len(P.drop_near_copies(spark, docs, "").collect())


def test_one_large_page_closes_only_its_own_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 200_000)
    pages = [(k, f"http://a.example/{k}", "x" * (300 + k)) for k in range(60)] + [(90, "http://a.example/l", "y" * 400_000), (91, None, None), (92, "http://a.example/l", "y" * 400_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, f"file://{tmp_path}/w", records_per_file=50)
    sizes = sorted(p.stat().st_size for p in (tmp_path / "w").glob("part-*"))
    assert sum(s < 200_000 for s in sizes) == 2 and len(sizes) == 4
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_and_index(df).collect()}
    assert len(got) == 63 and got[92] == ("revisit", 90, 400_000) and got[91] == ("response", None, 0)


def test_training_texts_are_bounded_in_bytes(spark):
    from millrace.llm import langid

    rows = [(k, ("der die das " if k % 2 else "the of and ") * 50, "de" if k % 2 else "en") for k in range(300)] + [(999, "q " * 2_000_000, "en")]
    seen = []
    fit = langid.fit
    langid.fit = lambda texts, **o: seen.extend(texts) or fit(texts, **o)
    try:
        langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_bytes=600_000)
    finally:
        langid.fit = fit
    assert 0 < sum(len(t) for t, _ in seen) <= 600_000
