"""Suffix-array removal and near-duplicate groups against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from millrace.llm import chosenpath, suffixes
from millrace.llm.common import components


def test_two_stage_sorts_like_python():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        data = rng.integers(97, 97 + int(rng.integers(1, 4)), n).astype(np.uint8)
        need = rng.random(n) < 0.7
        raw = data.tobytes()
        got = suffixes.two_stage(data, need, np.concatenate([suffixes.eights(data), np.zeros(200, np.uint64)]), 240)
        assert got.tolist() == sorted(np.flatnonzero(need).tolist(), key=lambda i: raw[i:])


def brute_removal(rows):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = True
            seen.add(w)
        runs = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        out[i] = (len(b), int(gone.sum()), int((runs == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("leaf,least", [(suffixes.LEAF, 64), (3, 64), (1, 2)])
def test_removal_against_brute_force(spark, monkeypatch, leaf, least):
    monkeypatch.setattr(suffixes, "LEAF", leaf)
    monkeypatch.setattr(suffixes.hot_anchors, "__defaults__", (10_000, 1 << 16, least))
    monkeypatch.setattr(suffixes.repeats, "__defaults__", (leaf, least))
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passage = [" ".join(word() for _ in range(40)) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "ab" * 300), (3, "x" * 99), (4, "x" * 100), (5, "x" * 101)]
    for i in range(10, 90):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passage)
            cut = rng.randint(0, 60)
            parts += [p[cut : cut + rng.randint(90, 260)], word()]
        rows.append((i, " ".join(parts)))
    rows += [(200, rows[20][1]), (201, rows[20][1]), (30, dict(rows)[30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_removal(rows)
    got = suffixes.remove_repeats(docs, leaf=leaf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id], r.doc_id


def test_removal_odd_rows(odd_docs, no_docs):
    rows = {r.doc_id: r for r in suffixes.remove_repeats(odd_docs, with_text=True).collect()}
    assert rows[2].n_bytes == 0 == rows[8].n_removed and rows[3].kept_text == ""
    assert rows[5].n_removed == 1_000_000 - 5 and rows[5].n_spans == 1
    assert rows[1].n_removed == 0
    assert suffixes.remove_repeats(no_docs).collect() == []


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_groups(rows, width, percent):
    sets = {i: ({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if (w := words_of(t)) else set()) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("leaf,most", [(1000, 100_000), (4, 0), (2, 100_000)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, leaf, most):
    monkeypatch.setattr("millrace.llm.common.BROADCAST_ROWS", most)
    rng = random.Random(11)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 120))] for _ in range(25)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 50)}"
        rows.append((i * 3 + 1, " ".join(x.upper() if rng.random() < 0.2 else x for x in w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in chosenpath.near_duplicates(docs, 4, 80, leaf=leaf).collect()}
    assert got == brute_groups(rows, 4, 80)


def test_blocks_of_a_large_group(spark):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(x if rng.random() > 0.02 else f"y{rng.randint(0, 99)}" for x in base)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {i: chosenpath.set_hash(chosenpath.Shingler(4).shingles(t)) for i, t in rows}
    members = spark.createDataFrame([(i, i, hashes[i], 0, 57) for i, _ in rows], "rep long, doc long, h1 long, grp long, n_shingles long")
    links = chosenpath.exact_edges(members, docs, 4, 80, block=600)
    assert not links.where("whole").count()
    got = {r.id: r.component for r in components(links.select("a", "b")).collect()}
    want = brute_groups(rows, 4, 80)
    assert {i: got.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in want.items()}


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    rows = collections.defaultdict(list)
    for r in chosenpath.near_duplicates(odd_docs).collect():
        rows[r.doc_id].append(r)
    assert len(rows[1]) == 2 and all(r.component_id == 1 and r.kept for r in rows[1])
    assert all(rows[i][0].n_shingles == 0 and rows[i][0].component_id == i for i in (2, 3, 4, 8))
    assert rows[5][0].n_shingles == 1 and rows[6][0].n_shingles == 1
    assert chosenpath.near_duplicates(no_docs).collect() == []


def test_texts_that_share_an_id_are_told_apart(spark):
    text = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(1, text("a")), (1, text("b")), (5, text("a") + " more"), (7, text("b") + " more"), (9, text("c")), (9, text("c")), (None, text("a"))]
    got = sorted(((r.doc_id, r.component_id) for r in chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == [(1, 1), (1, 1), (5, 1), (7, 1), (9, 9), (9, 9), (None, 1)]
    removed = suffixes.remove_repeats(spark.createDataFrame([(1, text("a")), (1, text("b")), (2, "- " + text("b")), (1, text("a"))], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in removed) == [(1, len(text("a")), 0), (1, len(text("a")), 0), (1, len(text("b")), 0), (2, len(text("b")) + 2, len(text("b")))]


@pytest.mark.parametrize("hub", [10_000, 3])
def test_components(spark, hub):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (60, 100), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), hub=hub).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 100: 50}
