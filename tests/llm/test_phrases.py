"""Phrase collocations against brute force, the trie against plain counting, and odd rows."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from millrace.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, longest=4, least=30, top=2000, cover=80):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            counts = f.setdefault(lang, Counter())
            for k in range(1, longest + 1):
                counts.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = {}
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(a, longer.get(p[i : i + k], 0))
        scored = []
        for p, a in candidates.items():
            if 100 * longer.get(p, 0) < cover * a:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def invented(seed, documents=200):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "C", "dé", "été", "мир", "x\x00y", "\x1c", "日本"]
    rows = []
    for _ in range(documents):
        lang = rng.choice(["en", "de", None])
        words = rng.choices(vocabulary, weights=[9, 7, 5, 4, 3, 2, 2, 1, 1], k=rng.randint(0, 80))
        if rng.random() < 0.5:
            words[len(words) // 2 : len(words) // 2] = ["Fixed", "Phrase", "of", "words"]
        rows.append(("".join(w + rng.choice([" "] * 12 + ["\t", "  ", ", ", ".", "\r\n", "\x0b", "!"]) for w in words), lang))
    return rows


@pytest.mark.parametrize("limits", [{}, {"limit": 12, "burst": 2, "batch_words": 40}])
def test_collocations_against_brute_force(spark, limits):
    rows = invented(len(limits))
    docs = spark.createDataFrame([(i, t, lang, "x", 3) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int").repartition(3)
    got = phrases.collocations(docs, **limits)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == plain(rows)
    assert len(plain(rows)) > 50


def test_other_lengths_and_tops(spark):
    rows = invented(9, 60)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, phrases.collocations(docs, longest=3, least=5, top=7, cover=50).collect())) == plain(rows, 3, 5, 7, 50)


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 7)
    for text in ("one two three, four five " * 40, "unbroken" * 9, "", " ", "...", "ends here"):
        low = text.encode().translate(phrases.CLEAN).replace(b"\n", b" . ").split()
        assert [w for part in phrases.words_of(text) for w in part] == low


@pytest.mark.parametrize("width", [2, 3, 4])
def test_trie_bursts_and_gives_back_what_it_was_given(width):
    rng = np.random.default_rng(width)
    trie, want = phrases.HatTrie(width, burst=20, limit=10_000), Counter()
    for _ in range(20):
        ids = rng.integers(0, 12, (200, width))
        rest = np.zeros(200, np.int64)
        for k in range(1, width):
            rest = rest << phrases.ID_BITS | ids[:, k]
        keys, counts = np.unique(np.column_stack([ids[:, 0], rest]), axis=0, return_counts=True)
        trie.add(keys[:, 0], keys[:, 1], counts)
        for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
            want[tuple(k)] += n
    assert bool(trie.nodes) == (width > 2)
    assert trie.entries == len(want)
    taken = lambda keys: list(zip(*(x.tolist() for x in trie.take(keys)), strict=True))
    got = taken(trie.largest())
    assert 2 * len(got) >= len(want) and trie.entries == len(want) - len(got)
    got += taken(list(trie.root))
    assert Counter({(f, r): n for f, r, n in got}) == want and len(got) == len(want)


def test_scores_beyond_64_bits(spark, monkeypatch):
    many = 1 << 52
    counts = spark.createDataFrame([("en", "a", 1, 3 * many), ("en", "b", 1, many + 1), ("en", "a b", 2, many)], "lang string, phrase string, width int, f long")
    totals = spark.createDataFrame([("en", 9 * many)], "lang string, n long")
    monkeypatch.setattr(phrases, "count_phrases", lambda *a, **k: (totals, counts))
    got = phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", many, 3 * many, many + 1, 9 * many, 2_000_000 * many // (4 * many + 1))]


def test_sql_and_odd_rows(spark, odd_docs, no_docs):
    assert phrases.collocations(no_docs).collect() == []
    docs = odd_docs.select("text", "lang").unionByName(spark.createDataFrame(invented(3, 80), "text string, lang string"))
    duck = duckdb.connect()
    duck.register("documents", docs.toPandas())
    got = sorted(map(tuple, phrases.collocations(docs).collect()))
    assert got == sorted(duck.execute(phrases.SQL).fetchall())
    assert any(r[2] == "word word" or r[2].startswith("word word") for r in got)
