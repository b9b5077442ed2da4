"""License scan against brute force over all blocks and templates, and odd rows."""

import random
import re

import duckdb
import pytest

from millrace.llm import licenses

STEP = 64


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(text, templates, step):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    starts, base, labels, score = [], set(), set(), 0.0
    for label, own, need, phrase in templates.rows:
        if phrase:
            found = [i for i in range(len(words)) if words[i : i + len(own)] == own]
            starts += found
            if found:
                base.add(label)
                score = 1.0
        else:
            for at in range(0, len(words), step):
                common = len(set(words[at : at + 2 * step]) & set(own))
                if common >= need:
                    labels.add(label)
                    score = max(score, common / len(set(own)))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def check(spark, texts, templates=None, step=STEP):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, n_words int, labels string").repartition(3), templates, step).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == [plain(t, templates or licenses.Templates(), step) for t in texts]
    return got


def test_phrases_and_notices_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [w for _, words in licenses.NOTICES for w in words.split()] + ["été", "мир", "foo"] * 10
    texts = []
    for _ in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 400))]
        for _ in range(rng.randint(0, 3)):
            notice = rng.choice(licenses.NOTICES + licenses.PHRASES)[1].split()
            for _ in range(rng.randint(0, 3)):
                notice[rng.randrange(len(notice))] = rng.choice(["foo", "The", "été"])
            at = rng.randint(0, len(words))
            words[at:at] = notice
        texts.append("".join(w.title() if rng.random() < 0.2 else w for x in words for w in (x, rng.choice([" ", ", ", "\n", "-", "\x00"]))))
    got = check(spark, texts)
    assert {r.labels for r in got} >= {"", "mit"} and max(r.n_base for r in got) > 1


def test_phrases_over_borders_of_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(licenses, "CHUNK", 10)
    texts = [" ".join(["x"] * k + ["MIT license apache  License"] + ["y"] * 70) for k in range(60, 68)]
    check(spark, [*texts, "general public license " * 300, "general\npublic general public. LICENSE"])


def test_own_templates_with_repeated_words(spark):
    own = licenses.Templates((("a", "one two three four five"),), (("b", "go go"), ("c", "go")), percent=60)
    check(spark, ["go go go", "go", "go one go", "one two x three", "one two", "five four one go go"], own, 5)
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame([], "doc_id long, text string"), own, 4)


def test_license_lines_are_labelled(spark):
    lines = {
        "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "This work is licensed under the GNU General Public License, version 3.": "gpl", "Released under the terms of the committee.": "", "Licensed under CC BY 4.0.": "",
    }
    got = check(spark, list(lines))
    assert [r.labels for r in got] == list(lines.values())


def test_sql_and_odd_rows(spark, odd_docs, no_docs):
    extra = spark.createDataFrame([(11, "mit license " * 100), (11, "mit license " * 100), (12, "Apache\tLicense" + " filler" * 150 + " MIT LICENSE")], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(extra)
    got = sorted(map(tuple, licenses.scan(docs).collect()), key=repr)
    duck = duckdb.connect()
    duck.register("documents", docs.toPandas())
    assert got == sorted(duck.execute(licenses.sql()).fetchall(), key=repr)
    assert licenses.scan(no_docs).collect() == []
    assert licenses.scan(odd_docs).count() == odd_docs.count()
