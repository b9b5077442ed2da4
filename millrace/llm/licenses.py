"""License scan by an exact set-similarity join of text blocks with templates.

A document's words are cut into blocks of ``2 * step`` words, one starting each ``step`` words, so that every stretch of
up to ``step`` words lies whole in a block.  A block and a template are sets of words.  A template is met where the
block holds at least ``need`` of its words, the ceiling of its size times the containment threshold.

Words are ordered by the number of places of the corpus that hold them, rarest first.  Of a template's words in this order,
a block that meets it must hold one of the first size - need + 1 (prefix filter); it must have ``need`` words of
templates at all (length filter); and what is left of both sides behind the shared word must suffice (positional filter).
Pairs that pass are settled on the whole sets.  No pair that meets the threshold is lost, none is reported that does not.

Phrases are templates that must be met whole; their places, where the words stand one after another, are then counted
in the blocks found, each in the block whose first half it begins in.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialise

#: (label, words that must stand one after another).
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: (label, notice as it is usually worded).
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Containment in per cent that a notice needs.
PERCENT = 90

#: A-Z to lower case; ASCII that is neither letter nor digit to a blank.
CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or b >= 97 and b not in range(123, 128) else 32 for b in range(256))
#: Bytes of a text that are split into words at a time.
CHUNK = 1 << 20


class Templates:
    """Notices and phrases as sets of words, and all their words."""

    def __init__(self, notices=NOTICES, phrases=PHRASES, percent: int = PERCENT):
        self.rows = [(label, words.split(), -(-percent * len(set(words.split())) // 100), False) for label, words in notices]
        self.rows += [(label, words.split(), len(set(words.split())), True) for label, words in phrases]
        if any(not words for _, words, _, _ in self.rows):
            raise ValueError("a template has no words")
        self.words = sorted({w for _, words, _, _ in self.rows for w in words})
        self.longest = max(len(words) for _, words, _, _ in self.rows)

    def ordered(self, counts: dict[str, int]) -> list[str]:
        """All words, rarest first; ties in their own order."""
        return sorted(self.words, key=lambda w: (counts.get(w, 0), w))

    def postings(self, spark: SparkSession, order: list[str]) -> DataFrame:
        """A row for each word of each template's prefix: token, i (its place), size, need, and the template itself."""
        rank = {w: i for i, w in enumerate(order)}
        rows = []
        for k, (label, words, need, phrase) in enumerate(self.rows):
            own = sorted({rank[w] for w in words})
            for i, token in enumerate(own[: len(own) - need + 1]):
                rows.append((token, i, len(own), need, k, label, phrase, own, [rank[w] for w in words]))
        return spark.createDataFrame(rows, "token int, i int, size int, need int, template int, label string, phrase boolean, own array<int>, words array<int>")


def ranks(text: str | None, order: dict[bytes, int]) -> np.ndarray:
    """Rank of each word of a text, -1 for words of no template."""
    data = (text or "").encode("utf-8", "replace").translate(CLEAN)
    parts, at = [np.zeros(0, np.int32)], 0
    while at < len(data):
        to = data.find(b" ", at + CHUNK)
        to = len(data) if to < 0 else to
        words = data[at:to].split()
        parts.append(np.fromiter(map(order.get, words, repeat(-1)), np.int32, len(words)))
        at = to
    return np.concatenate(parts)


def frequencies(docs: DataFrame, words: list[str], step: int) -> dict[str, int]:
    """In how many stretches of ``step`` words of all documents each word occurs; the result is as long as ``words``."""
    index = {w.encode(): i for i, w in enumerate(words)}

    def run(batches):
        total = np.zeros(len(index), np.int64)
        for batch in batches:
            for text in batch.column("text"):
                r = ranks(text.as_py(), index)
                hit = np.flatnonzero(r >= 0)
                cells = np.unique(hit // step * len(index) + r[hit])
                total += np.bincount(cells % len(index), minlength=len(index))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["word", "n"])

    found = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {words[r.word]: r.n for r in found}


def blocks(docs: DataFrame, order: list[str], prefix: set[int], step: int) -> DataFrame:
    """For each row of docs one with n_words and no block, and one for each block that has a word of any template's prefix:
    at (places of the words of templates, from the text's begin) and rank (their ranks)."""
    index = {w.encode(): i for i, w in enumerate(order)}
    rare = np.zeros(len(order), bool)
    rare[list(prefix)] = True
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            ids, rows = batch.column("doc_id"), batch.column("row").to_pylist()
            which, n_words, block, at, rank = [], [], [], [], []

            def flush(ids=ids, rows=rows, which=which, n_words=n_words, block=block, at=at, rank=rank):
                out = pa.RecordBatch.from_arrays(
                    [pa.array([rows[k] for k in which], pa.int64()), ids.take(pa.array(which, pa.int64())), pa.array(n_words, pa.int64()), pa.array(block, pa.int64()), pa.array(at, pa.list_(pa.int64())), pa.array(rank, pa.list_(pa.int32()))],
                    ["row", "doc_id", "n_words", "block", "at", "rank"],
                )
                for held in (which, n_words, block, at, rank):
                    held.clear()
                return out

            for k, text in enumerate(batch.column("text")):
                r = ranks(text.as_py(), index)
                found = [(None, None, None)]
                hit = np.flatnonzero(r >= 0)
                if len(hit):
                    cells = np.unique(hit[rare[r[hit]]] // step)
                    near = np.unique(np.concatenate([cells, cells[cells > 0] - 1]))
                    low, high = np.searchsorted(hit, near * step), np.searchsorted(hit, (near + 2) * step)
                    found += [(b, hit[lo:hi], r[hit[lo:hi]]) for b, lo, hi in zip(near.tolist(), low, high, strict=True)]
                for b, places, values in found:
                    which.append(k)
                    n_words.append(len(r) if b is None else None)
                    block.append(b)
                    at.append(places)
                    rank.append(values)
                    if len(which) >= 20_000:
                        yield flush()
            yield flush()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, f"row long, doc_id {id_type}, n_words long, block long, at array<long>, rank array<int>")


def met(found: DataFrame, postings: DataFrame) -> DataFrame:
    """Pairs of a block and a template it meets, once each: row, block, at, rank, template, label, phrase, words, containment.

    ``postings`` is as long as the templates' prefixes, however many the documents, and is broadcast.
    """
    sets = found.withColumn("tokens", F.array_sort(F.array_distinct("rank")))
    pairs = sets.select("*", F.posexplode("tokens").alias("j", "token")).join(F.broadcast(postings), "token")
    held = F.size("tokens")
    long_enough = held >= F.col("need")
    ahead = F.least(F.col("size") - F.col("i"), held - F.col("j"))
    in_place = F.least("i", "j") + ahead >= F.col("need")
    pairs = pairs.where(long_enough & in_place).withColumn("common", F.array_intersect("tokens", "own"))
    # A pair that shares several prefix words is kept at the first of them only.
    pairs = pairs.where((F.array_min("common") == F.col("token")) & (F.size("common") >= F.col("need")))
    return pairs.select("row", "block", "at", "rank", "template", "label", "phrase", "words", (F.size("common") / F.col("size")).alias("containment"))


def places(step: int):
    """Starts of the phrase ``words`` in a block whose first half they begin in."""
    k = F.size("words")

    def begins(i):
        first, last = F.get("at", i), F.get("at", i + k - 1)
        return (F.get("rank", i) == F.get("words", F.lit(0))) & (last - first == k - 1) & (first < (F.col("block") + 1) * step) & (F.slice("rank", i + 1, k) == F.col("words"))

    index = F.filter(F.sequence(F.lit(0), F.size("rank") - 1), begins)
    return F.transform(index, lambda i: F.get("at", i))


def scan(docs: DataFrame, templates: Templates | None = None, step: int = 64) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs (doc_id, text).

    Words are runs of ASCII letters and digits (A-Z in lower case) and of all other characters beyond ASCII.  n_base counts
    all places of phrases; first_word and last_word are the smallest and largest start, null without any;
    base_labels are those of the phrases that occur, labels those and the ones of notices met in a block, both
    distinct, sorted and joined by commas; score is the largest containment met, 1 where a phrase occurs, else 0.
    Null and empty texts have no words and no labels.  Each row counts for itself: repeated and null ids are fine.
    """
    spark = docs.sparkSession
    templates = templates or Templates()
    if templates.longest > step:
        raise ValueError(f"a template has more than {step} words")
    order = templates.ordered(frequencies(docs, templates.words, step))
    postings = templates.postings(spark, order)
    table = materialise(blocks(docs.select("doc_id", "text"), order, {r.token for r in postings.select("token").collect()}, step))
    found = met(table.where("block IS NOT NULL"), postings)
    found = found.withColumn("starts", F.when(F.col("phrase"), places(step)).otherwise(F.array().cast("array<long>")))
    found = found.where(~F.col("phrase") | (F.size("starts") > 0))
    per = found.groupBy("row").agg(
        F.sum(F.size("starts")).alias("n_base"),
        F.min(F.array_min("starts")).alias("first_word"),
        F.max(F.array_max("starts")).alias("last_word"),
        F.collect_set(F.when(F.col("phrase"), F.col("label"))).alias("base"),
        F.collect_set("label").alias("all"),
        F.max("containment").alias("best"),
    )
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return (
        table.where("block IS NULL").select("row", "doc_id", "n_words").join(per, "row", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
            joined("base").alias("base_labels"), joined("all").alias("labels"), F.coalesce("best", F.lit(0.0)).alias("score"),
        )
    )


def sql(templates: Templates | None = None, step: int = 64, docs: str = "documents") -> str:
    """DuckDB SQL of scan(): all blocks against all templates; phrases of two or three words."""
    templates = templates or Templates()
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ",\n    ".join(f"({k}, '{label}', {phrase}, {quoted(words)}, {need})" for k, (label, words, need, phrase) in enumerate(templates.rows))
    letters = "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH templates(k, label, phrase, words, need) AS (VALUES
    {rows}),
texts AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{letters.upper()}', '{letters}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {docs}),
cut AS (SELECT rid, unnest(generate_series(0, greatest(len(w) - 1, 0) // {step})) AS b, w FROM texts),
parts AS (SELECT rid, b, list_distinct(w[b * {step} + 1 : (b + 2) * {step}]) AS held FROM cut),
near AS (SELECT rid, label, len(list_intersect(held, words)) / len(list_distinct(words)) AS c FROM parts, templates
    WHERE NOT phrase AND len(list_intersect(held, words)) >= need),
flat AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM texts),
stands AS (SELECT rid, pos, word, lead(word) OVER o AS next, lead(word, 2) OVER o AS third FROM flat WINDOW o AS (PARTITION BY rid ORDER BY pos)),
base AS (SELECT rid, pos, label FROM stands, templates WHERE phrase AND word = words[1] AND next = words[2] AND (len(words) = 2 OR third = words[3])),
labelled AS (SELECT rid, label, c FROM near UNION ALL SELECT rid, label, 1.0 FROM base),
a AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY rid),
l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS score FROM labelled GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM texts LEFT JOIN a USING (rid) LEFT JOIN l USING (rid)"""
