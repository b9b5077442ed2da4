"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback measures each text: characters per token, share of tokens that are
fallback bytes, and entropy of the token distribution per word.  Bands are far-out fences (quartiles and
``fence`` times their distance) over all documents of a language, or of a script where no language is known.
Documents outside their band are rejected, besides those that fail the base rules.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Ragged, materialise

SYMBOLS = re.compile(r"[#*$%&|<>]")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
SPACES = " \t\n\r\x0b\x0c"


def base_measures(text: str, words: list[bytes], ids: np.ndarray) -> tuple[int, ...]:
    """The five base counts; words are the text's words in UTF-8, ids a number for each distinct word."""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    repeat = 0
    if len(ids) >= 3:
        wide = np.int64(ids.max()) + 1
        keys = (ids[:-2] * wide + ids[1:-1]) * wide + ids[2:] if wide < 1 << 20 else None
        if keys is None:
            _, keys = np.unique(np.column_stack([ids[:-2], ids[1:-1], ids[2:]]), axis=0, return_inverse=True)
        order = np.sort(keys)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            at = np.flatnonzero(np.isin(keys, twice))
            inside = np.zeros(len(ids), bool)
            inside[at] = inside[at + 1] = inside[at + 2] = True
            repeat = int(inside.sum())
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, len(SYMBOLS.findall(text)), dup, repeat


def script_of(text: str) -> str:
    """Most frequent script among the text's letters (first word of a character's name), ``none`` without letters."""
    if text.isascii():
        return "LATIN" if any(c.isalpha() for c in text) else "none"
    counts: dict[str, int] = {}
    for c in set(text):
        if c.isalpha():
            name = unicodedata.name(c, "none").split(" ")[0]
            counts[name] = counts.get(name, 0) + text.count(c)
    return min(counts, key=lambda k: (-counts[k], k)) if counts else "none"


def measure(docs: DataFrame, model_file: str, lang_col: str | None = "lang") -> DataFrame:
    """doc_id, band (language, else script), the base counts and the three measures of each row of docs (doc_id, text, lang).

    Null and empty texts have no words, no script and measures 0.
    """
    import sentencepiece

    with open(model_file, "rb") as f:
        proto = docs.sparkSession.sparkContext.broadcast(f.read())
    lang = F.col(lang_col) if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    docs = docs.select("doc_id", "text", lang.alias("lang"))

    def run(batches):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto.value)
        is_byte = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])
        memo = Ragged(lambda word: sp.encode(word.decode("utf-8", "replace")))
        for batch in batches:
            rows = []
            for text, known in zip(batch.column("text"), batch.column("lang"), strict=True):
                text, known = text.as_py() or "", known.as_py()
                words = text.encode("utf-8", "replace").split()
                ids = memo.ids(words)
                base = base_measures(text, words, ids)
                pieces = memo.gather(words)
                memo.drop()
                n = len(pieces)
                counts = np.bincount(pieces) if n else np.zeros(0)
                share = counts[counts > 0] / max(1, n)
                entropy = float(-(share * np.log2(share)).sum())
                rows.append(
                    (
                        known or f"script {script_of(text)}", *base,
                        base[1] / n if n else 0.0, float(is_byte[pieces].mean()) if n else 0.0,
                        entropy / math.log2(n + 1) if n else 0.0,
                    )
                )
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(9)]
            kinds = [pa.string(), *[pa.int64()] * 5, *[pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "band", *BASE, *MEASURES],
            )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, band string, " + ", ".join([*(f"{c} long" for c in BASE), *(f"{c} double" for c in MEASURES)])
    return docs.mapInArrow(run, schema)


def bands(measured: DataFrame, fence: float = 4.0, accuracy: int = 2000) -> DataFrame:
    """One row for each band: low and high of each measure, from all its rows that pass the base rules."""
    parts = []
    for m in MEASURES:
        q = F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), accuracy)
        parts.append(q.alias(f"q_{m}"))
    per = measured.where(~F.col("base_failed")).groupBy("band").agg(*parts)
    out = ["band"]
    for m in MEASURES:
        low, mid, high = (F.col(f"q_{m}")[i] for i in range(3))
        # No spread at all (most texts of a band alike) must not reject what differs a little.
        spread = F.greatest(high - low, F.abs(mid) * 0.02, F.lit(0.005))
        out += [(low - fence * spread).alias(f"low_{m}"), (high + fence * spread).alias(f"high_{m}")]
    return per.select(*out)


def judge(docs: DataFrame, model_file: str, lang_col: str | None = "lang", fence: float = 4.0, least_words: int = 50) -> DataFrame:
    """Base counts, measures and verdict of each row of docs.

    base_failed: fewer than ``least_words`` words, or over half of them in repeated 3-word windows.  kept:
    not base_failed, and all measures within the row's band (a row whose band has no fences is kept).
    """
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = materialise(measure(docs, model_file, lang_col).withColumn("base_failed", failed))
    # A band's row is repeated, so that a language with very many documents is not dealt to one task.
    salts = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("salt")
    fences = bands(measured, fence).select("*", salts)
    salted = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int"))
    joined = salted.join(fences, ["band", "salt"], "left")
    inside = F.lit(True)
    for m in MEASURES:
        inside &= F.coalesce(F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}")), F.lit(True))
    return joined.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "band", *MEASURES)
