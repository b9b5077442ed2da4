"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's letters, in lower case and with one blank between words, give its subwords: all windows of 2 to
4 characters that hold a blank at most at their ends, which so mark word boundaries.  Each is hashed to one
of ``buckets`` embeddings.  The text is the average of its subwords' embeddings; a linear layer and a
softmax give language scores.  Embeddings and layer are trained by stochastic gradient descent in numpy on
a bounded sample.  A temperature is fitted on held-out sample rows, and the rejection level is the score
below which predictions on those rows are wrong more often than right.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import sampled

RUNS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def subwords(text: str | None, bits: int) -> np.ndarray:
    """Buckets (below 2**bits) of a text's subwords, with repeats; none if it is null or has no letter."""
    runs = RUNS.findall(text.lower()) if text else []
    joined = " ".join(runs)
    if not joined.isascii() and not any(c.isalpha() for c in joined):
        return np.zeros(0, np.int64)  # superscripts and the like are word characters, but not letters
    if not runs:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(f" {joined} ".encode("utf-32-le", "replace"), np.uint32)
    blank, wide = codes == 32, codes.astype(np.uint64)
    found, inner = [], np.zeros(len(codes), bool)
    mixed = wide * FACTORS[0]
    for n in range(2, 5):
        if len(codes) < n:
            break
        # A window of n from i: its hash extends that of n - 1 from i; no blank may stand inside.
        mixed = (mixed[: len(codes) - n + 1] ^ (mixed[: len(codes) - n + 1] >> np.uint64(29))) + wide[n - 1 :] * FACTORS[n - 1]
        inner = inner[: len(codes) - n + 1] | (blank[n - 2 : len(codes) - 1] if n > 2 else False)
        found.append((mixed * FACTORS[0])[~inner] >> np.uint64(64 - bits))
    return np.concatenate(found).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # buckets x languages: embedding times layer
    bias: np.ndarray
    temperature: float
    reject_below: float

    def score(self, text: str | None) -> tuple[str, float]:
        found = subwords(text, len(self.logits).bit_length() - 1)
        if not len(found):
            return UNKNOWN, 0.0
        z = np.zeros(len(self.languages))
        for at in range(0, len(found), 1 << 16):
            z += self.logits[found[at : at + (1 << 16)]].sum(0, dtype="float64")
        z = (z / len(found) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def _shares(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares in its average."""
    counts = np.bincount(subwords(text, bits), minlength=1 << bits)
    where = np.flatnonzero(counts)
    return where, (counts[where] / max(1, counts.sum())).astype("float32")


def fit(rows: list[tuple[str, str]], bits: int = 15, dim: int = 12, epochs: int = 4, rate: float = 0.3, seed: int = 7) -> LanguageModel:
    """rows: (text, language).  Rows without letters are left out; one language or none gives a constant model."""
    rng = np.random.default_rng(seed)
    data = [(*_shares(t, bits), y) for t, y in rows if y is not None]
    data = [x for x in data if len(x[0])]
    languages = sorted({y for *_, y in data})
    if not languages:
        return LanguageModel([UNKNOWN], np.zeros((1 << bits, 1), "float32"), np.zeros(1), 1.0, 0.0)
    code = {y: i for i, y in enumerate(languages)}
    order = rng.permutation(len(data))
    held = [data[i] for i in order[: len(data) // 5]]
    train = [data[i] for i in order[len(data) // 5 :]]
    emb = rng.normal(0, 0.5, (1 << bits, dim)).astype("float32")
    layer, bias = rng.normal(0, 0.5, (dim, len(languages))).astype("float32"), np.zeros(len(languages), "float32")
    steps, total = 0, max(1, epochs * len(train))
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            where, share, y = train[i]
            step = np.float32(rate * (1 - steps / total))
            steps += 1
            rows_ = emb[where]
            hidden = share @ rows_
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[code[y]] -= 1
            # The step on the embeddings is normalised so that it moves the average by step * gradient.
            emb[where] = rows_ - np.outer(share * (step / (share @ share)), layer @ p)
            layer -= step * np.outer(hidden, p)
            bias -= step * np.float32(0.01) * p
    model = LanguageModel(languages, (emb @ layer).astype("float32"), bias.astype("float64"), 1.0, 0.0)
    if held:
        z = np.array([s @ model.logits[w] + bias for w, s, _ in held])
        y = np.array([code[x] for *_, x in held])
        z -= z.max(1, keepdims=True)
        loss = lambda t: -(z[np.arange(len(y)), y] / t - np.log(np.exp(z / t).sum(1))).mean()
        model.temperature = float(min(np.geomspace(0.25, 16, 49), key=loss))
        p = np.exp(z / model.temperature)
        model.reject_below = reject_level(p.max(1) / p.sum(1), p.argmax(1) == y, len(languages))
    return model


def reject_level(top: np.ndarray, right: np.ndarray, n_languages: int) -> float:
    """The largest score below which predictions are more often wrong than right; that of a guess if there is none."""
    order = np.argsort(top)
    wrong = np.cumsum(~right[order]) > 0.5 * np.arange(1, len(top) + 1)
    level = float(top[order][np.flatnonzero(wrong)[-1]]) if wrong.any() else 0.0
    return min(0.5, max(level, 1.0 / n_languages))


def train(docs: DataFrame, sample_rows: int = 3000, sample_bytes: int = 24 << 20, **options) -> LanguageModel:
    """Fit on about ``sample_rows`` rows of docs (doc_id, text, lang not null), chosen by a hash of doc_id, and on fewer where
    their texts have more than ``sample_bytes`` bytes."""
    rows = sampled(docs.where("lang IS NOT NULL").select("doc_id", "text", "lang"), "doc_id", sample_rows)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > sample_bytes:
        # A text that alone is beyond the bound is left out, since a share of the rows could still hold it.
        share = int(1_000_000 * sample_bytes / size)
        chosen = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)), F.lit(1_000_000)) < share
        rows = rows.where(chosen & (F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes // 8))
    rows = rows.orderBy("doc_id", "text").collect()
    return fit([(r["text"], r["lang"]) for r in rows], **options)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds lang_pred, score and rejected to each row of docs (text).

    Null and empty texts and texts without a letter get ``und``, score 0 and are rejected.  Other columns
    pass through; columns of these three names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    docs = docs.select(*kept)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string, score double, rejected boolean"])

    def run(batches):
        model = shared.value
        for batch in batches:
            out = [model.score(t.as_py()) for t in batch.column("text")]
            table = pa.Table.from_batches([batch])
            table = table.append_column("lang_pred", pa.array([x for x, _ in out], pa.string()))
            table = table.append_column("score", pa.array([s for _, s in out], pa.float64()))
            table = table.append_column("rejected", pa.array([x == UNKNOWN or s < model.reject_below for x, s in out], pa.bool_()))
            yield from table.to_batches()

    return docs.mapInArrow(run, schema)


def is_training_row(doc_id, folds: int = 4, held: int = 2):
    """Rows outside the held-out fold by crc32 of the id's text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds != held
