"""Toxicity by a lexicon that is matched with misspellings, and the contexts of its matches.

Terms are learned from a bounded sample of labelled rows.  Their trie is intersected with the Levenshtein
automaton of the words at hand: a state is the set of (trie node, edits used) that a prefix can have
reached, made deterministic as words need it.  Allowed edits grow with a term's length.  Each match is then
judged in a window of words: between quotation marks, or soon after a word of reporting, it counts as
quoted.  A logistic regression over exact, misspelled and quoted matches and their density gives the score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Memo, sampled

TOKEN = re.compile(r"[\w@$]+|[\"“”„«»‹›]")
QUOTES = frozenset("\"“”„«»‹›")
# Characters that stand for letters, and words that introduce what somebody else said.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
REPORTING = frozenset(
    "said says wrote writes called calls quoted quote quotes term word words phrase insult insults slur slurs "
    "sagte schrieb nannte zitat wort dit écrit appelé mot citation dijo escribió llamó cita palabra".split()
)
FEATURES = 4


def edits_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 8 else 2


class LexiconAutomaton:
    """Deterministic on demand; a state is a tuple of (node, edits), nodes are numbered in order of insertion."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.terms = terms
        for t, term in enumerate(terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                node = self.children[node][c]
            self.term[node] = t
        self.reach = [0] * len(self.children)  # the most edits that a term below a node may have
        for node in range(len(self.children) - 1, -1, -1):
            own = edits_allowed(len(terms[self.term[node]])) if self.term[node] >= 0 else -1
            self.reach[node] = max([own, *(self.reach[c] for c in self.children[node].values())])
        self.reset()

    def reset(self) -> None:
        self.known: dict[tuple, int] = {}
        self.states: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0})
        self.dead = self._state({})

    def _state(self, reached: dict[int, int]) -> int:
        todo = list(reached.items())
        while todo:  # characters of a term that the word leaves out
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.reach[child] and e + 1 < reached.get(child, 9):
                    reached[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(reached.items()))
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(reached)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] >= 0 and e <= edits_allowed(len(self.terms[self.term[n]]))]
            self.accepts.append(min(ends, default=None))
        return self.known[key]

    def _move(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}
        for node, e in self.states[state].items():
            for label, child in self.children[node].items():
                cost = e + (label != c)
                if cost <= self.reach[child] and cost < reached.get(child, 9):
                    reached[child] = cost
            if e + 1 <= self.reach[node] and e + 1 < reached.get(node, 9):  # a character that the term lacks
                reached[node] = e + 1
        to = self.moves[state][c] = self._state(reached)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, number of the term) of the nearest term within its allowed edits, ties to the earlier term."""
        state, moves, dead = self.start, self.moves, self.dead
        for c in word:
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state == dead:
                return None
        return self.accepts[state]


@dataclass
class ToxicityModel:
    terms: list[str]
    innocent: frozenset[str]  # clean words that lie within the allowed edits of a term
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = -2.0

    def memo(self, limit: int = 300_000) -> Memo:
        """A word's row: 0, or 1 for a term, 2 for a misspelled one, 3 for a quotation mark, 4 for a word of reporting."""
        machine = LexiconAutomaton(self.terms)

        def make(word: str, row: np.ndarray) -> None:
            if word in QUOTES:
                row[0] = 3
            elif word in REPORTING:
                row[0] = 4
            elif self.terms:
                if len(machine.states) > 50_000:
                    machine.reset()
                plain = word if word.isalpha() else word.translate(LOOKALIKES)
                found = machine.match(plain)
                if found and word not in self.innocent:
                    row[0] = 1 if not found[0] and plain == word else 2

        return Memo(make, 1, np.int8, limit)

    def features(self, text: str | None, memo: Memo, window: int = 12, after: int = 4) -> np.ndarray:
        """log(1 + exact), log(1 + misspelled), log(1 + quoted) matches, and matches per 10 words."""
        out = np.zeros(FEATURES)
        words = TOKEN.findall(text.lower()) if text else []
        kinds = memo.rows(words)[:, 0] if words else np.zeros(0, np.int8)
        memo.drop()
        hits = np.flatnonzero((kinds == 1) | (kinds == 2))
        if not len(hits):
            return out
        marks, reports = np.flatnonzero(kinds == 3), np.flatnonzero(kinds == 4)
        i = np.searchsorted(marks, hits)
        # Between an odd mark and the next one, both near.
        left = np.where(i > 0, hits - marks[np.maximum(i - 1, 0)], window + 1) if len(marks) else np.full(len(hits), window + 1)
        right = np.where(i < len(marks), marks[np.minimum(i, len(marks) - 1)] - hits, window + 1) if len(marks) else left
        j = np.searchsorted(reports, hits)
        report = np.where(j > 0, hits - reports[np.maximum(j - 1, 0)], after + 1) if len(reports) else np.full(len(hits), after + 1)
        quoted = ((left <= window) & (right <= window) & (i % 2 == 1)) | (report <= after)
        exact, wrong = np.sum(~quoted & (kinds[hits] == 1)), np.sum(~quoted & (kinds[hits] == 2))
        out[:] = np.log1p(exact), np.log1p(wrong), np.log1p(quoted.sum()), min(1.0, 10 * (exact + wrong) / len(words))
        return out

    def score(self, text: str | None, memo: Memo) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.features(text, memo) @ self.weights + self.bias)))))


def copy_groups(texts: list[str], keys: int = 8) -> dict[str, int]:
    """Text -> number of its group: texts that share the least hash of their 4-word windows under any of ``keys`` hashes."""
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    first: dict[tuple, int] = {}
    factors = np.random.default_rng(5).integers(1, 1 << 63, keys, dtype=np.uint64) | np.uint64(1)
    for i, t in enumerate(texts):
        h = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in t.split()], np.uint64)
        if len(h) >= 4:
            h = ((h[:-3] * np.uint64(31) + h[1:-2]) * np.uint64(31) + h[2:-1]) * np.uint64(31) + h[3:]
        for k, f in enumerate(factors if len(h) else []):
            parent[root(i)] = root(first.setdefault((k, int((h * f).min())), i))
    return {t: root(i) for i, t in enumerate(texts)}


def learn_terms(rows: list[tuple[str, int]], least: int = 4) -> list[str]:
    """Words (three characters or more) that speak for label 1 beyond chance among all words that were looked at.

    Equal texts count once, and so do near copies among those with label 1.  A word needs ``least`` texts with label
    1, nine in ten of its texts must have that label, and the likelihood ratio against the base rate must exceed the
    logarithm of the vocabulary's size by 5.
    """
    seen: dict[str, int] = {t: y for t, y in rows if t and y in (0, 1)}
    toxic, clean = Counter(), Counter()
    groups = copy_groups([t for t, y in seen.items() if y])
    counted: dict[int, set] = {}
    for t, y in seen.items():
        found = {w for w in TOKEN.findall(t.lower()) if len(w) > 2 and w.isalpha()}
        if y:
            counted.setdefault(groups[t], set()).update(found)
        else:
            clean.update(found)
    for found in counted.values():
        toxic.update(found)
    n, n1 = len(seen), sum(seen.values())
    if not 0 < n1 < n:
        return []
    base, floor = n1 / n, math.log(len(toxic) + len(clean)) + 5
    out = []
    for w, a in toxic.items():
        b = clean[w]
        if a >= least and a >= 0.9 * (a + b):
            share = a / (a + b)
            gain = a * math.log(share / base) + (b * math.log((1 - share) / (1 - base)) if b else 0)
            if gain > floor:
                out.append((-a, w))
    return [w for _, w in sorted(out)]


def fit(rows: list[tuple[str, int]], steps: int = 400, ridge: float = 1e-3) -> ToxicityModel:
    """rows: (text, label).  Without both labels the model has no terms and scores everything alike."""
    rows = [(t, y) for t, y in rows if y in (0, 1)]
    terms = learn_terms(rows)
    machine, clean = LexiconAutomaton(terms), Counter()
    for t, y in rows:
        if not y and t:
            clean.update(set(TOKEN.findall(t.lower())))
    known = set(terms)
    innocent = frozenset(w for w in clean if w not in known and (m := machine.match(w)) and m[0])
    model = ToxicityModel(terms, innocent)
    if not rows:
        return model
    memo = model.memo()
    x = np.array([model.features(t, memo) for t, _ in rows])
    y = np.array([float(v) for _, v in rows])
    w, b = np.zeros(FEATURES), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    for _ in range(steps):  # Newton's method, damped by the ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        a = np.column_stack([x, np.ones(len(x))])
        grad = a.T @ (p - y) / len(y) + ridge * np.append(w, 0)
        hess = (a * (p * (1 - p))[:, None]).T @ a / len(y) + np.diag([ridge] * FEATURES + [1e-6])
        move = np.linalg.solve(hess, grad)
        w, b = w - move[:-1], b - move[-1]
        if np.abs(move).max() < 1e-8:
            break
    # A misspelled term seldom occurs in a sample: it is held to be worth at least three quarters of an exact one.
    w[1] = max(w[1], 0.75 * w[0])
    model.weights, model.bias = w, float(b)
    return model


def is_training_row(doc_id, folds: int = 5, held: int = 0):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds != held


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, sample_bytes: int = 24 << 20) -> ToxicityModel:
    """Fit on about ``sample_rows`` labelled rows (docs: doc_id, text; labels: doc_id, toxic), chosen by a hash of doc_id, and
    on fewer where their texts have more than ``sample_bytes`` bytes.  Equal rows of labels count once."""
    labels = sampled(labels.where("toxic IS NOT NULL").select("doc_id", "toxic").distinct(), "doc_id", sample_rows)
    rows = docs.select("doc_id", "text").join(labels, "doc_id")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > sample_bytes:
        share = int(1_000_000 * sample_bytes / size)
        rows = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)), F.lit(1_000_000)) < share)
    rows = rows.orderBy("doc_id", "text", "toxic").collect()
    return fit([(r["text"], r["toxic"]) for r in rows])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted for each row of docs (doc_id, text); other columns are ignored.

    Null and empty texts and texts without a match get the score of no matches.  Repeated rows are scored alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        memo = model.memo()
        for batch in batches:
            scores = [model.score(t.as_py(), memo) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                ["doc_id", "score", "predicted"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")
