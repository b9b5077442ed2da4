"""Memos keep two generations of words."""

import random

import numpy as np

from millrace.llm.common import Memo, Ragged


def test_generations_give_the_same_rows():
    rng, made = random.Random(1), []

    def make(word, row):
        made.append(word)
        row[0] = len(word)

    plain, ragged = Memo(make, 1, np.int64, limit=40), Ragged(lambda w: [ord(c) for c in w], limit=40, note=lambda w, run: len(run) * 2)
    for _ in range(300):
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 12))]
        assert plain.rows(words)[:, 0].tolist() == [len(w) for w in words]
        assert ragged.gather(words).tolist() == [ord(c) for w in words for c in w]
        assert ragged.rows(words)[:, 2].tolist() == [2 * len(w) for w in words]
        plain.drop()
        ragged.drop()
        assert len(plain) + len(plain.old) <= 40 + 12
    assert len(made) < 300 * 3
