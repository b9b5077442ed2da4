"""Whitening against numpy's eigenvectors, exact deviations, and odd rows."""

import numpy as np
import pytest

from millrace.llm import whitening

DDL = "vec_id long, embedding array<float>, n string, component string"


def plain(vectors, wanted):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    rank = min(wanted, int((e > 1e-9 * e[0]).sum()))
    return ((n * x - s) ** 2).sum(1), centred @ q[:, :rank] / np.sqrt(e[:rank]), e[:rank] / e.sum()


def check(spark, vectors, wanted=32):
    rows = [(i, [float(c) for c in v], "a", "b") for i, v in enumerate(vectors)]
    got = whitening.whiten(spark.createDataFrame(rows, DDL).repartition(3), wanted=wanted).orderBy("vec_id", "component").toPandas()
    deviation, whitened, explained = plain(vectors, wanted)
    k = whitened.shape[1]
    assert len(got) == len(vectors) * k
    assert got.component.tolist() == list(range(1, k + 1)) * len(vectors)
    assert (got.n == len(vectors)).all()
    assert got.deviation.tolist() == np.repeat(deviation, k).tolist()
    assert np.allclose(got.explained[:k], explained, rtol=1e-10)
    w = got.whitened.to_numpy().reshape(-1, k)
    assert np.abs(w * np.sign((w * whitened).sum(0)) - whitened).max() < 1e-8
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


def test_all_components_of_spread_vectors(spark):
    rng = np.random.default_rng(4)
    check(spark, rng.normal(size=(300, 24)) * np.linspace(3, 0.4, 24) + 5)


def test_wanted_components_of_wide_vectors_stop_early(spark):
    rng = np.random.default_rng(5)
    check(spark, rng.normal(size=(400, 80)) * np.geomspace(40, 1, 80), wanted=4)


def test_rank_below_the_dimension(spark):
    rng = np.random.default_rng(6)
    few = rng.integers(-5, 5, size=(200, 3)).astype(float)
    check(spark, np.column_stack([few, few[:, :1], np.full((200, 2), 7.0)]))
    check(spark, rng.normal(size=(4, 10)) * 9)


def test_large_values_keep_exact_deviations(spark):
    rng = np.random.default_rng(8)
    check(spark, rng.normal(size=(50, 6)) * 100_000 + 1_000_000)


def test_deviation_beyond_64_bits(spark):
    rows = [(i, [i * 1e12, 1.0], "a", "b") for i in range(4)]
    with pytest.raises(Exception, match="exceeds 64 bits"):
        whitening.whiten(spark.createDataFrame(rows, DDL)).collect()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    sound = [(1, [1.0, 2.0]), (1, [3.0, 0.5]), (None, [0.0, 0.0]), (2, [1.0, 2.0])]
    odd = [(3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [-inf, 1.0]), (8, []), (9, [1.0])]
    make = lambda rows: spark.createDataFrame([(*r, "a", "b") for r in rows], DDL)
    got = whitening.whiten(make(sound + odd)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    assert {r.n for r in got} == {4}
    assert whitening.whiten(make([])).collect() == []
    assert whitening.whiten(make(sound[:1])).collect() == []
    assert whitening.whiten(make([(i, [2.0, 2.0]) for i in range(5)])).collect() == []
    assert whitening.whiten(make([])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
