"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Rows are held as whole numbers x = floor(scale * c) + shift; row vectors of the centred matrix A are x - S / n.  The
bidiagonalisation alternates two distributed products: y = A v for a right vector v, and z = A' u for a left vector u.
Left vectors have one entry a row of the table and are never stored: u = A w with a short vector w, so that each task
makes its part of all of them anew from its rows, and one pass gives both products of a step.  Both sides are fully
reorthogonalised: v against all earlier ones on the driver (they are as long as a row), u against all earlier ones by
inner products that tasks add up in the same pass.  Steps go on until the residuals of the wanted triplets are at rounding level, or to the dimension's end.  The
small bidiagonal matrix's singular values and right vectors give deviations and components.

What reaches the driver in a pass is one short row for each partition of the table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise

#: Bytes of whole numbers in a partition of the working table.
PART_BYTES = 8 << 20
SCALE, SHIFT = 64, 1_000_000
RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def fit_list(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x (array<long>) of the rows whose vector has entries, all of them finite.

    The dimension is that of most such rows (ties: the smaller); rows of another one are left out.  An entry whose x no
    64-bit number holds fails the job.
    """
    v = F.col(vector)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = rows.where(sound)
    sizes = kept.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = sizes.d if sizes else 0
    whole = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return kept.where(F.size(v) == d).select("vec_id", whole.alias("x"))


def as_matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


class Products:
    """Distributed sums over the centred rows of a table (vec_id, x)."""

    def __init__(self, table: DataFrame):
        self.table = table

        def of(x):
            if max(abs(int(x.min())), abs(int(x.max()))) * len(x) >= 1 << 62:
                raise OverflowError("the sum of a dimension exceeds 64 bits")
            return [np.concatenate([[len(x)], x.sum(0)])]

        parts = self._sums(of, "array<long>", centred=False)
        total = np.sum([np.array(p[0], dtype=object) for p in parts], 0) if parts else np.zeros(1, object)
        self.n, self.sums = int(total[0]), [int(s) for s in total[1:]]
        self.d = len(self.sums)

    def centre(self):
        """Rows minus their mean as doubles: (n * x - S) / n, exact up to the division where n * x - S fits 62 bits."""
        n, sums = self.n, self.sums
        floors = np.array([s // n for s in sums], np.int64)
        rests = np.array([s % n / n for s in sums])
        return lambda x: (x - floors).astype(float) - rests

    def _sums(self, of, kind: str, centred: bool = True) -> list:
        """One list of arrays from each partition: ``of(rows)`` of its batches, added up."""
        centre = self.centre() if centred else None

        def run(batches):
            total = None
            for batch in batches:
                if batch.num_rows:
                    x = as_matrix(batch)
                    found = of(centre(x) if centre else x)
                    total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([[t.tolist() for t in total]])], ["s"])

        # Partitions in a fixed order, so that sums of doubles repeat.
        found = self.table.select("x").mapInArrow(run, f"s array<{kind}>").select(F.spark_partition_id().alias("p"), "s").collect()
        return [r.s for r in sorted(found, key=lambda r: r.p)]

    def project(self, v: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """For u = A v: A' u, the inner products of u with all left vectors A w (w: columns of ``left``), and |u| squared."""

        def of(a):
            u = a @ v
            return [a.T @ u, (a @ left).T @ u if left.shape[1] else np.zeros(0), np.array([u @ u])]

        parts = self._sums(of, "array<double>")
        z, inner, square = (np.array([math.fsum(c) for c in zip(*(p[k] for p in parts), strict=True)]) for k in range(3))
        return z, inner, float(square[0])

    def total_variance(self) -> float:
        parts = self._sums(lambda a: [(a * a).sum(0)], "array<double>")
        return math.fsum(c for p in parts for c in p[0])


def bidiagonalise(a: Products, wanted: int, tolerance: float = 1e-15, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of the centred matrix (falling) and right vectors (columns) of the ``wanted`` largest, without null ones."""
    d, most = a.d, min(a.d, a.n)
    rng = np.random.default_rng(seed)
    right, left = np.zeros((d, 0)), np.zeros((d, 0))
    images = np.zeros((d, 0))  # A' u of each left vector
    alphas: list[float] = []
    betas: list[float] = []
    v = rng.normal(size=d)
    v /= np.linalg.norm(v)
    scale = 0.0
    while len(alphas) < most:
        # Left vector: A v minus beta times the last one, and what rounding left of its parts along all earlier ones.
        w = v - betas[-1] * left[:, -1] if betas else v
        z, inner, square = a.project(w, left)
        whole = math.sqrt(square)
        scale = max(scale, whole)
        w, z, square = w - left @ inner, z - images @ inner, max(0.0, square - float(inner @ inner))
        if np.abs(inner).max(initial=0.0) > 1e-6 * whole:
            z, inner, square = a.project(w, left)
            w, z, square = w - left @ inner, z - images @ inner, max(0.0, square - float(inner @ inner))
        alpha = math.sqrt(square)
        right = np.column_stack([right, v])
        if alpha <= 1e-13 * scale or scale == 0:
            # A v lies in the span of the earlier left vectors: no new one, the right vector closes the band.
            alphas.append(0.0)
            left, images = np.column_stack([left, np.zeros(d)]), np.column_stack([images, np.zeros(d)])
            z = np.zeros(d)
        else:
            alphas.append(alpha)
            left, images = np.column_stack([left, w / alpha]), np.column_stack([images, z / alpha])
            z = z / alpha
        # Right vector: A' u minus its parts along earlier ones, twice.
        fresh = z - right @ (right.T @ z)
        fresh -= right @ (right.T @ fresh)
        beta = float(np.linalg.norm(fresh))
        if len(alphas) == most:
            break
        if beta <= 1e-13 * max(scale, 1e-300):
            # An invariant space is found: go on with a new direction.
            fresh = rng.normal(size=d)
            fresh -= right @ (right.T @ fresh)
            fresh -= right @ (right.T @ fresh)
            beta, v = 0.0, fresh / np.linalg.norm(fresh)
        else:
            v = fresh / beta
        if len(alphas) >= wanted:
            p, sigma, _ = np.linalg.svd(small(alphas, betas))
            if beta and beta * np.abs(p[-1, :wanted]).max() <= tolerance * sigma[0]:
                break
        betas.append(beta)
    _, sigma, q = np.linalg.svd(small(alphas, betas[: len(alphas) - 1]))
    kept = sigma[:wanted] > 1e-12 * max(float(sigma[0]) if len(sigma) else 0.0, 1e-300)
    return sigma[:wanted][kept], (right @ q.T)[:, :wanted][:, kept]


def small(alphas: list[float], betas: list[float]) -> np.ndarray:
    """The bidiagonal matrix."""
    return np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1)


def identity_error(a: Products, turn: np.ndarray) -> float:
    """Largest absolute entry of the covariance of A turn minus the identity; partitions' moments about their own means are combined."""
    k = turn.shape[1]
    centre = a.centre()

    def run(batches):
        n, mean, second = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                y = centre(as_matrix(batch)) @ turn
                m = y.mean(0)
                y -= m
                gap, rows = m - mean, len(y)
                second += y.T @ y + np.outer(gap, gap) * (n * rows / (n + rows))
                mean += gap * (rows / (n + rows))
                n += rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([second.ravel().tolist()])], ["n", "mean", "second"])

    # Each partition's moments become entries of the whole, so that Spark adds them up, not the driver: with the sum of n * mean
    # and of second + n * mean mean' the means are near 0, since rows are centred.
    parts = a.table.select("x").mapInArrow(run, "n long, mean array<double>, second array<double>")
    cell = F.posexplode("second").alias("at", "s")
    i, j = F.floor(F.col("at") / k).cast("int"), (F.col("at") % k).cast("int")
    cells = parts.select("n", "mean", cell).select("at", "s", "n", F.col("mean")[i].alias("mi"), F.col("mean")[j].alias("mj"))
    summed = cells.groupBy("at").agg(F.sum(F.col("s") + F.col("n") * F.col("mi") * F.col("mj")).alias("s"), F.sum(F.col("n") * F.col("mi")).alias("mi"), F.sum(F.col("n") * F.col("mj")).alias("mj"))
    n = F.lit(float(a.n))
    covariance = (F.col("s") - F.col("mi") * F.col("mj") / n) / n
    one = (F.floor(F.col("at") / k) == F.col("at") % k).cast("double")
    return float(summed.agg(F.max(F.abs(covariance - one))).first()[0])


def whiten(rows: DataFrame, vector: str = "embedding", wanted: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each sound row and component.

    ``rows`` has vec_id and a vector; other columns are ignored.  Rows whose vector is null, empty or holds a null or
    non-finite entry are left out, and so are rows of another dimension than most.  Repeated ids are rows of their own;
    a null vec_id stays null.  There are min(wanted, dimension, rank) components: none without variance, so a table
    of equal vectors, of one row or of none gives no rows.  A deviation that no 64-bit number holds raises OverflowError.
    """
    spark = rows.sparkSession
    found = fit_list(rows, vector)
    # The working table's partitions are made by size: few files of a small table, bounded ones of a large table.
    width = found.agg(F.max(F.size("x")), F.count("*")).first()
    parts = max(1, math.ceil((width[0] or 0) * 8 * width[1] / PART_BYTES))
    table = materialise(found.coalesce(parts))
    a = Products(table)
    id_type = dict(table.dtypes)["vec_id"]
    schema = f"vec_id {id_type}, {RESULT}"
    if not a.n:
        return spark.createDataFrame([], schema)
    sigma, components = bidiagonalise(a, min(wanted, a.d))
    if not len(sigma):
        return spark.createDataFrame([], schema)
    values = sigma**2 / a.n
    turn = components / np.sqrt(values)
    error, explained = identity_error(a, turn), values / (a.total_variance() / a.n)
    n, sums, k, centre = a.n, a.sums, len(sigma), a.centre()

    def run(batches):
        exact = np.array([int(s) for s in sums], dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = as_matrix(batch)
            y = centre(x) @ turn
            widest = max(max(abs(n * int(lo) - s), abs(n * int(hi) - s)) for lo, hi, s in zip(x.min(0), x.max(0), sums, strict=True))
            if widest**2 * x.shape[1] < 1 << 62 and n * max(abs(int(x.min())), abs(int(x.max()))) < 1 << 62:
                deviation = ((n * x - np.array(sums, np.int64)) ** 2).sum(1)
            else:
                deviation = ((n * x.astype(object) - exact) ** 2).sum(1)
                if max(deviation) >= 1 << 63:
                    raise OverflowError("a deviation exceeds 64 bits")
                deviation = deviation.astype(np.int64)
            # A part of the rows at a time: each gives k rows.
            for at in range(0, len(x), 2000):
                m = len(y[at : at + 2000])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(np.arange(at, at + m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n)), pa.array(np.repeat(deviation[at : at + m], k)), pa.array(y[at : at + m].ravel()),
                        pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return table.mapInArrow(run, schema)
