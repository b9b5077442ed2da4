"""Nearest neighbours by inner product: multi-index hashing over learned rotated binary codes.

Model (fitted on a bounded sample): vectors are lifted by one component to equal norms, so that inner
products order like angles; several rotations, each learned to keep its bits close to the rotated
components (iterative quantisation), give a code of some hundred bits.  The Hamming radius is the one
within which the sample's nearest neighbours lie.

Search: a code is split into substrings of 64 bits, each with an index from value to rows.  A code within radius r of a
query agrees with it in one of m substrings up to thresholds that add up to r - m + 1 (pigeonhole), so probing the values
so near in each index retrieves every row within r.  The Hamming distances of what was retrieved are completed, and rows
within r are ranked by the inner product of the original vectors.  A query that finds fewer than k rows of a block widens
its radius step by step.  Rows are indexed in blocks, and the stated queries meet all blocks, in blocks of queries.

Substrings are this long because neighbours of evenly spread vectors differ in over a third of their bits: 16 bits
would have to be probed up to 6 or 7 of them, which retrieves nearly all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise

PIECE = 64


@dataclass
class CodeModel:
    top_norm: float
    mean: np.ndarray
    planes: np.ndarray  # (dimensions + 1) x bits
    radius: int

    def lift(self, x: np.ndarray, is_query: bool) -> np.ndarray:
        """Unit vectors whose inner products order like those of x with a query's vector."""
        if is_query:
            rest = np.zeros(len(x))
            scale = np.linalg.norm(x, axis=1)
        else:
            rest = np.sqrt(np.maximum(0.0, self.top_norm**2 - (x**2).sum(1)))
            scale = np.full(len(x), self.top_norm)
        return np.column_stack([x, rest]) / scale[:, None]

    def codes(self, x: np.ndarray, is_query: bool = False) -> np.ndarray:
        """Substrings of the codes, rows x m of uint64."""
        bits = (self.lift(x, is_query) - self.mean) @ self.planes > 0
        return np.packbits(bits, axis=1).view(np.uint64)


def learn_rotation(x: np.ndarray, bits: int, rng: np.random.Generator, rounds: int = 20) -> np.ndarray:
    """Planes (dimensions x bits): principal directions, then the rotation that moves them closest to signs."""
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    directions = vt[:bits].T
    v = (x - x.mean(0)) @ directions
    rotation = np.linalg.qr(rng.normal(size=(directions.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, wt = np.linalg.svd(np.sign(v @ rotation).T @ v)
        rotation = (u @ wt).T
    return directions @ rotation


def fit(sample: np.ndarray, top_norm: float, n_rows: int, k: int = 20, bits: int = 256, recall: float = 0.95, seed: int = 11) -> CodeModel:
    """sample: rows x dimensions.  The radius holds ``recall`` of the pairs (query, neighbour) in the sample, where a
    query's neighbours are as large a share of the sample as k is of all rows (one at least)."""
    rng = np.random.default_rng(seed)
    model = CodeModel(top_norm, np.zeros(sample.shape[1] + 1), np.zeros((sample.shape[1] + 1, PIECE)), bits)
    lifted = model.lift(sample, False)
    model.mean = lifted.mean(0) if len(sample) > 1 else model.mean
    width = min(bits, max(1, min(lifted.shape) - 1))
    parts = [learn_rotation(lifted, width, rng) for _ in range(math.ceil(bits / width))] if len(sample) > 1 else []
    planes = np.concatenate(parts, axis=1)[:, :bits] if parts else np.zeros((lifted.shape[1], bits))
    model.planes = planes
    if len(sample) > 2:
        picked = sample[rng.permutation(len(sample))[: min(400, len(sample))]]
        share = max(1, min(len(sample) - 1, math.ceil(k * len(sample) / max(1, n_rows))))
        score = picked @ sample.T
        score[score >= (picked**2).sum(1)[:, None] - 1e-12] = -np.inf  # itself and copies
        near = np.argpartition(-score, share - 1, axis=1)[:, :share]
        hc, qc = model.codes(sample), model.codes(picked, True)
        d = np.bitwise_count(qc[:, None, :] ^ hc[near]).sum(2, dtype=np.int64)
        model.radius = int(np.quantile(d[np.isfinite(np.take_along_axis(score, near, 1))], recall)) + 1 if np.isfinite(score).any() else bits
    return model


class Index:
    """The substring indexes of a block: for each, its distinct values and each row's place among them."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = [np.unique(codes[:, j], return_inverse=True) for j in range(codes.shape[1])]

    def probe(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """queries x rows: whether a row agrees with a query in one substring up to its threshold."""
        m = self.codes.shape[1]
        least, more = divmod(max(0, radius - m + 1), m)
        found = np.zeros((len(queries), len(self.codes)), bool)
        for j, (values, places) in enumerate(self.tables):
            near = np.bitwise_count(queries[:, j, None] ^ values[None, :]) <= least + (j < more)
            found |= near if len(values) == len(places) and np.array_equal(places, np.arange(len(places))) else near[:, places]
        return found

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all pairs within the radius; distances are completed for retrieved pairs only."""
        who, what = np.nonzero(self.probe(queries, radius))
        distance = np.bitwise_count(queries[who] ^ self.codes[what]).sum(1, dtype=np.int64)
        near = distance <= radius
        return who[near], what[near]


def search_block(model: CodeModel, qx: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, step: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of up to k rows of the block for each query; ties to smaller ids."""
    qc, index = model.codes(qx, True), Index(model.codes(x))
    bits = qc.shape[1] * PIECE
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(qx), 64):
        q = np.arange(at, min(at + 64, len(qx)))
        radius, pairs = model.radius, []
        while len(q):
            who, what = index.within(qc[q], radius)
            enough = np.bincount(who, minlength=len(q)) >= min(k, len(x))
            enough |= radius >= bits
            pairs.append((q[who][enough[who]], what[enough[who]]))
            q, radius = q[~enough], min(bits, radius + step)
        who, what = (np.concatenate(c) for c in zip(*pairs, strict=True))
        score = np.einsum("ij,ij->i", qx[who], x[what])
        order = np.lexsort((ids[what], -score, who))
        who, what, score = who[order], what[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        keep = rank < k
        out.append((who[keep], ids[what[keep]], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _valid(vectors: DataFrame) -> DataFrame:
    """Rows whose embedding is a vector: finite components without null, not all zero."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    return vectors.select("vec_id", "embedding").where(some)


def search(vectors: DataFrame, queries, k: int = 20, sample_rows: int = 10_000, bits: int = 256, recall: float = 0.95) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of vectors (vec_id, embedding) that ``queries`` holds for.

    A query's own row is no candidate.  Null vectors, zero vectors, and vectors with null or non-finite
    components take no part; vectors of another length than the first row's raise.  Equal vectors are searched
    once: only the k + 1 smallest ids of a vector can be among the k nearest, and all queries with one
    vector share its search.  Fewer than k candidates are all returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    valid = _valid(vectors)
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    ids = valid.withColumn("nth", F.row_number().over(by_vector)).where(F.col("nth") <= k + 1)
    distinct = materialise(ids.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select("embedding", "ids", F.col("ids")[0].alias("rep")))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    n, top = distinct.agg(F.count("*"), F.max(norm)).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    sample = distinct.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_rows / n)) + 1)
    rows = np.array([r[0] for r in sample.select("embedding").orderBy("rep").collect()], dtype="float64")
    if not len(rows):
        rows = np.array([distinct.orderBy("rep").first()["embedding"]], dtype="float64")
    shared = spark.sparkContext.broadcast(fit(rows, top, n, k, bits, recall))

    asked = valid.where(queries).select(F.col("vec_id").alias("query_id"), "embedding")
    asked = materialise(asked.join(distinct.select("embedding", "rep"), "embedding").select("query_id", F.col("rep").alias("qrep")))
    q = distinct.join(asked.select(F.col("qrep").alias("rep")).distinct(), "rep", "left_semi")
    n_q = max(1, q.count())
    blocks = max(1, math.ceil(n / min(16_384, max(1024, math.ceil(n / 16)))))
    q_blocks = max(1, math.ceil(n_q / 1024))
    block = lambda c, of, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = distinct.select("rep", "embedding", block("rep", blocks, 1).alias("b")).withColumn("qb", every(q_blocks))
    right = q.select(F.col("rep").alias("q_rep"), F.col("embedding").alias("q_embedding"), block("rep", q_blocks, 2).alias("qb")).withColumn("b", every(blocks))

    def run(rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asking):
            return pd.DataFrame({"qrep": [], "rep": [], "score": []}).astype({"qrep": "int64", "rep": "int64"})
        x, qx = (np.stack(f.to_numpy()).astype("float64") for f in (rows["embedding"], asking["q_embedding"]))
        who, found, score = search_block(shared.value, qx, x, rows["rep"].to_numpy(), k + 1)
        return pd.DataFrame({"qrep": asking["q_rep"].to_numpy()[who], "rep": found, "score": score})

    parts = left.groupBy("b", "qb").cogroup(right.groupBy("b", "qb")).applyInPandas(run, "qrep long, rep long, score double")
    best = Window.partitionBy("qrep").orderBy(F.col("score").desc(), "rep")
    top_vectors = parts.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).join(distinct.select("rep", "ids"), "rep")
    hits = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("i")))
    lists = top_vectors.groupBy("qrep").agg(F.sort_array(F.flatten(F.collect_list(hits))).alias("hits"))
    found = asked.join(lists, "qrep").select(
        "query_id", F.posexplode(F.slice(F.filter("hits", lambda h: h["i"] != F.col("query_id")), 1, k)).alias("pos", "hit")
    )
    return found.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.i").alias("vec_id"), (-F.col("hit.s")).alias("score"))
