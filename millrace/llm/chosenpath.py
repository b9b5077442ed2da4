"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles.  Equal sets are one class from the start.  Each class is
embedded into minwise tokens (position, least hash).  In each of several independent trees, a node picks one or
two positions (1 / threshold in the mean) by its own hash, and branches its documents by their tokens there.
Nodes of at most ``leaf`` documents are compared exhaustively on sketches of the tokens.  Larger ones branch again, unless
they hold the threshold's share of the node above: such documents agree in most tokens, branching hardly parts them,
and they are taken as one group.

Leaves give groups of documents that may be linked, directly or by way of others.  In each group all full sets are then
compared exactly, by prefix filter and with what is not yet linked only, in pairs of blocks where a group is large, so
that a group decides each of its links and only connections that all trees missed can be lost.  At similarity 0.8 one
level of one tree misses a pair with probability 0.16, twelve trees with 3e-10; where four levels are needed, with 3e-5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import components, hot_join, materialise, runs

TOKENS = 128
U64 = np.uint64
_rng = np.random.default_rng(20_240_101)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=U64) | U64(1)
MULTIPLY = (_rng.integers(1, 1 << 31, TOKENS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
ADD = _rng.integers(0, 1 << 32, TOKENS, dtype=np.uint32)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Shingler:
    """Sets of 64-bit hashes of a text's word shingles."""

    def __init__(self, width: int):
        self.width, self.powers, self.inverses = width, np.ones(1, U64), np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            self.powers = np.cumprod(np.concatenate([[U64(1)], np.full(2 * n, U64(BASE))]))
            self.inverses = np.cumprod(np.concatenate([[U64(1)], np.full(2 * n, U64(INVERSE))]))

    def word_hashes(self, text: str | None) -> np.ndarray:
        """One hash for each word, A-Z in lower case: differences of prefix sums of byte values times powers."""
        data = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
        if not len(data):
            return np.zeros(0, U64)
        self._grow(len(data) + 1)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~SPACE[data]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE[data] * self.powers[: len(data)], out=total[1:])
        return mixed((total[end] - total[start]) * self.inverses[start] + (end - start).astype(U64))

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; with fewer words than the width the whole sequence is one shingle."""
        words = self.word_hashes(text)
        if not len(words):
            return words
        width = min(self.width, len(words))
        out = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            out = out * U64(0xD6E8FEB86659FD93) + words[k : len(words) - width + 1 + k]
        return np.unique(mixed(out + U64(width)))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """Least hash of a set under each of TOKENS hash functions."""
    h = (shingles >> U64(32)).astype(np.uint32)
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 2048):
        np.minimum(out, (h[None, at : at + 2048] * MULTIPLY[:, None] + ADD[:, None]).min(1), out=out)
    return out


def set_hash(shingles: np.ndarray) -> int:
    return int(mixed(shingles).sum(dtype=U64).view(np.int64))


def branch(node: int, tokens: np.ndarray, threshold: float) -> list[int]:
    """Keys of the nodes to which a document goes from a node; all documents of a node draw the same positions."""
    draw = mixed(np.array([node & 0xFFFFFFFFFFFFFFFF], U64) + np.arange(3, dtype=U64) * U64(0x9E3779B97F4A7C15))
    first = int(draw[0] % U64(TOKENS))
    picked = [first]
    if float(draw[1] >> U64(11)) / (1 << 53) < 1 / threshold - 1:
        picked.append((first + 1 + int(draw[2] % U64(TOKENS - 1))) % TOKENS)
    at = np.array(picked, U64)
    keys = mixed(mixed(draw[:1] + at) + tokens[picked].astype(U64))
    return keys.view(np.int64).tolist()


def signatures(docs: DataFrame, width: int = 4, threshold: float = 0.8, trees: int = 12) -> DataFrame:
    """doc_id, text_hash, n_shingles, h1, h2 (a hash of the set), tokens, sketch and the keys of its first nodes, for each row of docs."""

    def run(batches):
        shingler = Shingler(width)
        for batch in batches:
            n, h1, h2, tokens, sketch, keys = [], [], [], [], [], []
            for t in batch.column("text"):
                s = shingler.shingles(t.as_py())
                n.append(len(s))
                h1.append(set_hash(s))
                h2.append(int(mixed(s ^ U64(0x5555555555555555)).sum(dtype=U64).view(np.int64)))
                m = minwise(s)
                tokens.append(m.tobytes() if len(s) else b"")
                sketch.append(m.astype(np.uint8).tobytes() if len(s) else b"")
                keys.append([k for tree in range(trees) for k in branch(tree, m, threshold)] if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(tokens, pa.binary()), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "h1", "h2", "tokens", "sketch", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, tokens binary, sketch binary, keys array<long>"
    )


def local_components(n: int, partners) -> np.ndarray:
    """Smallest member of each member's component; partners(i, open) gives those of the open members that are linked with i.
    Each member is asked once at most, and only about members that no component holds yet."""
    label = np.full(n, -1)
    free = np.arange(n)
    for i in range(n):
        if label[i] < 0:
            label[i] = i
            todo = [i]
            while todo:
                free = free[label[free] < 0]
                if not len(free):
                    break
                near = partners(todo.pop(), free)
                label[near] = i
                todo.extend(near.tolist())
    return label


def leaf_edges(leaves: DataFrame, threshold: float) -> DataFrame:
    """(a, b): within each leaf of (node, rep, n_shingles, sketch), members that sketches can't keep apart, linked to their smallest."""
    least = TOKENS * (threshold - 0.16)  # 4.5 standard deviations below the threshold

    def run(batches):
        a, b = [], []
        for leaf in runs(batches, "node"):
            rep = leaf.column("rep").to_numpy()
            order = np.argsort(rep, kind="stable")
            rep = rep[order]
            n = leaf.column("n_shingles").to_numpy()[order]
            s = np.frombuffer(b"".join(leaf.column("sketch").to_pylist()), np.uint8).reshape(len(rep), TOKENS)[order]

            def near(i, free, s=s, n=n):
                free = free[(n[free] >= threshold * n[i]) & (n[free] * threshold <= n[i])]
                return free[(s[free] == s[i]).sum(1) >= least]

            label = local_components(len(rep), near)
            other = rep != rep[label]
            a += rep[other].tolist()
            b += rep[label[other]].tolist()
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return leaves.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(run, "a long, b long").distinct()


def candidate_edges(reps: DataFrame, threshold: float, leaf: int) -> DataFrame:
    """Edges from the leaves of all trees over reps (rep, n_shingles, tokens, sketch, keys)."""
    level = materialise(reps.select(F.explode("keys").alias("node"), "rep", F.lit(None).cast("long").alias("above")))
    edges = None
    while True:
        size = materialise(level.groupBy("node").agg(F.count("*").alias("size"), F.min("rep").alias("least"), F.max("above").alias("above")).where("size > 1"))
        hot = size.where(F.col("size") > leaf)
        cool = hot_join(level, hot.select("node"), "node", "left_anti")
        small = cool.join(size.where(F.col("size") <= leaf).select("node"), "node", "left_semi")
        found = leaf_edges(small.join(reps.select("rep", "n_shingles", "sketch"), "rep"), threshold)
        edges = found if edges is None else edges.union(found)
        if hot.isEmpty():
            return edges
        rows = materialise(hot_join(level.select("node", "rep"), hot, "node"))
        tight = F.coalesce(F.col("size") >= threshold * F.col("above"), F.lit(False))
        edges = edges.union(rows.where(tight & (F.col("rep") != F.col("least"))).select(F.col("rep").alias("a"), F.col("least").alias("b")))

        def children(batches):
            for batch in batches:
                node, rep, above = [], [], []
                for k, r, n, t in zip(*(batch.column(c).to_pylist() for c in ("node", "rep", "size", "tokens")), strict=True):
                    for child in branch(k, np.frombuffer(t, np.uint32), threshold):
                        node.append(child)
                        rep.append(r)
                        above.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (node, rep, above)], ["node", "rep", "above"])

        parted = rows.where(~tight).select("node", "rep", "size").join(reps.select("rep", "tokens"), "rep")
        level = materialise(parted.mapInArrow(children, "node long, rep long, above long"))


class Prefixes:
    """Which sets of a task can be linked: of two linked sets, the rarest tokens of each (so many that the rest falls short of the
    threshold) have one in common."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, n: np.ndarray, tokens: int, percent: int):
        rarity = np.empty(tokens, np.int64)
        rarity[np.argsort(np.bincount(ids, minlength=tokens), kind="stable")] = np.arange(tokens)
        who = np.repeat(np.arange(len(n)), n)
        rank = rarity[ids]
        order = np.lexsort((rank, who))
        self.length = n - (percent * n + 99) // 100 + 1
        kept = order[np.arange(len(ids)) - np.repeat(starts, n) < np.repeat(self.length, n)]
        self.tokens = rank[kept]
        self.begin = np.cumsum(self.length) - self.length
        by_token = np.argsort(self.tokens, kind="stable")
        self.owner, self.sorted = who[kept][by_token], self.tokens[by_token]
        self.n, self.percent = n, percent

    def sharing(self, k: int, free: np.ndarray) -> np.ndarray:
        """Those of the free sets that fit set k in size and share one of its rarest tokens."""
        own = self.tokens[self.begin[k] : self.begin[k] + self.length[k]]
        low, high = np.searchsorted(self.sorted, own), np.searchsorted(self.sorted, own, side="right")
        found = np.zeros(len(self.n), bool)
        total = high - low
        ends = np.cumsum(total)
        found[self.owner[np.arange(ends[-1]) + np.repeat(low - ends + total, total)]] = True
        free = free[found[free]]
        return free[(100 * self.n[free] >= self.percent * self.n[k]) & (100 * self.n[k] >= self.percent * self.n[free])]


def exact_edges(members: DataFrame, docs: DataFrame, width: int, percent: int, block: int = 250_000) -> DataFrame:
    """(a, b, whole): links of full sets within each group of members (rep, doc, h1, grp, n_shingles), as stars around smallest
    members; the set of rep is that of the text of doc with hash h1.

    A group's documents are dealt to blocks of about ``block`` shingles, and each pair of blocks is compared in a
    task of its own; whole tells that the group was one block, so that its stars are final.
    """
    sizes = members.groupBy("grp").agg(F.ceil(F.sum("n_shingles") / F.lit(block)).cast("int").alias("blocks"))
    dealt = members.join(sizes, "grp").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("rep", "doc", "h1", "grp", "blocks", "own", other).select(
        "rep", "doc", "h1", "grp", "blocks", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(members.select("doc"), "doc", "left_semi")

    def sets(batches):
        shingler = Shingler(width)
        for batch in batches:
            found = [shingler.shingles(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array([set_hash(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["doc", "h1", "shingles"]
            )

    tasks = texts.mapInArrow(sets, "doc long, h1 long, shingles binary").join(dealt, ["doc", "h1"]).drop("doc", "h1")

    def run(batches):
        for task in runs(batches, "grp", "i", "j"):
            rep = task.column("rep").to_numpy()
            order = np.argsort(rep, kind="stable")
            rep = rep[order]
            raw = task.column("shingles").to_pylist()
            flat = np.frombuffer(b"".join(raw[k] for k in order), U64)
            n = np.array([len(raw[k]) // 8 for k in order])
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            values, ids = np.unique(flat, return_inverse=True)
            mark = np.zeros(len(values), np.int32)

            prefixes = Prefixes(ids, starts, n, len(values), percent)

            def linked(k, free, n=n, starts=starts, ids=ids, mark=mark, prefixes=prefixes):
                free = prefixes.sharing(k, free)
                if not len(free):
                    return free
                own = ids[starts[k] : starts[k] + n[k]]
                mark[own] = 1
                ends = np.cumsum(n[free])
                common = np.add.reduceat(mark[ids[np.arange(ends[-1]) + np.repeat(starts[free] - ends + n[free], n[free])]], ends - n[free])
                mark[own] = 0
                return free[100 * common >= percent * (n[free] + n[k] - common)]

            label = local_components(len(rep), linked)
            other = rep != rep[label]
            whole = task.column("blocks")[0].as_py() == 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[other]), pa.array(rep[label[other]]), pa.array([whole] * int(other.sum()), pa.bool_())], ["a", "b", "whole"]
            )

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks.repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(run, "a long, b long, whole boolean")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, trees: int = 12, leaf: int = 1000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash (xxhash64) for each row of docs (doc_id, text); other columns are ignored.

    Documents are linked if 100 * intersection >= percent * union of their sets; component_id is the smallest
    doc_id that links lead to, kept tells whether it is the row's own.  Null and empty texts and texts
    without words have no shingles and are components of their own.  Rows that repeat a doc_id with an equal
    set get equal results; rows that repeat it with another set are documents of their own, each with its links.
    Rows with a null doc_id take the component of their set, null if only such rows have it.
    """
    threshold = percent / 100
    sigs = materialise(signatures(docs, width, threshold, trees))
    key = ["n_shingles", "h1", "h2"]
    classes = sigs.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("doc"))
    # A class is named by its smallest doc_id; of several classes with one name (an id with several texts) all but one take a hash.
    first = F.row_number().over(Window.partitionBy("doc").orderBy(*key)) == 1
    classes = materialise(classes.withColumn("rep", F.when(first | F.col("doc").isNull(), F.col("doc")).otherwise(F.xxhash64("doc", *key))))
    reps = sigs.withColumnRenamed("doc_id", "doc").join(classes, [*key, "doc"])
    reps = materialise(reps.select("rep", "doc", "h1", "n_shingles", "tokens", "sketch", "keys").dropDuplicates(["rep"]))
    groups = materialise(components(candidate_edges(reps, threshold, leaf)))
    members = materialise(groups.select(F.col("id").alias("rep"), F.col("component").alias("grp")).join(reps.select("rep", "doc", "h1", "n_shingles"), "rep"))
    links = materialise(exact_edges(members, docs, width, percent))
    final = links.where("whole").select(F.col("a").alias("id"), F.col("b").alias("component"))
    split = links.where("NOT whole").select("a", "b")
    if not split.isEmpty():
        final = final.union(components(split))
    # The smallest doc_id of a component, from its members' documents.
    labelled = members.select(F.col("rep").alias("id"), "doc").join(final, "id", "left").select("id", "doc", F.coalesce("component", "id").alias("component"))
    named = labelled.groupBy("component").agg(F.min("doc").alias("label"))
    final = labelled.join(named, "component").select("id", "label")
    labels = classes.join(final, F.col("rep") == F.col("id"), "left").select(*key, F.coalesce("label", "doc").alias("component_id"))
    rows = sigs.select("doc_id", "text_hash", *key)
    # Classes of very many rows are joined apart.
    many = materialise(rows.where("n_shingles > 0").groupBy(*key).count().where("count > 10000").select(*key))
    same = F.coalesce("component_id", "doc_id")
    if many.isEmpty():
        rows = rows.join(labels, key, "left")
    else:
        one = F.struct(*key).alias("class")
        pack = lambda df: df.withColumn("class", one)
        hot = pack(labels.join(many, key, "left_semi")).select("class", "component_id")
        rows = hot_join(pack(rows), hot, "class").drop("class").unionByName(hot_join(pack(rows), hot.select("class"), "class", "left_anti").drop("class").join(labels, key, "left"))
    return rows.select("doc_id", "n_shingles", same.alias("component_id"), F.coalesce(F.col("doc_id") == same, F.lit(True)).alias("kept"), "text_hash")
