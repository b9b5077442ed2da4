"""Removal of repeated byte strings, by two-stage suffix sorting of the places where they may lie.

A string of ``SPAN`` bytes has an anchor, the leftmost least hash among its 16-byte grams, which depends on
its content only.  So equal strings have equal anchors, and texts need to be compared at anchors that occur more
than once.  An anchor's context is the stretch of text that its windows cover.  Occurrences with equal contexts
are copies of the first of them (equal in a hash of the anchor, one of the context and 48 bits of one of its halves).  The
different contexts of an anchor are cut from the texts and laid end to end, and their suffix array is built in two
stages: suffixes smaller than their successors are sorted directly, the others follow by scanning the buckets of first
bytes.  Adjacent common prefixes of ``SPAN`` bytes then give the classes of equal windows, of which all but the earliest
are removed.

An anchor with more than ``LEAF`` different contexts is split by content first: its windows are dealt to ranges by their
distance from the anchor, narrower at each step, and each range by the bytes that all its windows share.  Equal windows have
equal distances and shares, so they stay together; what shares its bytes with nothing else is done.  The suffix
arrays are those of what remains, so one method serves all sizes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.chosenpath import BASE, BYTE, INVERSE, mixed
from millrace.llm.common import hot_join, materialise, runs

U64 = np.uint64
SPAN = 100
GRAM = 16
#: Contexts of one anchor that are sorted together at most.
LEAF = 2_000
#: Windows of an anchor lie up to so many bytes before it; the widths of ranges of such distances, step by step.
REACH = SPAN - GRAM + 1
WIDTHS = (43, 22, 11, 6, 3, 2, 1)
#: Bytes of contexts that are sorted together, if no single anchor has more.
CHUNK = 1_000_000


def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over all windows of the width, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


class Anchors:
    """Anchors of texts; powers of the hash's base are kept from text to text."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, U64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(data):
            self.powers = np.cumprod(np.concatenate([[U64(1)], np.full(2 * len(data), U64(BASE))]))
            self.inverses = np.cumprod(np.concatenate([[U64(1)], np.full(2 * len(data), U64(INVERSE))]))
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE[data] * self.powers[: len(data)], out=total[1:])
        return total

    def of(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(gram hash, context hash, first window, shape) of each anchor, in order of position; shape packs the number of windows,
        the distance of the first from the anchor and a check hash."""
        if len(data) < SPAN:
            none = np.zeros(0, np.int64)
            return none.astype(U64), none.astype(U64), none, none
        total = self.prefix(data)
        g = (total[GRAM:] - total[:-GRAM]) * self.inverses[: len(total) - GRAM]
        g = (g ^ (g >> U64(31))) * U64(0xBF58476D1CE4E5B9)
        g ^= g >> U64(29)
        reach = REACH  # grams in a window
        least = sliding(np.minimum, g, reach)  # of each window
        n = len(least)
        # The grams that are the least of some window, ties included: those that equal one of their windows' minima.
        most = sliding(np.maximum, np.concatenate([np.zeros(reach - 1, U64), least, np.zeros(reach - 1, U64)]), reach)
        spots = np.flatnonzero(g == most)
        at = np.searchsorted(spots, np.arange(n))
        todo = np.arange(n)
        while len(todo):  # to the leftmost of the window's least grams
            todo = todo[g[spots[at[todo]]] != least[todo]]
            at[todo] += 1
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.append(first, n))
        end = first + count - 1 + SPAN
        spot = spots[at[first]]
        context = mixed((total[end] - total[first]) * self.inverses[first] + mixed((spot - first).astype(U64) * U64(1 << 20) + count.astype(U64)))
        left, right = (total[spot] - total[first]) * self.inverses[first], (total[end] - total[spot]) * self.inverses[spot]
        check = mixed(mixed(left) * U64(0x9E3779B97F4A7C15) + mixed(right ^ U64(0x5555555555555555))) >> U64(16)
        return g[spot], context, first, (check.astype(np.int64) << 14) | (spot - first) << 7 | count


def windows_of(shape):
    return shape & 127


def distance_of(shape):
    return (shape >> 7) & 127


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, zeros after the end."""
    padded = np.concatenate([data, np.zeros(SPAN + 16, np.uint8)])
    out = np.zeros(len(data) + SPAN + 8, U64)
    for k in range(8):
        out = (out << U64(8)) | padded[k : k + len(out)]
    return out


def sort_directly(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes at the given positions in order of their first ``depth`` bytes, eight at a time within ties."""
    order = at[np.argsort(words[at], kind="stable")]
    key = words[order]
    same = np.concatenate([[False], key[1:] == key[:-1]])
    for k in range(8, depth, 8):
        tied = same.copy()
        tied[:-1] |= same[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        group = np.cumsum(~same[rows])
        here = order[rows]
        key = words[here + k]
        inner = np.lexsort((key, group))
        order[rows] = here[inner]
        key, group = key[inner], group[inner]
        same[rows] = np.concatenate([[False], (key[1:] == key[:-1]) & (group[1:] == group[:-1])])
    return order


def two_stage(data: np.ndarray, need: np.ndarray, words: np.ndarray, depth: int = SPAN + 8) -> np.ndarray:
    """Positions marked in need, in the order of their suffixes (by ``depth`` bytes at least).

    Suffixes smaller than their successors are sorted directly.  A suffix that is larger than its successor
    stands in the bucket of its first byte in the order of the successors; buckets are completed in the
    order of their bytes, and each, once complete, places the larger suffixes before its members.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    run_ends = np.append(np.flatnonzero(data[1:] != data[:-1]), n - 1)
    grows = np.append(data[run_ends[:-1]] < data[run_ends[:-1] + 1], False)
    smaller = np.repeat(grows, np.diff(np.concatenate([[-1], run_ends])))
    # A larger suffix needs its successors up to the next smaller one.
    segment = np.concatenate([[0], np.cumsum(smaller, dtype=np.int32)[:-1]])
    starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    first_need = np.minimum.reduceat(np.where(need, np.arange(n), n), starts)
    needed = np.arange(n) >= np.repeat(first_need, np.diff(np.append(starts, n)))
    direct = sort_directly(words, np.flatnonzero(needed & smaller), depth)
    larger = needed & ~smaller
    bounds = np.searchsorted(data[direct], np.arange(257), side="left")
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    if larger[n - 1]:
        pending[data[n - 1]].append(np.array([n - 1]))
    out: list[np.ndarray] = []
    for c in range(256):
        layers = pending[c]
        front = np.concatenate(layers) if layers else np.zeros(0, np.int64)
        layers = [front]
        while len(front):
            before = front[front > 0] - 1
            front = before[larger[before] & (data[before] == c)]
            layers.append(front)
        bucket = np.concatenate([*layers, direct[bounds[c] : bounds[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[larger[before]]
        before = before[data[before] > c]
        first = data[before]
        before = before[np.argsort(first, kind="stable")]
        cuts = np.searchsorted(data[before], np.arange(c + 1, 257))
        for b in np.flatnonzero(np.diff(cuts)):
            pending[c + 1 + b].append(before[cuts[b] : cuts[b + 1]])
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[need[order]]


def repeated_windows(contexts: list[bytes], doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of runs of windows that also occur earlier among the contexts (doc and first: place of each)."""
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"\0".join([*contexts, b""]), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int32)
    which = np.repeat(np.arange(len(contexts), dtype=np.int32), sizes + 1)
    within = np.arange(len(data), dtype=np.int32) - begin[which]
    need = within <= sizes[which] - SPAN
    words = eights(data)
    order = two_stage(data, need, words)
    common = np.ones(max(0, len(order) - 1), bool)  # adjacent common prefixes of SPAN bytes
    for k in [*range(0, SPAN - 8, 8), SPAN - 8]:
        common &= words[order[1:] + k] == words[order[:-1] + k]
    group = np.concatenate([[0], np.cumsum(~common)])[: len(order)]
    twice = np.zeros(len(order), bool)
    twice[1:] |= common
    twice[:-1] |= common
    order, group = order[twice], group[twice]
    d, s = doc[which[order]], first[which[order]] + within[order]
    by = np.lexsort((s, d, group))
    order, group, d, s = order[by], group[by], d[by], s[by]
    lead = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
    span = np.diff(np.append(lead, len(group)))
    later = (d != np.repeat(d[lead], span)) | (s != np.repeat(s[lead], span))
    return merged(d[later], s[later], s[later] + SPAN)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching stretches of a document."""
    if not len(doc):
        return doc, start, end
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], end[by]
    # Ends so far, within a document: documents are set apart by more than any text's length.
    _, rank = np.unique(doc, return_inverse=True)
    shift = rank.astype(np.int64) * np.int64(1 << 33)
    so_far = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], start[1:] + shift[1:] > so_far[:-1]])
    lead = np.flatnonzero(new)
    return doc[lead], start[lead], np.maximum.reduceat(end, lead)


INTERVAL = "doc long, start long, stop long"


def _stretches(doc, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, stop)], ["doc", "start", "stop"])


HOT = 1 << 62  # set in the shape of contexts whose anchor is known to have very many
ROWS = "fp long, context long, doc long, first long, shape long"


def anchor_rows(docs: DataFrame, hot: np.ndarray | None = None, rows: int = 2000) -> DataFrame:
    """fp, context, doc, first, shape of each anchor of docs (doc_id, part, text).

    Of equal contexts within a batch only the first goes on as such; later ones are marked by shape < 0, and
    get random keys, so that a passage in very many documents doesn't meet in one task.  Contexts of anchors in ``hot``
    are keyed by themselves, not by their anchor: only equal ones meet.
    """
    hints = docs.sparkSession.sparkContext.broadcast(np.sort(hot) if hot is not None else np.zeros(0, U64))

    def run(batches):
        anchors, hot = Anchors(), hints.value
        for whole in batches:
            for cut in range(0, whole.num_rows, rows):
                batch = whole.slice(cut, rows)
                parts = []
                for doc, part, text in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("text"), strict=True):
                    t = text.as_py()
                    if t and doc is not None:
                        g, c, f, n = anchors.of(np.frombuffer(t.encode("utf-8", "replace"), np.uint8))
                        parts.append((g, c, np.full(len(g), doc, np.int64), f + (part << PART), n))
                if not sum(len(p[0]) for p in parts):
                    continue
                g, c, d, f, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                by = np.lexsort((f, d, n, c, g))
                g, c, d, f, n = g[by], c[by], d[by], f[by], n[by]
                again = np.concatenate([[False], (g[1:] == g[:-1]) & (c[1:] == c[:-1]) & (n[1:] == n[:-1])])
                same_place = np.concatenate([[False], (d[1:] == d[:-1]) & (f[1:] == f[:-1])])
                keep = ~(again & same_place)
                g, c, d, f, n, again = (x[keep] for x in (g, c, d, f, n, again))
                if len(hot):
                    known = hot[np.minimum(np.searchsorted(hot, g), len(hot) - 1)] == g
                    g, n = np.where(known, mixed(g ^ mixed(c)), g), np.where(known, n | HOT, n)
                g = np.where(again, mixed(d.astype(U64) ^ (f.astype(U64) << U64(40))), g)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), pa.array(d), pa.array(f), pa.array(np.where(again, -n, n))],
                    [c.split()[0] for c in ROWS.split(", ")],
                )

    return docs.select("doc_id", "part", "text").mapInArrow(run, ROWS)


def hot_anchors(docs: DataFrame, n_docs: int, sample_docs: int = 10_000, most: int = 1 << 16, least: int = 64) -> np.ndarray:
    """Anchors with most contexts in a sample of about ``sample_docs`` documents, ``most`` of them and ``least`` contexts at the least.

    They only say which rows are keyed apart from the start; results are the same without them.
    """
    share = min(1.0, sample_docs / max(1, n_docs))
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * share)) if share < 1 else docs
    counts = anchor_rows(some).where("shape > 0").groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    top = counts.orderBy(F.desc("n"), "fp").limit(most)  # a bounded number of hints
    return np.array([r["fp"] for r in top.select("fp").collect()], np.int64).view(U64)


def compare_contexts(anchors: DataFrame) -> DataFrame:
    """fp, doc, first, shape, open, contexts: copies of contexts (open false), and first occurrences of contexts of anchors that
    have several; contexts is their number, ``HOT`` where it is not known."""

    def emit(x: np.ndarray, opened: np.ndarray, contexts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x[k]) for k in (0, 2, 3, 4)), pa.array(opened), pa.array(contexts)], ["fp", "doc", "first", "shape", "open", "contexts"])

    def settle(x: np.ndarray) -> pa.RecordBatch:
        """x: the five columns of whole runs of fp, in order of (fp, context, shape, doc, first)."""
        copied = x[4] < 0
        out = [x[:, copied]]
        x = x[:, ~copied]
        change = lambda row: np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
        new_fp = change(x[0])
        new = new_fp | change(x[1]) | change(x[4])
        lead = np.maximum.accumulate(np.where(new, np.arange(x.shape[1]), 0))
        later = (x[2] != x[2][lead]) | (x[3] != x[3][lead])
        out.append(x[:, later])
        firsts, fp_no = x[:, new], np.cumsum(new_fp)[new]
        several = np.bincount(fp_no, minlength=1)[fp_no] if len(fp_no) else fp_no
        several = np.where(firsts[4] & HOT != 0, HOT, several)
        opened = firsts[:, several > 1]
        done = np.concatenate(out, axis=1)
        done[4] = np.abs(done[4])
        both = np.concatenate([done, opened], axis=1)
        both[4] &= HOT - 1
        flag = np.arange(both.shape[1]) >= done.shape[1]
        return emit(both, flag, np.concatenate([np.zeros(done.shape[1], np.int64), several[several > 1]]))

    def run(batches):
        held: list[np.ndarray] = []  # of the last run, which may go on
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if not x.shape[1]:
                continue
            cut = np.searchsorted(x[0], x[0, -1], side="left")
            if held and (cut or held[-1][0, -1] != x[0, -1]):
                held.append(x[:, :cut])
                yield settle(np.concatenate(held, axis=1))
                held = []
            elif cut:
                yield settle(x[:, :cut])
            held.append(x[:, cut:])
        if held:
            yield settle(np.concatenate(held, axis=1))

    parts = max(int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = anchors.repartition(parts, "fp").sortWithinPartitions("fp", "context", "shape", "doc", "first")
    return dealt.mapInArrow(run, "fp long, doc long, first long, shape long, open boolean, contexts long")


def packed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc, part, zip and the carried columns: the UTF-8 bytes of each text are compressed for the way through a shuffle."""
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array([press.compress((t.as_py() or "").encode("utf-8", "replace")) for t in batch.column("text")], pa.binary()), *(batch.column(c) for c in carry)],
                ["doc", "part", "zip", *carry],
            )

    return docs.select("doc_id", "part", "text", *carry).mapInArrow(run, "doc long, part int, zip binary" + kinds)


CONTEXT = "fp long, doc long, first long, distance int, contexts long, bytes binary"


def cut_contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp, doc, first, distance, contexts, bytes for wanted (fp, doc, first, shape, contexts); repeated rows of a text count once."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("fp", "first", "shape", "contexts")).alias("cuts"))
    both = packed(docs).dropDuplicates(["doc", "part"]).join(lists, "doc")

    def run(batches):
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc, part, z, cuts in zip(*(batch.column(c) for c in ("doc", "part", "zip", "cuts")), strict=True):
                data, d, p = unpress.decompress(z.as_py()), doc.as_py(), part.as_py()
                for c in cuts.as_py():
                    if c["first"] >> PART == p:
                        at = c["first"] - (p << PART)
                        rows.append((c["fp"], d, c["first"], distance_of(c["shape"]), c["contexts"], data[at : at + windows_of(c["shape"]) - 1 + SPAN]))
                if len(rows) > 20_000:
                    yield _context_rows(rows)
                    rows = []
            yield _context_rows(rows)

    return both.mapInArrow(run, CONTEXT)


def _context_rows(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in CONTEXT.split(", ")])


def sorted_stretches(contexts: DataFrame) -> DataFrame:
    """Stretches (doc, start, stop) whose windows occur earlier, from suffix arrays of the contexts of whole anchors."""

    def run(batches):
        held, size = [], 0

        def flush():
            tables = pa.concat_tables(held)
            return _stretches(*repeated_windows(tables.column("bytes").to_pylist(), tables.column("doc").to_numpy(), tables.column("first").to_numpy()))

        for group in runs(batches, "fp"):
            held.append(group)
            size += group.nbytes
            if size > CHUNK:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    parts = max(int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return contexts.select("fp", "doc", "first", "bytes").repartition(parts, "fp").sortWithinPartitions("fp").mapInArrow(run, INTERVAL)


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def split_contexts(contexts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(contexts, stretches): contexts dealt to ranges of ``width`` distances and by the bytes that all windows of a range share,
    with fp and the number of contexts made anew and those without company dropped; and stretches of those that equal an earlier one."""

    def run(batches):
        for batch in batches:
            rows, seen = [], {}
            for doc, first, far, data in zip(*(batch.column(c).to_pylist() for c in ("doc", "first", "distance", "bytes")), strict=True):
                near = far - (len(data) - SPAN)  # the distance of the last window
                k = far
                while k >= near:
                    low = k // width * width
                    high, last = min(low + width - 1, REACH - 1), max(low, near)
                    piece = data[far - k : far - last + SPAN]
                    fp = _hash(low.to_bytes(1, "little"), data[max(0, far - low) : far - high + SPAN] if far > low else data[: far - high + SPAN])
                    sub = _hash(b"whole", k.to_bytes(1, "little"), piece)
                    rows.append((fp, sub, doc, first + far - k, k, piece))
                    k = last - 1
            rows.sort(key=lambda r: (r[0], r[1], r[2], r[3]))
            # Later ones of equal pieces are settled here; they get keys of their own.
            again = [i > 0 and rows[i][:2] == rows[i - 1][:2] for i in range(len(rows))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.array(again, pa.bool_())], ["fp", "sub", "doc", "first", "distance", "bytes", "again"])

    pieces = materialise(contexts.mapInArrow(run, "fp long, sub long, doc long, first long, distance int, bytes binary, again boolean"))
    stop = (F.col("first") + F.octet_length("bytes")).alias("stop")
    done = pieces.where("again").select("doc", F.col("first").alias("start"), stop)
    fresh = pieces.where("NOT again")
    lead = fresh.groupBy("fp", "sub").agg(F.min(F.struct("doc", "first", "distance", "bytes")).alias("x"), F.count("*").alias("n"))
    lead = materialise(lead)
    known = lead.where("n > 1").select("fp", "sub", F.col("x.doc").alias("d0"), F.col("x.first").alias("f0"))
    later = fresh.join(known, ["fp", "sub"]).where("doc <> d0 OR first <> f0")  # one row a batch for each piece at most
    done = done.unionByName(later.select("doc", F.col("first").alias("start"), stop))
    sizes = lead.groupBy("fp").agg(F.count("*").alias("contexts")).where("contexts > 1")
    sizes = materialise(sizes)
    crowded = sizes.where(F.col("contexts") > LEAF)
    rows = lead.select("fp", F.col("x.doc").alias("doc"), F.col("x.first").alias("first"), F.col("x.distance").alias("distance"), F.col("x.bytes").alias("bytes"))
    kept = hot_join(rows, crowded, "fp").unionByName(hot_join(rows, crowded.select("fp"), "fp", "left_anti").join(sizes, "fp"))
    return materialise(kept.select("fp", "doc", "first", "distance", "contexts", "bytes")), done


#: Texts that share a doc_id are parts of one document; the place of a byte is part << PART plus its offset.
PART = 40


def with_parts(docs: DataFrame) -> DataFrame:
    """docs with doc_id as long and part: the number of a text among the different texts of its doc_id, in the order of their hashes."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("_h")).where("doc_id IS NOT NULL")
    twice = materialise(hashed.groupBy("doc_id").agg(F.min("_h").alias("a"), F.max("_h").alias("b")).where("a <> b").select("doc_id"))
    if twice.isEmpty():
        return docs.withColumn("part", F.lit(0))
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_h")) - 1
    parts = hashed.join(twice, "doc_id", "left_semi").distinct().withColumn("part", rank)
    return docs.withColumn("_h", F.xxhash64("text")).join(parts, ["doc_id", "_h"], "left").withColumn("part", F.coalesce("part", F.lit(0))).drop("_h")


def repeats(docs: DataFrame, leaf: int = LEAF, least: int = 64) -> DataFrame:
    """Stretches (doc, start, stop) of docs (doc_id, part, text) that are covered by strings of SPAN bytes which start earlier as well."""
    hints = hot_anchors(docs, docs.count(), least=least)
    found = materialise(compare_contexts(anchor_rows(docs, hints)))
    length = lambda c: F.col(c).bitwiseAND(127) - 1 + SPAN
    copies = found.where("NOT open").select("doc", F.col("first").alias("start"), (F.col("first") + length("shape")).alias("stop"))
    contexts = cut_contexts(docs, found.where("open").select("fp", "doc", "first", "shape", "contexts"))
    if found.where(F.col("open") & (F.col("contexts") > leaf)).isEmpty():
        return copies.union(sorted_stretches(contexts))
    contexts = materialise(contexts)
    out = copies.union(sorted_stretches(contexts.where(F.col("contexts") <= leaf)))
    held = contexts.where(F.col("contexts") > leaf)
    for width in WIDTHS:
        parts, done = split_contexts(held, width)
        out = out.union(done).union(sorted_stretches(parts.where(F.col("contexts") <= leaf)))
        held = parts.where(F.col("contexts") > leaf)
        if held.isEmpty():
            break
    return out


def remove_repeats(docs: DataFrame, with_text: bool = False, leaf: int = LEAF, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text); with_text adds the kept text, carry
    names further columns that pass through.

    Null texts are empty.  A byte is removed if a string of SPAN bytes that covers it also starts earlier: in a
    document with a smaller doc_id, or earlier in the same one.  Rows that repeat a doc_id and its text are one
    document, and get equal results; different texts of one doc_id are its parts, in the order of their hashes.  Rows with a
    null doc_id are left whole.  The kept text drops bytes of characters that a removal has cut.
    """
    kind = dict(docs.dtypes)["doc_id"]
    docs = with_parts(docs.select("doc_id", "text", *carry))
    spans = repeats(docs, leaf).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    both = packed(docs, carry).join(spans, "doc", "left")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches):
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, texts = [], []
            for doc, part, z, cuts in zip(*(batch.column(c) for c in ("doc", "part", "zip", "spans")), strict=True):
                data = unpress.decompress(z.as_py())
                kept, removed, n_spans = data, 0, 0
                base = part.as_py() << PART
                pairs = np.array([(c["start"] - base, c["stop"] - base) for c in cuts.as_py() if c["start"] - base >> PART == 0], np.int64) if cuts.is_valid else ()
                if len(pairs):
                    _, start, stop = merged(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
                    n_spans, removed = len(start), int((stop - start).sum())
                    edges = [0, *np.column_stack([start, stop]).ravel().tolist(), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((doc.as_py(), len(data), removed, n_spans, hashlib.sha256(kept).hexdigest()))
                if with_text:
                    texts.append(kept.decode("utf-8", "ignore"))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            arrays += [pa.array(texts, pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([*arrays, *(batch.column(c) for c in carry)], names + ["kept_text"] * with_text + [*carry])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return both.mapInArrow(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind))
