"""SentencePiece encoding and decoding as shortest paths of a weighted transducer.

Three machines are compiled from a model file:

* the normaliser: longest-match rewriting arcs of the model's character map (none in an identity model), removal of
  extra blanks if the model asks for it, blanks to U+2581, and the leading U+2581;
* the lexicon: a trie whose final states emit pieces;
* fallback: a character that is no piece emits its UTF-8 bytes, or the unknown piece in a model without them.

A text is composed with the normaliser, and what that emits with the lexicon.  The result is an acyclic lattice over
characters; arcs are relaxed in the order of their start, a topological one, and the shortest path in the tropical
semiring (min, +) is the encoding.  Many segments are relaxed together, as arrays.

Arc weights: in a unigram model, minus the piece's score.  The scores of a BPE model are merge ranks, under
which the shortest path is not the library's encoding.  There a piece weighs 1, and the lexicon is composed with an
acceptor of piece pairs as well: b after a weighs 0 if merging the characters of ab gives back (a, b), and infinity if
not.  A string has exactly one path of finite weight then, and so has each of its prefixes, so that one best arc for a
position is enough there too; that path is the BPE encoding.

Lattices are built for segments (U+2581 before other characters, or line feeds) where no piece crosses
from other characters to U+2581; their paths are kept in a bounded memo of each worker.  Decoding is the inverse:
each piece emits its bytes, which are read as UTF-8.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
INFINITE = np.float32(np.inf)
#: Segments of up to so many characters are relaxed as arrays, longer ones character by character.
ROW = 48
U64 = np.uint64


class Table:
    """A map from non-negative int64 to int32 for whole arrays of keys; missing ones give -1."""

    def __init__(self, bits: int = 12):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], np.int32(-1))
        todo = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(todo):
            here = at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            seen = self.keys[here]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[here[hit]]
            todo = todo[~hit & (seen >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that the table lacks."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            old, kept = self.keys[self.keys >= 0], self.values[self.keys >= 0]
            bits = max(self.bits + 1, int(4 * (self.used + len(keys))).bit_length())
            self.__init__(bits)
            self.put(old, kept)
        self.used += len(keys)
        at = self._slots(keys)
        todo = np.arange(len(keys))
        while len(todo):
            here = at[todo]
            free = self.keys[here] < 0
            self.keys[here[free]] = keys[todo[free]]  # of several for one slot the last stays
            done = self.keys[here] == keys[todo]
            self.values[here[done]] = values[todo[done]]
            todo = todo[~done]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)


@dataclass
class Normaliser:
    """Rewriting arcs from bytes to text, as nested dicts with the emitted text under None; and what is done with blanks."""

    arcs: dict = field(default_factory=dict)
    remove_blanks: bool = False
    prefix: bool = True
    suffix: bool = False
    escape: bool = True
    firsts: re.Pattern | None = None

    @classmethod
    def compile(cls, spec, suffix: bool = False) -> Normaliser:
        """From a model's normaliser_spec.  Its character map is a double array over bytes, which is read out into arcs."""
        out = cls({}, spec.remove_extra_whitespaces, spec.add_dummy_prefix, suffix, spec.escape_whitespaces)
        blob = spec.precompiled_charsmap
        if blob:
            size = int.from_bytes(blob[:4], "little")
            out._read(np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :])
        return out

    def _read(self, units: np.ndarray, emitted: bytes) -> None:
        """A unit of the double array: label in the low byte (and the top bit of values), bit 8 tells of a value, bit 9 and
        the upper ones give the offset of its children."""

        base = np.arange(len(units)) ^ ((units >> 10) << ((units & 512) >> 6))
        labels = np.arange(1, 256)
        todo = [(int(base[0]), self.arcs)]
        while todo:
            start, arcs = todo.pop()
            places = start ^ labels
            inside = places < len(units)
            inside[inside] = units[places[inside]] & 0x800000FF == labels[inside]
            for at in places[inside].tolist():
                below = arcs[at ^ start] = {}
                if units[at] >> 8 & 1:
                    where = int(units[base[at]]) & 0x7FFFFFFF
                    below[None] = emitted[where : emitted.index(b"\0", where)].decode()
                todo.append((int(base[at]), below))
        lead = [chr(c) for c in range(128) if c in self.arcs]
        self.firsts = re.compile("[" + re.escape("".join(lead)) + "\x80-\U0010ffff]")

    def rewrite(self, text: str) -> list[str]:
        """What the arcs emit: longest matches first, other characters as they are."""
        if self.firsts is None:
            return [text]
        out, at = [], 0
        data, where = None, 0
        for m in self.firsts.finditer(text):
            i = m.start()
            if i < at:
                continue
            if data is None:
                data, where, seen = text.encode("utf-8", "replace"), 0, 0
            where += len(text[seen:i].encode("utf-8", "replace"))
            seen = i
            arcs, k, best = self.arcs, where, None
            while k < len(data) and (arcs := arcs.get(data[k])) is not None:
                k += 1
                if None in arcs:
                    best = k, arcs[None]
            if best:
                out += [text[at:i], best[1]]
                at = i + len(data[where : best[0]].decode("utf-8", "replace"))
        return [*out, text[at:]]

    def apply(self, text: str) -> str:
        if not text:
            return ""
        parts = self.rewrite(text)
        whole = "".join(parts)
        blank = SPACE if self.escape else " "
        if self.remove_blanks and not (whole := re.sub(" {2,}", " ", whole).lstrip(" ")):
            return ""
        whole = (blank if self.prefix and not self.suffix else "") + whole.replace(" ", blank)
        if self.remove_blanks:
            whole = whole.rstrip(" " + blank)
        return whole + (blank if self.prefix and self.suffix else "")


@dataclass
class PieceTransducer:
    texts: list[str]
    bytes_of: list[bytes]
    weights: np.ndarray  # of each piece, float32
    normaliser: Normaliser
    byte_ids: list[int]
    unknown: int = 0
    bpe: bool = False
    ranks: dict = field(default_factory=dict)

    @classmethod
    def compile(cls, model_file: str) -> PieceTransducer:
        with open(model_file, "rb") as f:
            return cls.of_model(f.read())

    @classmethod
    def of_model(cls, data: bytes) -> PieceTransducer:
        """From a serialised SentencePiece model, unigram or BPE; BPE models with user-defined symbols raise ValueError."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        kind = proto.trainer_spec.model_type
        if kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("user-defined symbols are not supported")
        texts = [p.piece for p in proto.pieces]
        raw = [bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() if p.type == 1 else b"" for p in proto.pieces]
        byte_ids = [i for i, p in enumerate(proto.pieces) if p.type == 6] if proto.trainer_spec.byte_fallback else []
        byte_ids.sort(key=lambda i: raw[i])
        unknown = next((i for i, p in enumerate(proto.pieces) if p.type == 2), 0)
        scores = np.array([p.score for p in proto.pieces], np.float32)
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        out = cls(texts, raw, np.ones(len(texts), np.float32) if kind == 2 else -scores, Normaliser.compile(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix), byte_ids, unknown, kind == 2)
        out.ranks = {t: (-scores[i].item(), i) for t, i in normal.items()}
        return out.build()

    def build(self) -> PieceTransducer:
        """The lexicon's arcs from ranks (piece text -> (rank, number)); BPE pieces that merging never yields get no final state."""
        normal = [i for _, i in self.ranks.values()]
        within = {t: i for t, (_, i) in self.ranks.items() if not self.bpe or len(self._merged([*t], 1)) == 1}
        alphabet = sorted({c for t in self.ranks for c in t})
        self.class_of = np.zeros(0x110000, np.uint16 if len(alphabet) < 65_000 else np.int32)
        self.class_of[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.trie, nodes, keys = {}, 1, {}
        for t in self.ranks:
            node, at = [-1, self.trie], 0
            for c in t:
                node = node[1].setdefault(c, [-1, {}])
                key = at << 21 | int(self.class_of[ord(c)])
                if key not in keys:
                    keys[key], nodes = nodes, nodes + 1
                at = keys[key]
            node[0] = within.get(t, -1)
        self.arcs = Table()
        self.arcs.put(np.fromiter(keys, np.int64), np.fromiter(keys.values(), np.int32))
        self.final = np.full(nodes, -1, np.int32)
        for t in self.ranks:
            at = 0
            for c in t:
                at = keys[at << 21 | int(self.class_of[ord(c)])]
            self.final[at] = within.get(t, -1)
        self.single = np.zeros(len(self.class_of), bool)
        self.single[[ord(t) for t in self.ranks if len(t) == 1]] = True
        self.fallback = np.float32(1) if self.bpe else np.float32(np.max(self.weights[normal], initial=0) + np.float32(10))
        crossing = SPACE not in self.ranks or any(SPACE in t.lstrip(SPACE) for t in self.ranks)
        feeds = not self.byte_ids or any("\n" in t for t in self.ranks)
        self.segments = r"(?s).+" if crossing else rf"{SPACE}*[^{SPACE}]+|{SPACE}+" if feeds else rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"
        n = self.normaliser
        self.plain = not crossing and not feeds and n.firsts is None and n.prefix and n.escape and not n.suffix and not n.remove_blanks
        self.pairs = Table(18)
        lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.byte_starts, self.byte_lengths = np.cumsum(lengths) - lengths, lengths
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.is_byte = np.zeros(len(self.texts), bool)
        self.is_byte[self.byte_ids] = True
        return self

    def _stays_apart(self, a: int, b: int) -> bool:
        """Whether merging the characters of both pieces, best rank first and leftmost among equals, gives (a, b)."""
        return self._merged([*self.texts[a], *self.texts[b]], 2) == [self.texts[a], self.texts[b]] and self.texts[a] + self.texts[b] not in self.ranks

    def _merged(self, parts: list[str], least: int) -> list[str]:
        while len(parts) > least:
            best = min(((self.ranks[m][0], k) for k in range(len(parts) - 1) if (m := parts[k] + parts[k + 1]) in self.ranks), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def admitted(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """The pair acceptor's verdicts, kept in a bounded table; before is -1 after the start or fallback."""
        keys = np.where(before < 0, np.int64(0), before.astype(np.int64) * len(self.texts) + piece)
        found = self.pairs.get(keys)
        new = np.unique(keys[(found < 0) & (before >= 0)])
        if len(new):
            if self.pairs.used > 1_500_000:
                self.pairs = Table(18)
            verdicts = [self._stays_apart(*divmod(k, len(self.texts))) for k in new.tolist()]
            self.pairs.put(new, np.array(verdicts, np.int32))
            found = self.pairs.get(keys)
        return (found > 0) | (before < 0)

    def shortest_path(self, segment: str) -> list[int]:
        """Pieces of one segment, for those that are too long for rows of arrays; -1 - k stands for fallback at character k."""
        n = len(segment)
        cost, last, back = np.full(n + 1, INFINITE), [-1] * (n + 1), [0] * (n + 1)
        cost[0] = 0
        weights, verdicts, size = self.weights, {}, len(self.texts)
        for i in range(n):
            children, single, before = self.trie, False, last[i]
            for j in range(i, n):
                node = children.get(segment[j])
                if node is None:
                    break
                piece, children = node
                if piece >= 0:
                    single |= j == i
                    w = cost[i] + weights[piece]
                    if w < cost[j + 1]:
                        if self.bpe and before >= 0:
                            key = before * size + piece
                            if key not in verdicts:
                                verdicts[key] = bool(self.admitted(np.array([before], np.int32), np.array([piece], np.int32))[0])
                            if not verdicts[key]:
                                continue
                        cost[j + 1], last[j + 1], back[j + 1] = w, piece, i
            if not single and cost[i] + self.fallback < cost[i + 1]:
                cost[i + 1], last[i + 1], back[i + 1] = cost[i] + self.fallback, -1, i
        out, j = [], n
        while j > 0:
            out.append(last[j] if last[j] >= 0 else -j)
            j = back[j]
        return out[::-1]

    def _relaxed(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last piece (-1: fallback) and its start on the best path to each position of each row of character codes."""
        n, width = len(codes), codes.shape[1]
        known = self.class_of[codes].astype(np.int64)
        alone = ~self.single[codes]
        cost = np.full((n, width + 1), INFINITE)
        last, back = np.full((n, width + 1), -1, np.int32), np.zeros((n, width + 1), np.int16)
        cost[:, 0] = 0
        for i in range(width):
            rows = np.flatnonzero((sizes > i) & (cost[:, i] < INFINITE))
            if not len(rows):
                continue
            out = rows[alone[rows, i]]
            w = cost[out, i] + self.fallback
            out, w = out[w < cost[out, i + 1]], w[w < cost[out, i + 1]]
            cost[out, i + 1], last[out, i + 1], back[out, i + 1] = w, -1, i
            node = np.zeros(len(rows), np.int64)
            for j in range(i, width):
                on = sizes[rows] > j
                node = self.arcs.get(node << 21 | known[rows, j])
                on &= node > 0
                rows, node = rows[on], node[on].astype(np.int64)
                if not len(rows):
                    break
                piece = self.final[node]
                ends = np.flatnonzero(piece >= 0)
                r, p = rows[ends], piece[ends]
                w = cost[r, i] + self.weights[p]
                better = w < cost[r, j + 1]
                r, p, w = r[better], p[better], w[better]
                if self.bpe and len(r):
                    fits = self.admitted(last[r, i], p)
                    r, p, w = r[fits], p[fits], w[fits]
                cost[r, j + 1], last[r, j + 1], back[r, j + 1] = w, p, i
        return last, back

    def shortest_paths(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments one after another, number of ids of each)."""
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        paths: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # segment, place in it, piece (negative: fallback at a character)
        for low, high in ((0, 8), (8, 16), (16, ROW)):
            picked = np.flatnonzero((sizes > low) & (sizes <= high))
            for cut in range(0, len(picked), 20_000):
                some = picked[cut : cut + 20_000]
                n = sizes[some]
                flat = np.frombuffer("".join([segments[k] for k in some.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
                codes = np.zeros((len(some), int(n.max())), np.uint32)
                codes[np.arange(codes.shape[1]) < n[:, None]] = flat
                last, back = self._relaxed(codes, n)
                j, rows, step = n.copy(), np.arange(len(some)), 0
                while len(rows):
                    at = j[rows]
                    piece = last[rows, at]
                    paths.append((some[rows], np.full(len(rows), -step), np.where(piece < 0, -at, piece)))
                    j[rows] = back[rows, at]
                    rows, step = rows[j[rows] > 0], step + 1
        for k in np.flatnonzero(sizes > ROW).tolist():
            found = self.shortest_path(segments[k])
            paths.append((np.full(len(found), k), np.arange(len(found)), np.array(found, np.int64)))
        if not paths:
            return np.zeros(0, np.int32), np.zeros(len(segments), np.int64)
        who, place, piece = (np.concatenate(x) for x in zip(*paths, strict=True))
        order = np.lexsort((place, who))
        who, piece = who[order], piece[order]
        lost = np.flatnonzero(piece < 0)
        if not len(lost):
            return piece.astype(np.int32), np.bincount(who, minlength=len(segments))
        if not self.byte_ids:  # neighbouring unknown characters are one unknown piece
            again = (piece[1:] < 0) & (piece[:-1] < 0) & (who[1:] == who[:-1])
            keep = np.concatenate([[True], ~again])
            return np.where(piece < 0, self.unknown, piece)[keep].astype(np.int32), np.bincount(who[keep], minlength=len(segments))
        emitted = [segments[who[k]][-piece[k] - 1].encode("utf-8", "replace") for k in lost.tolist()]
        times = np.ones(len(piece), np.int64)
        times[lost] = [len(b) for b in emitted]
        out, who = np.repeat(piece, times), np.repeat(who, times)
        out[out < 0] = np.array(self.byte_ids)[np.frombuffer(b"".join(emitted), np.uint8)]
        return out.astype(np.int32), np.bincount(who, minlength=len(segments))

    def keys_of(self, text: str | None) -> list[str]:
        """The segments of a text, as keys of the memo.  In plain texts a key is a word, which stands for U+2581 and the
        word, or a line feed and the word after it; others have keys that begin with a zero and hold the segment."""
        if not text:
            return []
        if self.plain and "  " not in text and text[0] != " " and SPACE not in text and "\0" not in text:
            return text.replace("\n", " \n").split(" ")
        return ["\0" + x for x in re.findall(self.segments, self.normaliser.apply(text))]

    @staticmethod
    def segments_of(key: str) -> str:
        return key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else SPACE + key

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes that pieces emit, one after another."""
        if not len(ids):
            return b""
        n = self.byte_lengths[ids]
        ends = np.cumsum(n)
        return self.all_bytes[np.arange(ends[-1]) + np.repeat(self.byte_starts[ids] - ends + n, n)].tobytes()

    def decode(self, ids) -> str:
        """The inverse transducer: bytes of all pieces, read as UTF-8, without the blank that the normaliser added."""
        text = self.decoded(np.asarray(ids, np.int64)).decode("utf-8", "replace")
        n = self.normaliser
        return text if not n.prefix else text.removesuffix(" ") if n.suffix else text.removeprefix(" ")


class Segments:
    """A worker's memo of segments: key -> number of its run of ids.  Two generations are kept: a full one becomes the old
    one, from which keys that occur again are taken over."""

    def __init__(self, machine: PieceTransducer, limit: int = 300_000):
        self.machine, self.limit = machine, limit
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.old, self.old_runs = {}, (self.flat, self.starts, self.lengths)

    @staticmethod
    def gather(runs: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, starts, lengths = runs
        n = lengths[rows]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(n) else 0
        return flat[np.arange(total) + np.repeat(starts[rows] - ends + n, n)], n

    def _add(self, keys: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        if len(self.known) > self.limit // 2:
            self.old, self.old_runs = self.known, (self.flat, self.starts, self.lengths)
            self.known, self.flat, self.starts, self.lengths = {}, self.flat[:0], self.starts[:0], self.lengths[:0]
        keys = [self.machine.keys_of(t) for t in texts]
        new = set().union(*keys).difference(self.known)
        held = [k for k in new if k in self.old]
        if held:
            self._add(held, *self.gather(self.old_runs, np.fromiter(map(self.old.__getitem__, held), np.int64, len(held))))
        fresh = list(new.difference(self.old))
        if fresh:
            self._add(fresh, *self.machine.shortest_paths(list(map(self.machine.segments_of, fresh))))
        rows = np.fromiter(map(self.known.__getitem__, chain.from_iterable(keys)), np.int64, sum(map(len, keys)))
        ids, n = self.gather((self.flat, self.starts, self.lengths), rows)
        ends = np.cumsum([0, *map(len, keys)])
        total = np.concatenate([[0], np.cumsum(n)])
        return ids, total[ends[1:]] - total[ends[:-1]]


def encode(docs: DataFrame, transducer: PieceTransducer, text_col: str = "text", together: int = 1 << 20) -> DataFrame:
    """Adds ids (array of int), n_pieces, n_bytes_fallback and round_trip (decoding gives the text back) to docs.

    Null and empty texts have no ids and round-trip true.  round_trip is false where the normaliser changes a text; a
    text that holds U+2581 itself decodes to a blank there.  Texts are encoded whole, about ``together`` characters at a
    time.  Other columns pass through; columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(transducer)
    names = ("ids", "n_pieces", "n_bytes_fallback", "round_trip")
    docs = docs.select(*[c for c in docs.columns if c not in names])
    schema = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "ids array<int>, n_pieces long, n_bytes_fallback long, round_trip boolean"]
    )

    def run(batches):
        machine = shared.value
        memo = Segments(machine)

        def added(part: pa.RecordBatch, texts: list[str | None]) -> list[pa.RecordBatch]:
            ids, n = memo.encode(texts)
            offsets = np.concatenate([[0], np.cumsum(n)])
            lost = np.concatenate([[0], np.cumsum(machine.is_byte[ids])])
            same = [machine.decode(ids[a:b]) == (t or "") for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True)]
            table = pa.Table.from_batches([part])
            table = table.append_column("ids", pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())))
            table = table.append_column("n_pieces", pa.array(n, pa.int64()))
            table = table.append_column("n_bytes_fallback", pa.array(lost[offsets[1:]] - lost[offsets[:-1]], pa.int64()))
            return table.append_column("round_trip", pa.array(same, pa.bool_())).to_batches()

        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            start, size = 0, 0
            for k, t in enumerate(texts):
                size += len(t or "")
                if size > together or k + 1 == len(texts):
                    yield from added(batch.slice(start, k + 1 - start), texts[start : k + 1])
                    start, size = k + 1, 0

    return docs.mapInArrow(run, schema)
