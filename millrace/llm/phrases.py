"""Phrase collocations: exact counts of word sequences in HAT-tries, and their scores.

Counting goes by length.  Each task keeps a trie over word ids: below a phrase's first word lies a hash container of the
other words, packed in one number; a container that grows beyond ``burst`` becomes a node with a container for each second
word.  Where a trie's entries exceed the memory limit, its largest subtrees are given out whole, as runs sorted by
phrase, and forgotten.  The runs of all tasks are dealt to partitions by prefix, where equal phrases are added up.  A
task sends a phrase once for each time it spills, however often it occurs.

A phrase that occurs ``least`` times has no rarer part.  So the words, then the pairs, then the triples that are frequent
enough set bits of a map of fixed size, and longer phrases are counted only where the bits of their parts are set.  A bit set
by another phrase costs work but no count, and nothing frequent is passed over: all counts of frequent phrases are exact.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise

#: A-Z to lower case, tabs to blanks, separators of pieces to line ends.
CLEAN = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else b for b in range(256))
#: Stands between pieces in a list of words; no word holds it.
BREAK = b"."
CHUNK = 1 << 20
#: Bits of a word's id; a task's ids start anew where they are used up.
ID_BITS = 20
#: Bits of the map of frequent phrases: 16 MB, at any size of the corpus.
MAP_BITS = 27
BUCKET_BITS = 32_768
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(27))


def place(h: int) -> int:
    """joined_hash of one word's hash."""
    return h >> (64 - MAP_BITS)


def joined_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Place in the map of phrases, from the hashes of their words."""
    h = parts[0]
    for p in parts[1:]:
        h = mixed(h * U64(0x9E3779B97F4A7C15) + p)
        h = mixed(h)
    return (h >> U64(64 - MAP_BITS)).astype(np.int64)


def word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang + b"\0" + word)


class Vocabulary(dict):
    """Word -> id among the task's words that may be frequent; -1 for other words and the break.  One for each language,
    with ids from a common counter."""

    def __init__(self, lang: bytes, names: list, hashes: list, frequent: bytes):
        super().__init__({BREAK: -1})
        self.lang, self.names, self.hashes, self.frequent = lang, names, hashes, frequent

    def __missing__(self, word: bytes) -> int:
        h = word_hash(self.lang, word)
        at = place(h)
        if self.frequent[at >> 3] >> (at & 7) & 1:
            found = len(self.names)
            self.names.append((self.lang, word))
            self.hashes.append(h)
        else:
            found = -1
        # Rare words are as many as a corpus likes: only those seen since the last cut are remembered.
        self[word] = found
        return found


class HatTrie:
    """Counts of sequences (first id, other ids packed in one number of ``width - 1`` ids)."""

    def __init__(self, width: int, burst: int = 8192, limit: int = 600_000):
        self.width, self.burst, self.limit = width, burst, limit
        self.low = max(0, width - 2) * ID_BITS  # bits of the ids behind the second
        self.root: dict[int, dict] = {}
        self.nodes: set[int] = set()  # first ids whose container has burst
        self.sizes: dict[int, int] = {}
        self.entries = 0

    def add(self, first: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> None:
        """Distinct sequences, sorted by their first id."""
        starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else np.zeros(0, int)
        rests, numbers = rest.tolist(), counts.tolist()
        for at, to in zip(starts.tolist(), [*starts[1:].tolist(), len(first)], strict=True):
            key = int(first[at])
            below = self.root.setdefault(key, {})
            if key in self.nodes:
                grown = 0
                for r, n in zip(rests[at:to], numbers[at:to], strict=True):
                    box = below.setdefault(r >> self.low, {})
                    tail = r & ((1 << self.low) - 1)
                    if tail in box:
                        box[tail] += n
                    else:
                        box[tail] = n
                        grown += 1
            else:
                before = len(below)
                for r, n in zip(rests[at:to], numbers[at:to], strict=True):
                    below[r] = below.get(r, 0) + n
                grown = len(below) - before
                if len(below) > self.burst and self.low:
                    self.root[key] = self.split(below)
                    self.nodes.add(key)
            self.sizes[key] = self.sizes.get(key, 0) + grown
            self.entries += grown

    def split(self, box: dict[int, int]) -> dict[int, dict[int, int]]:
        node: dict[int, dict[int, int]] = {}
        for r, n in box.items():
            node.setdefault(r >> self.low, {})[r & ((1 << self.low) - 1)] = n
        return node

    def largest(self) -> list[int]:
        """First ids of the largest subtrees, which hold half of the entries at least."""
        out, held = [], 0
        for key in sorted(self.sizes, key=lambda k: -self.sizes[k]):
            if 2 * held >= self.entries:
                break
            out.append(key)
            held += self.sizes[key]
        return out

    def take(self, keys: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Removes subtrees; first ids, other ids packed, counts."""
        rests, counts, sizes = [], [], []
        for key in keys:
            below = self.root.pop(key)
            held = self.sizes.pop(key)
            self.entries -= held
            sizes.append(held)
            boxes = below.items() if key in self.nodes else [(0, below)]
            self.nodes.discard(key)
            for second, box in boxes:
                rests.append(np.fromiter(box.keys(), np.int64, len(box)) | second << self.low)
                counts.append(np.fromiter(box.values(), np.int64, len(box)))
        flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return np.repeat(np.array(keys, np.int64), np.array(sizes, np.int64)), flat(rests), flat(counts)


def words_of(text: str | None):
    """The words of a text with breaks between its pieces, a stretch at a time."""
    data = (text or "").encode("utf-8", "replace").translate(CLEAN)
    at = 0
    while at < len(data):
        to = at + CHUNK
        while to < len(data) and data[to] not in (10, 32):
            to += 1
        yield data[at:to].replace(b"\n", b" . ").split()
        at = to


def word_counts(docs: DataFrame, limit: int = 600_000) -> DataFrame:
    """Sorted runs (lang, phrase, n) of words: the trie of one level is its root container."""

    def run(batches):
        boxes: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                box = boxes.setdefault(lang, Counter())
                for words in words_of(text.as_py()):
                    box.update(words)
                    if len(box) > limit:
                        yield spill(lang, box)
                if sum(map(len, boxes.values())) > limit:
                    yield from spill_all(boxes)
        yield from spill_all(boxes)

    def spill(lang, box):
        box.pop(BREAK, None)
        out = sorted_run(pa.array([lang] * len(box), pa.string()), pa.array(box.keys(), pa.binary()), pa.array(box.values(), pa.int64()))
        box.clear()
        return out

    def spill_all(boxes):
        for lang in sorted(boxes):
            yield spill(lang, boxes[lang])

    return docs.mapInArrow(run, "lang string, phrase string, n long")


def sorted_run(lang: pa.Array, phrase: pa.Array, n: pa.Array) -> pa.RecordBatch:
    run = pa.RecordBatch.from_arrays([lang.cast(pa.string()), phrase.cast(pa.string()), n], ["lang", "phrase", "n"])
    return run.take(pc.sort_indices(run, sort_keys=[("lang", "ascending"), ("phrase", "ascending")]))


def phrase_counts(docs: DataFrame, width: int, words, parts, limit: int = 600_000, burst: int = 8192, batch_words: int = 1_000_000) -> DataFrame:
    """Sorted runs (lang, phrase, n) of all phrases of ``width`` words whose words and parts of width - 1 have their bits set.

    ``words`` and ``parts`` are broadcasts of the maps, of fixed size.
    """

    def run(batches):
        frequent, of_parts = words.value, np.frombuffer(parts.value, np.uint8)
        names: list = []
        hashes: list = []
        vocabularies: dict[bytes, Vocabulary] = {}
        trie = HatTrie(width, burst, limit)
        held: list[np.ndarray] = []
        n_held = 0

        def run_of(keys):
            first, rest, n = trie.take(keys)
            known = pa.array([w for _, w in names], pa.binary())
            ids = [first, *(rest >> ID_BITS * k & (1 << ID_BITS) - 1 for k in range(width - 2, -1, -1))]
            parts = [known.take(pa.array(i)) for i in ids]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
            return sorted_run(pa.array([x for x, _ in names], pa.binary()).take(pa.array(first)), phrase, pa.array(n))

        def count():
            nonlocal held, n_held
            ids = np.concatenate(held) if held else np.zeros(0, np.int64)
            held, n_held = [], 0
            if len(ids) < width:
                return
            h = np.array(hashes, U64)[ids] if hashes else np.zeros(len(ids), U64)  # of breaks: any, never used
            sound = ids >= 0
            many = len(ids) - width + 2
            part_sound = np.logical_and.reduce([sound[k : many + k] for k in range(width - 1)])
            at = np.flatnonzero(part_sound)
            if width > 2:
                bit = joined_hash([h[at + k] for k in range(width - 1)])
                at = at[(of_parts[bit >> 3] >> (bit & 7) & 1).astype(bool)]
            ok = np.zeros(many + 1, bool)
            ok[at] = True
            at = np.flatnonzero(ok[:-1] & ok[1:])
            at = at[at + width <= len(ids)]
            first, rest = ids[at], np.zeros(len(at), np.int64)
            for k in range(1, width):
                rest = rest << ID_BITS | ids[at + k]
            if width < 4:  # both fit one number
                both = np.sort(first << ID_BITS * (width - 1) | rest)
                first, rest = both >> ID_BITS * (width - 1), both & (1 << ID_BITS * (width - 1)) - 1
            else:
                order = np.lexsort((rest, first))
                first, rest = first[order], rest[order]
            if not len(first):
                return
            starts = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])])
            trie.add(first[starts], rest[starts], np.diff(np.r_[starts, len(first)]))

        def spilled():
            while trie.entries > trie.limit:
                yield run_of(trie.largest())

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                lang = lang.encode()
                if lang not in vocabularies:
                    vocabularies[lang] = Vocabulary(lang, names, hashes, frequent)
                known = vocabularies[lang]
                for found in words_of(text.as_py()):
                    held.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
                    n_held += len(found)
                held.append(np.full(1, -1))
                if n_held > batch_words:
                    count()
                    yield from spilled()
                    if len(names) > 1 << (ID_BITS - 1) or sum(map(len, vocabularies.values())) > limit:
                        yield run_of(list(trie.root))
                        names.clear()
                        hashes.clear()
                        vocabularies.clear()
        count()
        yield from spilled()
        yield run_of(list(trie.root))

    return docs.mapInArrow(run, "lang string, phrase string, n long")


def merged(runs: DataFrame, width: int, shares: int = 16) -> DataFrame:
    """lang, phrase, f: the runs of all tasks, dealt by prefix (all words but the last; of a single word itself) and added up.

    The phrases of a prefix are dealt to ``shares`` partitions, so that one that begins very many phrases burdens no task.
    """
    prefix = F.substring_index("phrase", " ", width - 1) if width > 1 else F.col("phrase")
    part = F.xxhash64("lang", prefix, F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.withColumn("part", part).repartition(parts, "part")
    return dealt.groupBy("part", "lang", "phrase").agg(F.sum("n").alias("f")).drop("part")


def bit_map(phrases: DataFrame) -> bytes:
    """2^MAP_BITS bits, set where a phrase of (lang, phrase) falls."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows = zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True)
                words = [[word_hash(lang.encode(), w) for w in p.encode().split(b" ")] for lang, p in rows]
                yield pa.RecordBatch.from_arrays([pa.array(joined_hash(list(np.array(words, U64).T)) + 1)], ["x"])

    x = phrases.select("lang", "phrase").mapInArrow(run, "x long")
    cells = x.groupBy(F.bitmap_bucket_number("x").alias("cell")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()
    out = np.zeros(((1 << MAP_BITS) // BUCKET_BITS, BUCKET_BITS // 8), np.uint8)
    for r in cells:
        out[r.cell - 1] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def count_phrases(docs: DataFrame, longest: int = 4, least: int = 30, limit: int = 600_000, burst: int = 8192, batch_words: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(lang, n) of all words, and (lang, phrase, width, f) of all phrases of up to ``longest`` words that occur ``least`` times."""
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")
    words = materialise(merged(word_counts(docs, limit), 1))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    levels = [materialise(words.where(F.col("f") >= least))]
    word_map = context.broadcast(bit_map(levels[0]))
    part_map = word_map
    for width in range(2, longest + 1):
        runs = phrase_counts(docs, width, word_map, part_map, limit, burst, batch_words)
        levels.append(materialise(merged(runs, width).where(F.col("f") >= least)))
        if width < longest:
            part_map = context.broadcast(bit_map(levels[-1]))
    every = None
    for width, level in enumerate(levels, 1):
        level = level.withColumn("width", F.lit(width))
        every = level if every is None else every.unionByName(level)
    return totals, every


def looked_up(rows: DataFrame, counts: DataFrame, phrase: str, name: str) -> DataFrame:
    """rows with ``name``, the count of their column ``phrase``.  A part that very many rows share makes a partition that the adaptive
    plan splits, since counts have one row for it."""
    return rows.join(counts.select("lang", F.col("phrase").alias(phrase), F.col("f").alias(name)), ["lang", phrase])


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, top: int = 2000, cover: int = 80, **limits) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of docs (text, lang).

    a is the phrase's count; cut after k words, l and r are the counts of its two parts and its score floor(2000000 * a /
    (l + r)); the lowest-scoring cut counts, of equal ones that with the smallest k.  A phrase inside a longer one that
    occurs at least ``cover`` per cent as often is left out.  Order: score and a falling, then phrase by bytes.  n is
    the number of words of the language; a null language is und, and one without a phrase has no rows.  Null and empty texts have
    no words.  Repeated rows count each time; other columns are ignored.
    """
    totals, counts = count_phrases(docs, longest, least, **limits)
    word = F.split("phrase", " ")
    found = counts.where("width > 1").select("lang", "phrase", "width", F.col("f").alias("a"))
    # Phrases that a longer one covers.
    spans = F.flatten(
        F.transform(F.sequence(F.lit(2), F.col("width") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("width") - k + 1), lambda i: F.array_join(F.slice(word, i, k), " ")))
    )
    inner = found.where("width > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.coalesce(F.col("longer").cast("decimal(38,0)") * 100 >= F.col("a").cast("decimal(38,0)") * cover, F.lit(False))
    kept = materialise(found.join(inner, ["lang", "phrase"], "left").where(~covered).select("lang", "phrase", "width", "a"))
    # Each cut's score, length by length: a part's count comes from the phrases of its length.  The lowest score is kept, and of
    # equal ones the first cut's.
    part = lambda at, n: F.array_join(F.slice(word, at, n), " ")
    score = "CAST(CAST(a AS DECIMAL(20,0)) * 2000000 div (CAST(l{k} AS DECIMAL(20,0)) + r{k}) AS BIGINT)"
    scored = None
    for width in range(2, longest + 1):
        rows = kept.where(F.col("width") == width)
        for k in range(1, width):
            for name, side, n in ((f"l{k}", part(1, k), k), (f"r{k}", part(k + 1, width - k), width - k)):
                rows = looked_up(rows.withColumn("part", side), counts.where(F.col("width") == n), "part", name).drop("part")
        cuts = [F.struct(F.expr(score.format(k=k)).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, width)]
        rows = rows.withColumn("low", F.least(*cuts) if len(cuts) > 1 else cuts[0]).select("lang", "phrase", "a", "low.l", "low.r", "low.score")
        scored = rows if scored is None else scored.unionByName(rows)
    # The first of each share of a language's phrases, then of all: no task orders a whole language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    part = scored.withColumn("_s", share).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("_r") <= top)
    first = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return first.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = """WITH texts AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT rid, lang, unnest(list_transform(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]'), lambda p: regexp_extract_all(p, '[^\\x20\\x09]+'))) AS w FROM texts),
numbered AS (SELECT row_number() OVER () AS pid, lang, w FROM pieces WHERE len(w) > 0),
flat AS (SELECT pid, lang, unnest(w) AS w1, generate_subscripts(w, 1) AS pos FROM numbered),
runs AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM flat WINDOW o AS (PARTITION BY pid ORDER BY pos)),
grams AS (SELECT lang, 1 AS width, w1 AS phrase FROM runs UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM runs WHERE w4 IS NOT NULL),
f AS (SELECT lang, width, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, count(*) AS n FROM flat GROUP BY lang),
c AS (SELECT lang, width, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE width > 1),
spans AS (SELECT lang, a, unnest([[1, 2], [2, 2], [3, 2], [1, 3], [2, 3]]) AS s, w, width FROM c WHERE width > 2),
covers AS (SELECT lang, array_to_string(w[s[1] : s[1] + s[2] - 1], ' ') AS phrase, max(a) AS longer FROM spans WHERE s[2] < width AND s[1] + s[2] - 1 <= width GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN covers USING (lang, phrase) WHERE longer IS NULL OR NOT 100::HUGEINT * longer >= 80::HUGEINT * a),
cuts AS (SELECT *, unnest(generate_series(1, width - 1)) AS k FROM kept),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, h.f AS l, t.f AS r, 2000000::HUGEINT * cuts.a // (h.f + t.f) AS score FROM cuts
    JOIN f h ON h.lang = cuts.lang AND h.phrase = array_to_string(w[1:k], ' ') JOIN f t ON t.lang = cuts.lang AND t.phrase = array_to_string(w[k + 1 : cuts.width], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
