"""WARC archives of pages and the external merge of their capture indexes.

Writing: one WARC/1.1 record per page, response or revisit by payload digest, in text files whose line
separator is the record terminator (CR LF CR LF).  Reading: archives are parsed by Content-Length, one
file at a time.  Index: each archive yields a run of captures sorted by URL key and time; the runs are
dealt to ranges of (key, time) and merged there by a loser tree into globally ordered capture histories.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import hot_join, materialise, shared_dir

END = "\r\n\r\n"
#: An archive holds at most so many bytes of payload (or one record), since it is read whole.
FILE_BYTES = 64 << 20
#: Bytes that a record's headers are taken to have.
HEADER_BYTES = 1000
#: Captures in a range of the merged index.
RANGE_ROWS = 100_000
CAPTURE = "page_id long, url string, urlkey string, ts string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels in reverse, then port, path and query; scheme, www and fragment don't count."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return (url or "").lower()
    labels = ",".join(reversed(host.split(".")))
    return f"{labels}{f':{port}' if port else ''}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def typed(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Adds payload, payload_bytes, payload_digest, record_type, refers_to to pages (page_id, url, html).

    Among equal payloads of at least ``least_bytes`` bytes the smallest page_id is the response.  A null
    html is an empty payload.  Repeated rows of that page_id are responses too.  The list of digests that several pages have
    is broadcast if it is short, so that payloads aren't shuffled, and else joined under salts.
    """
    pages = pages.select(
        "page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload")
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})
    first = (
        pages.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    pages = hot_join(pages, materialise(first), "payload_digest", "left", ["page_id", "url"])
    revisit = F.col("first_id").isNotNull() & (F.col("page_id") != F.col("first_id"))
    return pages.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, path: str, records_per_file: int = 2000, least_bytes: int = 100) -> None:
    """Write a WARC record for each row of pages (page_id, url, html) to files under path: plain ones, so that the index's
    offsets lead to records without reading what lies before.  A file has ``records_per_file`` records or as few as keep
    it below FILE_BYTES: pages are written by classes of size, each with its own number, so that a large page closes no
    file but its own.  Equal payloads have equal sizes, so a response and its revisits are in one class.

    A revisit carries the payload too, so that an archive can be read alone; its header names the page
    it refers to.  The date is the page_id in seconds after 2024-01-01 (pages have no time of their own).
    """
    size = F.coalesce(F.octet_length("html"), F.lit(0)) + HEADER_BYTES
    least = FILE_BYTES // records_per_file
    kind = F.greatest(F.lit(0), F.ceil(F.log(8.0, size / least))).cast("int")  # a class is eight times as large as the one below
    kinds = [row.kind for row in pages.select(kind.alias("kind")).distinct().orderBy("kind").collect()]  # a dozen at most
    for k in kinds or [0]:
        _write(typed(pages.where(kind == k), least_bytes), path, max(1, FILE_BYTES // (least * 8**k)))


def _write(rows: DataFrame, path: str, records_per_file: int) -> None:
    date = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.col("page_id"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", " ")
    record = F.concat(
        F.concat_ws(
            "\r\n",
            F.lit("WARC/1.1"),
            F.concat(F.lit("WARC-Type: "), F.col("record_type")),
            F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
            F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")),
            F.concat(F.lit("WARC-Target-URI: "), F.when(F.col("url").isNotNull(), uri)),
            F.concat(F.lit("WARC-Date: "), date),
            F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
            F.concat(F.lit("Content-Type: text/html; charset=utf-8")),
            F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string")),
        ),
        F.lit(END),
        F.col("payload"),
    )
    (
        rows.select(record.alias("value"))
        .write.option("lineSep", END)
        .option("maxRecordsPerFile", records_per_file)
        .option("compression", "none")
        .mode("append")
        .text(path)
    )


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """Offset, headers and payload of each record of an archive."""
    at, view = 0, memoryview(data)
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at offset {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield at, headers, view[head + 4 : head + 4 + size]
        at = head + 4 + size + len(END)


def _id(urn: str | None) -> int | None:
    found = re.search(r"-?\d+", urn or "")
    return int(found[0]) if found else None


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives under path; rows of an archive are sorted by urlkey, ts and page_id.

    The digest and the length are taken from the payload as read, not from the header; a mismatch raises.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                for at, h, payload in records(content):
                    digest = hashlib.sha256(payload).hexdigest()
                    if h["WARC-Payload-Digest"] != f"sha256:{digest}":
                        raise ValueError(f"payload of {h['WARC-Record-ID']} in {name} is damaged")
                    url = h.get("WARC-Target-URI")
                    rows.append((_id(h["WARC-Record-ID"]), url, url_key(url), h["WARC-Date"], len(payload), digest, h["WARC-Type"], _id(h.get("WARC-Refers-To")), name, at))
                rows.sort(key=lambda r: (r[2], r[3], r[0] is None, r[0]))
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in CAPTURE.split(", ")])
                frame["page_id"], frame["refers_to"] = frame["page_id"].astype("Int64"), frame["refers_to"].astype("Int64")
                yield frame

    return files.mapInPandas(run, CAPTURE)


class LoserTree:
    """k-way merge of sorted iterables: an inner node keeps the loser of its match, so a step replays one path."""

    def __init__(self, runs: Iterable[Iterable], key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(self.runs))
        self.heads = [self._next(i) for i in range(len(self.runs))] or [None]
        self.nodes = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for n in range(self.k - 1, 0, -1):
            a, b = winners[2 * n], winners[2 * n + 1]
            if self._less(b, a):
                a, b = b, a
            winners[n], self.nodes[n] = a, b
        self.winner = winners[1] if self.k > 1 else 0

    def _next(self, i: int):
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), item)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head goes before run b's; an ended run goes last, ties to the smaller run."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return (x[0], a) < (y[0], b)

    def __iter__(self):
        while self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i][1]
            self.heads[i] = self._next(i)
            n = (i + self.k) // 2
            while n >= 1:
                if self._less(self.nodes[n], i):
                    self.nodes[n], i = i, self.nodes[n]
                n //= 2
            self.winner = i


def merged_index(runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Merge sorted runs (capture_runs) into one order by (urlkey, ts, page_id) over all partitions; adds capture_no.

    Rows are dealt to ranges of the whole key, about RANGE_ROWS in each, so that a URL with very many captures is spread too and
    a task holds one range; a range's slices of the runs are merged by a loser tree.  capture_no counts a URL's captures from 1: within
    ranges by the merge, across them by adding what earlier ranges hold of the same key (a few rows each).
    """
    spark = runs.sparkSession
    runs = materialise(runs)  # the archives are read once; ranges are drawn from the runs
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(n, "urlkey", "ts", "page_id")
    names = [c.split()[0] for c in CAPTURE.split(", ")]

    def key(row):
        return row[2], row[3], row[0] is not None, row[0] or 0

    def run(batches):
        slices: dict[str, list] = {}
        for pdf in batches:
            for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None):
                slices.setdefault(row[8], []).append(row)
        for s in slices.values():
            if any(key(a) > key(b) for a, b in zip(s, s[1:], strict=False)):
                s.sort(key=key)  # fetched blocks of one run may come in any order
        part, out, last, no = None, [], None, 0
        for row in LoserTree([slices[k] for k in sorted(slices)], key):
            part = part or row
            no = no + 1 if row[2] == last else 1
            last = row[2]
            out.append((*row, no))
            if len(out) == 10_000:
                yield _frame(out, names)
                out = []
        if out:
            yield _frame(out, names)

    merged = materialise(dealt.mapInPandas(run, CAPTURE + ", no long").withColumn("part", F.spark_partition_id()))
    ends = merged.groupBy("urlkey", "part").agg(F.max("no").alias("n"))
    split = ends.groupBy("urlkey").agg(F.count("*").alias("parts")).where("parts > 1").select("urlkey")
    from pyspark.sql import Window

    before = Window.partitionBy("urlkey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = ends.join(split, "urlkey", "left_semi").select("urlkey", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return merged.join(shift, ["urlkey", "part"], "left").withColumn("capture_no", F.col("no") + F.coalesce(F.col("shift"), F.lit(0))).drop("no", "shift", "part")


def _frame(rows: list, names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[*names, "no"])
    for c in ("page_id", "refers_to"):
        frame[c] = frame[c].astype("Int64")
    return frame


def archive_and_index(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages to archives, read them back, and return the merged capture index, one row per page."""
    path = path or shared_dir(pages.sparkSession)
    write_archives(pages, path)
    return merged_index(capture_runs(pages.sparkSession, path))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
