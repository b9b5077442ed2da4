"""Seen keys, snapshots and cards over many batches, repeated ones too."""

import glob

import pytest
from pyspark.sql import functions as F

from millrace.sources import readers
from millrace.streaming import growing, state


def test_seen_keys_over_many_batches(spark, tmp_path):
    base, every = f"file://{tmp_path}", 4
    marked = growing.SeenKeys(spark, base, {"source": "string", "id": "string"}, buckets=2, every=every)
    make = lambda ids, day=0: spark.createDataFrame([("s", str(i), day) for i in ids], "source string, id string, day int").coalesce(1)
    marked.begin(make([1000]))
    seen = {"1000"}
    for n in range(18):
        batch = make([3 * n, 3 * n + 1, n, 1000 + n % 2], n)
        for _ in range(1 + (n in (4, 9))):  # a batch that runs again
            assert {r.id for r in marked.lookup(batch, n).collect()} == {r.id for r in batch.collect()} & seen
            marked.mark(batch, n)
        seen |= {r.id for r in batch.collect()}
        files = [f for p in marked.table.paths(n + 1) for f in glob.glob(f"{p.removeprefix('file://')}/bucket=*/*.parquet")]
        per = [sum(f"bucket={b}/" in f for f in files) for b in (0, 1)]
        assert max(per) <= 1 + every
    assert {r.day for r in marked.lookup(make([1001]), 18).collect()} == {17}
    assert len(glob.glob(f"{tmp_path}/keys/*")) <= 2 + 2 * every + every
    unknown = marked.passing(make(range(5000, 5400)), 18)
    assert unknown.count() < 20  # the filters keep most of them from a lookup


def test_first_seen_in_batches(spark):
    rows = spark.createDataFrame([("a", str(k % 7), "python" if k % 3 else "cook", k) for k in range(40)], "source string, id string, title string, ord long").coalesce(1)
    want = sorted(map(tuple, state.first_seen(spark, rows, ["python"]).collect()))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 6)
    try:
        got = sorted(map(tuple, state.first_seen(spark, rows, ["python"], files=1, every=3).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert got == want == [("a", str(k), k, bool(k % 3)) for k in range(7)]


def test_windows_tell_what_changed(spark):
    at = [5, 12, 7, 33, 34, 61, 64, 69]
    rows = spark.createDataFrame([(1_700_000_000 + t, "a", float(t)) for t in at], "s long, bucket string, value double").select(F.timestamp_seconds("s").alias("ts"), "bucket", "value")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        told = state.windowed(spark, rows.coalesce(1), "10 seconds", files=1)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    steps = sorted((r.batch, r.ts.timestamp() % 1000, r.n) for r in told.since_fold().collect())
    assert steps == [(0, 0.0, 2), (0, 10.0, 1), (1, 30.0, 2), (1, 60.0, 1), (2, 60.0, 3)]
    assert {(r.ts.timestamp() % 1000, r.n, r.total) for r in told.latest().collect()} == {(0.0, 2, 12.0), (10.0, 1, 12.0), (30.0, 2, 67.0), (60.0, 3, 194.0)}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    ddl = "oid long, model_key string, mtime long, review_status string"
    table = readers.CardTable(spark, f"file://{tmp_path}", ddl, buckets=8)
    table.create(spark.createDataFrame([(k, "m", 1, "edited" if k % 5 == 0 else "new") for k in range(40)], ddl))
    files = lambda: {b: sorted(glob.glob(f"{tmp_path}/cards/bucket={b}/*.parquet")) for b in range(8)}
    before = files()
    updates = spark.createDataFrame([(3, "m", 2, "u"), (5, "m", 2, "u"), (100, "m", 1, "u")], ddl)
    touched = {r.bucket for r in table._bucketed(updates).collect()}
    table.upsert(updates, "one")
    after = files()
    assert all((before[b] == after[b]) == (b not in touched) for b in range(8))
    rows = {r.oid: (r.mtime, r.review_status) for r in table.read().collect()}
    assert len(rows) == 41 and rows[3] == (2, "u") and rows[5] == (1, "edited") and rows[100] == (1, "u")
    table.upsert(updates, "one")
    assert {r.oid: (r.mtime, r.review_status) for r in table.read().collect()} == rows
    table.upsert(spark.createDataFrame([(3, "m", 3, "v")], ddl), "two")
    assert {r.oid: r.mtime for r in table.read().collect()}[3] == 3


@pytest.mark.parametrize("rounds", [3])
def test_growing_tables_fold(spark, tmp_path, rounds):
    table = growing.Growing(spark, f"file://{tmp_path}", "k int", every=2)
    for n in range(2 * rounds + 1):
        assert sorted(r.k for r in table.before(n).collect()) == list(range(n))
        table.write(n, spark.createDataFrame([(n,)], "k int"))
    assert len(table.paths(2 * rounds + 1)) <= 2
