"""Problems 1, 5 and 7 on small tables made to be awkward."""

import pytest
from pyspark.sql import functions as F

from waymark.operators.changefeed import EqualityDeleteTable, current_items, whole_seconds
from waymark.operators.incremental import IncrementalTarget, pending_fetches
from waymark.operators.manifest import ConcurrentCommit
from waymark.operators.references import orphan_counts, orphans
from waymark.streaming.feeds import apply_changes, snapshot_events, webhook_spool

FETCH = "fetch_id long, file_path string, content_hash binary, updated_at long, extra string"
DOCS = "doc_id long, file_path string, blake3_hash binary, last_indexed long"
ITEMS = "feed_id long, source_name string, id string, title string, updated_at long, deleted boolean"


def test_pending_fetches(spark):
    f = spark.createDataFrame([
        (1, "same", b"a", 5, None), (2, "changed", b"a", 5, None), (3, "changed", b"b", 9, None), (4, "late", b"z", 3, None), (5, "late", b"a", 7, None), (6, "failed", b"a", 5, None), (7, "failed", None, 9, None),
        (8, "tie", None, 5, None), (2, "tie", b"a", 5, None), (9, "new", b"q", 1, None), (9, "new", b"q", 1, None), (10, None, b"x", 1, None), (11, "nulltime", b"a", None, None),
    ], FETCH)
    d = spark.createDataFrame([(i, p, b"a", 1) for i, p in enumerate(["same", "changed", "late", "failed", "tie", "nulltime"])] + [(99, None, b"x", 1)], DOCS)
    assert sorted(r.file_path for r in pending_fetches(f, d).collect()) == ["changed", "failed", "new"]
    assert pending_fetches(f.limit(0), d).isEmpty() and pending_fetches(f, d.limit(0)).count() == 7


def test_incremental_runs(spark, tmp_path):
    t = IncrementalTarget(spark, str(tmp_path / "t"), ["k"], "v")
    source = spark.createDataFrame([("a", 1), ("b", 1), ("c", None)], "k string, v long")
    assert t.pending(source).count() == 3
    t.publish(t.pending(source))
    assert [r.k for r in t.pending(source).collect()] == ["c"]  # an unknown version stays pending
    changed = spark.createDataFrame([("a", 2), ("b", 1), ("d", 1)], "k string, v long")
    todo = t.pending(changed)
    assert sorted(r.k for r in todo.collect()) == ["a", "d"]
    t.table.stage("data", todo.withColumn("_run", F.lit(2).cast("long")))  # a run that dies before it commits
    assert sorted(r.k for r in t.pending(changed).collect()) == ["a", "d"]
    t.publish(todo)
    assert t.pending(changed).isEmpty() and sorted(map(tuple, t.read().select("k", "v").collect()), key=str) == [("a", 2), ("b", 1), ("c", None), ("d", 1)]
    t.compact()
    assert t.pending(changed).isEmpty() and t.table.read("data").count() == 4
    with pytest.raises(ConcurrentCommit):
        t.table.commit({"data": []}, 0)


ROWS = [
    (1, "s", "x", "one", 100, False), (2, "s", "x", "two", 200, False), (3, "s", "x", "late", 150, None), (2, "s", "x", "two", 200, False), (4, "s", "y", "gone", 100, False), (5, "s", "y", None, 101, True),
    (6, "s", "z", "ms", 1_700_000_000_500, False), (7, "s", "z", "s", 1_700_000_000, None), (8, "r", "x", None, 1, None), (9, "s", "w", "back", 10, True), (10, "s", "w", "back", 10, False), (11, None, "q", "t", 1, False), (12, "s", "v", "null time", None, False),
]
LIVE = [("r", "x", 8), ("s", "v", 12), ("s", "w", 10), ("s", "x", 2), ("s", "z", 7)]


def test_current_items(spark):
    feed = spark.createDataFrame(ROWS, ITEMS)
    assert sorted(map(tuple, current_items(feed).select("source_name", "id", "feed_id").collect())) == LIVE
    assert current_items(feed.limit(0)).isEmpty()


def _table(spark, root):
    return EqualityDeleteTable(spark, root, ["source_name", "id"], [whole_seconds(F.col("updated_at")), F.col("feed_id")], F.col("deleted"))


@pytest.mark.parametrize("order", [1, -1])
def test_equality_delete_table(spark, tmp_path, order):
    t = _table(spark, str(tmp_path / "t"))
    for i, part in enumerate([ROWS[::order][:5], ROWS[::order][4:9], ROWS[::order][9:], ROWS[::order][:3]]):
        t.apply(spark.createDataFrame(part, ITEMS))
        if i == 1:
            t.compact()
    assert sorted(map(tuple, t.read().select("source_name", "id", "feed_id").collect())) == LIVE
    t.compact()
    assert sorted(map(tuple, t.read().select("source_name", "id", "feed_id").collect())) == LIVE and t.table.read("data").count() == 5


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for part in (ROWS[:6], ROWS[6:]):
        spark.createDataFrame(part, ITEMS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = apply_changes(feed, str(tmp_path / "t"), str(tmp_path / "c"), ["source_name", "id"], [whole_seconds(F.col("updated_at")), F.col("feed_id")], F.col("deleted"))
    q.awaitTermination(120)
    t = _table(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, t.read().select("source_name", "id", "feed_id").collect())) == LIVE and t.table.version() == 2


def test_webhook_and_watch(spark, tmp_path):
    (tmp_path / "spool").mkdir()
    (tmp_path / "spool/a.json").write_text('{"path":"/a.md","content_b64":"aGk="}\n{"path":"/b.md","content_b64":"aG"}\n')
    q = webhook_spool(spark, str(tmp_path / "spool")).writeStream.format("memory").queryName("hooks").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.path, bytes(r.content) if r.content else None, r.valid) for r in spark.table("hooks").collect()) == [("/a.md", b"hi", True), ("/b.md", None, False)]
    a = spark.createDataFrame([("x", b"1"), ("y", b"1"), ("z", b"1")], "file_path string, content_hash binary")
    b = spark.createDataFrame([("x", b"1"), ("y", b"2"), ("n", b"1")], "file_path string, content_hash binary")
    assert sorted((r.path, r.kind) for r in snapshot_events(a, b).collect()) == [("n", "created"), ("y", "modified"), ("z", "deleted")]


def test_orphans(spark):
    link = "from_id long, to_id long, category string, kind string, weight float, byte_offset long, created_at long"
    docs = spark.createDataFrame([(1, "/v/Café Notes.md", b"", 10), (2, "/v/b.md", b"", 10), (3, "jira://X/X-1.jira", b"", 10)], DOCS)
    tombs = spark.createDataFrame([(2, 5), (2, 10), (1, 5), (1, 5), (7, 1)], "doc_id long, tombstoned_at long")
    links = spark.createDataFrame([(1, 1, "", "", 1.0, 0, 0), (1, 2, "", "", 1.0, 0, 0), (1, 2, "", "", 1.0, 0, 0), (1, 9, "", "", 1.0, 0, 2_700_000), (1, None, "", "", 1.0, 0, 0)], link)
    chunks = spark.createDataFrame([(1, 1, 0), (2, 2, 0), (3, 8, 0)], "chunk_id long, doc_id long, indexed_at long")
    refs = ["café notes", " CAF%C3%89%20NOTES.md#x|y", "/v/Café Notes.md", "b", "x-1|shown", "X-1#h", "x-1 (2)", "#only", "100%", None]
    pend = spark.createDataFrame([(i, r, "", "", 0, 0) for i, r in enumerate(refs)], "from_id long, target_ref string, category string, kind string, byte_offset long, created_at long")
    got = {(r.ref_table, r.owner_id, r.target) for r in orphans(links, chunks, pend, docs, tombs).collect()}
    assert got == {("doc_links", 1, "2"), ("doc_links", 1, "9"), ("doc_links", 1, None), ("chunks", 2, "2"), ("chunks", 3, "8"), ("doc_links_pending", 3, "b"), ("doc_links_pending", 6, "x-1 (2)"), ("doc_links_pending", 7, "#only"), ("doc_links_pending", 8, "100%"), ("doc_links_pending", 9, None)}
    counts = {(r.ref_table, r.month): (r.n_references, r.n_orphans) for r in orphan_counts(links, chunks, pend, docs, tombs).collect()}
    assert counts == {("doc_links", "1970-01"): (3, 2), ("doc_links", "1970-02"): (1, 1), ("chunks", "1970-01"): (3, 2), ("doc_links_pending", "1970-01"): (10, 5)}
    assert orphans(links.limit(0), chunks.limit(0), pend.limit(0), docs, tombs).isEmpty()
    assert orphans(links, chunks, pend, docs.limit(0), tombs.limit(0)).count() == 4 + 3 + 10


def test_heavy_keys_apart(spark):
    """Counts and rows are the same whatever counts as heavy: a dead and a live key of a third each, a null one, and many small ones."""
    from waymark.operators.references import OrphanSplit

    rows = [("t", i, "m1", "#1") for i in range(300)] + [("t", i, "m2", "#2") for i in range(300)] + [("u", i, "m1", "") for i in range(40)] + [("u", i, "m1", f"#{i}") for i in range(100)]
    refs = spark.createDataFrame(rows, "ref_table string, owner_id long, month string, key string")
    live = spark.createDataFrame([(f"#{i}",) for i in [*range(2, 50), 2]], "_live string")
    want = {r for r in rows if r[3] not in {f"#{i}" for i in range(2, 50)}}
    for share in (1.0, 0.3, 0.02, 1e-9):
        s = OrphanSplit(refs, live, share)
        assert {tuple(r) for r in s.rows().select(*refs.columns).collect()} == want and s.rows().count() == len(want)
        assert {tuple(r) for r in s.counts().collect()} == {("t", "m1", 300, 300), ("t", "m2", 300, 0), ("u", "m1", 140, sum(r[0] == "u" for r in want))}
    empty = OrphanSplit(refs.limit(0), live)
    assert empty.rows().isEmpty() and empty.counts().isEmpty() and OrphanSplit(refs, live.limit(0)).rows().count() == len(rows)
