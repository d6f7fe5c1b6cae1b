import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.engine import Engine
from waymark.operators import ingest, vectors
from waymark.sources import remote


def test_lifecycle(spark, tmp_path):
    vault = tmp_path / "vault"
    vault.mkdir()
    (vault / "node_modules").mkdir()
    (vault / "node_modules/x.md").write_text("no")
    (vault / "a.md").write_text("---\ntags: [work]\n---\n# A\nsee [[b]] and [[missing]] #alpha\n")
    (vault / "b.md").write_text("# B\ntext #work\n## Sub\nmore\n")
    (vault / "skip.log").write_text("x")
    (vault / "c.py").write_text("import os\ndef f():\n    pass\n")
    e = Engine(spark, str(tmp_path / "index"))
    assert tuple(e.index(str(vault), 100).first()) == (3, 0, 0, 0)
    assert tuple(e.index(str(vault), 101).first()) == (0, 0, 3, 0)
    got = e.search("tag:work").collect()
    assert [r.file_path.rsplit("/", 1)[1] for r in sorted(got, key=lambda r: r.doc_id)] == ["a.md", "b.md"] and got[0].total_matching == 2
    a, b, c = (e.tables.documents.where(F.col("file_path").endswith(x)).first().doc_id for x in ("a.md", "b.md", "c.py"))
    assert [(r.from_id, r.to_id) for r in e.tables.edges.collect()] == [(a, b)] and sorted(r.target_ref for r in e.tables.pending.collect()) == ["missing", "os"]
    assert e.tables.vectors.count() == e.tables.chunks.count() == 5
    assert {r.chunk_id for r in e.semantic("more", "tag:work", 3).collect()} <= {r.chunk_id for r in e.tables.chunks.collect()} and e.semantic("x", "tag:none").isEmpty()
    (vault / "a.md").write_text("# A\nnow #beta\n")
    (vault / "c.py").unlink()
    (vault / "missing.md").write_text("here\n")
    assert tuple(e.index(str(vault), 102).first()) == (1, 1, 1, 1)
    assert e.match("tag:alpha").isEmpty() and [r[0] for r in e.match("tag:beta").collect()] == [a] and e.match("lang:python").isEmpty() and e.tables.edges.isEmpty()
    assert e.status().first().total_documents == 3 and e.filters("tag").count() == 2
    e.compact()
    assert e.tables.tombstones.isEmpty() and e.tables.documents.count() == 3 and e.tables.chunks.where(F.col("doc_id") == c).isEmpty() and e.tables.vectors.count() == e.tables.chunks.count()
    (vault / "c.py").write_text("x = 1\n")
    assert tuple(e.index(str(vault), 103).first()) == (1, 0, 3, 0)
    assert e.index(str(vault), 104, kinds=["markdown"]).first().tombstoned == 0  # code isn't taken for deleted
    with pytest.raises(ValueError):
        e.semantic("x", rerank=True)


def test_recreated_after_tombstone(spark):
    reg = spark.createDataFrame([(1, "/a", b"x"), (2, "/b", b"y"), (3, "/r/c", b"z"), (4, "/rx/d", b"z")], "doc_id long, file_path string, blake3_hash binary")
    snap = spark.createDataFrame([("/a", b"x"), ("/b", b"q"), ("/n", b"1"), ("/n", b"1"), ("/u", None), (None, b"1")], "file_path string, content_hash binary")
    got = {r.file_path: r.action for r in ingest.snapshot_actions(snap, reg, None, spark.createDataFrame([(1,)], "doc_id long")).collect()}
    assert got == {"/a": "updated", "/b": "updated", "/n": "indexed", "/u": "unread", "/r/c": "tombstoned", "/rx/d": "tombstoned"}
    assert {r.file_path for r in ingest.snapshot_actions(snap, reg, "/r").collect() if r.action == "tombstoned"} == {"/r/c"}


def test_events(spark):
    reg = spark.createDataFrame([(1, "/a", b"x"), (2, "/b", b"y"), (3, "/old", b"z")], "doc_id long, file_path string, blake3_hash binary")
    ev = spark.createDataFrame([(1, "/a", "Modified", None, b"q"), (2, "/a", "Modified", None, b"x"), (3, "/b", "Deleted", None, None), (4, "/n", "Created", None, b"1"), (5, "/new", "Renamed", "/old", b"z"), (6, "/zz", "Deleted", None, None), (7, "/.git/x", "Created", None, b"1")], "seq long, path string, kind string, from_path string, content_hash binary")
    got = {r.path: (r.action, r.doc_id) for r in ingest.event_actions(ev, reg).collect()}
    assert got == {"/a": ("skipped", 1), "/b": ("tombstoned", 2), "/n": ("indexed", None), "/new": ("renamed", 3), "/old": ("moved_away", 3), "/zz": ("ignored", None), "/.git/x": ("skipped", None)}
    keys = spark.createDataFrame([(3, "folder:/"), (3, "tag:a")], "doc_id long, bitmap_key string")
    assert sorted(r.bitmap_key for r in ingest.renamed_keys(keys, spark.createDataFrame([(3, "/q/new")], "doc_id long, path string")).collect()) == ["folder:/q", "tag:a"]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "id long, embedding array<float>")
    assert [tuple(r) for r in vectors.nearest(v, [1.0, 0.0], 3).collect()] == [(1, 1.0), (3, 1.0), (6, 1.0)]
    assert [r.id for r in vectors.nearest(v, [1.0, 0.0], 3, spark.createDataFrame([(2,), (5,)], "id long")).collect()] == [2, 5]
    assert vectors.nearest_for_all(v, v.limit(0)).isEmpty() and vectors.nearest(v.limit(0), [1.0], 3).isEmpty()
    assert {(r.query_id, r.id) for r in vectors.nearest_for_all(v, v.where("id < 3"), 1, block=1).collect()} == {(1, 3), (2, 1)}
    new = vectors.upsert(v, spark.createDataFrame([(1, [0.5, 0.5]), (9, [1.0, 1.0])], "id long, embedding array<float>"))
    assert new.count() == 7 and new.where("id = 1").first().embedding == [0.5, 0.5] and vectors.delete(new, spark.createDataFrame([(9,)], "id long")).count() == 6
    texts = spark.createDataFrame([(1, "long text"), (2, None), (3, "x")], "id long, text string")
    assert [r.id for r in vectors.rerank(spark.createDataFrame([(1, 0.1), (2, 0.9), (3, 0.5)], "id long, score double"), texts, "q", lambda q, ts: [float(len(t)) for t in ts]).collect()] == [1, 3]
    e = vectors.embed_texts(texts, lambda ts: np.array([[np.sin(len(t)), np.cos(len(t))] for t in ts]))
    assert sorted(r.id for r in e.collect()) == [1, 3]


PAGES = {
    "/rest/api/content?spaceKey=OPS&limit=50&expand=version,body.storage,metadata.labels,ancestors": {"results": [{"id": 1, "title": "P", "version": {"when": "2024-01-01T00:00:00Z"}}], "_links": {"next": "/next"}},
    "/next": {"results": [{"id": 2, "title": "Q", "status": "trashed", "version": {"when": "2024-06-01T00:00:00+02:00"}}], "_links": {}},
    "/api/conversations.history?channel=C1&oldest=0&limit=200&cursor=": {"channel_name": "ops", "messages": [{"ts": "90000.5", "text": "b"}, {"ts": "5", "text": "a"}], "response_metadata": {"next_cursor": "n"}},
    "/api/conversations.history?channel=C1&oldest=0&limit=200&cursor=n": {"messages": [{"ts": "90001", "text": "c"}]},
}


def test_remote(spark, tmp_path):
    pages = dict(PAGES)

    def recorded(path):
        if "/search" in path:
            return {"total": 2, "issues": [{"key": "K-1" if "startAt=0" in path else "K-2", "fields": {"summary": "s", "updated": "2024-01-01T00:00:00.000+0000"}}]}
        return pages[path]

    w = {r.id: r for r in remote.poll(spark, recorded, "confluence", "wiki", ["OPS"]).collect()}
    assert w["1"].updated_at == 1704067200 and w["2"].deleted and w["2"].updated_at == 1717192800 and w["1"].synthetic_path == "confluence://OPS/1.confluence"
    assert sorted(r.id for r in remote.poll(spark, recorded, "jira", "issues", ["K"]).collect()) == ["K-1", "K-2"]
    c = {r.id: r for r in remote.poll(spark, recorded, "slack", "chat", ["C1"]).collect()}
    got = []
    assert remote.poll_once(spark, recorded, "slack", "chat", ["C1"], 0, 500, got.append) == (2, 500) and remote.poll_once(spark, recorded, "confluence", "wiki", ["NOPE"], 7, 500, got.append) == (0, 7) and len(got) == 1
    e = Engine(spark, str(tmp_path / "index"))
    files = remote.item_files(got[0])
    assert tuple(e.sync(files, 500, snapshot=False).first()) == (2, 0, 0, 0) and e.match("slack:channel:ops").count() == 2
    one = files.where(F.col("file_path").endswith("01.slack"))
    assert tuple(e.sync(one.limit(0), 501, snapshot=False).first()) == (0, 0, 0, 0) and tuple(e.sync(one.limit(0), 502, snapshot=False, deleted=one).first()) == (0, 0, 0, 1) and e.match("slack:channel:ops").count() == 1
    assert set(c) == {"C1-1970-01-01", "C1-1970-01-02"} and c["C1-1970-01-02"].updated_at == 90001 and c["C1-1970-01-01"].title == "#ops — 1970-01-01"


def test_registry(spark):
    from waymark.operators import registry as r

    docs = spark.createDataFrame([(4, "/a", "x"), (7, "/b", "y")], "doc_id long, file_path string, auto_type string")
    more = r.insert_documents(docs, spark.createDataFrame([("/d", "q"), ("/c", None)], "file_path string, auto_type string"))
    assert sorted(map(tuple, more.collect())) == [(4, "/a", "x"), (7, "/b", "y"), (8, "/c", None), (9, "/d", "q")]
    for bad in ([("/a", "")], [("/z", ""), ("/z", "")]):
        with pytest.raises(r.DuplicatePath):
            r.insert_documents(docs, spark.createDataFrame(bad, "file_path string, auto_type string"))
    assert sorted(map(tuple, r.update_documents(docs, spark.createDataFrame([(4, None), (7, "n")], "doc_id long, auto_type string")).collect())) == [(4, "/a", "x"), (7, "/b", "n")]
    with pytest.raises(r.NotFound):
        r.update_documents(docs, spark.createDataFrame([(5, "n")], "doc_id long, auto_type string"))
    assert r.move_documents(docs, spark.createDataFrame([(4, "/q")], "doc_id long, file_path string")).where("doc_id = 4").first().file_path == "/q"
    with pytest.raises(r.DuplicatePath):
        r.move_documents(docs, spark.createDataFrame([(4, "/b")], "doc_id long, file_path string"))
    assert r.delete_documents(spark.createDataFrame([(4,), (4,)], "doc_id long"), documents=docs)["documents"].count() == 1
    keys = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "doc_id long, bitmap_key string")
    ids = spark.createDataFrame([(1,), (3,), (3,)], "doc_id long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(r.set_keys(keys, spark.createDataFrame([(1, "c"), (1, "c")], "doc_id long, bitmap_key string"))) == [(1, "c"), (2, "a")]
    assert rows(r.put_key(keys, "a", ids)) == [(1, "a"), (1, "b"), (3, "a")] and rows(r.put_key(keys, "a", ids.limit(0))) == [(1, "b")]
    assert rows(r.add_to_key(keys, "a", ids)) == [(1, "a"), (1, "b"), (2, "a"), (3, "a")] and rows(r.remove_from_key(keys, "a", ids)) == [(1, "b"), (2, "a")]
    pend = spark.createDataFrame([(1, "t", "k", "c", None, 5)], "from_id long, target_ref string, kind string, category string, byte_offset long, created_at long")
    assert sorted((x.target_ref, x.created_at) for x in r.insert_pending(pend, spark.createDataFrame([(1, "t", "k", "c", None, 9), (1, "u", "k", "c", None, 9), (1, "u", "k", "c", None, 7)], pend.schema)).collect()) == [("t", 5), ("u", 7)]
    cache = spark.createDataFrame([("/a", b"1", "h", ["t"])], "file_path string, content_hash binary, config_hash string, tags array<string>")
    hit, miss = r.cached_tags(spark.createDataFrame([(1, "/a", b"1"), (2, "/b", b"1")], "doc_id long, file_path string, content_hash binary"), cache, F.lit("h"))
    assert [x.doc_id for x in hit.collect()] == [1] and [x.doc_id for x in miss.collect()] == [2]


def test_rank_within(spark):
    from waymark.operators.registry import rank_within

    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("k"), (F.col("id") * 7919 % 3001).alias("o"), F.lit(None).cast("string").alias("x"))
    got = rank_within(df, ["k"], ["o"], "place")
    from pyspark.sql import Window

    want = df.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("o")))
    assert sorted(map(tuple, got.select("k", "o", "place").collect())) == sorted(map(tuple, want.select("k", "o", "place").collect()))
    assert rank_within(df.withColumn("k", F.lit(None).cast("string")), ["k"], ["o"], "place").agg(F.max("place")).first()[0] == 3000 and rank_within(df.limit(0), ["k"], ["o"], "place").isEmpty()


def test_broken_run(spark, tmp_path, monkeypatch):
    from waymark.operators.manifest import ManifestTable
    from waymark.runtime import Files

    vault = tmp_path / "vault"
    vault.mkdir()
    for n in "abc":
        (vault / f"{n}.md").write_text(f"# {n}\n[[a]] #tag-{n}\n")
    e = Engine(spark, str(tmp_path / "index"))
    for where, name, when in ((Files, "write_once", 1), (ManifestTable, "stage", 5)):  # at the manifest, and between the tables
        own, calls = getattr(where, name), []

        def fails(self, *args, own=own, calls=calls, when=when):
            calls.append(args)
            if len(calls) == when:
                raise OSError("lost")
            return own(self, *args)

        monkeypatch.setattr(where, name, fails)
        with pytest.raises(OSError):
            e.index(str(vault), 1)
        monkeypatch.setattr(where, name, own)
        assert e.tables.documents.isEmpty() and e.tables.chunks.isEmpty() and e.tables.doc_keys.isEmpty()
    assert tuple(e.index(str(vault), 2).first()) == (3, 0, 0, 0)
    assert e.tables.documents.count() == 3 and e.tables.chunks.count() == 3 and e.tables.edges.count() == 3 and e.tables.vectors.count() == 3 and e.filters("tag").count() == 3


def test_a_reader_sees_one_version(spark, tmp_path):
    vault = tmp_path / "vault"
    vault.mkdir()
    for n in "abc":
        (vault / f"{n}.md").write_text(f"# {n}\n[[a]] #old\n")
    e = Engine(spark, str(tmp_path / "index"))
    e.index(str(vault), 1)
    reader = e.at(e.tables)
    before = reader.tables.stored.read("documents/data", reader.tables.version)
    (vault / "a.md").write_text("# a\n#new\n")
    e.index(str(vault), 2)  # a commit between reading the rows and their deletes
    assert before.count() == 3 and reader.tables.documents.count() == 3 and reader.match("tag:old").count() == 3 and reader.match("tag:new").isEmpty()
    assert e.match("tag:old").count() == 2 and e.match("tag:new").count() == 1
    late = e.at(e.tables)
    e.compact()
    from waymark.operators.manifest import ConcurrentCommit

    with pytest.raises(ConcurrentCommit):  # of two writers from one version the second is refused, and nothing of it is seen
        late.tables.change(tombstones=(spark.createDataFrame([(1, 5)], "doc_id long, tombstoned_at long"), None))
    assert e.tables.tombstones.isEmpty()


def test_sources_and_enrichment(spark, tmp_path):
    from waymark.functions.keys import RuleTagger

    issue = b'{"key": "K-1", "fields": {"summary": "S", "status": {"name": "Open"}, "issuetype": {"name": "Bug"}, "project": {"key": "K"}}}'
    rows = [("jira://K/K-1.jira", issue, "issue"), ("/v/a.md", b"# A\nx\n", "markdown"), ("/v/b.py", b"x = 1\n", "code"), ("slack://c/2024-01-01.slack", b'{"channel_name": "c", "date": "2024-01-01", "messages": [{"ts": "1", "user": "U", "text": "hi"}]}', "chat")]
    files = spark.createDataFrame(rows, "file_path string, content binary, parser string").withColumn("content_hash", ingest.content_hash(F.col("content")))
    e = Engine(spark, str(tmp_path / "index"), rules=[RuleTagger.load({"name": "r", "rules": [{"match": {"folder": "/v"}, "add_tags": ["place:vault"]}]})])
    e.sync(files, 1)
    assert {r.file_path: r.source_type for r in e.tables.documents.collect()} == {"jira://K/K-1.jira": "jira", "/v/a.md": "obsidian", "/v/b.py": "code", "slack://c/2024-01-01.slack": "slack"}
    assert {r.bitmap_key: r.cardinality for r in e.filters("source").collect()} == {"source:jira": 1, "source:obsidian": 1, "source:code": 1, "source:slack": 1}
    assert e.match("place:vault").count() == 2 and e.match("complexity:low").count() == 4
    unread = files.where("parser <> 'code'").select("file_path").union(spark.createDataFrame([("/v/b.py",), ("/v/new.py",)], "file_path string"))
    assert tuple(e.sync(files.where("parser <> 'code'"), 2, listing=unread).first()) == (0, 0, 4, 0)  # an unread file isn't a deleted one


def test_no_walk_goes_through_the_dead(spark):
    docs = spark.createDataFrame([(i, f"/{i}") for i in range(1, 5)], "doc_id long, file_path string").selectExpr("doc_id", "file_path", "'x' AS source_type")
    edges = spark.createDataFrame([(a, b, "reference", "ref:link", 1.0, 0, 0) for a, b in ((1, 2), (2, 3), (1, 4))], "from_id long, to_id long, category string, kind string, weight float, byte_offset long, created_at long")
    e = Engine(spark, documents=docs, edges=edges, tombstones=spark.createDataFrame([(2, 1)], "doc_id long, tombstoned_at long"))
    seed = spark.createDataFrame([(1,)], "doc_id long")
    assert {r.doc_id for r in e.expand(seed, 2).collect()} == {1, 4} and {r.doc_id for r in e.reachable(1).collect()} == {4} and [r.doc_id for r in e.neighbours(seed).collect()] == [4]
    assert e.graph_stats().first().edge_count == 1 and [r.doc_id for r in e.central("indegree").collect()] == [4]
    from waymark.operators.graph import NoPath

    with pytest.raises(NoPath):
        e.shortest_path(1, 3)


def test_process(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "index"))
    event = "seq long, path string, kind string, from_path string, content binary"
    first = e.process(spark.createDataFrame([(1, "/v/in/a.md", "Created", None, b"# A\n#one\n"), (2, "/v/b.md", "Created", None, b"# B\n"), (3, "/v/.git/c.md", "Created", None, b"x")], event), 1)
    assert sorted((r.path, r.action) for r in first.collect()) == [("/v/.git/c.md", "skipped"), ("/v/b.md", "indexed"), ("/v/in/a.md", "indexed")]
    a = e.inspect("/v/in/a.md").first().doc_id
    got = e.process(spark.createDataFrame([(4, "/v/t.md", "Renamed", "/v/in/a.md", None), (5, "/v/out/test_a.md", "Renamed", "/v/t.md", None), (6, "/v/b.md", "Deleted", None, None)], event), 2)
    assert {(r.path, r.action, r.doc_id) for r in got.collect() if r.action in ("renamed", "tombstoned")} >= {("/v/out/test_a.md", "renamed", a)} and e.inspect("/v/in/a.md").isEmpty()
    moved = e.inspect("/v/out/test_a.md").first()
    assert moved.doc_id == a and {"folder:/v/out", "convention:test", "tag:one"} <= set(moved["keys"]) and "folder:/v/in" not in moved["keys"] and e.status().first().total_documents == 1
    again = e.process(spark.createDataFrame([(7, "/v/b.md", "Created", None, b"# B\n"), (8, "/v/out/test_a.md", "Modified", None, b"# A\n#one\n")], event), 3)
    assert {r.path: r.action for r in again.collect()} == {"/v/b.md": "updated", "/v/out/test_a.md": "skipped"} and e.status().first().total_documents == 2


@pytest.mark.parametrize("n", [400, 6_000])
def test_cell_index_recall(spark, n):
    rng = np.random.RandomState(n)
    centres = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(size=16) * 0.7]) for i in range(n)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    index, q = vectors.CellIndex(v), v.where("id % 10 = 0")
    assert len(index.centres) == max(vectors.CELLS, int(n**0.5)) and index.probes < len(index.centres)
    for some in (None, v.where("id % 3 = 1")):
        exact = {(r.query_id, r.id) for r in vectors.nearest_for_all(v, q, 5, candidates=some).collect()}
        found = [(r.query_id, r.id) for r in index.search(q, 5, candidates=some).collect()]
        assert len(found) == len(set(found)) and len(set(found) & exact) >= 0.9 * len(exact) and (some is None or all(i % 3 == 1 for _, i in found))


def test_poll_due(spark, tmp_path):
    pages, broken = dict(PAGES), []

    def recorded(path):
        if "NOPE" in path and broken:
            raise OSError("down")
        return pages.get(path, {"results": [], "_links": {}, "messages": []})

    sources = spark.createDataFrame([("wiki", "confluence", ["OPS"], 60), ("bad", "confluence", ["NOPE"], 60)], "name string, kind string, scopes array<string>, poll_interval_secs long")
    got, state = [], str(tmp_path / "polls")
    broken.append(1)
    run = lambda now: {r.name: (r["items"], r.last_poll) for r in remote.poll_due(spark, recorded, sources, state, now, got.append).collect()}
    assert run(100) == {"wiki": (2, 100), "bad": (0, 0)} and len(got) == 1
    assert run(130) == {"bad": (0, 0)}  # wiki isn't due, the failed one is
    broken.clear()
    assert run(150) == {"bad": (0, 150)} and run(155).keys() == set() and run(165).keys() == {"wiki"}


def test_look_and_watch(spark, tmp_path):
    import time

    from waymark.streaming.feeds import look, watch

    vault, state, seen = tmp_path / "vault", str(tmp_path / "state"), []
    vault.mkdir()
    (vault / ".gitignore").write_text("skip*\n")
    for n in ("a", "b", "skip"):
        (vault / f"{n}.md").write_text(n)
    handle = lambda events: seen.append(sorted((r.path.rsplit("/", 1)[1], r.kind) for r in events.collect()))
    assert look(spark, str(vault), state, handle) == 2 and look(spark, str(vault), state, handle) == 0 and seen == [[("a.md", "created"), ("b.md", "created")]]
    (vault / "a.md").write_text("other")
    (vault / "b.md").unlink()

    def fails(events):
        raise OSError("handler")

    with pytest.raises(OSError):
        look(spark, str(vault), state, fails)
    q = watch(spark, str(vault), state, str(tmp_path / "clock"), handle, 1)
    for _ in range(60):
        if len(seen) > 1:
            break
        time.sleep(0.5)
    q.stop()
    assert seen[1] == [("a.md", "modified"), ("b.md", "deleted")]  # what the failed handler was shown comes again
