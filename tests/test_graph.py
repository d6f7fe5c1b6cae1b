import pytest

from waymark.operators import graph
from waymark.operators.chunks import nest, next_ids, replace_chunks

SCHEMA = "from_id long, to_id long, category string, kind string, weight float, byte_offset long, created_at long"


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "reference", "ref:wikilink", 1.0, None, 0) for a, b in pairs], SCHEMA)


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "doc_id long")


def found(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_expand(spark):
    chain = edges(spark, (0, 1), (1, 2), (2, 3), (3, 0))
    assert found(graph.expand(chain, ids(spark, 0), 2)) == [0, 1, 2]
    assert found(graph.expand(chain, ids(spark, 0), None)) == [0, 1, 2, 3]
    assert found(graph.expand(chain, ids(spark, 0), 1, "incoming", include_seeds=False)) == [3]
    hub = edges(spark, *((0, i) for i in range(1, 11)))
    with pytest.raises(graph.ExpansionLimit):
        graph.expand(hub, ids(spark, 0), 1, max_nodes=3)
    assert found(graph.expand(hub, ids(spark, 0), 1, max_nodes=10, include_seeds=False)) == list(range(1, 11))
    assert found(graph.reachable(edges(spark, (0, 1), (1, 2), (0, 3)), 0)) == [1, 2, 3]


def test_paths(spark):
    e = edges(spark, (0, 1), (1, 2), (2, 3), (0, 3))
    assert graph.shortest_path(e, 0, 3) == [0, 3] and graph.shortest_path(e, 7, 7) == [7]
    with pytest.raises(graph.NoPath):
        graph.shortest_path(edges(spark), 0, 99)


def test_central(spark):
    star = edges(spark, (1, 0), (2, 0), (3, 0))
    ranks = graph.pagerank(star, 30).collect()
    assert max(ranks, key=lambda r: r.score).doc_id == 0 and abs(sum(r.score for r in ranks) - 1) < 1e-9
    assert tuple(graph.central(edges(spark, (1, 0), (2, 0), (3, 1)), "in", 1).first()) == (0, 2.0)
    assert graph.pagerank(edges(spark), 3).isEmpty()


def test_pagerank_production_run(spark, monkeypatch):
    from waymark.plans import index_queries

    pairs = [(i, i + 1) for i in range(12)] + [(i, i + 1) for i in range(20, 32)] + [(12, 0), (5, 0), (5, 0), (32, 5), (40, 41)]  # far from its limit after 5 iterations
    nodes = sorted({x for p in pairs for x in p})
    out = {x: [b for a, b in pairs if a == x] for x in nodes}
    score = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(100):
        loose = sum(score[x] for x in nodes if not out[x])
        got = dict.fromkeys(nodes, 0.0)
        for x in nodes:
            for y in out[x]:
                got[y] += score[x] / len(out[x])
        score = {x: 0.15 / len(nodes) + 0.85 * (got[x] + loose / len(nodes)) for x in nodes}
    e = edges(spark, *pairs)
    monkeypatch.setattr(index_queries, "_edges", lambda spark, d: e)
    ranks = {r.doc_id: r.score for r in index_queries.INDEX.queries["pagerank"](spark, "").collect()}
    assert ranks == pytest.approx(score, abs=1e-12)
    assert max(abs(r.score - score[r.doc_id]) for r in graph.pagerank(e, 5).collect()) > 1e-3
    top = index_queries.INDEX.queries["central_pagerank"](spark, "").collect()
    assert [r.doc_id for r in top] == sorted(nodes, key=lambda x: (-ranks[x], x))[:10]


def test_edges_and_filters(spark):
    rows = [(1, 2, "reference", "a", 1.0, None, 1), (1, 2, "reference", "a", 2.0, None, 5), (1, 2, "reference", "a", 2.0, None, 5), (1, 2, "workflow", "b", None, None, 1), (2, 2, "reference", "a", 1.0, None, 1), (None, 3, "reference", "a", 1.0, None, 1)]
    e = graph.distinct_edges(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.from_id, r.to_id, r.kind, r.weight) for r in e.collect()) == [(1, 2, "a", 2.0), (1, 2, "b", 1.0), (2, 2, "a", 1.0)]
    assert graph.neighbours(e, ids(spark, 2), "both").count() == 3  # the self-loop once
    assert graph.neighbours(e, ids(spark, 1), "out", graph.Kinds(())).isEmpty()
    assert graph.neighbours(e, ids(spark, 1), "out", graph.AnyOf((graph.Kinds(("b",)), graph.Category("provenance")))).count() == 1
    s = graph.stats(e).first()
    assert (s.edge_count, s.node_count, s.by_category) == (3, 2, {"reference": 2, "workflow": 1})
    assert graph.without_documents(e, ids(spark, 1)).count() == 1 and graph.restrict(e, ids(spark, 2)).count() == 1


def test_resolve(spark):
    pending = spark.createDataFrame([(1, "ProjectAlpha", "reference", "ref:wikilink", None, 5), (1, "ProjectAlpha", "reference", "ref:wikilink", None, 9), (1, "/v/B.md", "reference", "ref:wikilink", None, 1), (1, "nowhere", "reference", "ref:wikilink", None, 1)], "from_id long, target_ref string, category string, kind string, byte_offset long, created_at long")
    docs = spark.createDataFrame([(2, "/vault/ProjectAlpha.md"), (3, "/v/B.md"), (4, "/old/ProjectAlpha.md")], "doc_id long, file_path string")
    e, still = graph.resolve(pending, docs)
    assert sorted((r.from_id, r.to_id, r.created_at) for r in e.collect()) == [(1, 2, 5), (1, 3, 1)] and [r.target_ref for r in still.collect()] == ["nowhere"]


def test_nest_and_ids(spark):
    rows = [(1, 9, "frontmatter", 0, 0), (2, 9, "section", 10, 1), (3, 9, "section", 20, 2), (4, 9, "section", 30, 2), (5, 9, "section", 40, 1), (6, 9, "section", 50, 3), (6, 9, "section", 50, 3), (7, 9, "body", 60, 2), (8, 9, "section", 70, 3), (1, 8, "class", 0, 0), (2, 8, "method", 5, 1)]
    c = spark.createDataFrame(rows, "chunk_id long, doc_id long, kind string, byte_start long, depth int")
    got = {(r.doc_id, r.chunk_id): (r.parent_chunk_id, r.level) for r in nest(c).collect()}
    assert got == {(9, 1): (None, 0), (9, 2): (None, 0), (9, 3): (2, 1), (9, 4): (2, 1), (9, 5): (None, 0), (9, 6): (5, 1), (9, 7): (5, 1), (9, 8): (5, 1), (8, 1): (None, 0), (8, 2): (1, 1)}
    assert nest(c.limit(0)).isEmpty()
    old = spark.createDataFrame([(4, 1, 0), (7, 2, 0)], "chunk_id long, doc_id long, byte_start long")
    new = spark.createDataFrame([(2, 50), (2, 0), (3, 0)], "doc_id long, byte_start long")
    assert [r.chunk_id for r in next_ids(new, old, "chunk_id", ["doc_id", "byte_start"]).orderBy("doc_id", "byte_start").collect()] == [8, 9, 10]
    assert sorted(map(tuple, replace_chunks(old, new).collect())) == [(4, 1, 0), (8, 2, 0), (9, 2, 50), (10, 3, 0)]
