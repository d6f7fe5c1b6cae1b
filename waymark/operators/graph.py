"""The typed link graph: neighbours, expansion, paths, centrality, link resolution.

Edges are rows (from_id, to_id, category, kind, weight, byte_offset, created_at). The
walks are loops of frontier joins whose state is cut by checkpoint after every hop; a
frontier is never collected.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import file_stem
from waymark.operators.incremental import newest_per_key
from waymark.runtime import cut

#: Categories, and the kind of edge that a source's links become.
CATEGORIES = ("reference", "dependency", "hierarchy", "workflow", "provenance")
DIRECTIONS = {"outgoing": "outgoing", "out": "outgoing", "incoming": "incoming", "in": "incoming", "both": "both"}


class ExpansionLimit(RuntimeError):
    """An expansion found more documents than allowed."""


class NoPath(RuntimeError):
    """No path leads from one document to the other."""


@dataclass(frozen=True)
class AnyEdge:
    def column(self) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Category:
    name: str

    def column(self) -> Column:
        return F.col("category") == self.name


@dataclass(frozen=True)
class Kinds:
    names: tuple[str, ...]

    def column(self) -> Column:
        return F.col("kind").isin(*self.names) if self.names else F.lit(False)


@dataclass(frozen=True)
class AllOf:
    parts: tuple

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (p.column() for p in self.parts), F.lit(True))


@dataclass(frozen=True)
class AnyOf:
    parts: tuple

    def column(self) -> Column:
        return reduce(lambda a, b: a | b, (p.column() for p in self.parts), F.lit(False))


def distinct_edges(links: DataFrame) -> DataFrame:
    """One edge per (from_id, to_id, kind): the one created last; a null weight is 1."""
    e = newest_per_key(links, ["from_id", "to_id", "kind"], [F.col("created_at")], ["category", "weight", "byte_offset", "created_at"])
    return e.withColumn("weight", F.coalesce("weight", F.lit(1.0).cast("float")))


def _directed(edges: DataFrame, direction: str) -> DataFrame:
    """(at, other, category, kind, weight, byte_offset) in walking direction; both gives a self-loop once."""
    direction = DIRECTIONS[direction]
    rest = ["category", "kind", "weight", "byte_offset"]
    out = edges.select(F.col("from_id").alias("at"), F.col("to_id").alias("other"), *rest)
    back = edges.select(F.col("to_id").alias("at"), F.col("from_id").alias("other"), *rest)
    return out if direction == "outgoing" else back if direction == "incoming" else out.unionByName(back.where("at <> other"))


def _step(edges: DataFrame, direction: str, where) -> DataFrame:
    return _directed(edges.where(where.column()), direction).select("at", "other")


def neighbours(edges: DataFrame, seeds: DataFrame, direction: str = "outgoing", where=AnyEdge()) -> DataFrame:  # noqa: B008
    """A row per edge at any seed (doc_id): seed, doc_id of the other end, category, kind, weight, hop_distance 1."""
    d = _directed(edges.where(where.column()), direction)
    s = seeds.select(F.col("doc_id").alias("at")).distinct()
    return d.join(s, "at", "left_semi").select(F.col("at").alias("seed"), F.col("other").alias("doc_id"), "category", "kind", "weight", F.lit(1).alias("hop_distance"))


def incident(edges: DataFrame, doc_id: int) -> DataFrame:
    return edges.where((F.col("from_id") == doc_id) | (F.col("to_id") == doc_id))


def restrict(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (doc_id)."""
    n = nodes.select("doc_id").distinct()
    return edges.join(n.select(F.col("doc_id").alias("from_id")), "from_id", "left_semi").join(n.select(F.col("doc_id").alias("to_id")), "to_id", "left_semi")


def expand(edges: DataFrame, seeds: DataFrame, hops: int | None = 1, direction: str = "outgoing", where=AnyEdge(), max_nodes: int | None = None, include_seeds: bool = True) -> DataFrame:  # noqa: B008
    """doc_id, hop_distance of everything within ``hops`` of the seeds, each once at its least distance.

    ``hops`` None goes on until nothing new is found. More than ``max_nodes`` results
    raise ExpansionLimit. A hop joins the frontier with the edges and drops what was
    seen; cycles end there.
    """
    step = _step(edges, direction, where)
    seen = cut(seeds.select("doc_id").distinct().withColumn("hop_distance", F.lit(0)))
    frontier, hop = seen, 0
    while hops is None or hop < hops:
        hop += 1
        new = step.join(frontier.select(F.col("doc_id").alias("at")), "at", "left_semi").select(F.col("other").alias("doc_id")).distinct()
        frontier = cut(new.join(seen.select("doc_id"), "doc_id", "left_anti").withColumn("hop_distance", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
        if max_nodes is not None and seen.where("hop_distance > 0 OR " + str(include_seeds).lower()).count() > max_nodes:
            raise ExpansionLimit(f"more than {max_nodes} documents")
    out = seen if include_seeds else seen.where("hop_distance > 0")
    if max_nodes is not None and hop == 0 and out.count() > max_nodes:
        raise ExpansionLimit(f"more than {max_nodes} documents")
    return out


def reachable(edges: DataFrame, seed: int, direction: str = "outgoing", where=AnyEdge()) -> DataFrame:  # noqa: B008
    """Everything that can be reached from the seed, which isn't part of it."""
    start = edges.sparkSession.createDataFrame([(seed,)], "doc_id long")
    return expand(edges, start, None, direction, where, include_seeds=False)


def shortest_path(edges: DataFrame, start: int, end: int, where=AnyEdge()) -> list[int]:  # noqa: B008
    """The documents of a shortest outgoing path; of equal ones that of the smallest predecessors. Raises NoPath."""
    if start == end:
        return [start]
    spark, step = edges.sparkSession, _step(edges, "outgoing", where)
    seen = cut(spark.createDataFrame([(start, None, 0)], "doc_id long, parent long, hop int"))
    frontier = seen
    for hop in itertools.count(1):
        new = step.join(frontier.select(F.col("doc_id").alias("at")), "at").groupBy(F.col("other").alias("doc_id")).agg(F.min("at").alias("parent"))
        frontier = cut(new.join(seen.select("doc_id"), "doc_id", "left_anti").select("doc_id", "parent", F.lit(hop).alias("hop")))
        if frontier.isEmpty():
            raise NoPath(f"{start} -> {end}")
        seen = cut(seen.unionByName(frontier))
        if not frontier.where(F.col("doc_id") == end).isEmpty():
            break
    path = [end]
    while path[-1] != start:  # one row per hop
        path.append(seen.where(F.col("doc_id") == path[-1]).select("parent").first()[0])
    return path[::-1]


def degrees(edges: DataFrame, side: str = "in") -> DataFrame:
    """doc_id, score: edges at each node, parallel kinds apart; nodes without any are absent."""
    c = "to_id" if side == "in" else "from_id"
    return edges.groupBy(F.col(c).alias("doc_id")).agg(F.count("*").cast("double").alias("score"))


def pagerank(edges: DataFrame, iterations: int = 100, damping: float = 0.85, weighted: bool = False, cut_every: int = 1) -> DataFrame:
    """doc_id, score after a fixed number of iterations; scores sum to 1.

    The mass of nodes without outgoing edges is spread evenly, as is the rest of the
    damping. Edges are aggregated to one share per pair first and stay partitioned.
    A step reads the scores before it twice, so every step left uncut doubles the plan.
    """
    w = F.sum(F.col("weight").cast("double")) if weighted else F.count("*").cast("double")
    pairs = edges.groupBy("from_id", "to_id").agg(w.alias("w"))
    out_w = pairs.groupBy("from_id").agg(F.sum("w").alias("_all"))
    share = cut(pairs.join(out_w, "from_id").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), (F.col("w") / F.col("_all")).alias("share")))
    nodes = cut(share.select(F.col("src").alias("doc_id")).union(share.select("dst")).distinct().join(share.select(F.col("src").alias("doc_id")).distinct().withColumn("_out", F.lit(True)), "doc_id", "left"))
    n = nodes.count()
    if not n:
        return edges.sparkSession.createDataFrame([], "doc_id long, score double")
    rank = nodes.select("doc_id", "_out", F.lit(1.0 / n).alias("score"))
    for i in range(iterations):
        got = share.join(rank.select(F.col("doc_id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("doc_id")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        loose = rank.where("_out IS NULL").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("loose")).scalar()
        rank = nodes.join(got, "doc_id", "left").select("doc_id", "_out", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + loose / n)).alias("score"))
        if (i + 1) % cut_every == 0:
            rank = cut(rank)
    return rank.select("doc_id", "score")


def central(edges: DataFrame, algorithm: str = "pagerank", limit: int | None = 10, nodes: DataFrame | None = None, iterations: int = 100) -> DataFrame:
    """doc_id, score by "pagerank", "indegree" or "outdegree", highest first, within ``nodes`` if given."""
    e = edges if nodes is None else restrict(edges, nodes)
    kinds = {"pagerank": "pagerank", "pr": "pagerank", "indegree": "in", "in": "in", "outdegree": "out", "out": "out"}
    how = kinds[algorithm]
    scores = pagerank(e, iterations) if how == "pagerank" else degrees(e, how)
    ranked = scores.orderBy(F.desc("score"), "doc_id")
    return ranked if limit is None else ranked.limit(limit)


def stats(edges: DataFrame) -> DataFrame:
    """One row: edge_count, node_count and edges by category (a map)."""
    nodes = edges.select(F.col("from_id").alias("doc_id")).union(edges.select("to_id")).agg(F.count_distinct("doc_id")).scalar()
    by = edges.groupBy("category").agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edge_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category")).select("edge_count", nodes.alias("node_count"), "by_category")


def edge_kind(source: Column) -> tuple[Column, Column]:
    """(category, kind) of a source's links: imports of code, wikilinks of notes, plain references otherwise."""
    return (
        F.when(source == "code", "dependency").otherwise("reference"),
        F.when(source == "code", "dep:import").when(source == "obsidian", "ref:wikilink").otherwise("ref:link"),
    )


def resolve(pending: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, still pending): targets equal to a document's path, else to its stem, case counting.

    A stem that several documents share leads to the smallest doc_id. Of repeated pending
    rows (from_id, target_ref, kind) the first created counts. Resolved edges weigh 1.
    """
    first = newest_per_key(pending, ["from_id", "target_ref", "kind"], [-F.col("created_at")], ["category", "byte_offset", "created_at"])
    paths = documents.groupBy(F.col("file_path").alias("_path")).agg(F.min("doc_id").alias("_by_path"))
    stems = documents.groupBy(file_stem(F.col("file_path")).alias("_stem")).agg(F.min("doc_id").alias("_by_stem"))
    joined = first.join(paths, first.target_ref == paths._path, "left").join(stems, first.target_ref == stems._stem, "left").withColumn("to_id", F.coalesce("_by_path", "_by_stem"))
    edges = joined.where("to_id IS NOT NULL").select("from_id", "to_id", "category", "kind", F.lit(1.0).cast("float").alias("weight"), "byte_offset", "created_at")
    return edges, joined.where("to_id IS NULL").select("from_id", "target_ref", "category", "kind", "byte_offset", "created_at")


def replace_outgoing(edges: DataFrame, sources: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Edges with all outgoing ones of ``sources`` (doc_id) replaced by ``new_edges``."""
    kept = edges.join(sources.select(F.col("doc_id").alias("from_id")).distinct(), "from_id", "left_anti")
    return distinct_edges(kept.unionByName(new_edges))


def without_documents(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges at none of the documents of ``gone``, in either direction."""
    g = gone.select("doc_id").distinct()
    return edges.join(g.select(F.col("doc_id").alias("from_id")), "from_id", "left_anti").join(g.select(F.col("doc_id").alias("to_id")), "to_id", "left_anti")
