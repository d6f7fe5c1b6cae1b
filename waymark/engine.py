"""One object for the whole index: search, semantic search, inspection, graph queries and upkeep.

An index is a folder with one manifest for all its tables: documents, chunks, doc_keys,
edges, pending, tombstones and vectors. Reading methods return DataFrames, all of one
version. Writing methods append what changed, with deletes of the documents it replaces,
and publish the new version of all tables by one rename: a run costs what changed, not
what there is, and a run that breaks off has done nothing. ``compact`` rewrites.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.keys import RuleTagger
from waymark.operators import chunks as chunk_ops
from waymark.operators import filters, graph, ingest, vectors
from waymark.operators.manifest import ManifestTable
from waymark.plans.filter_dsl import Filter, from_list, leaf_keys, parse_filter
from waymark.runtime import cut
from waymark.sources import files as file_source
from waymark.sources.parsers import Parser, chunk_rows, keys_of, link_rows, parse_files

SCHEMAS = {
    "documents": "doc_id long, file_path string, source_type string, auto_type string, blake3_hash binary, last_indexed long, text string",
    "chunks": "chunk_id long, doc_id long, kind string, byte_start long, byte_end long, label string, depth int, signature string, language string, visibility string",
    "doc_keys": "doc_id long, bitmap_key string",
    "edges": "from_id long, to_id long, category string, kind string, weight float, byte_offset long, created_at long",
    "pending": "from_id long, target_ref string, category string, kind string, byte_offset long, created_at long",
    "tombstones": "doc_id long, tombstoned_at long",
    "vectors": "id long, embedding array<float>, doc_id long",
}
#: The column by whose values rows of a table are replaced; doc_id in all others.
REPLACED_BY = {"edges": "from_id", "pending": "from_id"}


class Tables:
    """The tables of an index by name, from a folder with one manifest or from given DataFrames.

    ``pinned`` tables are those of one version, whatever is committed meanwhile; others look for the newest at every access.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, version: int | None = None, **given: DataFrame):
        self.spark, self.root, self.given, self.version = spark, root, given, version
        self.stored = ManifestTable(spark, root) if root else None

    def pinned(self) -> Tables:
        if self.stored is None or self.version is not None:
            return self
        return Tables(self.spark, self.root, self.stored.version(), **self.given)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        if name in self.given:
            return self.given[name]
        version = None if self.stored is None else self.stored.version() if self.version is None else self.version
        rows = self.stored.read(f"{name}/data", version) if self.stored else None
        if rows is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        deletes = self.stored.read(f"{name}/deletes", version)
        if deletes is not None:  # a row goes if a later version replaces its document
            last = deletes.groupBy("_key").agg(F.max("_at").alias("_gone"))
            rows = rows.join(last, (rows[REPLACED_BY.get(name, "doc_id")] == last._key) & (rows._seq < last._gone), "left_anti")
        return rows.drop("_seq")

    def change(self, **changes: tuple[DataFrame, DataFrame | None]) -> None:
        """Append to each table (rows, ids whose earlier rows they replace); all is written before the version with all of it is published."""
        base, parts = self.version or 0, {}
        for name, (rows, replaced) in changes.items():
            parts[f"{name}/data"] = [self.stored.stage(f"{name}/data", rows.withColumn("_seq", F.lit(base + 1).cast("long")))]
            if replaced is not None:
                parts[f"{name}/deletes"] = [self.stored.stage(f"{name}/deletes", replaced.select(F.col(replaced.columns[0]).alias("_key"), F.lit(base + 1).cast("long").alias("_at")).distinct())]
        self.stored.commit(parts, base)

    def rewrite(self, **new: DataFrame) -> None:
        """Put these tables in place of all that is stored."""
        base = self.version or 0
        parts = {f"{name}/data": [self.stored.stage(f"{name}/data", df.withColumn("_seq", F.lit(base + 1).cast("long")))] for name, df in new.items()}
        self.stored.commit(parts, base, replace=True)


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None, embedder: Callable | None = None, reranker: Callable | None = None, rules: Sequence[RuleTagger] = (), **tables: DataFrame):
        self.spark, self.tables, self.rules = spark, Tables(spark, root, **tables), rules
        self.embedder, self.reranker = embedder or vectors.hashing_embedder(), reranker

    def at(self, tables: Tables) -> Engine:
        """This engine over tables of one version."""
        out = Engine(self.spark, None, self.embedder, self.reranker, self.rules)
        out.tables = tables.pinned()
        return out

    @property
    def _live_edges(self) -> DataFrame:
        """Edges between documents that are there: none leads from, to or through a tombstoned one."""
        t = self.tables.pinned()
        return graph.without_documents(t.edges, t.tombstones)

    def _filter(self, f: Filter | str | Sequence[str], op: str = "and") -> Filter:
        return parse_filter(f) if isinstance(f, str) else from_list(f, op) if isinstance(f, (list, tuple)) else f

    def match(self, f: Filter | str | Sequence[str], op: str = "and") -> DataFrame:
        """doc_id of what a filter, its text or a list of keys matches."""
        t = self.tables.pinned()
        return filters.match(t.doc_keys, self._filter(f, op), t.documents.select("doc_id"), t.tombstones)

    def search(self, f: Filter | str | Sequence[str], op: str = "and", limit: int | None = 20, offset: int = 0) -> DataFrame:
        """Pointers of one page, with total_matching; the page is cut before anything is joined."""
        e = self.at(self.tables)
        ids = filters.page(e.match(f, op), limit, offset)
        rows = filters.hydrate(ids, e.tables.documents, e.tables.chunks, leaf_keys(self._filter(f, op)))
        return rows.join(ids, "doc_id")

    def expand(self, ids: DataFrame, hops: int = 1, direction: str = "outgoing", max_nodes: int | None = 500, include_seeds: bool = True) -> DataFrame:
        """Linked documents; tombstoned ones are neither found nor walked through."""
        e = self.at(self.tables)
        out = graph.expand(e._live_edges, ids, hops, direction, max_nodes=max_nodes, include_seeds=include_seeds)
        return out.join(e.tables.tombstones.select("doc_id"), "doc_id", "left_anti")

    def semantic(self, query: str, f: Filter | str | Sequence[str] | None = None, k: int = 10, hops: int | None = None, rerank: bool = False, query_vector: Sequence[float] | None = None) -> DataFrame:
        """doc_id, chunk_id, score: filter, expand along links, then rank the chunks of what is left."""
        e = self.at(self.tables)
        t = e.tables
        docs = filters.match_all(t.doc_keys, t.tombstones) if f is None else e.match(f)
        if hops:
            docs = e.expand(docs, hops, max_nodes=None).select("doc_id")
        owned = t.chunks.select(F.col("chunk_id").alias("id"), "doc_id", "byte_start", "byte_end").dropDuplicates(["id"]).join(docs, "doc_id", "left_semi")
        q = query_vector if query_vector is not None else self.embedder([query])[0]
        best = vectors.nearest(t.vectors, q, k, owned)
        if rerank:
            if self.reranker is None:
                raise ValueError("no reranker is set")
            texts = owned.join(t.documents.select("doc_id", F.col("text").cast("binary").alias("_b")), "doc_id")
            from waymark.functions.text import chunk_bytes

            texts = texts.select("id", chunk_bytes(F.col("_b"), F.col("byte_start"), F.coalesce("byte_end", F.octet_length("_b"))).alias("text"))
            best = vectors.rerank(best, texts, query, self.reranker)
        return best.join(owned.select("id", "doc_id"), "id").select("doc_id", F.col("id").alias("chunk_id"), "score").orderBy(F.desc("score"), "chunk_id")

    def inspect(self, path: str) -> DataFrame:
        t = self.tables.pinned()
        return filters.inspect(path, t.documents, t.doc_keys)

    def status(self) -> DataFrame:
        t = self.tables.pinned()
        return filters.status(t.documents, t.chunks, t.doc_keys, t.tombstones)

    def filters(self, category: str | None = None) -> DataFrame:
        return filters.catalog(self.tables.doc_keys, None if category is None else f"{category}:")

    def chunk_tree(self, ids: DataFrame | None = None) -> DataFrame:
        c = self.tables.chunks
        return chunk_ops.nest(c if ids is None else c.join(ids.select("doc_id"), "doc_id", "left_semi"))

    def neighbours(self, ids: DataFrame, direction: str = "outgoing", where=graph.AnyEdge(), limit: int | None = 20) -> DataFrame:  # noqa: B008
        """Neighbours with their paths and source types."""
        e = self.at(self.tables)
        n = graph.neighbours(e._live_edges, ids, direction, where)
        n = (n.orderBy("doc_id", "seed", "kind").limit(limit) if limit is not None else n).join(e.tables.documents.select("doc_id", "file_path", "source_type"), "doc_id", "left")
        return n

    def reachable(self, seed: int, direction: str = "outgoing") -> DataFrame:
        return graph.reachable(self._live_edges, seed, direction)

    def shortest_path(self, start: int, end: int) -> list[int]:
        return graph.shortest_path(self._live_edges, start, end)

    def central(self, algorithm: str = "pagerank", limit: int = 10, ids: DataFrame | None = None) -> DataFrame:
        return graph.central(self._live_edges, algorithm, limit, ids)

    def graph_stats(self) -> DataFrame:
        return graph.stats(self._live_edges)

    def index(self, root: str, now: int, ignore_lines: Sequence[str] = (), extra: dict[str, Parser] | None = None, kinds: Sequence[str] | None = None) -> DataFrame:
        """Bring the index in line with the files below ``root``; gives the counts of what was done.

        Only new and changed files are parsed. Files of parsers that don't take part
        (``kinds``) are never taken for deleted ones.
        """
        found, listing = file_source.walk(self.spark, root, ignore_lines, kinds)
        return self.sync(found, now, root, extra, kinds, listing=listing)

    def sync(
        self, found: DataFrame, now: int, root: str | None = None, extra: dict[str, Parser] | None = None, kinds: Sequence[str] | None = None, snapshot: bool = True, deleted: DataFrame | None = None, listing: DataFrame | None = None,
    ) -> DataFrame:
        """``index`` over a table of file_path, content, content_hash, parser.

        With ``snapshot`` False the table holds changes only, as a poll's items do: what
        it lacks stays, and ``deleted`` (file_path) tells what is gone. What only
        ``listing`` (file_path) has is there but couldn't be read: it stays as it is.
        """
        t = self.tables.pinned()
        known = t.documents if kinds is None else t.documents.where(file_source.parser_of(F.col("file_path")).isin(*kinds))
        hashes = cut(found.groupBy("file_path").agg(F.max("content_hash").alias("content_hash")))
        there = hashes if listing is None else hashes.unionByName(listing.select("file_path").distinct().join(hashes, "file_path", "left_anti").withColumn("content_hash", F.lit(None).cast("binary")))
        actions = ingest.snapshot_actions(there, known, root, t.tombstones)
        if not snapshot:
            actions = actions.where("action <> 'tombstoned'")
            if deleted is not None:
                gone = known.join(deleted.select("file_path").distinct(), "file_path", "left_semi").join(t.tombstones.select("doc_id"), "doc_id", "left_anti").join(found.select("file_path"), "file_path", "left_anti")
                actions = actions.unionByName(gone.select("file_path", "doc_id", F.lit("tombstoned").alias("action")))
        actions = cut(actions)
        self._apply(t, actions, found, hashes, now, extra)
        return ingest.action_counts(actions)

    def process(self, events: DataFrame, now: int, extra: dict[str, Parser] | None = None) -> DataFrame:
        """Apply change events (seq, path, kind, from_path, content); gives path, doc_id, action.

        Per path the last event counts. A renamed document keeps its id, through chains of
        renames too, and is derived anew at its new path from the content of the event or,
        without any, that of the index. Ignored and unchanged paths are "skipped".
        """
        t = self.tables.pinned()
        e = events.withColumn("content_hash", ingest.content_hash(F.col("content")))
        actions = cut(ingest.event_actions(e, t.documents, t.tombstones))
        last = e.where("content IS NOT NULL").groupBy("path").agg(F.max(F.struct("seq", "content", "content_hash")).alias("x")).select(F.col("path").alias("file_path"), "x.content", "x.content_hash")
        kept = actions.where("action = 'renamed'").select(F.col("path").alias("file_path"), "doc_id").join(last.select("file_path"), "file_path", "left_anti")
        kept = kept.join(t.documents.select("doc_id", F.col("text").cast("binary").alias("content"), F.col("blake3_hash").alias("content_hash")), "doc_id").drop("doc_id")
        found = cut(last.unionByName(kept).withColumn("parser", file_source.parser_of(F.col("file_path"))).where("parser IS NOT NULL"))
        todo = actions.select(F.col("path").alias("file_path"), "doc_id", F.when(F.col("action") == "renamed", "updated").otherwise(F.col("action")).alias("action"))
        self._apply(t, cut(todo), found, found.select("file_path", "content_hash"), now, extra)
        return actions

    def _apply(self, t: Tables, actions: DataFrame, found: DataFrame, hashes: DataFrame, now: int, extra: dict[str, Parser] | None) -> None:
        """Derive what actions (file_path, doc_id, action) say from ``found`` and publish it."""
        changed = actions.where("action IN ('indexed', 'updated')")
        parsed = cut(parse_files(found.join(changed.select("file_path"), "file_path", "left_semi"), extra).where("error IS NULL"))
        fresh = chunk_ops.next_ids(changed.where("action = 'indexed'").select("file_path"), t.documents, "doc_id", ["file_path"])
        ids = cut(changed.where("action = 'updated'").select("file_path", "doc_id").unionByName(fresh.select("file_path", "doc_id")).join(parsed.select("file_path"), "file_path", "left_semi"))
        keys = cut(keys_of(parsed, ids, self.rules))
        source = keys.where(F.col("bitmap_key").startswith("source:")).groupBy("doc_id").agg(F.substring(F.min("bitmap_key"), 8, 1000).alias("source_type"))
        docs = ids.join(parsed.select("file_path", "auto_type", "text"), "file_path").join(hashes.select("file_path", F.col("content_hash").alias("blake3_hash")), "file_path").join(source, "doc_id", "left")
        docs = docs.select("doc_id", "file_path", "source_type", "auto_type", "blake3_hash", F.lit(now).cast("long").alias("last_indexed"), "text")
        docs = cut(docs)
        replaced = changed.where("action = 'updated'").select("doc_id").join(ids, "doc_id", "left_semi")
        chunks = cut(chunk_ops.next_ids(chunk_rows(parsed, ids).drop("position"), t.chunks, "chunk_id", ["doc_id", "byte_start"]).select(*t.chunks.columns))
        links = link_rows(parsed, ids).withColumn("created_at", F.lit(now).cast("long"))
        names = t.documents.select("doc_id", "file_path").join(replaced, "doc_id", "left_anti").unionByName(docs.select("doc_id", "file_path"))
        edges, waiting = graph.resolve(links, names)
        others = t.pending.join(docs.select(F.col("doc_id").alias("from_id")), "from_id", "left_anti")
        late = cut(graph.resolve(others, docs.select("doc_id", "file_path"))[0])  # what waited for the new documents
        moved = late.select("from_id").distinct()
        rest = graph.resolve(others.join(moved, "from_id", "left_semi"), docs.select("doc_id", "file_path"))[1]
        late = late.join(t.edges.select("from_id", "to_id", "kind"), ["from_id", "to_id", "kind"], "left_anti")
        gone = actions.where("action = 'tombstoned'").select("doc_id", F.lit(now).cast("long").alias("tombstoned_at"))
        texts = chunks.join(docs.select("doc_id", F.col("text").cast("binary").alias("_b")), "doc_id")
        from waymark.functions.text import chunk_bytes

        texts = texts.select(F.col("chunk_id").alias("id"), chunk_bytes(F.col("_b"), F.col("byte_start"), F.col("byte_end")).alias("text"))
        embedded = vectors.embed_texts(texts, self.embedder).join(chunks.select(F.col("chunk_id").alias("id"), "doc_id"), "id")
        out = [replaced.select(F.col("doc_id").alias("from_id")), moved]
        t.change(
            chunks=(chunks, replaced), doc_keys=(keys, replaced), vectors=(embedded, replaced), tombstones=(gone, replaced),
            edges=(graph.distinct_edges(edges.unionByName(late)), out[0]), pending=(waiting.unionByName(rest), out[0].union(out[1])), documents=(docs, replaced),
        )

    def compact(self) -> None:
        """Drop tombstoned documents from every table, edges and vectors too."""
        t = self.tables.pinned()
        out = ingest.compact(t.tombstones, documents=t.documents, chunks=t.chunks, doc_keys=t.doc_keys, edges=t.edges)
        out["pending"] = t.pending.join(t.tombstones.select(F.col("doc_id").alias("from_id")).distinct(), "from_id", "left_anti")
        out["vectors"] = t.vectors.join(t.tombstones.select("doc_id").distinct(), "doc_id", "left_anti")
        t.rewrite(**out)
