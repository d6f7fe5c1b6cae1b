"""Boolean filters over the key table, paging, and hydration of what they match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.plans.filter_dsl import And, Filter, Key, Not, Or, leaf_keys, parse_filter


def _truth(f: Filter, on: dict[str, Column]) -> Column:
    if isinstance(f, Key):
        return on[f.name]
    if isinstance(f, Not):
        return ~_truth(f.inner, on)
    if not f.parts:
        return F.lit(False)
    join = (lambda a, b: a & b) if isinstance(f, And) else (lambda a, b: a | b)
    return reduce(join, (_truth(p, on) for p in f.parts))


def holds_for_none(f: Filter) -> bool:
    """Whether a document without any of the filter's keys matches."""
    if isinstance(f, Key):
        return False
    if isinstance(f, Not):
        return not holds_for_none(f.inner)
    each = [holds_for_none(p) for p in f.parts]
    return bool(each) and (all(each) if isinstance(f, And) else any(each))


def match(doc_keys: DataFrame, f: Filter | str, universe: DataFrame | None = None, tombstones: DataFrame | None = None) -> DataFrame:
    """The doc_id of every live document that the filter holds for, once each.

    However deep the filter, the key table is scanned once for its keys (pushed down to
    the scan) and aggregated once per document. The universe (doc_id) is joined only if
    documents without any of the keys can match; without one it is every document of the
    key table. Unknown keys match nothing; And and Or of nothing match nothing.
    """
    f = parse_filter(f) if isinstance(f, str) else f
    names = list(dict.fromkeys(leaf_keys(f)))
    held = doc_keys.where(F.col("bitmap_key").isin(names)) if names else doc_keys.where(F.lit(False))
    flags = {k: f"_k{i}" for i, k in enumerate(names)}
    some = held.groupBy("doc_id").agg(*(F.bool_or(F.col("bitmap_key") == k).alias(c) for k, c in flags.items()), F.lit(1).alias("_"))
    if holds_for_none(f):
        every = (doc_keys if universe is None else universe).select("doc_id").distinct()
        some = every.join(some, "doc_id", "left")
    out = some.where(_truth(f, {k: F.coalesce(F.col(c), F.lit(False)) for k, c in flags.items()})).select("doc_id")
    if tombstones is not None:
        out = out.join(tombstones.select("doc_id"), "doc_id", "left_anti")
    return out


def match_all(doc_keys: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Every live document with a source: key."""
    out = doc_keys.where(F.col("bitmap_key").startswith("source:")).select("doc_id").distinct()
    return out if tombstones is None else out.join(tombstones.select("doc_id"), "doc_id", "left_anti")


def page(ids: DataFrame, limit: int | None = 20, offset: int = 0) -> DataFrame:
    """doc_id in ascending order after ``offset``, at most ``limit``, each with total_matching."""
    total = ids.agg(F.count("*").alias("n")).scalar()
    cut = ids.orderBy("doc_id").offset(offset)
    return (cut if limit is None else cut.limit(limit)).select("doc_id", total.alias("total_matching"))


def hydrate(ids: DataFrame, documents: DataFrame, chunks: DataFrame, filter_keys: list[str] | None = None) -> DataFrame:
    """Pointers of the given documents: path, source, type, last_modified, chunks in byte order, matched_filters.

    The ids should be a page: each document's chunks come together in one row.
    """
    of = ids.select("doc_id").distinct()
    own = chunks.select("chunk_id", "doc_id", "kind", "byte_start", "byte_end", "label", "depth").dropDuplicates(["chunk_id"]).join(of, "doc_id", "left_semi")
    lists = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("byte_start", "chunk_id", "byte_end", "kind", "label", "depth"))).alias("chunks"))
    d = documents.select("doc_id", "file_path", "source_type", "auto_type", F.col("last_indexed").alias("last_modified"))
    empty = F.array().cast("array<struct<byte_start:bigint,chunk_id:bigint,byte_end:bigint,kind:string,label:string,depth:int>>")
    return d.join(of, "doc_id", "left_semi").join(lists, "doc_id", "left").select(
        "doc_id", "file_path", "source_type", "auto_type", "last_modified", F.coalesce("chunks", empty).alias("chunks"), F.array(*(F.lit(k) for k in filter_keys or [])).cast("array<string>").alias("matched_filters"),
        F.lit(None).cast("double").alias("score"),
    )


def catalog(doc_keys: DataFrame, prefix: str | None = None) -> DataFrame:
    """bitmap_key, category and cardinality of every key, reserved ones left out; a key table has a key of a document once."""
    k = doc_keys.where(~F.col("bitmap_key").isin("__all_docs__", "__tombstone__"))
    k = k if prefix is None else k.where(F.col("bitmap_key").startswith(prefix))
    return k.groupBy("bitmap_key").agg(F.count("doc_id").alias("cardinality")).select("bitmap_key", F.substring_index("bitmap_key", ":", 1).alias("category"), "cardinality")


def jaccard_with(doc_keys: DataFrame, key: str) -> DataFrame:
    """Every other key that shares a document with ``key``: n_both, n_either, jaccard.

    One scan marks the rows of documents that have the key, one conditional count per key
    gives both sizes; the key's own row holds its size. No pairs are made.
    """
    mine = doc_keys.where(F.col("bitmap_key") == key).select(F.col("doc_id").alias("_mine"))
    marked = doc_keys.join(mine, F.col("doc_id") == F.col("_mine"), "left")
    sizes = marked.groupBy("bitmap_key").agg(F.count("_mine").alias("n_both"), F.count("*").alias("_n"))
    own = mine.agg(F.count("*")).scalar()
    either = F.col("_n") + own - F.col("n_both")
    return sizes.where((F.col("bitmap_key") != key) & (F.col("n_both") > 0)).select("bitmap_key", "n_both", either.alias("n_either"), (F.col("n_both") / either).alias("jaccard"))


def jaccard(doc_keys: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n_both, n_either and jaccard of two keys, 0 if neither has documents."""
    per_doc = doc_keys.where(F.col("bitmap_key").isin(a, b)).groupBy("doc_id").agg(F.bool_or(F.col("bitmap_key") == a).alias("a"), F.bool_or(F.col("bitmap_key") == b).alias("b"))
    n = per_doc.agg(F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count("*").alias("n_either"))
    return n.select("n_both", "n_either", F.when(F.col("n_either") == 0, 0.0).otherwise(F.col("n_both") / F.col("n_either")).alias("jaccard"))


def status(documents: DataFrame, chunks: DataFrame, doc_keys: DataFrame, tombstones: DataFrame) -> DataFrame:
    """One row: live documents, keys, tombstones and the next ids."""
    gone = tombstones.select("doc_id").distinct()
    live = documents.join(gone, "doc_id", "left_anti").agg(F.count("*")).scalar()
    keys = doc_keys.where(~F.col("bitmap_key").isin("__all_docs__", "__tombstone__")).agg(F.count_distinct("bitmap_key")).scalar()
    dead = gone.agg(F.count("*")).scalar()
    next_chunk = chunks.agg(F.coalesce(F.max("chunk_id"), F.lit(0)) + 1).scalar()
    return documents.agg((F.coalesce(F.max("doc_id"), F.lit(0)) + 1).alias("next_doc_id")).select(
        live.alias("total_documents"), keys.alias("total_keys"), dead.alias("total_tombstones"), "next_doc_id", next_chunk.alias("next_chunk_id")
    )


def inspect(path: str, documents: DataFrame, doc_keys: DataFrame) -> DataFrame:
    """The document at exactly ``path``: its columns, hash in hex and all its keys, sorted; tombstoned ones too."""
    d = documents.where(F.col("file_path") == path).select("doc_id", "file_path", "source_type", "auto_type", "last_indexed", F.lower(F.hex("blake3_hash")).alias("content_hash"))
    k = doc_keys.join(d.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_set("bitmap_key")).alias("keys"))
    return d.join(k, "doc_id", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))


def chunk_ranges(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_start, chunk_end (inclusive) and n_chunks, max_depth of every document with chunks."""
    return chunks.groupBy("doc_id").agg(F.min("chunk_id").alias("chunk_start"), F.max("chunk_id").alias("chunk_end"), F.count_distinct("chunk_id").alias("n_chunks"), F.max("depth").alias("max_depth"))


def doc_for_chunk(chunk_ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id, doc_id of the wanted chunks: an equi-join in place of the range lookup."""
    owner = chunks.select("chunk_id", "doc_id").distinct()
    return chunk_ids.select("chunk_id").distinct().join(owner, "chunk_id")


def key_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, bitmap_key, change ("added" or "removed") between two key tables."""
    a, b = old.select("doc_id", "bitmap_key").distinct(), new.select("doc_id", "bitmap_key").distinct()
    both = a.withColumn("_o", F.lit(1)).join(b.withColumn("_n", F.lit(1)), ["doc_id", "bitmap_key"], "full_outer")
    return both.where("_o IS NULL OR _n IS NULL").select("doc_id", "bitmap_key", F.when(F.col("_o").isNull(), "added").otherwise("removed").alias("change"))
