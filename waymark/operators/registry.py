"""Changes to the document, key and edge tables: each takes tables and gives the new ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.chunks import next_ids
from waymark.operators.incremental import newest_per_key
from waymark.runtime import cut


class DuplicatePath(ValueError):
    """A new document has the path of a registered one, or of another new one."""


class NotFound(KeyError):
    """A document to be changed isn't registered."""


def insert_documents(documents: DataFrame, new: DataFrame) -> DataFrame:
    """``documents`` with ``new`` (without doc_id) added, ids in order of paths; all or none."""
    twice = new.groupBy("file_path").count().where("count > 1").select("file_path")
    if not twice.union(new.select("file_path").join(documents.select("file_path"), "file_path", "left_semi")).isEmpty():
        raise DuplicatePath("a path is registered already")
    return documents.unionByName(next_ids(new, documents, "doc_id", ["file_path"]), allowMissingColumns=True).select(*documents.columns)


def update_documents(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """``documents`` with the columns of ``changes`` (doc_id and any others) in place of theirs; null leaves a value.

    Of several changes of one document the greatest row counts. Unknown ids raise NotFound.
    """
    values = [c for c in changes.columns if c != "doc_id"]
    last = newest_per_key(changes, ["doc_id"], [F.lit(0)], values)
    last = last.select(F.col("doc_id").alias("_id"), *(F.col(c).alias(f"_n_{c}") for c in values))
    if not last.join(documents.select(F.col("doc_id").alias("_id")), "_id", "left_anti").isEmpty():
        raise NotFound("a changed document isn't registered")
    joined = documents.join(last, F.col("doc_id") == F.col("_id"), "left")
    return joined.select(*(F.coalesce(f"_n_{c}", c).alias(c) if c in values else F.col(c) for c in documents.columns))


def move_documents(documents: DataFrame, moves: DataFrame) -> DataFrame:
    """``documents`` at the paths of ``moves`` (doc_id, file_path); ids stay. Raises DuplicatePath if a path is taken."""
    out = cut(update_documents(documents, moves.select("doc_id", "file_path")))
    if not out.groupBy("file_path").count().where("count > 1").isEmpty():
        raise DuplicatePath("a path is registered already")
    return out


def delete_documents(gone: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table (with a doc_id column) without the documents of ``gone``."""
    ids = gone.select("doc_id").distinct()
    return {name: t.join(ids, "doc_id", "left_anti").select(*t.columns) for name, t in tables.items()}


def set_keys(doc_keys: DataFrame, new: DataFrame) -> DataFrame:
    """Keys of the documents in ``new`` replaced by those there."""
    kept = doc_keys.join(new.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "bitmap_key")
    return kept.unionByName(new.select("doc_id", "bitmap_key").where("bitmap_key IS NOT NULL").distinct())


def put_key(doc_keys: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The document set of one key replaced; an empty set removes the key."""
    return doc_keys.where(F.col("bitmap_key") != key).select("doc_id", "bitmap_key").unionByName(ids.select("doc_id").distinct().withColumn("bitmap_key", F.lit(key)))


def add_to_key(doc_keys: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    return doc_keys.select("doc_id", "bitmap_key").unionByName(ids.select("doc_id", F.lit(key).alias("bitmap_key"))).distinct()


def remove_from_key(doc_keys: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    gone = ids.select(F.col("doc_id").alias("_id")).distinct()
    return doc_keys.join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("bitmap_key") == key), "left_anti")


def insert_pending(pending: DataFrame, new: DataFrame) -> DataFrame:
    """Pending links with new ones added; a (from_id, target_ref, kind) that is there already stays as it is."""
    keys = ["from_id", "target_ref", "kind"]
    fresh = newest_per_key(new, keys, [-F.col("created_at")], [c for c in pending.columns if c not in keys])
    return pending.unionByName(fresh.join(pending.select(*keys).distinct(), keys, "left_anti").select(*pending.columns))


def cached_tags(contents: DataFrame, cache: DataFrame, config: Column) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of documents (doc_id, file_path, content_hash) in a tag cache (file_path, content_hash, config_hash, tags).

    The path belongs to the key: taggers read it, so equal contents elsewhere may have other tags.
    """
    keys = ["file_path", "content_hash", "config_hash"]
    wanted = contents.withColumn("config_hash", config)
    known = cache.groupBy(*keys).agg(F.max("tags").alias("tags"))
    return wanted.join(known, keys), wanted.join(known, keys, "left_anti")


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """``df`` with each row's place (from 1) among the rows of its keys, for keys that may hold any share of all rows.

    Rows are range-partitioned by keys and order, so a large key spans tasks; every task
    numbers its rows, and the sizes of the tasks before it are added. Ties beyond
    ``order`` are settled arbitrarily, as a row number's are. Null keys are a key.
    """
    by = [*keys, *order]
    parts = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    local = parts.withColumn("_i", F.col("_m") - F.col("_p").cast("long") * (1 << 33))
    sizes = local.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per partition
    numbered = local.join(F.broadcast(before), F.col("_p") == F.col("_q")).withColumn("_at", F.col("_i") + F.col("_before"))
    first = numbered.groupBy(*keys).agg(F.min("_at").alias("_first")).select(*(F.col(k).alias(f"_f_{k}") for k in keys), "_first")
    same = [numbered[k].eqNullSafe(first[f"_f_{k}"]) for k in keys]
    return numbered.join(first, same).select(*df.columns, (F.col("_at") - F.col("_first") + 1).cast("int").alias(out))
