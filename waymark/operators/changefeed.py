"""Problem 5: a feed of inserts, updates and deletes as data files and equality-delete files.

Each change gets a sequence number. Inserts and updates append a data row, and every
change appends a delete of its key at its sequence number; nothing is ever rewritten
to apply a change. A reader drops the data rows for which a later delete of the same
key exists. Order of arrival doesn't matter, nor does how often a change arrives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.incremental import newest_per_key
from waymark.operators.manifest import ManifestTable

#: A time of at least this many units is in milliseconds: as seconds it would be the year 5138.
MILLISECONDS_FROM = 100_000_000_000


def whole_seconds(t: Column) -> Column:
    """A Unix time in seconds, from seconds or milliseconds."""
    return F.when((t >= MILLISECONDS_FROM) | (t <= -MILLISECONDS_FROM), F.floor(t / 1000)).otherwise(t).cast("long")


def split_feed(feed: DataFrame, keys: Sequence[str], sequence: Sequence[Column], deleted: Column) -> tuple[DataFrame, DataFrame]:
    """The feed as (data, deletes): data rows with their sequence as _seq, deletes as keys and _seq.

    A null ``deleted`` is no delete. Rows with a null key name nothing: they are left out.
    """
    seq = F.struct(*(F.coalesce(c.cast("long"), F.lit(-(2**63))).alias(f"s{i}") for i, c in enumerate(sequence)))
    known = feed.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).withColumn("_seq", seq)
    return known.where(~F.coalesce(deleted, F.lit(False))), known.select(*keys, "_seq")


def merge_on_read(data: DataFrame, deletes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The current rows: of ``data`` those without a later delete of their key.

    Both sides are first cut to the newest row of each key, on the map side too, so
    a key with a third of all changes crosses the network once per map task; an
    older data row always has a later delete. Then each key meets one row. Rows of
    one sequence number are the same change delivered again: one stays.
    """
    rest = [c for c in data.columns if c not in {*keys, "_seq"}]
    newest = newest_per_key(data, keys, [F.col("_seq")], ["_seq", *rest])
    last = deletes.groupBy(*keys).agg(F.max("_seq").alias("_deleted_at"))
    last = last.select(*(F.col(k).alias(f"_d_{k}") for k in keys), "_deleted_at")
    later = [newest[k] == last[f"_d_{k}"] for k in keys] + [newest["_seq"] < last["_deleted_at"]]
    return newest.join(last, later, "left_anti").drop("_seq")


def current_items(remote_items: DataFrame) -> DataFrame:
    """Every live item of a poll feed: one row per (source_name, id), the columns of the feed."""
    keys = ["source_name", "id"]
    sequence = [whole_seconds(F.col("updated_at")), F.col("feed_id")]
    return merge_on_read(*split_feed(remote_items, keys, sequence, F.col("deleted")), keys)


class EqualityDeleteTable:
    """A stored table fed by changes: ``apply(feed)`` appends, ``read()`` merges, ``compact()`` rewrites.

    Applying a batch again changes nothing that a reader sees.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], sequence: Sequence[Column], deleted: Column):
        self.table, self.keys, self.sequence, self.deleted = ManifestTable(spark, root), list(keys), list(sequence), deleted

    def apply(self, feed: DataFrame) -> int:
        base = self.table.version()
        data, deletes = split_feed(feed, self.keys, self.sequence, self.deleted)
        added = {"data": [self.table.stage("data", data)], "deletes": [self.table.stage("deletes", deletes)]}
        return self.table.commit(added, base)

    def read(self, version: int | None = None) -> DataFrame | None:
        at = self.table.version() if version is None else version  # data and deletes of one version, whoever commits meanwhile
        data, deletes = self.table.read("data", at), self.table.read("deletes", at)
        return None if data is None else merge_on_read(data, deletes, self.keys)

    def compact(self) -> int:
        """Keep of each key the live row and the last delete: late deliveries are still judged right."""
        base = self.table.version()
        data, deletes = self.table.read("data", base), self.table.read("deletes", base)
        if data is None:
            return base
        last = deletes.groupBy(*self.keys).agg(F.max("_seq").alias("_seq"))
        live = merge_on_read(data.withColumn("_kept", F.col("_seq")), deletes, self.keys).withColumnRenamed("_kept", "_seq")
        added = {"data": [self.table.stage("data", live)], "deletes": [self.table.stage("deletes", last)]}
        return self.table.commit(added, base, replace=True)
