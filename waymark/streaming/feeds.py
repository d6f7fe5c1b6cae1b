"""Change feeds under Structured Streaming: the batch operators, batch after batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waymark.functions.text import strict_base64
from waymark.operators.changefeed import EqualityDeleteTable
from waymark.operators.manifest import ManifestTable
from waymark.runtime import cut
from waymark.sources.files import walk


def apply_changes(feed: DataFrame, root: str, checkpoint: str, keys: Sequence[str], sequence: Sequence[Column], deleted: Column, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream of changes to an equality-delete table; each batch becomes one version.

    A batch that is repeated after a failure changes nothing that readers see: its rows
    have the sequence numbers they had.
    """

    def write(batch: DataFrame, _: int) -> None:
        EqualityDeleteTable(batch.sparkSession, root, keys, sequence, deleted).apply(batch)

    return feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def webhook_spool(spark: SparkSession, folder: str) -> DataFrame:
    """Pushed documents (JSON lines of path, content_b64) as a stream: path, content, valid."""
    raw = spark.readStream.schema("path string, content_b64 string").json(folder)
    return raw.select("path", strict_base64(F.col("content_b64")).alias("content"), strict_base64(F.col("content_b64")).isNotNull().alias("valid"))


def snapshot_events(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, kind, content_hash of what changed between two listings (file_path, content_hash): what a watcher would tell."""
    a = before.select(F.col("file_path").alias("_a"), F.col("content_hash").alias("_ah"))
    b = now.select(F.col("file_path").alias("_b"), F.col("content_hash").alias("_bh"))
    j = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    kind = F.when(F.col("_b").isNull(), "deleted").when(F.col("_a").isNull(), "created").when(~F.col("_ah").eqNullSafe(F.col("_bh")), "modified")
    return j.select(F.coalesce("_b", "_a").alias("path"), kind.alias("kind"), F.col("_bh").alias("content_hash")).where("kind IS NOT NULL")


def look(spark: SparkSession, root: str, state: str, handle: Callable[[DataFrame], None], ignore_lines: Sequence[str] = ()) -> int:
    """List the files below ``root`` once and hand what changed since the listing handled last (path, kind, content_hash) to ``handle``; gives how many.

    A listing is always whole, so deletions are seen as well. It is kept as a manifest
    version under ``state`` after the handler is done: one that fails sees the same changes
    again. A file that can't be read keeps the hash it had.
    """
    found, listing = walk(spark, root, ignore_lines)
    now = cut(listing.join(found.select("file_path", "content_hash"), "file_path", "left"))
    seen = ManifestTable(spark, state)
    base = seen.version()
    old = seen.read("listing", base)
    before = now.limit(0) if old is None else old
    kept = now.join(before.select("file_path", F.col("content_hash").alias("_old")), "file_path", "left").select("file_path", F.coalesce("content_hash", "_old").alias("content_hash"))
    events = cut(snapshot_events(before, kept))
    n = events.count()
    if n:
        handle(events)
        seen.commit({"listing": [seen.stage("listing", kept.distinct())]}, base, replace=True)
    return n


def watch(spark: SparkSession, root: str, state: str, checkpoint: str, handle: Callable[[DataFrame], None], seconds: float = 5, ignore_lines: Sequence[str] = ()) -> StreamingQuery:
    """``look`` every ``seconds``, as a streaming query that can be stopped and restarted; its clock carries no data."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(lambda batch, _: look(batch.sparkSession, root, state, handle, ignore_lines) and None).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def event_counts(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events (ts, event_type) by event-time window; rows later than ``late`` are dropped, the same over a batch without."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
