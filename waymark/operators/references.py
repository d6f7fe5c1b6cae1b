"""Problem 7: references to records that do not exist, listed and counted by table and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.names import fold, fold_ascii, is_ascii, reference_name, undo_percent
from waymark.functions.text import utc_date
from waymark.runtime import cut

#: A key is heavy if it holds at least this share of all references: there are at most 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 0.0005


def live_documents(documents: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Documents that no tombstone set at or after their last indexing covers: doc_id, file_path.

    Repeated and outdated tombstones make no difference. Where last_indexed is null
    no tombstone can be said to be later, so the document is live.
    """
    gone = tombstones.groupBy("doc_id").agg(F.max("tombstoned_at").alias("_gone_at")).withColumnRenamed("doc_id", "_gone_id")
    docs = documents.select("doc_id", "file_path", "last_indexed")
    return docs.join(gone, (docs.doc_id == gone._gone_id) & (gone._gone_at >= docs.last_indexed), "left_anti").select("doc_id", "file_path")


def _folded(df: DataFrame, raw: str, out: str) -> DataFrame:
    """``df`` with column ``out``, the folded form of ``raw``; only non-ASCII rows go through Python."""
    plain = df.where(is_ascii(F.col(raw))).withColumn(out, fold_ascii(F.col(raw)))
    return plain.unionByName(df.where(~is_ascii(F.col(raw))).withColumn(out, fold(F.col(raw))))


def live_names(live: DataFrame) -> DataFrame:
    """Every name of a live document, folded: its path, file name and file name without extension."""
    name = F.regexp_extract("file_path", r"([^/]*)$", 1)
    names = live.select(F.explode(F.array("file_path", name, F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))).alias("_raw"))
    return _folded(names.where(F.col("_raw").isNotNull()).select(undo_percent(F.col("_raw")).alias("_raw")), "_raw", "_name").where("_name <> ''").select("_name").distinct()


def month_of(seconds: Column) -> Column:
    return F.date_format(utc_date(seconds), "yyyy-MM")


def references(doc_links: DataFrame, chunks: DataFrame, pending: DataFrame) -> DataFrame:
    """All different references: ref_table, owner_id, target (as text), month, key.

    The key is what the reference leads to: "#" and a document's id, or "=" and a folded name;
    "" if it leads nowhere by itself, as a null does.
    """
    rows = lambda t, name, owner, target, at: t.select(F.lit(name).alias("ref_table"), F.col(owner).alias("owner_id"), F.col(target).cast("string").alias("target"), month_of(F.col(at)).alias("month"))
    by_id = rows(doc_links, "doc_links", "from_id", "to_id", "created_at").unionByName(rows(chunks, "chunks", "chunk_id", "doc_id", "indexed_at"))
    by_id = by_id.withColumn("key", F.coalesce(F.concat(F.lit("#"), "target"), F.lit("")))
    by_name = rows(pending, "doc_links_pending", "from_id", "target_ref", "created_at").withColumn("_raw", F.coalesce(reference_name(F.col("target")), F.lit("")))
    by_name = _folded(by_name, "_raw", "key").drop("_raw").withColumn("key", F.when(F.col("key") == "", "").otherwise(F.concat(F.lit("="), "key")))
    return by_id.unionByName(by_name).distinct()


def live_keys(live: DataFrame) -> DataFrame:
    """The keys of ``references`` that a live document stands behind."""
    return live.select(F.concat(F.lit("#"), F.col("doc_id").cast("string")).alias("_live")).union(live_names(live).select(F.concat(F.lit("="), "_name")))


class OrphanSplit:
    """References judged by their keys, heavy keys apart from the rest.

    ``refs`` (ref_table, month, key and more) are counted per key, table and month first, and
    all that follows is of these counts. Keys with at least ``heavy_share`` of all references,
    at most 1 / heavy_share of them, are checked once each against the live keys and
    broadcast; the other counts go through a shuffled anti-join, in which no key can weigh
    more than that share. The two orphan counts are united.
    """

    def __init__(self, refs: DataFrame, live: DataFrame, heavy_share: float = HEAVY_SHARE):
        self.refs, self.counted = refs, cut(refs.groupBy("key", "ref_table", "month").agg(F.count("*").alias("n")))
        per_key = self.counted.groupBy("key").agg(F.sum("n").alias("_n"))
        most = self.counted.agg(F.sum("n")).first()[0] or 0
        heavy = cut(per_key.where(F.col("_n") >= max(1, most * heavy_share)).select(F.col("key").alias("_heavy")))
        alive = live.join(F.broadcast(heavy), F.col("_live") == F.col("_heavy"), "left_semi").select("_live").distinct()
        self.heavy, self.dead_heavy = heavy, cut(heavy.join(alive, F.col("_heavy") == F.col("_live"), "left_anti"))
        rest = self.counted.join(F.broadcast(heavy), F.col("key") == F.col("_heavy"), "left_anti")
        self._rest = cut(rest.join(live, F.col("key") == F.col("_live"), "left_anti"))

    def counts(self) -> DataFrame:
        """ref_table, month, n_references, n_orphans."""
        of_heavy = self.counted.join(F.broadcast(self.dead_heavy), F.col("key") == F.col("_heavy"), "left_semi")
        orphans = of_heavy.unionByName(self._rest).select("ref_table", "month", F.lit(0).cast("long").alias("n"), F.col("n").alias("orphan"))
        every = self.counted.select("ref_table", "month", "n", F.lit(0).cast("long").alias("orphan"))
        return every.unionByName(orphans).groupBy("ref_table", "month").agg(F.sum("n").alias("n_references"), F.sum("orphan").alias("n_orphans"))

    def rows(self) -> DataFrame:
        """The references that are orphans: those of dead heavy keys never move, the others meet the orphaned keys."""
        of_heavy = self.refs.join(F.broadcast(self.dead_heavy), F.col("key") == F.col("_heavy"), "left_semi")
        rest = self.refs.join(F.broadcast(self.heavy), F.col("key") == F.col("_heavy"), "left_anti")
        return of_heavy.unionByName(rest.join(self._rest.select(F.col("key").alias("_dead")).distinct(), F.col("key") == F.col("_dead"), "left_semi"))


def _split(doc_links: DataFrame, chunks: DataFrame, pending: DataFrame, documents: DataFrame, tombstones: DataFrame) -> OrphanSplit:
    return OrphanSplit(cut(references(doc_links, chunks, pending)), live_keys(cut(live_documents(documents, tombstones))))


def orphans(doc_links: DataFrame, chunks: DataFrame, pending: DataFrame, documents: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Every orphan reference: ref_table, owner_id, target (as text), month.

    Repeated references are one row; empty tables give none. Extra columns of the inputs aren't read.
    """
    return _split(doc_links, chunks, pending, documents, tombstones).rows().drop("key")


def orphan_counts(doc_links: DataFrame, chunks: DataFrame, pending: DataFrame, documents: DataFrame, tombstones: DataFrame) -> DataFrame:
    """ref_table, month, n_references, n_orphans over different references (table, owner, target, month)."""
    return _split(doc_links, chunks, pending, documents, tombstones).counts()


__all__ = ["OrphanSplit", "live_documents", "live_names", "orphan_counts", "orphans"]
