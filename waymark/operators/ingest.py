"""Bringing an index up to date: snapshots, change events, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import parent_folder
from waymark.operators.incremental import newest_per_key
from waymark.runtime import cut

#: Directories that a walk never enters.
PRUNED = ("target", "node_modules", "__pycache__", ".git", ".hg", ".svn", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache")


def content_hash(content: Column) -> Column:
    """The 32 bytes by which contents are told apart."""
    return F.unhex(F.sha2(content, 256))


def is_pruned(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda c: c.isin(*PRUNED))


def under(path: Column, root: str) -> Column:
    """Whether the path is ``root`` or below it, by whole components."""
    r = root.rstrip("/")
    return (path == r) | path.startswith(r + "/")


def snapshot_actions(snapshot: DataFrame, registry: DataFrame, root: str | None = None, tombstones: DataFrame | None = None) -> DataFrame:
    """file_path, doc_id, action of a full snapshot (file_path, content_hash) against the registry.

    indexed: new; updated: other content, or the same content tombstoned before; skipped:
    the same; tombstoned: registered (below ``root``) and not in the snapshot, unless it
    is tombstoned already. A null hash in the snapshot means unread: skipped if known,
    else left for the next run as "unread". Repeated snapshot rows count once, the
    greatest hash first; both sides have one row per path, so the join can't fan out.
    """
    s = snapshot.where("file_path IS NOT NULL").groupBy("file_path").agg(F.max("content_hash").alias("_new"), F.lit(True).alias("_in"))
    r = registry.where("file_path IS NOT NULL").groupBy("file_path").agg(F.max(F.struct("doc_id", "blake3_hash")).alias("_r"))
    r = r.select(F.col("file_path").alias("_path"), F.col("_r.doc_id").alias("doc_id"), F.col("_r.blake3_hash").alias("_old"))
    if tombstones is not None:
        gone = tombstones.select(F.col("doc_id").alias("_gone")).distinct()
        r = r.join(gone, r.doc_id == gone._gone, "left")
    else:
        r = r.withColumn("_gone", F.lit(None).cast("long"))
    j = s.join(r, F.col("file_path") == F.col("_path"), "full_outer").withColumn("file_path", F.coalesce("file_path", "_path"))
    scope = under(F.col("file_path"), root) if root is not None else F.lit(True)
    action = (
        F.when(F.col("_path").isNull(), F.when(F.col("_new").isNull(), "unread").otherwise("indexed"))
        .when(F.col("_new").isNotNull() & (F.col("_gone").isNotNull() | ~F.col("_old").eqNullSafe(F.col("_new"))), "updated")
        .when(F.col("_new").isNotNull(), "skipped")
    )
    known = F.col("_path").isNotNull()
    action = action.when(known & F.col("_in"), "skipped").when(known & scope & F.col("_gone").isNull(), "tombstoned")
    return j.select("file_path", "doc_id", action.alias("action")).where("action IS NOT NULL")


def action_counts(actions: DataFrame) -> DataFrame:
    """One row: indexed, updated, skipped, tombstoned."""
    return actions.agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("indexed", "updated", "skipped", "tombstoned")))


def rename_origins(moved: DataFrame, registry: DataFrame) -> DataFrame:
    """path, doc_id of every path that a registered document came to by the renames (seq, path, from_path), over as many steps as it took.

    A step follows an earlier rename to where this one began, so what is renamed there
    and back, or onto a path that another left, is told by the order of the events.
    """
    own = registry.groupBy(F.col("file_path").alias("_file")).agg(F.max("doc_id").alias("doc_id"))
    steps = cut(newest_per_key(moved, ["path", "seq"], [F.lit(0)], ["from_path"]))
    hops = cut(steps.select("path", F.col("seq").alias("last"), F.col("seq").alias("_at"), F.col("from_path").alias("_from")))
    while True:  # one round a step of the longest chain in the batch
        back = steps.select(F.col("path").alias("_p"), F.col("seq").alias("_s"), F.col("from_path").alias("_f"))
        j = hops.join(back, (hops._from == back._p) & (back._s < hops._at), "left")
        j = cut(j.groupBy("path", "last").agg(F.max(F.struct("_s", "_f")).alias("_b"), F.max(F.struct("_at", "_from")).alias("_h")))
        hops = cut(j.select("path", "last", F.coalesce("_b._s", "_h._at").alias("_at"), F.coalesce("_b._f", "_h._from").alias("_from")))
        if j.where("_b._s IS NOT NULL").isEmpty():
            break
    found = hops.join(own, hops._from == own._file)
    return found.groupBy("path").agg(F.max(F.struct("last", "doc_id")).alias("_x")).select("path", "_x.doc_id")


def event_actions(events: DataFrame, registry: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """The outcome of change events (seq, path, kind, from_path, content_hash): path, doc_id, action.

    Per path the last event counts; a rename deletes its old path and creates the new one
    with the document's id, over chains of renames too. created or modified: indexed if
    unknown, skipped if the hash is the same and the document isn't tombstoned, else
    updated; deleted: tombstoned, or ignored if unknown. Events at pruned paths are skipped.
    """
    e = events.withColumn("kind", F.lower("kind"))
    moved = e.where("kind = 'renamed' AND from_path IS NOT NULL")
    flat = e.select("seq", "path", "kind", "from_path", "content_hash").unionByName(moved.select("seq", F.col("from_path").alias("path"), F.lit("moved_away").alias("kind"), F.lit(None).cast("string").alias("from_path"), F.lit(None).cast("binary").alias("content_hash")))
    last = newest_per_key(flat, ["path"], [F.col("seq")], ["kind", "from_path", "content_hash"])
    r = registry.groupBy("file_path").agg(F.max(F.struct("doc_id", "blake3_hash")).alias("_r"))
    here = r.select(F.col("file_path").alias("_path"), F.col("_r.doc_id").alias("doc_id"), F.col("_r.blake3_hash").alias("_old"))
    there = rename_origins(moved.select("seq", "path", "from_path"), registry).select(F.col("path").alias("_to"), F.col("doc_id").alias("_from_id"))
    gone = registry.select("doc_id").where(F.lit(False)) if tombstones is None else tombstones.select("doc_id")
    here = here.join(gone.select(F.col("doc_id").alias("_gone")).distinct(), here.doc_id == F.col("_gone"), "left")
    j = last.join(here, last.path == here._path, "left").join(there, last.path == there._to, "left")
    same = F.col("_old").eqNullSafe(F.col("content_hash")) & F.col("_path").isNotNull() & F.col("_gone").isNull()
    action = (
        F.when(is_pruned(F.col("path")), "skipped")
        .when(F.col("kind") == "moved_away", "moved_away")
        .when(F.col("kind") == "renamed", F.when(F.col("_from_id").isNotNull(), "renamed").otherwise("indexed"))
        .when(F.col("kind") == "deleted", F.when(F.col("_path").isNotNull(), "tombstoned").otherwise("ignored"))
        .when(same, "skipped")
        .when(F.col("_path").isNull(), "indexed")
        .otherwise("updated")
    )
    return j.select("path", F.when(F.col("kind") == "renamed", F.col("_from_id")).otherwise(F.col("doc_id")).alias("doc_id"), action.alias("action"))


def renamed_keys(doc_keys: DataFrame, renames: DataFrame) -> DataFrame:
    """Keys after renames (doc_id, path): the folder key of each renamed document is that of its new path."""
    r = renames.groupBy("doc_id").agg(F.max("path").alias("path"))
    kept = doc_keys.join(r.select(F.col("doc_id").alias("_r")), (F.col("doc_id") == F.col("_r")) & F.col("bitmap_key").startswith("folder:"), "left_anti")
    return kept.select("doc_id", "bitmap_key").unionByName(r.select("doc_id", F.concat(F.lit("folder:"), parent_folder(F.col("path"))).alias("bitmap_key"))).distinct()


def compact(tombstones: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without the tombstoned documents (by doc_id, or by from_id and to_id for edges); tombstones come back empty."""
    gone = tombstones.select("doc_id").distinct()
    out = {}
    for name, t in tables.items():
        for c in [c for c in ("doc_id", "from_id", "to_id") if c in t.columns]:
            t = t.join(gone.select(F.col("doc_id").alias(c)), c, "left_anti")
        out[name] = t
    out["tombstones"] = tombstones.where(F.lit(False))
    return out
