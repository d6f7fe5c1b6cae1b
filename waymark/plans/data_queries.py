"""Queries of the data problems that belong to the core: 1, 5 and 7."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import changefeed, incremental, references
from waymark.plans.registry import Registry
from waymark.runtime import table

DATA = Registry()

CURRENT_FETCH = """
  SELECT file_path, content_hash FROM (
    SELECT *, row_number() OVER (PARTITION BY file_path
      ORDER BY updated_at DESC, (content_hash IS NOT NULL) DESC, fetch_id DESC) AS rn
    FROM item_fetches WHERE file_path IS NOT NULL)
  WHERE rn = 1"""


@DATA.add("p1_found", f"""
SELECT DISTINCT c.file_path FROM ({CURRENT_FETCH}) c
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.file_path = c.file_path AND d.blake3_hash = c.content_hash)""")
def p1_found(spark, d):
    docs = table(spark, d, "documents")
    return incremental.pending_fetches(table(spark, d, "item_fetches"), docs).select("file_path")


@DATA.add("p1_actions", f"""
SELECT c.file_path,
  CASE WHEN c.content_hash IS NULL THEN 'unavailable' WHEN d.file_path IS NULL THEN 'insert'
       WHEN d.blake3_hash = c.content_hash THEN 'unchanged' ELSE 'update' END AS action
FROM ({CURRENT_FETCH}) c LEFT JOIN documents d ON d.file_path = c.file_path""")
def p1_actions(spark, d):
    """What the next run does with every delivered path."""
    docs = table(spark, d, "documents").select(F.col("file_path").alias("_path"), "blake3_hash")
    cur = incremental.current_fetches(table(spark, d, "item_fetches"))
    action = (
        F.when(F.col("content_hash").isNull(), "unavailable").when(F.col("_path").isNull(), "insert").when(F.col("blake3_hash") == F.col("content_hash"), "unchanged").otherwise("update")
    )
    return cur.join(docs, F.col("file_path") == F.col("_path"), "left").select("file_path", action.alias("action"))


SECONDS = "CASE WHEN abs(updated_at) >= 100000000000 THEN updated_at // 1000 ELSE updated_at END"
CURRENT_ITEM = f"""
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY source_name, id ORDER BY {SECONDS} DESC NULLS LAST, feed_id DESC) AS rn
    FROM remote_items WHERE source_name IS NOT NULL AND id IS NOT NULL)
  WHERE rn = 1 AND NOT coalesce(deleted, false)"""


@DATA.add("p5_found", f"SELECT source_name, id, feed_id FROM ({CURRENT_ITEM})")
def p5_found(spark, d):
    return changefeed.current_items(table(spark, d, "remote_items")).select("source_name", "id", "feed_id")


@DATA.add("p5_current_state", f"""
SELECT source_name, id, synthetic_path, title, {SECONDS} AS updated_at FROM ({CURRENT_ITEM})""")
def p5_current_state(spark, d):
    """The live items with their columns, times in seconds."""
    now = changefeed.current_items(table(spark, d, "remote_items"))
    return now.select("source_name", "id", "synthetic_path", "title", changefeed.whole_seconds(F.col("updated_at")).alias("updated_at"))


LIVE = """
  SELECT d.doc_id, d.file_path FROM documents d WHERE NOT EXISTS (
    SELECT 1 FROM tombstones t WHERE t.doc_id = d.doc_id AND t.tombstoned_at >= d.last_indexed)"""
UNPERCENT = r"coalesce(try(url_decode(regexp_replace({0}, '%([0-9A-Fa-f]{{2}})', '%\1', 'g'))), {0})"
ORPHAN_ROWS = f"""
WITH live AS ({LIVE}),
file_names AS (SELECT file_path AS p, regexp_extract(file_path, '([^/]*)$', 1) AS f FROM live),
raw_names AS (SELECT p AS s FROM file_names UNION SELECT f FROM file_names UNION SELECT regexp_replace(f, '(.)\\.[^.]*$', '\\1') FROM file_names),
live_names AS (SELECT DISTINCT lower(nfc_normalize(trim(url_decode(s), E' \\t\\r\\n'))) AS s FROM raw_names),
refs AS (
  SELECT DISTINCT 'doc_links' AS ref_table, from_id AS owner_id, CAST(to_id AS VARCHAR) AS target, to_id, created_at AS t FROM doc_links
  UNION SELECT DISTINCT 'chunks', chunk_id, CAST(doc_id AS VARCHAR), doc_id, indexed_at FROM chunks),
pending AS (
  SELECT DISTINCT from_id AS owner_id, target_ref AS target, created_at AS t,
    lower(nfc_normalize(trim(url_decode(regexp_replace(target_ref, '[|#].*$', '', 's')), E' \\t\\r\\n'))) AS s FROM doc_links_pending),
judged AS (
  SELECT ref_table, owner_id, target, strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m') AS month, live.doc_id IS NULL AS orphan
  FROM refs LEFT JOIN live ON live.doc_id = refs.to_id
  UNION
  SELECT 'doc_links_pending', owner_id, target, strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m'), live_names.s IS NULL
  FROM pending LEFT JOIN live_names ON live_names.s = pending.s)
"""


def _reference_tables(spark, d):
    return [table(spark, d, t) for t in ("doc_links", "chunks", "doc_links_pending", "documents", "tombstones")]


@DATA.add("p7_found", ORPHAN_ROWS + "SELECT DISTINCT ref_table, owner_id, target FROM judged WHERE orphan")
def p7_found(spark, d):
    return references.orphans(*_reference_tables(spark, d)).select("ref_table", "owner_id", "target").distinct()


@DATA.add("p7_orphan_counts", ORPHAN_ROWS + """
SELECT ref_table, month, CAST(count(*) AS BIGINT) AS n_references, CAST(count(*) FILTER (WHERE orphan) AS BIGINT) AS n_orphans
FROM judged GROUP BY ALL""")
def p7_orphan_counts(spark, d):
    return references.orphan_counts(*_reference_tables(spark, d))
