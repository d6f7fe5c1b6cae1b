"""The chunk tree and chunk storage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.runtime import cut

#: Kinds that never hold other chunks.
FLAT = ("frontmatter", "body")


def nest(chunks: DataFrame) -> DataFrame:
    """chunk_id, doc_id, parent_chunk_id (null at the top), level (from 0), in byte order of each document.

    A chunk's parent is the last open chunk of smaller depth; a chunk closes all open ones
    of its depth or more; frontmatter and bodies close but never hold. Documents come as
    sorted streams and only the open chunks are held, so no document is gathered.
    Repeated rows of a chunk count once; null starts and depths are 0.
    """
    rows = chunks.select("doc_id", "chunk_id", F.coalesce("byte_start", F.lit(0)).cast("long").alias("at"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.lower("kind").isin(*FLAT).alias("flat"))
    rows = rows.where("doc_id IS NOT NULL AND chunk_id IS NOT NULL").dropDuplicates(["doc_id", "chunk_id"]).repartition("doc_id").sortWithinPartitions("doc_id", "at", "chunk_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, stack = None, []
        for pdf in batches:
            out = []
            for d, c, _, depth, flat in pdf.itertuples(index=False, name=None):
                if d != doc:
                    doc, stack = d, []
                while stack and stack[-1][1] >= depth:
                    stack.pop()
                out.append((c, d, stack[-1][0] if stack else None, len(stack)))
                if not flat:
                    stack.append((c, depth))
            yield pd.DataFrame(out, columns=["chunk_id", "doc_id", "parent_chunk_id", "level"]).astype({"parent_chunk_id": "Int64", "level": "int32"})

    return rows.mapInPandas(run, "chunk_id long, doc_id long, parent_chunk_id long, level int")


def next_ids(rows: DataFrame, existing: DataFrame, id_column: str, order: list[str]) -> DataFrame:
    """``rows`` with fresh ids above all existing ones, in ``order``.

    Rows are range-partitioned by the order; every partition is numbered by itself and
    shifted by the sizes of those before it, so no single task sees all rows.
    """
    top = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("long")).scalar()
    parts = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per partition
    numbered = parts.join(F.broadcast(before), F.col("_p") == F.col("_q"))
    return numbered.withColumn(id_column, top + F.col("_before") + (F.col("_m") - F.col("_p").cast("long") * (1 << 33)) + 1).drop("_p", "_m", "_q", "_before")


def replace_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of the documents in ``new`` replaced; the new ones get fresh ids, a contiguous run per document in byte order."""
    kept = chunks.join(new.select("doc_id").distinct(), "doc_id", "left_anti").select(*chunks.columns)
    fresh = next_ids(new.drop("chunk_id"), chunks, "chunk_id", ["doc_id", "byte_start"])
    return kept.unionByName(fresh.select(*kept.columns))
