"""What queries over a table folder keep: its key table, and an index of its notes and code, each built once a session.

They stand in the session's shared folder, under the application and the state of the
tables they were built from, so neither another session nor other tables meet them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.engine import Engine
from waymark.functions.keys import document_keys
from waymark.operators.ingest import content_hash
from waymark.runtime import Files, shared_folder, spread, table

#: The parser for documents of each source type that are stored as they were read.
PARSER_OF = {"obsidian": "markdown", "code": "code"}


def home(spark: SparkSession, d: str, what: str, *tables: str) -> str:
    """Where ``what`` made of these tables, as they are now, stands in this session."""
    files = Files(spark, d)
    state = "|".join(f"{d}/{t}:{files.modified(f'{d}/{t}.parquet')}" for t in tables)
    return f"{shared_folder(spark)}/waymark-{spark.sparkContext.applicationId}/{what}-{hashlib.sha256(state.encode()).hexdigest()[:16]}"


def doc_keys(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, bitmap_key of the documents, stored by key: a filter reads the row groups of its keys only, and no texts."""
    at = home(spark, d, "keys", "documents")
    if not Files(spark, at).exists(f"{at}/_SUCCESS"):
        docs = spread(table(spark, d, "documents").select("doc_id", "file_path", "source_type", "auto_type", "lang", "text"))
        # by key and document, so a key of a third of all documents is spread over files
        document_keys(docs).repartitionByRange("bitmap_key", "doc_id").sortWithinPartitions("bitmap_key", "doc_id").write.mode("overwrite").parquet(at)
    return spark.read.schema("doc_id long, bitmap_key string").parquet(at)


def note_files(spark: SparkSession, d: str) -> DataFrame:
    """The notes and code among the documents as a file table: file_path, content, content_hash, parser."""
    docs = spread(table(spark, d, "documents").select("file_path", "source_type", "text")).where(F.col("source_type").isin(*PARSER_OF) & F.col("text").isNotNull())
    content = F.col("text").cast("binary")
    parser = F.when(F.col("source_type") == "obsidian", "markdown").otherwise("code")
    return docs.select("file_path", content.alias("content"), content_hash(content).alias("content_hash"), parser.alias("parser"))


class Indexed:
    """An index of the notes and code of ``d`` after a first run and, without the documents that tombstones name, a second."""

    def __init__(self, spark: SparkSession, d: str):
        self.home = home(spark, d, "index", "documents", "tombstones")
        self.engine = Engine(spark, f"{self.home}/tables")
        self.counts = {}
        files = Files(spark, self.home)
        for run in (1, 2):
            if not files.exists(f"{self.home}/run-{run}"):
                found = note_files(spark, d)
                if run == 2:
                    gone = table(spark, d, "documents").join(table(spark, d, "tombstones").select("doc_id"), "doc_id", "left_semi").select("file_path")
                    found = found.join(gone, "file_path", "left_anti")
                done = self.engine.sync(found, run).first()
                files.write_once(f"{self.home}/run-{run}", ",".join(str(x) for x in done))
            self.counts[run] = [int(x) for x in files.read(f"{self.home}/run-{run}").split(",")]

    def run(self, number: int) -> DataFrame:
        return self.engine.spark.createDataFrame([tuple(self.counts[number])], "indexed long, updated long, skipped long, tombstoned long")
