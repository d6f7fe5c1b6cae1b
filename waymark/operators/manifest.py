"""Numbered manifests: a table is the list of folders that its newest manifest names."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from waymark.runtime import Files


class ConcurrentCommit(RuntimeError):
    """Another writer committed the same version first; read again and retry."""


class ManifestTable:
    """Folders of Parquet files under ``root`` made visible by one atomic rename a version.

    A run that dies before its manifest is renamed leaves unreferenced folders and
    nothing else: readers go on with the version before, and the next run writes
    its own folders. ``parts`` maps a kind ("data", "deletes") to folder names.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._files = Files(spark, self.root)

    def version(self) -> int:
        """The newest committed version; 0 for a table never written."""
        names = self._files.list(f"{self.root}/manifests")
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def parts(self, version: int | None = None) -> dict[str, list[str]]:
        v = self.version() if version is None else version
        return json.loads(self._files.read(f"{self.root}/manifests/{v:012d}.json")) if v else {}

    def read(self, kind: str, version: int | None = None) -> DataFrame | None:
        folders = self.parts(version).get(kind, [])
        return self.spark.read.parquet(*(f"{self.root}/{f}" for f in folders)) if folders else None

    def stage(self, kind: str, df: DataFrame) -> str:
        """Write ``df`` into a folder of its own that no manifest names yet."""
        folder = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder

    def commit(self, added: dict[str, list[str]], base: int, replace: bool = False) -> int:
        """Publish version base + 1 with the staged folders added, or in place of the old ones."""
        parts = {} if replace else self.parts(base)
        for kind, folders in added.items():
            parts[kind] = parts.get(kind, []) + folders
        if not self._files.write_once(f"{self.root}/manifests/{base + 1:012d}.json", json.dumps(parts)):
            raise ConcurrentCommit(f"version {base + 1} of {self.root} exists")
        return base + 1
