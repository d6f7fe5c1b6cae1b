"""Session helpers shared by the operators: tables, lineage cuts and file-system moves."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor reaches; where none is set, one of this machine if the session runs on it alone, else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="waymark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint, which outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=eager)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer splits than there are cores, as one small file has; for stages of Python that would leave cores idle.

    A table with splits enough comes back as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Files:
    """The few file-system calls that commits need.

    Commits rest on a rename that is refused where the target exists. Local file systems,
    HDFS and Azure's hierarchical stores have one; on other stores a commit is refused.
    """

    ATOMIC = ("file", "hdfs", "viewfs", "abfs", "abfss")

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._root = self._path(root)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def list(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(name)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_once(self, name: str, text: str) -> bool:
        """Write ``name`` whole or not at all; False if it is there already.

        The text goes to a hidden sibling first and is renamed into place, so no
        reader sees half of it and of two writers one loses.
        """
        if self._fs.getScheme() not in self.ATOMIC:
            raise NotImplementedError(f"{self._fs.getScheme()} has no rename that two writers can't both win")
        target = self._path(name)
        self._fs.mkdirs(target.getParent())
        tmp = self._path(f"{target.getParent()}/.{target.getName()}.{self._jvm.java.util.UUID.randomUUID()}")
        stream = self._fs.create(tmp, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self._fs.exists(target) or not self._fs.rename(tmp, target):
            self._fs.delete(tmp, False)
            return False
        return True

    def modified(self, name: str) -> int:
        """When a file or folder, or the newest file in it, was last changed; 0 if it isn't there."""
        if not self.exists(name):
            return 0
        path = self._path(name)
        return max([self._fs.getFileStatus(path).getModificationTime(), *(x.getModificationTime() for x in self._fs.listStatus(path))])

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
