"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder from ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder of its own; a cluster gets an
    error, since a folder of one machine would be invisible to the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    folder = tempfile.mkdtemp(prefix="lectern-")
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}"


class Files:
    """Names of files under a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._path, self.root = spark._jvm.org.apache.hadoop.fs.Path, root
        self._system = self._path(root).getFileSystem(spark._jsparkSession.sparkContext().hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        """What is in a folder; nothing, if there is no such folder."""
        return sorted(s.getPath().getName() for s in self._system.listStatus(self._at(folder))) if self.exists(folder) else []

    def exists(self, name: str = "") -> bool:
        return self._system.exists(self._at(name))

    def remove(self, name: str) -> None:
        self._system.delete(self._at(name), True)

    def remove_at_end(self) -> None:
        """The folder goes when the application ends."""
        self._system.deleteOnExit(self._at(""))


def files_of(spark: SparkSession, root: str) -> Files:
    return Files(spark, root)


def passing_path(spark: SparkSession) -> str:
    """A new path in the shared folder whose files go when the application ends."""
    path = fresh_path(spark)
    files_of(spark, path).remove_at_end()
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage and gives Spark true sizes."""
    path = passing_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*settled: DataFrame) -> None:
    """Delete the files of tables that ``settle`` gave and that nothing reads any more."""
    for df in settled:
        for folder in {unquote(f).rsplit("/", 1)[0] for f in df.inputFiles()}:
            files_of(df.sparkSession, folder).remove("")
