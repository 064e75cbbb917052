"""Folders that driver and executors share, and steps of iterations that are written there."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on one machine without that setting a temporary one, removed at exit.

    On a cluster, whose executors could not see a temporary folder, that is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="waymark-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write a step to the shared folder and read it again, so that plans don't grow with the rounds."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Files:
    """The few calls of Spark's own file systems that tables need, so that any store that Spark reaches will do."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.at(path).getFileSystem(self._conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)

    def at(self, path: str):  # noqa: ANN201
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self.at(path))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.at(folder))) if self.exists(folder) else []

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self.at(path)).getLength()

    def remove(self, path: str) -> None:
        self._fs.delete(self.at(path), True)

    def text(self, path: str) -> str:
        stream = self._fs.open(self.at(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, path: str, text: str) -> bool:
        """Write a file whole or not at all; False if it is there already. The rename is the one moment that counts."""
        beside = f"{path}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self.at(beside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        options[0] = rename.NONE
        try:
            self._context.rename(self.at(beside), self.at(path), options)
        except Exception:
            self.remove(beside)
            if self.exists(path):
                return False
            raise
        return True

    def copy(self, source: str, target: str) -> None:
        """Copy a file or folder, which may lie in another store."""
        util = self._jvm.org.apache.hadoop.fs.FileUtil
        from_ = self.at(source)
        util.copy(from_.getFileSystem(self._conf), from_, self._fs, self.at(target), False, self._conf)
