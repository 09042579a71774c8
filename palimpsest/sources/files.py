"""Small metadata files, through Hadoop's file systems: any store that Spark reads."""

from __future__ import annotations

import json
import tempfile
from typing import Any

from pyspark.sql import SparkSession

from ..errors import ConfigurationError


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset, a folder of our own,
    but only in a session whose executors are this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ConfigurationError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, uri: str):
        path = self._jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(self._conf), path

    def exists(self, uri: str) -> bool:
        fs, path = self._at(uri)
        return fs.exists(path)

    def delete(self, uri: str) -> None:
        fs, path = self._at(uri)
        fs.delete(path, True)

    def children(self, uri: str) -> list[str]:
        fs, path = self._at(uri)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def size(self, uri: str) -> int:
        fs, path = self._at(uri)
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    def room(self, uri: str) -> int:
        """Bytes that the store of ``uri`` says are free."""
        fs, path = self._at(uri)
        return fs.getStatus().getRemaining()

    def read_text(self, uri: str) -> str:
        fs, path = self._at(uri)
        stream = fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create_new(self, uri: str, text: str) -> bool:
        """False if the file exists already.  Exclusive where the store's create is
        (local disks, HDFS); stores that only overwrite, such as s3a, need one writer."""
        fs, path = self._at(uri)
        fs.mkdirs(path.getParent())
        try:
            out = fs.create(path, False)
        except Exception as e:
            if fs.exists(path):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read_json(self, uri: str) -> Any:
        return json.loads(self.read_text(uri))
