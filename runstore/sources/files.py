"""The few file operations a store needs, on whatever file system its path names."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def list(self, path: str) -> list[tuple[str, int]]:
        """(name, bytes) of what lies in a folder; nothing if there is none."""
        at = self._path(path)
        return [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def ages(self, path: str) -> dict[str, float]:
        """Seconds since each file or folder in a folder was changed."""
        at = self._path(path)
        now = time.time()
        return {x.getPath().getName(): now - x.getModificationTime() / 1000 for x in self._fs.listStatus(at)} if self._fs.exists(at) else {}

    def put_if_absent(self, path: str, text: str) -> bool:
        """Write a small file that must not be there yet; one writer alone can create it."""
        at = self._path(path)
        if self._fs.exists(at):
            return False
        try:
            out = self._fs.create(at, False)
        except Exception:
            return False
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))
