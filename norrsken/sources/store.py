"""Small files of a shared folder through the session's Hadoop file system: listing, reading, publishing once."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    """A folder on whatever storage Spark reads. Only names and short texts pass through the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._utf8 = spark.sparkContext._jvm.java.nio.charset.StandardCharsets.UTF_8
        self._io = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        """Names below a folder, sorted; none if it does not exist."""
        if not self._fs.exists(self._at(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._io.toString(stream, self._utf8)
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write a file whole or not at all; False if it is there already.

        The text goes to a file of its own first, so that readers never see a part of it; renaming does not
        replace an existing file.
        """
        if self._fs.exists(self._at(name)):
            return False
        draft = self._at(f"{name}.{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self._fs.rename(draft, self._at(name)):
            return True
        self._fs.delete(draft, False)
        return False

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
