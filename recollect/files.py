"""A folder on any file system that Hadoop reaches: local disk, HDFS or an object store."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def make(self) -> None:
        self.fs.mkdirs(self._path(""))

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """Children that aren't hidden, sorted."""
        at = self._path(name)
        if not self.fs.exists(at):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self.fs.listStatus(at)) if n[0] not in "._")

    def read(self, name: str) -> str:
        at = self._path(name)
        stream = self.fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str = "") -> bool:
        """False if there is such a file already."""
        try:
            stream = self.fs.create(self._path(name), False)
        except Exception as e:  # py4j wraps the JVM's error
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def replace(self, name: str, text: str) -> None:
        """The file holds either the old or the new text, whenever it is read."""
        staged = f"{name}.{uuid.uuid4().hex}"
        self.create(staged, text)
        fs = self.jvm.org.apache.hadoop.fs
        over = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        over[0] = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getEnumConstants()[1]  # OVERWRITE
        fs.FileContext.getFileContext(self._path("").toUri() if self._path("").toUri().getScheme() else self.fs.getUri(), self.conf).rename(self._path(staged), self._path(name), over)

    def delete(self, name: str = "") -> bool:
        return self.fs.delete(self._path(name), True)

    def size(self, name: str = "") -> int:
        return self.fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0
