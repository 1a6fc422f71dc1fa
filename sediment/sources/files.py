"""File operations through Hadoop's interface, so that every file system that Spark reads can hold a table."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from sediment.model import CommitConflict


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._new_array = spark.sparkContext._gateway.new_array
        self.root = self._path(root)
        self._fs = self.root.getFileSystem(self._conf)
        self.root = self._fs.makeQualified(self.root)

    def _path(self, *parts: str):
        p = self._jvm.org.apache.hadoop.fs.Path(parts[0])
        for x in parts[1:]:
            p = self._jvm.org.apache.hadoop.fs.Path(p, x)
        return p

    def at(self, relative: str):
        return self._path(self.root.toString(), relative) if relative else self.root

    def uri(self, relative: str = "") -> str:
        return self.at(relative).toString()

    def make(self, relative: str = "") -> None:
        self._fs.mkdirs(self.at(relative))

    def exists(self, relative: str) -> bool:
        return self._fs.exists(self.at(relative))

    def entries(self, relative: str) -> list[tuple[str, int, int]]:
        """(name, bytes, milliseconds of the last change) of a folder's entries, in order of name; none if there is no folder."""
        if not self.exists(relative):
            return []
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in self._fs.listStatus(self.at(relative)))

    def list(self, relative: str) -> list[tuple[str, int]]:
        """(name, bytes) of a folder's entries."""
        return [(name, size) for name, size, _ in self.entries(relative)]

    def publish(self, relative: str, text: str) -> None:
        """Make a new file appear whole under its name; if there is one already, raise CommitConflict.

        The text is written and synced under a name of its own. Then the name is
        claimed by one atomic step that fails where the target exists: a hard link
        on a local file system, a rename without overwriting elsewhere. HDFS makes
        that rename atomic; a store that doesn't must not hold a commit log that
        several applications write.
        """
        folder, _, name = relative.rpartition("/")
        own = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self.at(own), False)
        try:
            out.write(bytearray(text.encode()))
            out.hsync()
        finally:
            out.close()
        target = self._fs.resolvePath(self.at(own)).getParent()
        try:
            if target.toUri().getScheme() == "file":
                java = self._jvm.java.nio.file
                at = lambda n: java.Paths.get(target.toUri()).resolve(n)
                java.Files.createLink(at(name), at(own.rpartition("/")[2]))
            else:
                never = self._new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(self.at(own), self.at(relative), never)
        except Exception as e:
            if self.exists(relative):
                raise CommitConflict(relative) from e
            raise
        finally:
            self._fs.delete(self.at(own), False)

    def read(self, relative: str) -> str:
        stream = self._fs.open(self.at(relative))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def delete(self, relative: str) -> None:
        self._fs.delete(self.at(relative), True)
