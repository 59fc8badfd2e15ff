"""Small files and folders of a stored index on any file system that Spark reaches, from the driver."""

from __future__ import annotations

import fcntl
import os
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Folder:
    """A folder by its path or URI; names inside it are relative."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def local_path(self) -> str | None:
        """The folder on this machine, if its file system is the local one."""
        uri = self._fs.makeQualified(self._at("")).toUri()
        return uri.getPath() if uri.getScheme() == "file" else None

    def names(self, name: str = "") -> list[str]:
        """What a folder inside holds; nothing if it isn't there."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name)))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> str:
        source = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def write_new(self, name: str, text: str) -> None:
        """A file that comes into being whole; one of that name must not be there."""
        if self.exists(name):
            raise FileExistsError(name)
        temporary = f"_{name}.writing"
        out = self._fs.create(self._at(temporary), True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        if not self._fs.rename(self._at(temporary), self._at(name)):
            raise FileExistsError(name)

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    @contextmanager
    def lock(self, name: str):
        """Yields whether this process alone holds the lock; never waits.

        On the local file system the lock ends with the process. Elsewhere it is a file that only one
        can create; after a crash it has to be deleted by hand.
        """
        self._fs.mkdirs(self._at(""))
        local = self.local_path()
        if local is None:
            alone = self._fs.createNewFile(self._at(name))
            try:
                yield alone
            finally:
                if alone:
                    self.delete(name)
            return
        with open(os.path.join(local, name), "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError:
                yield False
                return
            yield True
