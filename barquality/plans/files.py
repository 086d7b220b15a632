"""Small files and folders through Hadoop's file systems, so any store that Spark reads will do."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Names are relative to a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _at(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.conf), path

    def read(self, name: str) -> str | None:
        fs, path = self._at(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def add(self, name: str, text: str) -> None:
        """A new file that appears whole; FileExistsError if one is there already, whoever writes at the same time.

        File systems of a cluster refuse a rename onto a file; a local one
        replaces it, but refuses a link.
        """
        fs, new = self._at(f"staging/{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        _, path = self._at(name)
        fs.mkdirs(path.getParent())
        try:
            if fs.exists(path):
                raise FileExistsError(str(path))
            if fs.getUri().getScheme() == "file":
                local = self.jvm.java.nio.file.Paths
                none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("java.lang.String"), 0)
                self.jvm.java.nio.file.Files.createLink(local.get(path.toUri().getPath(), none), local.get(new.toUri().getPath(), none))
                fs.delete(new, False)
            elif not fs.rename(new, path):
                raise FileExistsError(str(path))
        except Exception as e:
            fs.delete(new, False)
            if isinstance(e, FileExistsError) or "FileAlreadyExists" in str(e):
                raise FileExistsError(str(path)) from e
            raise

    def children(self, name: str) -> list[str]:
        fs, path = self._at(name)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def matching(self, pattern: str) -> list[tuple[str, float]]:
        """Names below the root that match a pattern, and when each was changed, in seconds since 1970."""
        fs, path = self._at(pattern)
        _, root = self._at("")
        length = len(fs.makeQualified(root).toString()) + 1
        return [(s.getPath().toString()[length:], s.getModificationTime() / 1000) for s in fs.globStatus(path) or []]

    def move(self, old: str, new: str) -> None:
        """Rename a folder, where it is there."""
        fs, path = self._at(old)
        if fs.exists(path):
            _, to = self._at(new)
            fs.mkdirs(to.getParent())
            fs.rename(path, to)

    def delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)
