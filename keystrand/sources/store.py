"""Small files through the Hadoop file system, so that any store Spark knows will do."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: File systems whose files appear when they are closed and can't be renamed in one step.
OBJECT_STORES = ("s3a", "s3", "gs", "abfs", "abfss", "wasb", "wasbs", "oss")


def _taken(e: Exception) -> bool:
    return any(x in str(e) for x in ("AlreadyExists", "already exists", "PreconditionFailed", "412"))


class Store:
    """Lists, reads, creates and deletes files under a folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.path(name)))

    def names(self, folder: str) -> list[str]:
        """Names in a folder, none if there is no such folder."""
        at = self._path(self.path(folder))
        if not self._fs.exists(at):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at))

    def files(self, folder: str) -> dict[str, int]:
        """Paths (relative to the root) and sizes of all files below a folder."""
        at = self._path(self.path(folder))
        if not self._fs.exists(at):
            return {}
        base = self._fs.makeQualified(self._path(self.root)).toUri().getPath().rstrip("/") + "/"
        found, walk = {}, self._fs.listFiles(at, True)
        while walk.hasNext():
            s = walk.next()
            found[s.getPath().toUri().getPath().removeprefix(base)] = s.getLen()
        return found

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.path(name)))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def modified(self, folder: str) -> dict[str, float]:
        """When each file below a folder was last changed, in seconds since 1970."""
        at = self._path(self.path(folder))
        if not self._fs.exists(at):
            return {}
        base = self._fs.makeQualified(self._path(self.root)).toUri().getPath().rstrip("/") + "/"
        found, walk = {}, self._fs.listFiles(at, True)
        while walk.hasNext():
            s = walk.next()
            found[s.getPath().toUri().getPath().removeprefix(base)] = s.getModificationTime() / 1000
        return found

    def create(self, name: str, content: str) -> bool:
        """Writes a file that must not exist yet; False if it does.  One step decides and shows the
        whole content, so a writer that dies leaves nothing that stands in another's way.

        Local files are linked and those of a file system with atomic renames renamed, both only
        where the name is free.  Object stores show a file when it is closed; that of two writers
        one fails there needs their conditional writes to be on."""
        target = self._path(self.path(name))
        if self._fs.exists(target):
            return False
        scheme = self._fs.getUri().getScheme()
        if scheme in OBJECT_STORES:
            try:
                self._put(target, content)
            except Exception as e:  # noqa: BLE001
                if _taken(e):
                    return False
                raise
            return True
        part = self._path(self.path(f"{name}.{uuid.uuid4().hex}.part"))
        self._put(part, content)
        jvm = self.spark._jvm
        try:
            if scheme == "file":
                local = lambda p: jvm.java.io.File(self._fs.makeQualified(p).toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(target), local(part))
            else:
                none = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(part, target, none)
        except Exception as e:  # noqa: BLE001
            if _taken(e):
                return False
            raise
        finally:
            self._fs.delete(part, False)
        return True

    def _put(self, path, content: str) -> None:
        out = self._fs.create(path, False)
        try:
            out.write(bytearray(content.encode()))
            out.hsync()
        finally:
            out.close()

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._path(self.path(name)), True)
