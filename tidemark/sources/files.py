"""Small files through Hadoop's file system API, so that any store that Spark reads will do."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Files:
    """The files under one folder. Names are relative to it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        path = self._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self._fs.makeQualified(path).toString().rstrip("/")
        self.local = self.root.removeprefix("file:") if self.root.startswith("file:") else None

    def path(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def names(self, folder: str) -> list[str]:
        if self.local:
            return sorted(n for n in os.listdir(f"{self.local}/{folder}") if not n.endswith(".tmp")) if os.path.isdir(f"{self.local}/{folder}") else []
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> bytes:
        if self.local:
            with open(f"{self.local}/{name}", "rb") as f:
                return f.read()
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def publish(self, name: str, data: bytes, sync: bool) -> bool:
        """Make a whole file appear under a new name, or not at all; False if the name is taken."""
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        if self.local:
            part, whole = f"{self.local}/{temporary}", f"{self.local}/{name}"
            with open(part, "wb") as f:
                f.write(data)
                if sync:
                    f.flush()
                    os.fsync(f.fileno())
            try:
                os.link(part, whole)
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
            if sync:
                _sync(os.path.dirname(whole))
            return True
        stream = self._fs.create(self._path(temporary), False)
        try:
            stream.write(data)
            stream.hsync() if sync else None
        finally:
            stream.close()
        if self._fs.exists(self._path(name)) or not self._fs.rename(self._path(temporary), self._path(name)):
            self._fs.delete(self._path(temporary), False)
            return False
        return True

    def sync_folder(self, name: str) -> None:
        """Make a local folder's entries durable, with the files below it (other stores are durable on close)."""
        if not self.local:
            return
        for top, _, files in os.walk(f"{self.local}/{name}"):
            for f in [*(os.path.join(top, x) for x in files), top]:
                _sync(f)

    def delete(self, name: str) -> None:
        if self.local and os.path.isfile(f"{self.local}/{name}"):
            os.unlink(f"{self.local}/{name}")
            return
        self._fs.delete(self._path(name), True)


def _sync(path: str) -> None:
    handle = os.open(path, os.O_RDONLY)
    try:
        os.fsync(handle)
    finally:
        os.close(handle)
