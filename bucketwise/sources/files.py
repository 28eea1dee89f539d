"""Small files and folders of the file system behind a path, whichever Spark is set up for."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Names, short texts and removal; data goes through Spark's readers and writers."""

    def __init__(self, spark: SparkSession):
        self._spark = spark

    def _at(self, path: str):
        where = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self._spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        where, system = self._at(path)
        return system.exists(where)

    def names(self, folder: str) -> list[str]:
        """What lies in a folder, without hidden files; nothing if there is no such folder."""
        where, system = self._at(folder)
        if not system.exists(where):
            return []
        found = [entry.getPath().getName() for entry in system.listStatus(where)]
        return [n for n in found if not n.startswith((".", "_")) or n.startswith("__")]

    def text(self, path: str) -> str:
        where, system = self._at(path)
        stream = system.open(where)
        try:
            return self._spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, path: str, text: str) -> None:
        """Write a short text; it appears under its name whole or not at all."""
        where, system = self._at(path)
        draft, _ = self._at(f"{path.rsplit('/', 1)[0]}/.draft-{uuid.uuid4().hex}")
        stream = system.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not system.rename(draft, where):
            raise OSError(f"could not put {path} in place")

    def remove(self, path: str) -> None:
        where, system = self._at(path)
        system.delete(where, True)
