"""Folders of any file system that Spark can reach, for what readers and writers do not do: list, size, delete."""

from urllib.parse import unquote

from pyspark.sql import SparkSession


def plain_path(file: str) -> str:
    """A path as readers take it, from one as they state it: without escapes, and local ones with a single slash."""
    return unquote(f"file:/{file.removeprefix('file:').lstrip('/')}" if file.startswith("file:/") else file)


class Folder:
    """A path and what lies directly below it."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._to_path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._to_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _below(self, name: str):
        return self._to_path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._files.exists(self._below(name))

    def names(self, name: str = "") -> list[str]:
        """Names of files and folders, none if the folder is not there."""
        if not self.exists(name):
            return []
        return sorted(status.getPath().getName() for status in self._files.listStatus(self._below(name)))

    def delete(self, name: str) -> None:
        """Delete a file or folder below this one; one that is gone already is no error."""
        if not name:
            raise ValueError("a name below the folder is needed")
        self._files.delete(self._below(name), True)

    def size_of(self, file: str) -> int:
        """Bytes of a file, given by its full path."""
        return self._files.getFileStatus(self._to_path(file)).getLen()
