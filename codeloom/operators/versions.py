"""Tables that are replaced as a whole, with numbered versions.

``path/rows-<id>`` holds the rows of one write and ``path/versions/<number>`` names
it. A version is made by creating that small file, which the file system lets one
writer do: of two writers that finish together each gets a number of its own, and
one that says which version its rows are based on is refused if another came
between. A job that dies before leaves rows that no version names; readers never
see them. A version whose rows were damaged or are gone is passed over for the one
before it, and without any the table counts as never written, so it is made anew.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


#: What Spark says of files that are gone or not whole; other errors, as of a cluster in trouble, are raised.
DAMAGE = ("PATH_NOT_FOUND", "FileNotFoundException", "CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE", "UNABLE_TO_INFER_SCHEMA", "is not a Parquet file", "ChecksumException")


class Conflict(Exception):
    """Another writer made a version since the one that the rows are based on."""


class Store:
    """A table of a project's state (file states, sections, chunks)."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list:
        at = self._path(folder)
        return list(self._files.listStatus(at)) if self._files.exists(at) else []

    def versions(self) -> list[int]:
        """Numbers of all versions, the last first."""
        names = (f.getPath().getName() for f in self._list(f"{self.path}/versions"))
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def _folder(self, version: int) -> str:
        stream = self._files.open(self._path(f"{self.path}/versions/{version:012}"))
        try:
            return f"{self.path}/{bytes(stream.readAllBytes()).decode()}"
        finally:
            stream.close()

    def _rows(self, version: int) -> DataFrame | None:
        """The rows of a version, null if they are not whole."""
        try:
            folder = self._folder(version)
            if not self._files.exists(self._path(f"{folder}/_SUCCESS")):
                return None
            self.spark.read.parquet(folder)  # reads the footers
            rows = self.spark.read.schema(self.schema).parquet(folder)
            rows.count()
            return rows
        except (PySparkException, Py4JJavaError) as e:
            if any(sign in str(e) for sign in DAMAGE):
                return None
            raise

    def current(self) -> tuple[int, DataFrame] | None:
        """The last version that can be read and its rows, null if there is none."""
        for version in self.versions():
            if (rows := self._rows(version)) is not None:
                return version, rows
        return None

    def read(self) -> DataFrame | None:
        """The current rows, null if nothing readable was ever written."""
        found = self.current()
        return None if found is None else found[1]

    def write(self, rows: DataFrame, based_on: int | None = None) -> int:
        """Write ``rows`` and make them the current version, whose number is given back.

        ``based_on`` (0: none): refuse if another version has come since.
        """
        folder = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        while True:
            last = max(self.versions(), default=0)
            if based_on is not None and last != based_on:
                raise Conflict(f"{self.path} is at version {last}, not {based_on}")
            if self._claim(last + 1, folder):
                return last + 1

    def _claim(self, version: int, folder: str) -> bool:
        at = self._path(f"{self.path}/versions/{version:012}")
        self._files.mkdirs(at.getParent())
        if not self._files.createNewFile(at):
            return False
        stream = self._files.create(at, True)
        stream.write(bytearray(folder.encode()))
        stream.close()
        return True

    def expire(self, keep: int = 2, age: float = 7 * 86_400.0) -> int:
        """Drop versions but the last ``keep``, and rows that no version names, once they are ``age`` seconds old; how many folders went.

        ``age`` has to be longer than any job that reads or writes the table.
        """
        versions = self.versions()
        held = {self._folder(v) for v in versions[:keep]}
        old = (time.time() - age) * 1000
        for version in versions[keep:]:
            at = self._path(f"{self.path}/versions/{version:012}")
            if self._files.getFileStatus(at).getModificationTime() <= old:
                self._files.delete(at, False)
            else:
                held.add(self._folder(version))
        gone = 0
        for status in self._list(self.path):
            name = status.getPath().getName()
            if name.startswith("rows-") and f"{self.path}/{name}" not in held and status.getModificationTime() <= old:
                gone += bool(self._files.delete(status.getPath(), True))
        return gone
