"""Tables in Parquet folders that are replaced as a whole: written beside, then pointed to."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _local_folder(_: str) -> str:
    return tempfile.mkdtemp(prefix="quarry-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where it is unset, a temporary one on a local master;
    on a cluster that is an error."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not re.match(r"local($|\[)", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local_folder(sc.applicationId)


class Table:
    """A table whose versions are folders. Pointer files _at-N, each created once and never changed, name them; the complete
    one of the highest N counts. Readers see the old version or the new one, also where a writer stops between any two steps;
    of two writers that start from the same version one fails. Any Hadoop file system will do."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, start: str) -> list[str]:
        top = self._path(self.path)
        if not self._fs.exists(top):
            return []
        return sorted(n for x in self._fs.listStatus(top) if (n := x.getPath().getName()).startswith(start))

    def _pointer(self, name: str) -> tuple[str, str] | None:
        """Version and token; None for a pointer that was not written to its end."""
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            line = stream.readAllBytes().decode()
        finally:
            stream.close()
        version, _, token = line.rstrip("\n").partition(" ")
        return (version, token) if line.endswith("\n") else None

    def _current(self) -> tuple[str, str] | None:
        return next((x for name in reversed(self._names("_at-")) if (x := self._pointer(name))), None)

    def exists(self) -> bool:
        return self._current() is not None

    def read(self) -> DataFrame:
        current = self._current()
        if current is None:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/{current[0]}")

    def replace(self, rows: DataFrame, *, token: str = "", by: list[str] = ()) -> None:
        """Writes a new version and makes it current. A token that the current version has is taken as done already."""
        self.publish(lambda folder: (rows.write.partitionBy(*by) if by else rows.write).parquet(folder), token=token)

    def publish(self, write: Callable[[str], None], *, token: str = "") -> None:
        """The same for what `write` puts into the new version's folder."""
        names, current = self._names("_at-"), self._current()
        if token and current and current[1] == token:
            return
        version = f"v-{uuid.uuid4().hex}"
        write(f"{self.path}/{version}")
        self._point(f"_at-{int(names[-1][4:]) + 1 if names else 0:012d}", f"{version} {token}\n")

    def folder(self) -> str | None:
        """Where the current version is."""
        current = self._current()
        return current and f"{self.path}/{current[0]}"

    def _point(self, name: str, line: str) -> None:
        out = self._fs.create(self._path(f"{self.path}/{name}"), False)  # fails if another writer has made it
        out.writeBytes(line)
        out.close()

    def vacuum(self) -> None:
        """Removes versions that aren't current, and earlier pointers."""
        current = self._current()
        for name in self._names("v-"):
            if current is None or name != current[0]:
                self._fs.delete(self._path(f"{self.path}/{name}"), True)
        pointers = self._names("_at-")
        last = next((n for n in reversed(pointers) if self._pointer(n)), None)
        for name in pointers:
            if last is not None and name < last:
                self._fs.delete(self._path(f"{self.path}/{name}"), False)

    def append(self, rows: DataFrame) -> None:
        self.replace(self.read().unionByName(rows, allowMissingColumns=True) if self.exists() else rows)

    def upsert(self, rows: DataFrame, keys: list[str], order: str | None = None) -> None:
        from ..operators.ledger import upsert

        self.replace(upsert(self.read() if self.exists() else rows.limit(0), rows, keys, order))

    def delete(self, gone: DataFrame, keys: list[str]) -> None:
        self.replace(self.read().join(gone.select(*keys).distinct(), keys, "left_anti"))

    def delete_where(self, condition) -> None:
        self.replace(self.read().where(~F.coalesce(condition, F.lit(False))))

    def drop(self) -> None:
        self._fs.delete(self._path(self.path), True)
