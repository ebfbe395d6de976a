"""Sums by month that grow by appending: what a batch adds is written once, and merged a few times later."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONTH = "month"
PART = "part"


def file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Paths below ``path`` that match ``pattern``."""
    folder, fs = file_system(spark, path)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, pattern))
    return [f.getPath().toString() for f in found or []]


def delete(spark: SparkSession, path: str) -> None:
    folder, fs = file_system(spark, path)
    fs.delete(folder, True)


@dataclass
class SumLog:
    """Rows of ``keys``, ``month`` and measures below ``path``, equal keys to be added up.

    ``entries`` are (month, part, level): a batch's own part has level 0, ``fan`` parts of a month and
    level are merged into one of the next.  A row is so written once for its batch and once more for
    each level, whose number grows as the logarithm of the batches.  The caller keeps ``entries`` (see
    ``rows``) with its batch number; parts of a batch that is repeated are overwritten by it.
    """

    path: str
    keys: Sequence[str]
    schema: T.StructType
    entries: list[tuple[str, str, int]] = field(default_factory=list)
    fan: int = 8

    def _folder(self, part: str, month: str) -> str:
        return f"{self.path}/{PART}={part}/{MONTH}={month}"

    def _write(self, rows: DataFrame, part: str) -> list[str]:
        """The months that ``rows`` hold, written as ``part``."""
        path = f"{self.path}/{PART}={part}"
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(MONTH).parquet(path)
        return sorted(p.rsplit("=", 1)[1] for p in listed(rows.sparkSession, path, f"{MONTH}=*"))

    def read(self, spark: SparkSession, entries: Sequence[tuple[str, str, int]]) -> DataFrame:
        """The parts as they are: keys may repeat."""
        if not entries:
            return spark.createDataFrame([], self.schema)
        paths = [self._folder(part, month) for month, part, _ in entries]
        return spark.read.schema(self.schema).option("basePath", self.path).parquet(*paths).select(*self.schema.names)

    def sums(self, spark: SparkSession, months: Sequence[str] | None = None, since: str | None = None) -> DataFrame:
        """One row a key: of some months, or of those from ``since`` on."""
        chosen = [e for e in self.entries if (months is None or e[0] in months) and (since is None or e[0] >= since)]
        return self._added(self.read(spark, chosen))

    def _added(self, rows: DataFrame) -> DataFrame:
        measures = [c for c in self.schema.names if c not in (*self.keys, MONTH)]
        sums = [F.sum(c).cast(self.schema[c].dataType).alias(c) for c in measures]
        return rows.groupBy(*self.keys, MONTH).agg(*sums).select(*self.schema.names)

    def append(self, rows: DataFrame, number: int) -> list[str]:
        """Add a batch's own sums; the months that it touches."""
        spark = rows.sparkSession
        months = self._write(rows, str(number))
        self.entries += [(m, str(number), 0) for m in months]
        level = 0
        while True:
            full = [m for m in {m for m, _, at in self.entries if at == level}
                    if sum(e[0] == m and e[2] == level for e in self.entries) >= self.fan]
            if not full:
                return months
            merged = [e for e in self.entries if e[0] in full and e[2] == level]
            part = f"{number}-{level + 1}"
            done = self._write(self._added(self.read(spark, merged)), part)
            self.entries = [e for e in self.entries if e not in merged] + [(m, part, level + 1) for m in done]
            level += 1

    def sweep(self, spark: SparkSession, keep: Sequence[tuple[str, str, int]]) -> None:
        """Delete parts that neither these entries nor ``keep`` name."""
        named = {part for _, part, _ in [*self.entries, *keep]}
        for path in listed(spark, self.path, f"{PART}=*"):
            if path.rsplit("=", 1)[1] not in named:
                delete(spark, path)
