"""A folder of Parquet tables as a catalogue: read, replace, append, list."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from graphloom.operators import store


#: How the folder of rows that were added to a version ends.
ADDED = "-added"


class Catalog:
    """``catalog("functions")`` reads; writes go to a new version of the table and then its name moves.

    Versions are folders below the table's, numbered on from the last one.  The newest whole
    one is read together with what has been added since, so a reader sees either the old
    rows or the new ones.  Paths may be in any store that Spark reads; one writer a table.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[str]:
        at = self._path(f"{self.root}/{name}")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(n for n in names if n.startswith("v") and self._fs.exists(self._path(f"{self.root}/{name}/{n}/_SUCCESS")))

    def _live(self, name: str) -> list[str]:
        """The newest whole version and all that was added to it."""
        versions = self._versions(name)
        whole = max((i for i, v in enumerate(versions) if not v.endswith(ADDED)), default=0)
        return versions[whole:]

    def _next(self, name: str) -> str:
        versions = self._versions(name)
        n = int(versions[-1][1:9]) + 1 if versions else 0
        return f"{self.root}/{name}/v{n:08d}-{uuid.uuid4().hex[:8]}"

    def __call__(self, name: str) -> DataFrame:
        live = self._live(name)
        if not live:
            raise KeyError(f"no table {name} in {self.root}")
        return self.spark.read.parquet(*[f"{self.root}/{name}/{v}" for v in live])

    def names(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory())

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def replace(self, name: str, rows: DataFrame) -> None:
        rows.write.parquet(self._next(name))

    def append(self, name: str, rows: DataFrame) -> None:
        """Writes only the new rows, in the table's columns and types; a row that lacks one, or has another, is refused."""
        if not self.exists(name):
            return self.replace(name, rows)
        have = self(name).schema
        if sorted(have.names) != sorted(rows.columns):
            raise ValueError(f"{name} has the columns {have.names}, not {rows.columns}")
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in have]).write.parquet(self._next(name) + ADDED)

    def upsert(self, name: str, rows: DataFrame, key: list[str]) -> None:
        self.replace(name, store.upsert(self(name), rows, key) if self.exists(name) else rows)

    def write_batch(self, batch: dict[str, DataFrame], keys: dict[str, list[str]]) -> None:
        """One set-based write for each table of the batch."""
        for name, rows in batch.items():
            self.upsert(name, rows, keys[name])

    def forget(self, name: str, keep: int = 2) -> None:
        """Removes all but the newest whole versions and what was added to them."""
        versions = self._versions(name)
        whole = [v for v in versions if not v.endswith(ADDED)]
        for v in versions:
            if keep < len(whole) and v < whole[-keep]:
                self._fs.delete(self._path(f"{self.root}/{name}/{v}"), True)


def raw_query(spark: SparkSession, text: str, tables: dict[str, DataFrame], **parameters) -> DataFrame:
    """SQL over named tables, with :name parameters; nothing is pasted into the text."""
    views = []
    try:
        for name, rows in tables.items():
            rows.createOrReplaceTempView(name)
            views.append(name)
        return spark.sql(text, args=parameters)
    except AnalysisException as e:
        raise ValueError(str(e).splitlines()[0]) from e
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
