"""Tables that grow batch by batch on shared storage, for streams that may run a batch again.

A batch's rows go to folders of its number, and a marker file, written when all of them are complete, makes them visible, all tables of the
batch at once. A batch that failed half way stays invisible and overwrites its own folders when it runs again; one that is already marked is left
alone, so a replay changes nothing. Readers list markers, never data folders.

Defined results: a table that no committed batch holds is empty; a batch may lack any of the tables; numbers need not be
gapless; rows of one batch may be null in any column but the key of a KeyedTable.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..work import CODEC


def as_schema(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


class BatchStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._root = self._at(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _marker(self, kind: str, number: int):
        return self._at(f"{self.path}/_{kind}/{number}")

    def _numbers(self, kind: str) -> list[int]:
        at = self._at(f"{self.path}/_{kind}")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _mark(self, kind: str, number: int) -> bool:
        """Put the marker where there is none; whether this call did."""
        try:
            self._fs.create(self._marker(kind, number), False).close()
        except Exception as e:  # the JVM's, by name
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        return True

    def committed(self) -> list[int]:
        return self._numbers("commits")

    def holds(self, number: int) -> bool:
        return self._fs.exists(self._marker("commits", number))

    def write(self, number: int, tables: Mapping[str, DataFrame]) -> bool:
        """All tables of a batch, or nothing where the batch is committed; whether it wrote."""
        if self.holds(number):
            return False
        for name, df in tables.items():
            df.write.mode("overwrite").options(**CODEC).parquet(f"{self.path}/{name}/batch={number}")
        return self._mark("commits", number)

    def _folders(self, name: str, numbers: list[int]) -> list[str]:
        every = [f"{self.path}/{name}/batch={n}" for n in numbers]
        return [f for f in every if self._fs.exists(self._at(f))]

    def read(self, name: str, schema: T.StructType | str) -> DataFrame:
        """The committed rows of a table with their batch number in `batch`."""
        with_batch = T.StructType([f for f in as_schema(schema) if f.name != "batch"]).add("batch", "long")
        folders = self._folders(name, self.committed())
        if not folders:
            return self.spark.createDataFrame([], with_batch)
        return self.spark.read.schema(with_batch).option("basePath", f"{self.path}/{name}").parquet(*folders)


class KeyedTable(BatchStore):
    """One table in which the newest batch's row of a key stands. Batches are changes; when there are `fold` of them they are folded with
    the last whole table into a new one, beside the old files, which readers may still have open and which go at the folding after."""

    NAME = "rows"

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType | str, fold: int = 20) -> None:
        super().__init__(spark, path)
        self.key, self.schema, self.fold = key, as_schema(schema), fold

    def _base(self) -> int:
        return max(self._numbers("bases"), default=-1)

    def holds(self, number: int) -> bool:
        return number <= self._base() or super().holds(number)

    def upsert(self, number: int, changes: DataFrame) -> bool:
        """changes: at most one row a key."""
        wrote = self.write(number, {self.NAME: changes.select(*self.schema.names)})
        base = self._base()
        later = [n for n in self.committed() if n > base]
        if len(later) >= self.fold:
            self._fold(base, later[-1])
        return wrote

    def _fold(self, old: int, new: int) -> None:
        self.latest().write.mode("overwrite").options(**CODEC).parquet(f"{self.path}/base/batch={new}")
        if self._mark("bases", new):
            for n in [n for n in self.committed() if n <= old]:
                self._fs.delete(self._at(f"{self.path}/{self.NAME}/batch={n}"), True)
                self._fs.delete(self._marker("commits", n), False)
            for n in [n for n in self._numbers("bases") if n < old]:
                self._fs.delete(self._at(f"{self.path}/base/batch={n}"), True)
                self._fs.delete(self._marker("bases", n), False)

    def latest(self) -> DataFrame:
        """The row of each key. Changes are as many as `fold` batches touch, so the fold is one partial aggregation by key."""
        base = self._base()
        folders = self._folders(self.NAME, [n for n in self.committed() if n > base])
        with_batch = T.StructType(list(self.schema)).add("batch", "long")
        parts = [self.spark.read.schema(with_batch).option("basePath", f"{self.path}/{kind}").parquet(*some) for kind, some in (("base", self._folders("base", [base])), (self.NAME, folders)) if some]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
        rest = [c for c in self.schema.names if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), "batch").alias("_newest")).select(self.key, "_newest.*").select(*self.schema.names)
