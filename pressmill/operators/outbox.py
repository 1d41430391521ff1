"""What a run selects is logged before it is sent, and sent once: an outbox.

A run's rows are written under its name and then claimed, by a numbered file that only one run can create; the claim is the append. A
row is sent by the run that appended its key first, and a run that is started again, or died between its claim and its end, finds its claim and sends
the rows it stored, not a new selection. What is sent as a table (send()) is written under the run's name and shown by a marker, so readers see it once however often the
run is repeated; a sender of one's own gets the same rows under the same run each time, to tell repeats by.

Defined results: of a run's rows with equal keys the first by `order` is taken; rows with a null key go; a run without rows is logged and
sends nothing; a claim whose run never wrote its name in it is void; runs claim in the order of their appends, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..streaming.store import BatchStore
from ..work import CODEC

#: Runs of up to so many rows look their keys up in the ledger by a broadcast of the run, so the ledger is read where it lies.
MOST_BROADCAST = 1_000_000


class Outbox(BatchStore):
    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType | str, order: str = "ord") -> None:
        super().__init__(spark, path)
        self.key, self.order = key, order
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def claims(self) -> list[str]:
        """The runs in the order of their appends."""
        out = []
        for n in self._numbers("claims"):
            stream = self._fs.open(self._marker("claims", n))
            try:
                name = stream.readUTF() if stream.available() else None
            finally:
                stream.close()
            if name and name not in out:
                out.append(name)
        return out

    def _claim(self, run: str) -> None:
        while True:
            at = self._marker("claims", max(self._numbers("claims"), default=-1) + 1)
            try:
                stream = self._fs.create(at, False)
            except Exception as e:  # the JVM's: another run was first, so the next number
                if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                    continue
                raise
            stream.writeUTF(run)
            stream.close()
            return

    def append(self, run: str, rows: DataFrame) -> bool:
        """Log a run's rows, unless it has logged before; whether it did now."""
        if run in self.claims():
            return False
        first = Window.partitionBy(self.key).orderBy(self.order)
        once = rows.where(F.col(self.key).isNotNull()).withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*self.schema.names)
        once.write.mode("overwrite").options(**CODEC).parquet(f"{self.path}/entries/{run}")
        self._claim(run)
        return True

    def _entries(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/entries/{r}" for r in runs))

    def ledger(self) -> DataFrame:
        """All keys that any run has logged."""
        return self._entries(self.claims()).select(self.key).distinct()

    def first_of(self, run: str) -> DataFrame:
        """The rows that this run was the first to log."""
        runs = self.claims()
        own, before = self._entries([run]), self._entries(runs[: runs.index(run)]).select(self.key)
        if own.count() <= MOST_BROADCAST:
            before = before.join(F.broadcast(own.select(self.key)), self.key, "left_semi")
        return own.join(before.distinct(), self.key, "left_anti")

    def _sent(self, run: str):
        return self._at(f"{self.path}/_sent/{run}")

    def emit(self, run: str, rows: DataFrame, sender: Callable[[DataFrame], None] | None = None) -> bool:
        """Log the rows, send those that the run logged first, and note that they are sent; False where that was so already."""
        self.append(run, rows)
        if self._fs.exists(self._sent(run)):
            return False
        (sender or (lambda df: self._send(run, df)))(self.first_of(run))
        self._fs.create(self._sent(run), True).close()
        return True

    def _send(self, run: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").options(**CODEC).parquet(f"{self.path}/messages/{run}")

    def messages(self) -> DataFrame:
        """The rows of all runs that are sent, with their run."""
        runs = [r for r in self.claims() if self._fs.exists(self._sent(r)) and self._fs.exists(self._at(f"{self.path}/messages/{r}"))]
        if not runs:
            return self.spark.createDataFrame([], T.StructType(list(self.schema)).add("run", "string"))
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/messages/{r}").withColumn("run", F.lit(r)) for r in runs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out
