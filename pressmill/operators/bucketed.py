"""A ledger that lies in buckets of its key, so that an anti-join shuffles the day's rows only.

The ledger is a table of the catalog, each bucket sorted by the key. Appends add files to the buckets; compact() makes one file of each bucket again. The day's rows are dealt to
the same number of buckets and merged with those of the ledger where they lie.

Defined results: rows whose key is null stay, null keys of the ledger match nothing; a key may be logged more than once; a ledger
that is empty or does not exist yet leaves all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..work import CODEC


class BucketedLedger:
    def __init__(self, spark: SparkSession, name: str, path: str, key: str, buckets: int) -> None:
        """`buckets`: so many that a bucket's keys fit a task, about one for 200 MB of the ledger to come."""
        self.spark, self.name, self.path, self.key, self.buckets = spark, name, path, key, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def _save(self, df: DataFrame, name: str, path: str) -> None:
        dealt = df.repartition(self.buckets, self.key)  # a file a bucket, not one a task and bucket
        dealt.write.mode("append").options(**CODEC, path=path).bucketBy(self.buckets, self.key).sortBy(self.key).format("parquet").saveAsTable(name)

    def append(self, rows: DataFrame) -> None:
        self._save(rows, self.name, self.path)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def absent(self, df: DataFrame) -> DataFrame:
        """The rows of df whose key the ledger lacks."""
        if not self.exists():
            return df
        held = self.rows().select(F.col(self.key).alias("_key")).where("_key IS NOT NULL").hint("merge")
        dealt = df.repartition(self.buckets, self.key)
        return dealt.join(held, dealt[self.key] == held["_key"], "left_anti")

    def compact(self, path: str) -> None:
        """Write the ledger anew under another path, each bucket one sorted file, and take that path on."""
        if path.rstrip("/") == self.path.rstrip("/"):
            raise ValueError("a ledger is compacted to another path than its own")
        fresh = f"{self.name}_compacting"
        self.spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        files = self.spark.read.schema(self.rows().schema).parquet(self.path)  # read as buckets, the rows would not be dealt anew
        self._save(files, fresh, path)
        self.spark.sql(f"DROP TABLE {self.name}")
        self.spark.sql(f"ALTER TABLE {fresh} RENAME TO {self.name}")
        self.path = path
