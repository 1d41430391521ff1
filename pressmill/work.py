"""Work tables in the folder that the driver and all executors share.

Every table is registered with its session until it is forgotten, so that release() can delete what a query left behind once
its result is written. Tables are compressed with zstd: its streams hold no direct buffers outside the heap, which those of
the default codec do until the next full collection.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CODEC = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where it is unset and Spark is local (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = getattr(spark, "_pressmill_work", None)
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = spark._pressmill_work = tempfile.mkdtemp(prefix="pressmill-")
    return at.rstrip("/")


def _held(spark: SparkSession) -> dict[str, str | None]:
    """Paths of the session's work tables, with their names in the catalog where they have one."""
    sc = spark.sparkContext
    if not hasattr(sc, "_pressmill_held"):
        sc._pressmill_held = {}
    return sc._pressmill_held


def save(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write a work table and read it back: the lineage ends here, and a lost executor costs nothing. With `by`, a folder for each value of
    that column, of which there must be few."""
    spark = df.sparkSession
    path = place(spark, tag)
    writer = df.write.options(**CODEC)
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pressmill_path = path
    return out


def save_bucketed(df: DataFrame, tag: str, key: str, buckets: int) -> DataFrame:
    """A work table in `buckets` buckets of the key, each sorted by it, so that joins on the key need no shuffle."""
    spark = df.sparkSession
    name = f"pressmill_{tag}_{uuid.uuid4().hex}"
    path = f"{work_dir(spark)}/{name}"
    _held(spark)[path] = name
    df.write.options(**CODEC, path=path).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._pressmill_path = path
    return out


def place(spark: SparkSession, tag: str) -> str:
    """A new path for what is written otherwise; release() deletes it too."""
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _held(spark)[path] = None
    return path


def _delete(spark: SparkSession, path: str) -> None:
    name = _held(spark).pop(path, None)
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def forget(*tables: DataFrame) -> None:
    """Delete work tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_pressmill_path", None)
        if path:
            _delete(df.sparkSession, path)


def mark(spark: SparkSession) -> set[str]:
    """The work tables that there are now, for release()."""
    return set(_held(spark))


def release(spark: SparkSession, but: set[str] = frozenset()) -> None:
    """Delete the session's work tables, but for those; for use when the results that read them are written."""
    for path in [p for p in _held(spark) if p not in but]:
        _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
