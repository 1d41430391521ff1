"""Running state over streams: engagement and trends that grow with every batch, and repeats dropped over time.

State is kept by the engine's state store (RocksDB, so that keys live on the executors' disks and only changes go to the checkpoint).
Aggregates run in update mode: a batch hands on the keys that it changed, with their new totals, and these are merged by key
into a KeyedTable; the discussion log is never read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions.dates import rounded
from ..operators.news import keyword_hits
from .store import BatchStore, KeyedTable

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENGAGEMENT = "url string, posts long, total_length long"
TRENDS = "keyword string, hits long, first struct<ord: long, n: int>"
LATE = "rows long"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """The state store of queries started meanwhile, unless the session names one."""
    set_here = spark.conf.get(PROVIDER, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    if set_here:
        spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if set_here:
            spark.conf.unset(PROVIDER)


def _start(df: DataFrame, mode: str, write: Callable[[int, DataFrame], bool], checkpoint: str) -> StreamingQuery:
    def sink(batch: DataFrame, number: int) -> None:
        if not write(number, batch):  # it is written already, but the engine's state must go through the batch again
            batch.write.format("noop").mode("overwrite").save()

    with rocks_state(df.sparkSession):
        return df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- engagement by URL


def engagement_table(spark: SparkSession, path: str, fold: int = 20) -> KeyedTable:
    return KeyedTable(spark, path, "url", ENGAGEMENT, fold)


def run_engagement(posts: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """posts (url, content), a stream: what has arrived is added to the posts and lengths of each URL. Rows without a URL go."""
    kept = posts.where(F.coalesce(F.col("url").cast("string"), F.lit("")) != "")
    totals = kept.groupBy(F.col("url").cast("string").alias("url")).agg(F.count(F.lit(1)).alias("posts"), F.sum(F.char_length(F.coalesce("content", F.lit(""))).cast("long")).alias("total_length"))
    return _start(totals, "update", table.upsert, checkpoint)


def engagement_now(table: KeyedTable) -> DataFrame:
    """The metrics as the batch operator gives them."""
    mean = rounded(F.col("total_length").cast("double") / F.col("posts")).cast("long")
    return table.latest().withColumn("mean_length", mean)


# --- trends


def trends_table(spark: SparkSession, path: str, fold: int = 20) -> KeyedTable:
    return KeyedTable(spark, path, "keyword", TRENDS, fold)


def run_trends(news: DataFrame, words: Sequence[str], table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """news (ord, title), a stream: hits of each list entry, and the first of them."""
    seen = keyword_hits(news.select(F.col("ord").cast("long").alias("ord"), "title"), words)
    totals = seen.groupBy("keyword").agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("ord", "n")).alias("first"))
    return _start(totals, "update", table.upsert, checkpoint)


def trends_now(table: KeyedTable) -> DataFrame:
    """Keywords ranked by hits, first seen first; a row a keyword of the list, so the window is small."""
    return table.latest().withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hits"), "first"))).drop("first")


# --- repeats over time


def run_distinct(rows: DataFrame, key: Sequence[str], at: str, bound: str, store: BatchStore, checkpoint: str) -> StreamingQuery:
    """rows, a stream: of rows with equal keys within `bound` of event time after the first the first goes to the table `distinct`, a later one is let
    through again. Rows older than the watermark (the newest event so far less `bound`) are late and go; record_late() counts them."""
    once = rows.withWatermark(at, bound).dropDuplicatesWithinWatermark(list(key))
    return _start(once, "append", lambda n, df: store.write(n, {"distinct": df}), checkpoint)


def record_late(query: StreamingQuery, store: BatchStore) -> None:
    """After the end of an available-now run: late rows of each of its batches, as the table `late` of a store of their own."""
    spark = store.spark
    for p in query.recentProgress:
        dropped = sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])
        store.write(p["batchId"], {"late": spark.createDataFrame([(dropped,)], LATE)})
