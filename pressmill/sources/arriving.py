"""Feeds that land as files, read as a stream: items to one table, what cannot be read to a table beside it.

A file is a feed's XML, of some megabytes at most, and is read as a whole. Files are read once, by the checkpoint, and moved to an archive when a later batch has read on,
so the landing folder stays small. Items come in the form of the batch reader; an item that is broken, or lacks its link, goes to the
rejected table with its file and text instead of being lost, and so does a file in which no item is found, or none is closed at its end.

Defined results: an item's feed is the name of the folder that its file landed in (behind `=`, where that has one); a replayed batch changes nothing; a title or snippet that is
missing is null, as the batch reader has it; an empty file is passed over; files keep their order in nothing, as items carry their time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..streaming.store import BatchStore
from .readers import RSS_ITEM, item_columns

ITEMS = "feed string, title string, link string, snippet string, content string, iso_ts timestamp_ntz"
REJECTED = "feed string, file string, reason string, text string"
#: An item, whatever its attributes; and one that begins and is not closed.
ITEM, OPEN = r"(?s)(<item(?:\s[^>]*)?>.*?</item>)", r"(?s)<item(?:\s[^>]*)?>(?:(?!</item>).)*$"
LONGEST_TEXT = 10_000


def landed_files(spark: SparkSession, path: str, archive: str | None = None) -> DataFrame:
    """A stream of whole files: feed, file, xml."""
    reader = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    file = F.col("_metadata.file_path")
    return reader.load(path).select(F.regexp_extract(file, "(?:[^/=]+=)?([^/]+)/[^/]+$", 1).alias("feed"), file.alias("file"), F.col("value").alias("xml"))


def read_items(files: DataFrame) -> dict[str, DataFrame]:
    """files (feed, file, xml): the tables `items` and `rejected`."""
    texts = F.regexp_extract_all("xml", F.lit(ITEM), F.lit(1))
    tail = F.regexp_extract("xml", OPEN, 0)
    found = files.select("feed", "file", "xml", texts.alias("texts"), tail.alias("tail"))
    each = found.select("feed", "file", F.explode("texts").alias("text"))
    each = each.withColumn("item", F.from_xml("text", f"{RSS_ITEM}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    reason = F.when(F.col("item").isNull() | F.col("item._broken").isNotNull(), "broken item").when(F.trim(F.coalesce("item.link", F.lit(""))) == "", "no link")
    each = each.withColumn("reason", reason)
    shown = lambda c: F.substring(c, 1, LONGEST_TEXT).alias("text")
    bad = each.where("reason IS NOT NULL").select("feed", "file", "reason", shown("text"))
    bad = bad.unionAll(found.where("tail <> ''").select("feed", "file", F.lit("unclosed item"), shown("tail")))
    bad = bad.unionAll(found.where("size(texts) = 0 AND tail = ''").select("feed", "file", F.lit("no items"), shown("xml")))
    return {"items": each.where("reason IS NULL").select("feed", "item.*").select(*item_columns(F.col("feed"))), "rejected": bad}


def run_feeds(files: DataFrame, store: BatchStore, checkpoint: str) -> StreamingQuery:
    """landed_files() to the tables of the store."""

    def write(df: DataFrame, number: int) -> None:
        df.persist()  # two tables of one reading
        try:
            store.write(number, read_items(df))
        finally:
            df.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
