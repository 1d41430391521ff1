"""The discussion log as a stream: messages are filtered, joined with the thread they answer, and appended once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..work import place


def role_indicator(roles: Column, member: str, guest: str) -> Column:
    """1 for the first role, 0 for the second, else null; the first wins."""
    return F.when(F.array_contains(roles, member), 1).when(F.array_contains(roles, guest), 0).cast("int")


def discussion_rows(messages: DataFrame, starters: DataFrame, own_author: str, member: str, guest: str) -> DataFrame:
    """Messages of people in threads that the service itself began with an embedded article; works on streams and tables."""
    begun = starters.where((F.col("author_id") == own_author) & F.col("url").isNotNull()).select(F.col("thread_id").alias("_thread"), F.col("title").alias("news_title"), F.col("url").alias("news_url"), F.col("embed_ts").alias("news_post_date"))
    kept = messages.where(~F.col("is_bot") & F.col("in_guild") & F.col("thread_id").isNotNull())
    both = kept.join(begun, kept["thread_id"] == begun["_thread"])
    return both.select("message_id", "ts", F.col("author_id").alias("user_id"), "username", "content", "news_title", "news_url", "news_post_date", role_indicator(F.col("roles"), member, guest).alias("user_role"))


def append_batches(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is, then stop. A batch goes to a folder of its own number, so a replayed batch replaces itself."""

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_events(spark: SparkSession, events_path: str, name: str) -> DataFrame:
    """events as messages through the stream: errors count as bots, sign-ups are members, views are guests."""
    schema = spark.read.parquet(events_path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(events_path)
    stream = spark.readStream.schema(schema)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():  # a stream reads folders
        raw = stream.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    else:
        raw = stream.parquet(events_path)
    messages = raw.select(F.col("event_id").alias("message_id"), "ts", F.col("user_id").cast("string").alias("author_id"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"), (F.col("event_type") == "error").alias("is_bot"), F.lit(True).alias("in_guild"), (F.get_json_object("props", "$.k").cast("long") % 10).cast("string").alias("thread_id"), F.col("props").alias("content"), F.array(F.col("event_type")).alias("roles"))
    starters = spark.range(7).select(F.col("id").cast("string").alias("thread_id"), F.when(F.col("id") < 5, "service").otherwise("other").alias("author_id"), F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"), F.concat(F.lit("https://news.example/"), F.col("id").cast("string")).alias("url"), F.lit("2024-01-01").cast("timestamp_ntz").alias("embed_ts"))
    at = place(spark, name)
    append_batches(discussion_rows(messages, starters, "service", "signup", "view"), f"{at}/log", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/log").drop("batch")
