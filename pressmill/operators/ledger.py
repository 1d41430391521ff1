"""Sinks: typed appends, insert-if-absent, registration routing, batches. append_typed appends as often as it is called; the others give the same however often
they run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import without_utm
from ..work import save
from .news import not_in


def append_typed(df: DataFrame, path: str, kind: str = "type") -> None:
    """Append rows of all types, one folder a type."""
    df.write.mode("append").partitionBy(kind).parquet(path)


def append_once(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table at the path does not hold, once each; a replay adds nothing."""
    spark = df.sparkSession
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fresh = df.dropDuplicates([key])
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        fresh = not_in(fresh, spark.read.parquet(path), key)
    fresh.write.mode("append").parquet(path)


def overwrite_guide(df: DataFrame, path: str) -> None:
    """The guide's one row: rendered text and clean URL."""
    df.select("rendered", without_utm(F.col("url")).alias("url")).write.mode("overwrite").parquet(path)


def book_row(books: DataFrame, now: Column) -> DataFrame:
    """Ledger rows with the defaults of missing fields."""
    text = ["isbn", "title", "author", "publisher", "pubdate", "categories", "book_type"]
    return books.select(F.coalesce("timestamp", now).alias("timestamp"), *(F.coalesce(c, F.lit("")).alias(c) for c in text), F.coalesce("score", F.lit(0)).alias("score"))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with a gapless number from 0 by order, without a window over all rows: rows are ranged, numbered in their range, and the
    counts of the ranges before (one row a range) are added."""
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    ranged = save(ranged, "ranged")
    sums = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_range", before.alias("_before"))
    return ranged.join(F.broadcast(sums), "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def insert_absent(catalog: DataFrame, fresh: DataFrame, start: int = 72) -> DataFrame:
    """New catalog rows (content_id, url, title): clean URLs that the catalog lacks, first of equals, numbered on from the
    last id, `c` and at least three digits."""
    clean = fresh.withColumn("url", without_utm(F.col("url")))
    clean = clean.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("ord"))).where("_n = 1").drop("_n")
    new = not_in(clean, catalog, "url")
    last = catalog.agg(F.coalesce(F.max(F.regexp_extract("content_id", "^c([0-9]+)$", 1).try_cast("int")), F.lit(start - 1)).alias("last"))
    both = numbered(new, "ord", "number").crossJoin(F.broadcast(last))  # one row
    text = (F.col("number") + 1 + F.col("last")).cast("string")
    return both.select(F.concat(F.lit("c"), F.when(F.char_length(text) < 3, F.lpad(text, 3, "0")).otherwise(text)).alias("content_id"), "url", "title")


def batches(emails: DataFrame, size: int = 50) -> DataFrame:
    """Recipients in batches by order: batch, n. Blank addresses go."""
    kept = emails.where(F.trim(F.coalesce("email", F.lit(""))) != "")
    return numbered(kept, "ord", "_number").withColumn("batch", F.floor(F.col("_number") / size)).drop("_number")


#: Registration types that have a detail sheet or a mail of their own.
DETAIL = {"アンバサダー0日目特典登録": "ambassador", "VibeCodingスタートガイド特典登録": "vibe_coding", "スターターキット特典登録": "starter_kit"}
MAIL = {"確定申告テンプレ特典登録": "tax_template", "Nano Banana Pro特典登録": "image_prompts", "Nano Banana 2 プロンプト集（全13テンプレート）": "image_prompts", **DETAIL}


def route(registrations: DataFrame) -> DataFrame:
    """Each registration's detail sink (null: none) and mail (null without an address, `auto_reply` for other types)."""
    kind = F.col("registration_type")
    pick = lambda m: F.coalesce(*(F.when(kind == k, v) for k, v in m.items()))
    email = F.coalesce(F.col("email"), F.lit(""))
    return registrations.withColumns({"detail": pick(DETAIL), "mail": F.when(email != "", F.coalesce(pick(MAIL), F.lit("auto_reply")))})


#: The kinds of rows that a post to the log may be, with their columns.
LOGS = {
    "newbook": ["timestamp", "isbn", "title", "author", "publisher", "pubdate", "score", "categories", "book_type", "posted_date"],
    "discussion": ["timestamp", "user_id", "username", "content", "news_title", "news_url", "news_post_date", "user_role"],
    "news": ["timestamp", "title", "link", "news_date", "insight", "questions"],
    "addarticles": ["timestamp", "url", "title", "pub_date", "priority", "score"],
    "globalresearch": ["timestamp", "title_original", "title_ja", "link", "summary", "key_points", "implications", "publish_date"],
}


def log_rows(posts: DataFrame, now: Column, kind: str = "type") -> DataFrame:
    """Posts of all kinds, parsed, as rows for append_typed: `sink`, and the columns of its kind; a missing time is now, kinds without a log go, columns that posts lack
    are null. (streaming.router takes posts as they come, and gives each kind a table.)"""
    sink = F.when(F.lower(kind).isin(list(LOGS)), F.lower(kind))
    names = list(dict.fromkeys(c for cs in LOGS.values() for c in cs))
    held = lambda c: F.col(c) if c in posts.columns else F.lit(None).cast("string")
    value = lambda c: F.when(sink.isin([k for k, cs in LOGS.items() if c in cs]), F.coalesce(held("timestamp"), now) if c == "timestamp" else held(c))
    return posts.select(sink.alias("sink"), *(value(c).alias(c) for c in names)).where("sink IS NOT NULL")


def archive_row(mails: DataFrame, now: Column) -> DataFrame:
    """Sent mails as rows of the archive."""
    return mails.select(now.alias("sent_at"), "subject", "url", F.coalesce("recipients", F.lit(0)).cast("long").alias("recipients"), F.coalesce("body", F.lit("")).alias("body"), F.coalesce("post", F.lit("")).alias("post"))


def detail_row(registrations: DataFrame, columns: list[str]) -> DataFrame:
    """Detail columns, a dash for what is missing, and the state of a new entry."""
    return registrations.select(*(F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(F.col(c)).alias(c) for c in columns), F.lit("未対応").alias("status"))
