"""Views of the test tables as articles, books, posts and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keywords import article_text
from ..work import table


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """documents: the first line is the title, all others are the snippet."""
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("feed"), title.alias("title"), F.expr("substring(text, char_length(split_part(text, '\\n', 1)) + 2)").alias("snippet"), F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("link"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id AS INT))").alias("iso_ts"))
    return d.withColumn("text", article_text(F.col("title"), F.col("snippet")))


ARTICLES = """articles AS (SELECT doc_id AS ord, source AS feed, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS snippet,
  'https://' || source || '.example/' || doc_id AS link, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS iso_ts,
  lower(split_part(text, chr(10), 1) || ' ' || substr(text, length(split_part(text, chr(10), 1)) + 2)) AS text FROM documents)"""


def books(spark: SparkSession, sf: str) -> DataFrame:
    """part with lineitem: dates in several written forms, reviews from order lines."""
    lines = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).cast("int").alias("reviews"), F.min("l_shipdate").alias("shipped"), F.avg("l_quantity").alias("quantity"))
    form = F.col("p_partkey") % 8
    d = lambda f: F.date_format("shipped", f)
    pubdate = F.when(form == 0, d("yyyy")).when(form == 1, d("yyyyMM")).when(form == 2, d("yyyyMMdd")).when(form == 3, d("yyyy-MM-dd")).when(form == 4, d("yyyy年MM月dd日")).when(form == 5, d("yyyy/MM/dd")).when(form == 6, F.concat(d("yyyyMM"), F.lit("31"))).otherwise("20241")
    p = table(spark, sf, "part")
    return p.join(lines, p["p_partkey"] == lines["l_partkey"], "left").select(
        F.col("p_partkey").alias("ord"), F.when(F.col("p_size") == 1, "").otherwise(F.concat(F.lit("978"), F.col("p_size").cast("string"), F.replace("p_brand", F.lit("Brand#"), F.lit("")))).alias("isbn"),
        F.col("p_name").alias("title"), F.lower("p_type").alias("author"), F.col("p_brand").alias("publisher"), F.lit("").alias("series"),
        F.when(F.col("shipped").isNotNull(), pubdate).alias("pubdate"), F.when(F.col("p_retailprice") > 1000, "cover").otherwise("").alias("cover"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat("p_name", F.lit(" "), "p_type")).alias("description"), F.coalesce("reviews", F.lit(0)).alias("review_count"), (F.col("quantity") / 6).alias("review_average"),
    )


BOOKS = """books AS (SELECT p_partkey AS ord, CASE WHEN p_size = 1 THEN '' ELSE '978' || p_size || replace(p_brand, 'Brand#', '') END AS isbn, p_name AS title, lower(p_type) AS author, p_brand AS publisher, '' AS series,
  CASE WHEN shipped IS NULL THEN NULL ELSE CASE p_partkey % 8 WHEN 0 THEN strftime(shipped, '%Y') WHEN 1 THEN strftime(shipped, '%Y%m') WHEN 2 THEN strftime(shipped, '%Y%m%d') WHEN 3 THEN strftime(shipped, '%Y-%m-%d')
    WHEN 4 THEN strftime(shipped, '%Y年%m月%d日') WHEN 5 THEN strftime(shipped, '%Y/%m/%d') WHEN 6 THEN strftime(shipped, '%Y%m') || '31' ELSE '20241' END END AS pubdate,
  CASE WHEN p_retailprice > 1000 THEN 'cover' ELSE '' END AS cover, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name || ' ' || p_type END AS description, coalesce(reviews, 0)::INT AS review_count, quantity / 6 AS review_average
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS reviews, min(l_shipdate) AS shipped, avg(l_quantity) AS quantity FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey),
digits AS (SELECT *, regexp_replace(pubdate, '[-/年月日]', '', 'g') AS ds, regexp_replace(pubdate, '[-/]', '', 'g') AS dw FROM books),
dated AS (SELECT *, CASE WHEN length(ds) = 4 THEN make_date(ds[1:4]::INT, 1, 1) WHEN length(ds) = 6 THEN make_date(ds[1:4]::INT, ds[5:6]::INT, 1) WHEN length(ds) >= 8 THEN (make_date(ds[1:4]::INT, ds[5:6]::INT, 1) + INTERVAL 1 DAY * (ds[7:8]::INT - 1))::DATE END AS pub_date,
  CASE WHEN length(dw) = 4 THEN make_date(dw[1:4]::INT, 1, 1) WHEN length(dw) = 6 THEN make_date(dw[1:4]::INT, dw[5:6]::INT, 1)
    WHEN length(dw) >= 8 THEN (make_date(dw[1:4]::INT, 1, 1) + INTERVAL 1 MONTH * (try_cast(regexp_extract(dw[5:6], '^[0-9]+') AS INT) - 1) + INTERVAL 1 DAY * (try_cast(regexp_extract(dw[7:8], '^[0-9]+') AS INT) - 1))::DATE END AS win_date FROM digits)"""


def posts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("url"), F.col("turn"), "role", F.col("text").alias("content"))


def posted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").where("quality = 0").select("doc_id")


def recent_news(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("title"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(item_id AS INT))").alias("at"))
