"""Readers of landed feeds and catalogue answers. A broken source gives no rows, not an error."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import sales_date
from ..functions.once import computed, spread
from ..functions.text import strip_isbn, trim_all
from ..operators.news import interesting

RSS_ITEM = "title string, link string, description string, `content:encoded` string, isoDate string, pubDate string"


def mail_date(c: Column) -> Column:
    """A mail date without its day of the week, and with a numeric zone."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), "^[A-Za-z]+,\\s*", ""), "(?:GMT|UTC|UT|Z)$", "+0000")


def item_columns(feed: Column) -> list[Column]:
    """The columns of an item from those of RSS_ITEM; dates in UTC whatever the session's zone."""
    at = F.coalesce(F.try_to_timestamp("isoDate"), F.try_to_timestamp(mail_date(F.col("pubDate")), F.lit("d MMM yyyy HH:mm:ss Z")))
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))
    return [feed.alias("feed"), F.col("title"), F.col("link"), F.col("description").alias("snippet"), F.coalesce("`content:encoded`", "description").alias("content"), utc.alias("iso_ts")]


def rss(spark: SparkSession, paths: Sequence[str], feed: str | None = None) -> DataFrame:
    """Items of landed RSS files: feed, title, link, snippet, content, iso_ts. The feed's name, or the file it came from."""
    raw = spark.read.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE").option("ignoreCorruptFiles", "true").schema(RSS_ITEM).load(list(paths))
    name = F.lit(feed) if feed else F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)$", 1)
    return raw.select(*item_columns(name)).where("link IS NOT NULL")


def titled_rss(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Items of landed feeds under the title of their feed: source, title, link, published, snippet, content. A feed without a title has a null source."""
    items = "array<struct<" + ", ".join(f.replace(" string", ": string") for f in RSS_ITEM.split(", ")) + ">>"
    feeds = spark.read.format("xml").option("rowTag", "channel").option("mode", "PERMISSIVE").option("ignoreCorruptFiles", "true").schema(f"title string, item {items}").load(list(paths))
    each = feeds.select(F.col("title").alias("_source"), F.inline("item"))
    return each.select(*item_columns(F.col("_source"))).where("link IS NOT NULL").withColumnsRenamed({"feed": "source", "iso_ts": "published"})


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_item(items: DataFrame) -> DataFrame:
    """The first item of each feed as it came, by ord."""
    return items.withColumn("_n", F.row_number().over(Window.partitionBy("feed").orderBy("ord"))).where("_n = 1").drop("_n")


SHOP_ITEM = "title string, author string, publisherName string, isbn string, salesDate string, largeImageUrl string, itemCaption string, itemUrl string, seriesName string, reviewCount int, reviewAverage string"


def shop_books(spark: SparkSession, path: str, as_of: str, with_reviews: bool = True, multi_line: bool = True) -> DataFrame:
    """Landed shop answers ({"Items": [{"Item": {...}}]}), one a file, or one a line: one row a book. The answers sorted by sales
    carry no reviews."""
    raw = spark.read.schema(f"Items array<struct<Item: struct<{SHOP_ITEM.replace(' string', ': string').replace(' int', ': int')}>>>").option("multiLine", multi_line).json(path)
    i = raw.select(F.explode("Items.Item").alias("i"))
    now = F.lit(as_of).cast("timestamp_ntz")
    reviews = (F.col("i.reviewCount"), F.col("i.reviewAverage").try_cast("double")) if with_reviews else (F.lit(None).cast("int"), F.lit(None).cast("double"))
    return i.select(F.lit("shop").alias("source"), "i.title", "i.author", F.col("i.publisherName").alias("publisher"), F.col("i.seriesName").alias("series"), "i.isbn", sales_date(F.col("i.salesDate"), now).alias("pubdate"), F.col("i.largeImageUrl").alias("cover"), F.col("i.itemCaption").alias("description"), reviews[0].alias("review_count"), reviews[1].alias("review_average"), F.col("i.itemUrl").alias("url"))


VOLUME = "title: string, authors: array<string>, publisher: string, publishedDate: string, description: string, infoLink: string, industryIdentifiers: array<struct<type: string, identifier: string>>, imageLinks: struct<thumbnail: string>"


def volume_books(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Landed volume searches ({"items": [{"volumeInfo": {...}}]}), one a file, or one a line: ISBN-13 if there is one, else ISBN-10."""
    raw = spark.read.schema(f"items array<struct<volumeInfo: struct<{VOLUME}>>>").option("multiLine", multi_line).json(path)
    v = raw.select(F.explode("items.volumeInfo").alias("v"))
    pick = lambda kind: F.get(F.filter("v.industryIdentifiers", lambda x: x["type"] == kind), F.lit(0))["identifier"]
    return v.select(F.lit("volumes").alias("source"), "v.title", F.array_join("v.authors", ", ").alias("author"), "v.publisher", F.coalesce(pick("ISBN_13"), pick("ISBN_10"), F.lit("")).alias("isbn"), F.replace("v.publishedDate", F.lit("-"), F.lit("")).alias("pubdate"), F.col("v.imageLinks.thumbnail").alias("cover"), "v.description", F.col("v.infoLink").alias("url"))


def search_items(raw: DataFrame, column: str = "xml") -> DataFrame:
    """Library search answers held as XML text: title, author, publisher, isbn, pubdate of each item that has the first and an
    ISBN of ten or more characters."""
    item = raw.select(F.explode(F.regexp_extract_all(column, F.lit("(?s)<item>(.*?)</item>"), F.lit(1))).alias("x"))
    tag = lambda p: trim_all(F.regexp_extract("x", f"(?s)<{p}[^>]*>(.*?)</{p}>", 1))
    isbn = strip_isbn(F.regexp_extract("x", r'(?s)(?:<dc:identifier[^>]*ISBN[^>]*>|urn:isbn:)\s*([0-9Xx-]{10,17})', 1))
    out = item.select(tag("title").alias("title"), tag("author").alias("author"), tag("dc:publisher").alias("publisher"), isbn.alias("isbn"), tag("pubDate").alias("pubdate"))
    return out.where((F.col("title") != "") & (F.char_length("isbn") >= 10))


def release_hints(pages: DataFrame, words: Sequence[str] | None = None, html: str = "html") -> DataFrame:
    """Links to books on a new-release page: isbn, and hints from the link and its row, cell or block: title, publisher, author, date. With
    words, only books with one of them in their hints or the text around."""
    block = r"(?s)(<(?:tr|li|div)\b[^>]*>(?:(?!<(?:tr|li|div)\b).)*?<a[^>]*href=\"[^\"]*/bd/isbn/[0-9]{13}[^\"]*\"[^>]*>.*?</a>.*?(?=</?(?:tr|li|div)\b|$))"
    bare = r'(?s)(<a[^>]*href="[^"]*/bd/isbn/[0-9]{13}[^"]*"[^>]*>.*?</a>)'
    blocks, links = F.regexp_extract_all("_html", F.lit(block), F.lit(1)), F.regexp_extract_all("_html", F.lit(bare), F.lit(1))
    found = computed(spread(pages.select(F.col(html).alias("_html"))), _blocks=blocks)
    found = computed(found, _found=F.when(F.size("_blocks") > 0, F.col("_blocks")).otherwise(links))
    link = computed(found.select(F.posexplode("_found").alias("ord", "b")), a=F.regexp_extract("b", bare, 1))
    plain = lambda c: trim_all(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), "\\s+", " "))
    link = computed(link, around=plain("b"), text=plain("a"), alt=F.regexp_extract("a", 'alt="([^"]*)"', 1))
    around, text, alt = F.col("around"), F.col("text"), F.col("alt")
    hint = lambda p: F.regexp_extract(around, p, 1)
    day = F.regexp_extract(around, "([0-9]{4}[/年-]\\s?[0-9]{1,2}[/月-]\\s?[0-9]{1,2})", 1)
    out = computed(
        link,
        isbn=F.regexp_extract("a", "/bd/isbn/([0-9]{13})", 1),
        title=F.when(text != "", text).when(alt != "", alt).otherwise(F.substring(around, 1, 120)),
        publisher=hint("出版社[:：]?\\s*([^\\s|｜/／]+)"),
        author=hint("著者?[:：]?\\s*([^\\s|｜/／]+)"),
        pubdate=F.regexp_replace(F.regexp_replace(day, "\\s", ""), "[/年月]", "-"),
    ).select("ord", "isbn", "title", "publisher", "author", "pubdate", "around")
    if words is not None:
        out = out.where(interesting(words, *map(F.col, ("title", "author", "publisher", "around"))))
    return out.drop("around").withColumn("_n", F.row_number().over(Window.partitionBy("isbn").orderBy("ord"))).where("_n = 1").drop("_n")


def with_details(hints: DataFrame, details: DataFrame, words: Sequence[str] | None = None) -> DataFrame:
    """Left join on ISBN: the detail row where there is one, else the hint, which needs a title; with words, only books that name one
    in title, author or publisher."""
    names = ("title", "author", "publisher", "pubdate", "description")
    d = details.select(F.col("isbn").alias("_isbn"), *(F.col(c).alias(f"_{c}") for c in names))
    both = hints.join(d, hints["isbn"] == d["_isbn"], "left")
    value = lambda c: F.coalesce(f"_{c}", F.when(F.col(c) != "", F.col(c))) if c in hints.columns else F.col(f"_{c}")
    out = both.select("ord", "isbn", *(value(c).alias(c) for c in names)).where("title IS NOT NULL")
    return out if words is None else out.where(interesting(words, F.col("title"), F.col("author"), F.col("publisher")))


def details_as_of(details: DataFrame, as_of: Column, at: str = "known_at") -> DataFrame:
    """details (isbn, known_at, ...), a row each time that something became known: the newest row of each ISBN not later than as_of, so that a run that is repeated with
    its as_of joins what it joined the first time. A partial aggregation, so an ISBN may have any number of rows; of equally new rows the greatest by all
    columns; rows without a time or an ISBN are never taken."""
    rest = [c for c in details.columns if c not in ("isbn", at)]
    known = details.where(F.col("isbn").isNotNull() & (F.col(at) <= as_of))
    return known.groupBy("isbn").agg(F.max(F.struct(at, *rest)).alias("_newest")).select("isbn", "_newest.*")


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger (posted links, posted ISBNs, discussion, recent news, subscribers) by its schema; one that is not there yet is empty."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def registration(raw: DataFrame, column: str = "body") -> DataFrame:
    """Form posts as JSON text; `Email` is an alias of `email`."""
    fields = "timestamp email name subscribe page_url registration_type utm_source utm_medium utm_campaign utm_term utm_content".split()
    j = lambda f: F.get_json_object(column, f"$.{f}")  # noqa: E731  from_json would take email and Email for one
    return raw.select(*((F.coalesce(j("email"), j("Email")) if f == "email" else j(f)).alias(f) for f in fields))


def cells(sheet: DataFrame, named: dict[str, str]) -> DataFrame:
    """One row with the named cells of a sheet, whose rows carry their number from 1 as `ord`; a cell is written as in B2, and one
    that the sheet lacks is null."""
    at = {name: (cell.rstrip("0123456789"), int(cell.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) for name, cell in named.items()}
    rows = sheet.where(F.col("ord").isin(sorted({row for _, row in at.values()})))
    return rows.agg(*(F.max(F.when(F.col("ord") == row, F.col(column))).alias(name) for name, (column, row) in at.items()))


def sheet_column(sheet: DataFrame, column: str, first: int = 2) -> DataFrame:
    """The non-empty cells of a column from a row on, in the order of `ord`."""
    return sheet.where((F.col("ord") >= first) & (F.coalesce(F.col(column).cast("string"), F.lit("")) != "")).select("ord", F.col(column).alias("value"))
