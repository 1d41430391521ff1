"""Posts to the log as a stream: JSON of five kinds, each to a table of its own, all of a batch's tables visible at once.

A batch is parsed once and fanned out; its tables are written under its number and made visible by one marker (BatchStore), so a reader never sees
articles of a batch without its books, and a batch that runs again adds nothing. What cannot be routed is kept with the reason.

Defined results: a missing time is the time of receipt; lists are joined by line ends; a number that cannot be read is null (0 for a book's score); a list of
articles gives a row an article, an empty one none; posts that are no JSON object, of no kind, or of articles without a list are rejected; kinds are
told apart with their case. A null post is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.once import computed
from .store import BatchStore

#: The kinds of posts, and the columns of their logs.
LOGS = {
    "newBook": "timestamp string, isbn string, title string, author string, publisher string, pubdate string, score double, categories string, bookType string, postedDate string",
    "discussion": "timestamp string, userId string, username string, content string, newsTitle string, newsUrl string, newsPostDate string, userRole int",
    "news": "timestamp string, title string, link string, newsDate string, insight string, discussionQuestions string",
    "addArticles": "timestamp string, url string, title string, pubDate string, priority string, score double",
    "globalResearch": "timestamp string, titleOriginal string, titleJa string, link string, summary string, keyPoints string, implications string, publishDate string",
}
REJECTED = "body string, received_at string, reason string"
ARTICLES = "array<struct<url: string, title: string, pubDate: string, priority: string, score: string>>"


def _names(kind: str) -> list[str]:
    return [c.split()[0] for c in LOGS[kind].split(", ")]


def _lines(c: Column) -> Column:
    """A JSON list of texts as lines; a text as it is."""
    return F.when(F.startswith(c, F.lit("[")), F.array_join(F.from_json(c, "array<string>"), "\n")).otherwise(c)


def judged(posts: DataFrame) -> DataFrame:
    """posts (body, received_at) with `type`, and `reason` where a post is rejected."""
    field = lambda path: F.get_json_object("body", path)
    read, kind = computed(posts, type=field("$.type"), _json=field("$").isNotNull()), F.col("type")
    reason = F.when(~F.col("_json") | ~F.startswith(F.trim("body"), F.lit("{")), "no JSON object")
    reason = reason.when(~F.coalesce(kind.isin(list(LOGS)), F.lit(False)), "unknown kind").when((kind == "addArticles") & ~F.coalesce(F.startswith(field("$.articles"), F.lit("[")), F.lit(False)), "no articles")
    return read.select("body", "received_at", "type", reason.alias("reason"))


def routed(posts: DataFrame) -> dict[str, DataFrame]:
    """The rows of each log, and `rejected`. Fields are read as text by the schema of their kind."""
    return _fanned(judged(posts))


def _fanned(read: DataFrame) -> dict[str, DataFrame]:
    """The same for posts that are judged."""
    out = {}
    for kind in LOGS:
        names = _names(kind)
        schema = f"articles {ARTICLES}" if kind == "addArticles" else ", ".join(f"{n} string" for n in names)
        rows = read.where(F.col("reason").isNull() & (F.col("type") == kind)).select("received_at", F.from_json("body", schema).alias("post"))
        if kind == "addArticles":
            rows = rows.select(F.col("received_at").alias("timestamp"), F.inline("post.articles"))
            value = {n: F.col(n) for n in names} | {"score": F.col("score").try_cast("double")}
        else:
            value = {n: F.col("post")[n] for n in names}
            value["timestamp"] = F.coalesce(value["timestamp"], "received_at")
        if kind == "newBook":
            value = {n: F.coalesce(c, F.lit("")) for n, c in value.items()} | {"timestamp": F.col("received_at"), "score": F.coalesce(value["score"].try_cast("double"), F.lit(0.0)), "postedDate": F.coalesce(F.nullif(value["postedDate"], F.lit("")), "received_at")}
        if kind == "discussion":
            value["userRole"] = value["userRole"].try_cast("int")
        value |= {n: _lines(value[n]) for n in ("discussionQuestions", "keyPoints") if n in value}
        out[kind] = rows.select(*(value[n].alias(n) for n in names))
    return out | {"rejected": read.where(F.col("reason").isNotNull()).select("body", "received_at", "reason")}


def run_router(posts: DataFrame, store: BatchStore, checkpoint: str) -> StreamingQuery:
    """posts (body, received_at), a stream, to the tables of the store."""

    def fan_out(df: DataFrame, number: int) -> None:
        read = judged(df).persist()  # six tables of one reading, each post judged once
        try:
            store.write(number, _fanned(read))
        finally:
            read.unpersist()

    return posts.writeStream.foreachBatch(fan_out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log(store: BatchStore, kind: str) -> DataFrame:
    """The committed rows of a kind, or of `rejected`."""
    return store.read(kind, LOGS.get(kind, REJECTED)).drop("batch")
