"""Messages as rows: what each scheduled pipeline would post, as a title, a text and named fields. Sending is not done here.

Every renderer takes the rows of its pipeline and adds `message`, a struct (title, url, text, fields: array of (name, value), footer) with nulls where there is
nothing; rows without what a message needs (a title and a link) still give one, as the pipelines have gated them before. Lengths are in code points. Ties
and order are those of the rows: a digest is ordered by its `rank`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import greeting
from ..functions.text import bullets, escape_brackets, host, japanese_date, shop_links

#: The words of the messages, and the greatest length of a field.
NO_SUMMARY, THEMES, GUIDE_NOTE = "概要はありません。", "**💭 今日の議論テーマ**", "*※この記事はAIによって要約されています。正確な情報は必ず原文をご確認ください。*"
GREETINGS = {"morning": "おはようございます", "evening": "こんばんは"}
MOST_VALUE = 1024


def _fields(*named: tuple[str, Column]) -> Column:
    """The fields that have a value."""
    kept = [F.when(F.coalesce(v, F.lit("")) != "", F.struct(F.lit(n).alias("name"), v.alias("value"))) for n, v in named]
    return F.array_compact(F.array(*kept))


def _message(text: Column | None = None, title: Column | None = None, url: Column | None = None, fields: Column | None = None, footer: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<struct<name: string, value: string>>")
    parts = {"title": title, "url": url, "text": text, "fields": empty if fields is None else fields, "footer": footer}
    return F.struct(*((none if c is None else c).alias(n) for n, c in parts.items()))


def render_daily(df: DataFrame) -> DataFrame:
    """Rows (title, link, snippet, insight: (insight, questions)): the post, `thread`, the name of the discussion below it, and `themes`, its first message."""
    text = F.when(F.col("snippet").isNotNull(), F.concat(F.substring("snippet", 1, 400), F.lit("..."))).otherwise(NO_SUMMARY)
    post = _message(text, F.col("title"), F.col("link"), _fields(("🔬", F.col("insight.insight"))), F.concat(F.lit("Source: "), host(F.col("link"))))
    numbered = F.transform(F.coalesce("insight.questions", F.array().cast("array<string>")), lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q))
    return df.withColumns({"message": post, "thread": F.concat(F.lit("【議論】"), F.substring("title", 1, 80)), "themes": F.concat(F.lit(THEMES + "\n"), F.array_join(numbered, "\n"))})


def render_platform(df: DataFrame) -> DataFrame:
    """Rows (title, link, source, score, label, translation: (titleJa, summary)): one field a row, `name` and `value`. The link is always whole: a summary that would
    push it over the limit is cut."""
    link = F.concat(F.lit("\n\n[原文を読む]("), F.col("link"), F.lit(") (*Source: "), F.col("source"), F.lit("*)"))
    summary = F.coalesce("translation.summary", F.lit(""))
    room = MOST_VALUE - F.char_length(link) - 4
    value = F.when(F.char_length(summary) + F.char_length(link) <= MOST_VALUE, F.concat(summary, link)).otherwise(F.concat(F.substring(summary, F.lit(1), F.greatest(room, F.lit(0))), F.lit("..."), link))
    name = F.concat(F.lit("["), F.col("score").cast("string"), F.lit("点 | "), F.col("label"), F.lit("] "), escape_brackets(F.coalesce("translation.titleJa", F.lit(""))))
    return df.withColumns({"name": name, "value": value})


def render_book(df: DataFrame, reason: Column | None = None) -> DataFrame:
    """Rows (title, author, publisher, pubdate, categories: array, total, isbn, description, and the links shop_url and catalog_url)."""
    fields = _fields(
        ("✍️ 著者", F.col("author")),
        ("🏢 出版社", F.col("publisher")),
        ("📅 発売日", japanese_date(F.col("pubdate"))),
        ("🏷️ カテゴリ", F.array_join("categories", " + ")),
        ("⭐ スコア", F.concat(F.col("total").cast("string"), F.lit("点"))),
        ("🤖 選書メモ", F.lit(None).cast("string") if reason is None else reason),
        ("📖 ISBN", F.col("isbn")),
        ("📝 概要", F.substring("description", 1, 300)),
        ("🔗 購入リンク", shop_links(F.col("isbn"), F.col("shop_url"), F.col("catalog_url"))),
    )
    return df.withColumn("message", _message(F.concat(F.lit("**"), F.col("title"), F.lit("**")), F.lit("📚 今日の一冊"), fields=fields))


def render_research(df: DataFrame, as_of: Column) -> DataFrame:
    """Rows (rank, link, translation: (titleJa, summary, keyPoints, implications)): a message a row, and `greeting` for the digest's head."""
    t = F.col("translation")
    fields = _fields(("📝 要約", t["summary"]), ("🔍 重要ポイント", F.array_join(F.transform(F.coalesce(t["keyPoints"], F.array().cast("array<string>")), lambda p: F.concat(F.lit("• "), p)), "\n")), ("💡 日本の農業への示唆", t["implications"]))
    title = F.concat(F.col("rank").cast("string"), F.lit(". "), F.coalesce(t["titleJa"], F.lit("")))
    hello = F.coalesce(*(F.when(greeting(as_of) == k, v) for k, v in GREETINGS.items()))
    return df.withColumns({"message": _message(None, title, F.col("link"), fields, F.concat(F.lit("Source: "), host(F.col("link")))), "greeting": hello})


def render_terms(terms: DataFrame) -> DataFrame:
    """Rows (rank, term, meaning) of at most a handful of terms: one row, the digest's glossary."""
    line = F.concat(F.lit("• **"), F.col("term"), F.lit("**: "), F.col("meaning"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return terms.agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("glossary"))


def render_guide(df: DataFrame) -> DataFrame:
    """Rows (title, link, summary, guide: (actionable, facts, evidence) or null)."""
    g = F.col("guide")
    quoted = F.array_join(F.transform(g["evidence"], lambda e: F.concat(F.lit("*「"), e, F.lit("」*"))), "\n")
    fields = _fields(("📊 本文が伝える具体的な事実", bullets(g["facts"])), ("💡 明日から使えるヒント", F.concat(F.lit("> "), F.nullif(g["actionable"], F.lit("")))), ("🧾 記事中の注目キーワード・発言", quoted))
    text = F.concat(F.lit(GUIDE_NOTE + "\n\n**【概要】**\n"), F.col("summary"))
    return df.withColumn("message", _message(text, F.concat(F.lit("🌾 "), F.col("title")), F.col("link"), fields))
