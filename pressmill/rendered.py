"""Queries of the messages that the pipelines would post, from the test tables with canned answers of a model, and SQL for their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import messages as M
from .sources import fixtures as S
from .sources.fixtures import ARTICLES, BOOKS
from .work import table


def shown(message: Column) -> Column:
    """A message as one text: its parts, then a line a field."""
    parts = [F.coalesce(message[c], F.lit("-")) for c in ("title", "url", "text", "footer")]
    return F.concat_ws("|", *parts, F.array_join(F.transform(message["fields"], lambda f: F.concat(f["name"], F.lit("="), f["value"])), "|"))


def _line(df: DataFrame, key: str, *more: Column) -> DataFrame:
    return df.select(F.col(key).alias("ord"), F.md5(F.concat_ws("#", shown(F.col("message")), *more).cast("binary")).alias("message_md5"))


def message_daily(s: SparkSession, sf: str) -> DataFrame:
    n = F.col("ord").cast("string")
    questions = F.when(F.col("ord") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("q"), n), F.lit("why")))
    a = S.articles(s, sf).withColumns({"snippet": F.when(F.col("ord") % 5 != 0, F.col("snippet")), "insight": F.struct(F.when(F.col("ord") % 2 == 0, F.concat(F.lit("insight "), n)).alias("insight"), questions.alias("questions"))})
    return _line(M.render_daily(a), "ord", F.col("thread"), F.col("themes"))


def message_platform(s: SparkSession, sf: str) -> DataFrame:
    """Summaries are whole texts, so most are cut to leave room for the link."""
    a = S.articles(s, sf).withColumns({"source": F.col("feed"), "score": (F.col("ord") % 20).cast("int"), "label": F.lit("Biz"), "translation": F.struct(F.concat(F.lit("[題] "), F.col("ord").cast("string")).alias("titleJa"), F.when(F.col("ord") % 2 == 0, F.col("text")).otherwise(F.substring("text", 1, 300)).alias("summary"))})
    return M.render_platform(a).select("ord", "name", F.md5(F.col("value").cast("binary")).alias("value_md5"), F.char_length("value").alias("size"))


def message_book(s: SparkSession, sf: str) -> DataFrame:
    n = F.col("ord")
    b = S.books(s, sf).withColumns({"categories": F.when(n % 2 == 0, F.array(F.lit("core"), F.lit("tech"))).otherwise(F.array().cast("array<string>")), "total": (n % 40).cast("int"), "shop_url": F.when(n % 3 == 0, F.lit("https://shop.example/x")), "catalog_url": F.lit(None).cast("string")})
    return _line(M.render_book(b, F.when(n % 4 == 0, F.lit("because"))), "ord")


def message_research(s: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    rows = table(s, sf, "pages").select(F.col("page_id").alias("rank"), F.col("url").alias("link"), F.struct(F.concat(F.lit("題"), n).alias("titleJa"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("sum "), n)).alias("summary"), F.array(F.lit("k1"), n).alias("keyPoints"), F.lit("示唆").alias("implications")).alias("translation"))
    return _line(M.render_research(rows, F.expr("TIMESTAMP_NTZ '2024-01-02 13:00:00'")), "rank", F.col("greeting"))


def message_guide(s: SparkSession, sf: str) -> DataFrame:
    n = F.col("ord")
    guide = F.struct(F.when(n % 4 != 0, F.lit("try")).otherwise("").alias("actionable"), F.array(F.lit("f1"), n.cast("string")).alias("facts"), F.when(n % 5 != 0, F.array(F.lit("e1"), F.lit("e2"))).alias("evidence"))
    a = S.articles(s, sf).withColumns({"guide": F.when(n % 3 != 0, guide), "summary": F.concat(F.lit("s "), n.cast("string"))})
    return _line(M.render_guide(a), "ord")


QUERIES = {f.__name__: f for f in (message_daily, message_platform, message_book, message_research, message_guide)}
_fields = lambda *named: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN coalesce({v}, '') <> '' THEN '{n}=' || {v} END" for n, v in named) + "], lambda x: x IS NOT NULL), '|')"
_shown = lambda title, url, text, footer, fields: f"coalesce({title}, '-') || '|' || coalesce({url}, '-') || '|' || coalesce({text}, '-') || '|' || coalesce({footer}, '-') || '|' || {fields}"
_host = lambda c: f"regexp_extract({c}, '^https?://([^/?#]+)', 1)"
_isbn = "replace(isbn, '-', '')"
_links = f"nullif(array_to_string(list_filter([CASE WHEN ord % 3 = 0 THEN '[楽天ブックス](https://shop.example/x)' WHEN isbn <> '' THEN '[楽天ブックス](https://books.rakuten.co.jp/search?sitem=' || {_isbn} || ')' END, CASE WHEN isbn <> '' THEN '[Amazon](https://www.amazon.co.jp/dp/' || {_isbn} || ')' END], lambda x: x IS NOT NULL), ' | '), '')"
_link = "(chr(10) || chr(10) || '[原文を読む](' || link || ') (*Source: ' || feed || '*)')"

_daily = _shown("title", "link", f"CASE WHEN ord % 5 <> 0 THEN substr(snippet, 1, 400) || '...' ELSE '{M.NO_SUMMARY}' END", f"'Source: ' || {_host('link')}", _fields(("🔬", "CASE WHEN ord % 2 = 0 THEN 'insight ' || ord END")))
_book = _shown(
    "'📚 今日の一冊'", "NULL", "'**' || title || '**'", "NULL",
    _fields(("✍️ 著者", "author"), ("🏢 出版社", "publisher"), ("📅 発売日", r"regexp_replace(pubdate, '([0-9]{4})([0-9]{2})([0-9]{2})', '\1年\2月\3日', 'g')"), ("🏷️ カテゴリ", "CASE WHEN ord % 2 = 0 THEN 'core + tech' END"), ("⭐ スコア", "((ord % 40) || '点')"),
            ("🤖 選書メモ", "CASE WHEN ord % 4 = 0 THEN 'because' END"), ("📖 ISBN", "isbn"), ("📝 概要", "substr(description, 1, 300)"), ("🔗 購入リンク", _links)),
)
_research = _shown("page_id || '. 題' || page_id", "url", "NULL", f"'Source: ' || {_host('url')}", _fields(("📝 要約", "CASE WHEN page_id % 2 = 0 THEN 'sum ' || page_id END"), ("🔍 重要ポイント", "('• k1' || chr(10) || '• ' || page_id)"), ("💡 日本の農業への示唆", "'示唆'")))
_guide = _shown(
    "'🌾 ' || title", "link", f"'{M.GUIDE_NOTE}' || chr(10) || chr(10) || '**【概要】**' || chr(10) || 's ' || ord", "NULL",
    _fields(("📊 本文が伝える具体的な事実", "CASE WHEN ord % 3 <> 0 THEN '・f1' || chr(10) || '・' || ord END"), ("💡 明日から使えるヒント", "CASE WHEN ord % 3 <> 0 AND ord % 4 <> 0 THEN '> try' END"), ("🧾 記事中の注目キーワード・発言", "CASE WHEN ord % 3 <> 0 AND ord % 5 <> 0 THEN '*「e1」*' || chr(10) || '*「e2」*' END")),
)
ORACLES = {
    "message_daily": f"WITH {ARTICLES} SELECT ord, md5({_daily} || '#' || '【議論】' || substr(title, 1, 80) || '#' || '{M.THEMES}' || chr(10) || CASE WHEN ord % 3 = 0 THEN '' ELSE '1. q' || ord || chr(10) || '2. why' END) AS message_md5 FROM articles",
    "message_platform": f"""WITH {ARTICLES}, v AS (SELECT ord, {_link} AS l, CASE WHEN ord % 2 = 0 THEN text ELSE substr(text, 1, 300) END AS t FROM articles), w AS (SELECT ord, CASE WHEN length(t) + length(l) <= {M.MOST_VALUE} THEN t || l ELSE substr(t, 1, {M.MOST_VALUE} - length(l) - 4) || '...' || l END AS value FROM v)
      SELECT ord, '[' || (ord % 20) || '点 | Biz] ［題］ ' || ord AS name, md5(value) AS value_md5, length(value)::INT AS size FROM w""",
    "message_book": f"WITH {BOOKS} SELECT ord, md5({_book}) AS message_md5 FROM books",
    "message_research": f"SELECT page_id AS ord, md5({_research} || '#' || '{M.GREETINGS['evening']}') AS message_md5 FROM pages",
    "message_guide": f"WITH {ARTICLES} SELECT ord, md5({_guide}) AS message_md5 FROM articles",
}
