"""Queries of streams and of ledgers that grow run by run: the test tables arrive in parts, each through the same checkpoint, and SQL over the
whole tables gives the rows that must stand at the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .operators import models as M
from .operators.bucketed import BucketedLedger
from .operators.outbox import Outbox
from .sources import arriving as A
from .sources import fixtures as S
from .sources.fixtures import ARTICLES
from .sources.readers import details_as_of, with_details
from .streaming import router as T
from .streaming import running as W
from .streaming.store import BatchStore
from .work import place, table

TREND = ["the", "and", "ing", "the", "with", "that", "was", "xyz"]


def arrive(df: DataFrame, part: Column, parts: int, start: Callable[[DataFrame], StreamingQuery], after: Callable[[StreamingQuery], None] | None = None) -> None:
    """df in parts: each is landed in one folder, and then what start() makes of the folder as a stream runs until it has read it."""
    spark, at = df.sparkSession, place(df.sparkSession, "arrivals")
    dealt = df.withColumn("_part", part)
    for i in range(parts):
        dealt.where(F.col("_part") == i).drop("_part").write.mode("append").parquet(at)
        query = start(spark.readStream.schema(df.schema).parquet(at))
        query.awaitTermination()
        if after:
            after(query)


# --- running engagement and trends


def event_posts(s: SparkSession, sf: str) -> DataFrame:
    """events as posts: the thread is a number of the properties, which are the content; errors have no thread."""
    thread = F.get_json_object("props", "$.k").cast("long") % 100
    url = F.when(F.col("event_type") != "error", F.concat(F.lit("https://news.example/"), thread.cast("string")))
    return table(s, sf, "events").select("event_id", url.alias("url"), F.col("props").alias("content"))


def running_engagement(s: SparkSession, sf: str) -> DataFrame:
    """Three arrivals; every two of them are folded into a whole table."""
    kept = W.engagement_table(s, place(s, "engagement"), fold=2)
    at = place(s, "checkpoint")
    arrive(event_posts(s, sf), F.col("event_id") % 3, 3, lambda posts: W.run_engagement(posts, kept, at))
    return W.engagement_now(kept)


def running_trends(s: SparkSession, sf: str) -> DataFrame:
    kept = W.trends_table(s, place(s, "trends"))
    at = place(s, "checkpoint")
    arrive(S.articles(s, sf).select("ord", "title"), F.col("ord") % 3, 3, lambda news: W.run_trends(news, TREND, kept, at))
    return W.trends_now(kept)


# --- repeats over time

BOUND = 4


def deliveries(s: SparkSession, sf: str) -> DataFrame:
    """The first event of each user and kind in each of three spans of ten days, delivered twice with its span, or a span later for every tenth user."""
    span = F.least(F.floor(F.date_diff("ts", F.lit("2024-01-01").cast("date")) / 10), F.lit(2)).cast("int")
    late = (F.col("user_id") % 10 == 0).cast("int")
    link = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    first = table(s, sf, "events").groupBy(link.alias("link"), (span + late).alias("arrival")).agg(F.min(F.col("ts").cast("timestamp")).alias("ts"))
    return first.unionAll(first)


def stream_distinct_links(s: SparkSession, sf: str) -> DataFrame:
    """What is left of the deliveries, and how many of all rows came too late."""
    kept, late, at = BatchStore(s, place(s, "distinct")), BatchStore(s, place(s, "late")), place(s, "checkpoint")
    start = lambda rows: W.run_distinct(rows, ["link"], "ts", f"{BOUND} days", kept, at)
    arrive(deliveries(s, sf), F.col("arrival"), 4, start, lambda query: W.record_late(query, late))
    counted = late.read("late", W.LATE).agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("late_rows"))
    rows = kept.read("distinct", "link string, ts timestamp, arrival int")
    return rows.crossJoin(F.broadcast(counted)).select("link", "arrival", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "late_rows")  # one row


# --- the log's five kinds

RECEIVED = "2024-01-02T00:00:00"
_post = lambda kind, **fields: F.to_json(F.struct(F.lit(kind).alias("type"), *(c.alias(n) for n, c in fields.items())))


def log_posts(s: SparkSession, sf: str) -> DataFrame:
    """orders as posts: five kinds, one that there is not, and broken text."""
    n, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    text = lambda t: F.concat(F.lit(f"{t} "), key)
    some = lambda c, every: F.when(n % every != 0, c)
    article = lambda i: F.struct(F.concat(F.lit(f"https://a.example/{i}/"), key).alias("url"), text("title").alias("title"), F.col("o_orderstatus").alias("pubDate"), F.col("o_orderpriority").alias("priority"), (n % 50 + i).alias("score"))
    bodies = [
        _post("newBook", isbn=F.concat(F.lit("978"), key), title=some(text("book"), 4), author=F.col("o_orderpriority"), score=some((n % 30).cast("string"), 3), postedDate=some(F.lit("2024-01-01"), 2)),
        _post("discussion", timestamp=some(F.lit("2024-01-01T10:00:00"), 5), userId=key, username=text("user"), content=some(text('a "quoted"\nline'), 4), newsUrl=text("url"), userRole=some(F.lit(1), 2)),
        _post("news", title=text("news"), link=F.concat(F.lit("https://n.example/"), key), newsDate=F.col("o_orderstatus"), insight=some(text("why"), 3), discussionQuestions=F.array(text("q1"), text("q2"))),
        _post("addArticles", articles=F.when(n % 4 == 1, F.array().cast("array<struct<url: string, title: string, pubDate: string, priority: string, score: bigint>>")).otherwise(F.array(article(0), article(1)))),
        _post("globalResearch", titleOriginal=text("original"), titleJa=text("題"), link=F.concat(F.lit("https://g.example/"), key), summary=some(text("sum"), 3), keyPoints=text("points"), publishDate=F.col("o_orderstatus")),
        _post("somethingElse", title=text("t")),
        F.concat(F.lit("{broken "), key),
    ]
    body = F.coalesce(*(F.when(n % 7 == i, b) for i, b in enumerate(bodies)))
    return table(s, sf, "orders").select(n, body.alias("body"), F.lit(RECEIVED).alias("received_at"))


def post_router(s: SparkSession, sf: str) -> DataFrame:
    """Every row of every log as one text, and the rejected posts with the reason."""
    store, at = BatchStore(s, place(s, "logs")), place(s, "checkpoint")
    arrive(log_posts(s, sf).select("body", "received_at", "o_orderkey"), F.col("o_orderkey") % 3, 3, lambda posts: T.run_router(posts.drop("o_orderkey"), store, at))
    out = []
    for kind in [*T.LOGS, "rejected"]:
        rows = T.log(store, kind)
        cells = [F.coalesce(F.col(c).cast("bigint").cast("string") if t == "double" else F.col(c).cast("string"), F.lit("-")) for c, t in rows.dtypes]
        out.append(rows.select(F.lit(kind).alias("log"), F.concat_ws("|", *cells).alias("line")))
    first, *others = out
    for o in others:
        first = first.unionAll(o)
    return first


# --- what a run sends


def outbox_runs(s: SparkSession, sf: str) -> DataFrame:
    """Three runs whose selections overlap: the first is started twice, the second dies between its append and its end, and is started again."""
    box = Outbox(s, place(s, "outbox"), "link", "ord long, link string")
    a = S.articles(s, sf).select(F.col("ord").cast("long").alias("ord"), "link")

    def dies(rows: DataFrame) -> None:
        raise ConnectionError("the first time")

    for run, rows, sender in (("one", "ord % 3 = 0", None), ("one", "ord % 3 = 0", None), ("two", "ord % 5 < 2", dies), ("three", "ord % 2 = 0", None), ("two", "true", None)):
        try:
            box.emit(run, a.where(rows), sender)
        except ConnectionError:
            pass
    return box.messages().select("run", "ord", "link")


def headline_posted_bucketed(s: SparkSession, sf: str) -> DataFrame:
    """The ledger comes in two parts, and is compacted between them."""
    path = place(s, "ledger")
    ledger = BucketedLedger(s, f"ledger_{path.rsplit('-', 1)[-1]}", path, "doc_id", 8)
    posted = S.posted(s, sf)
    ledger.append(posted.where("doc_id % 2 = 0"))
    ledger.compact(place(s, "ledger"))
    ledger.append(posted.where("doc_id % 2 = 1"))
    return ledger.absent(S.articles(s, sf).select("ord", "link", F.col("ord").alias("doc_id"))).select("ord", "link")


# --- feeds that arrive


def feed_arrivals(s: SparkSession, sf: str) -> DataFrame:
    """Three arrivals of two feeds, with items that are broken or have no link."""
    n, name = F.col("page_id"), F.col("page_id").cast("string")
    link = F.when(n % 7 != 0, F.concat(F.lit("<link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link>"))).otherwise("")
    day = F.date_format(F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(page_id AS INT))"), "EEE, dd MMM yyyy HH:mm:ss")
    item = F.concat(F.lit("<item><title>page "), name, F.when(n % 11 == 3, "</titl>").otherwise("</title>"), link, F.lit("<description>d"), name, F.lit("</description><pubDate>"), day, F.lit(" GMT</pubDate></item>"))
    items = table(s, sf, "pages").select((n % 2).alias("feed"), (n % 3).alias("part"), n.alias("n"), item.alias("item"))
    files = items.groupBy("feed", "part", (F.col("n") % 30).alias("file")).agg(F.array_join(F.array_sort(F.collect_list("item")), "\n").alias("xml"))  # as a feed's server writes them
    at, checkpoint, store = place(s, "feeds"), place(s, "checkpoint"), BatchStore(s, place(s, "items"))
    archive = place(s, "archive")
    for part in range(3):
        files.where(F.col("part") == part).repartition(1).select("feed", F.concat(F.lit("<rss><channel>"), "xml", F.lit("</channel></rss>"))).write.mode("append").partitionBy("feed").text(at)
        A.run_feeds(A.landed_files(s, at, archive), store, checkpoint).awaitTermination()
    good, bad = store.read("items", A.ITEMS), store.read("rejected", A.REJECTED)
    rows = good.select(F.lit("item").alias("kind"), "feed", F.regexp_extract("snippet", "^d([0-9]+)$", 1).cast("long").alias("page_id"), "link", F.date_format("iso_ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
    return rows.unionAll(bad.select(F.col("reason"), "feed", F.regexp_extract("text", "<description>d([0-9]+)<", 1).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string")))


def details_over_time(s: SparkSession, sf: str) -> DataFrame:
    """What a run of each of two days joins: parts with the newest order line that was known on the day as their detail."""
    day = F.col("l_shipdate").cast("date")
    known = table(s, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("isbn"), day.alias("known_at"), F.concat(F.lit("detail "), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("title"), *(F.lit(None).cast("string").alias(c) for c in ("author", "publisher", "pubdate", "description")))
    hints = table(s, sf, "part").select(F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("isbn"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("").alias("title"))
    days = ["1993-06-15", "1997-06-15"]
    one, two = (with_details(hints, details_as_of(known, F.lit(d).cast("date"))).select(F.lit(d).alias("day"), "isbn", "title") for d in days)
    return one.unionAll(two)


# --- models


def stub_client() -> Callable[[list[str]], list[str | None]]:
    """A model for tests: answers by the length of the prompt, fails for lengths that 5 divides, and gives no JSON for those that 3 divides."""

    def client(prompts: list[str]) -> list[str | None]:
        if any(len(p) % 5 == 0 for p in prompts):
            raise TimeoutError("no answer in time")
        return ["I cannot." if len(p) % 3 == 0 else 'Sure: {"titleJa": "題 %d", "insight": "why %d", "questions": ["q"], "summary": "s %d"} end' % ((len(p),) * 3) for p in prompts]

    return client


def model_translation(s: SparkSession, sf: str) -> DataFrame:
    a = S.articles(s, sf).select("ord", "title", F.when(F.col("ord") % 2 == 0, F.col("text")).alias("body"), "snippet")
    return M.translated(a, stub_client, pause=0.0).select("ord", F.col("translation.titleJa").alias("title_ja"))


def model_insight(s: SparkSession, sf: str) -> DataFrame:
    a = S.articles(s, sf).select("ord", "title", "snippet")
    trend = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("soil "), F.col("ord").cast("string"))).otherwise(M.NO_TREND)
    return M.with_insight(a, trend, stub_client, pause=0.0).select("ord", "insight.insight", F.size("insight.questions").alias("questions"), F.col("error").isNotNull().alias("failed"))


def model_guide_summary(s: SparkSession, sf: str) -> DataFrame:
    a = S.articles(s, sf).select("ord", "title", F.when(F.col("ord") % 4 != 0, F.col("text")).alias("body"))
    return M.with_guide_summary(a, stub_client, pause=0.0).select("ord", "summary", F.col("guide").isNotNull().alias("answered"))


POSTS_SQL = "posts AS (SELECT 'https://news.example/' || ((props->>'$.k')::BIGINT % 100) AS url, props::VARCHAR AS content FROM events WHERE event_type <> 'error')"
_listed = "(VALUES " + ", ".join(f"({i}, '{w}')" for i, w in enumerate(TREND)) + ") AS k(n, keyword)"
_some = lambda v, every, other="'-'": f"CASE WHEN n % {every} <> 0 THEN {v} ELSE {other} END"
_row = lambda *cells: " || '|' || ".join(cells)
_lines = {
    "newBook": _row(f"'{RECEIVED}'", "'978' || n", _some("'book ' || n", 4, "''"), "o_orderpriority", "''", "''", _some("(n % 30)", 3, "0"), "''", "''", _some("'2024-01-01'", 2, f"'{RECEIVED}'")),
    "discussion": _row(_some("'2024-01-01T10:00:00'", 5, f"'{RECEIVED}'"), "n", "'user ' || n", _some("'a \"quoted\"' || chr(10) || 'line ' || n", 4), "'-'", "'url ' || n", "'-'", _some("'1'", 2)),
    "news": _row(f"'{RECEIVED}'", "'news ' || n", "'https://n.example/' || n", "o_orderstatus", _some("'why ' || n", 3), "'q1 ' || n || chr(10) || 'q2 ' || n"),
    "addArticles": _row(f"'{RECEIVED}'", "'https://a.example/' || i || '/' || n", "'title ' || n", "o_orderstatus", "o_orderpriority", "(n % 50 + i)"),
    "globalResearch": _row(f"'{RECEIVED}'", "'original ' || n", "'題 ' || n", "'https://g.example/' || n", _some("'sum ' || n", 3), "'points ' || n", "'-'", "o_orderstatus"),
}
_from = lambda i, kind: f"SELECT '{kind}' AS log, {_lines[kind]} AS line FROM o" + (", (VALUES (0), (1)) AS v(i)" if kind == "addArticles" else "") + f" WHERE n % 7 = {i}" + (" AND n % 4 <> 1" if kind == "addArticles" else "")
QUERIES = {f.__name__: f for f in (running_engagement, running_trends, stream_distinct_links, post_router, outbox_runs, headline_posted_bucketed, feed_arrivals, details_over_time, model_translation, model_insight, model_guide_summary)}
ORACLES = {
    "running_engagement": f"WITH {POSTS_SQL} SELECT url, count(*) AS posts, sum(length(content))::BIGINT AS total_length, floor(sum(length(content))::DOUBLE / count(*) + 0.5)::BIGINT AS mean_length FROM posts WHERE url IS NOT NULL GROUP BY url",
    "running_trends": f"WITH {ARTICLES}, hits AS (SELECT ord, n, keyword FROM articles JOIN {_listed} ON contains(lower(title), keyword)) SELECT keyword, count(*)::BIGINT AS hits, row_number() OVER (ORDER BY count(*) DESC, min(ord * 1000 + n))::INT AS rank FROM hits GROUP BY keyword",
    "stream_distinct_links": f"""WITH RECURSIVE d AS (SELECT user_id || ':' || event_type AS link, (least(date_diff('day', DATE '2024-01-01', ts::DATE) // 10, 2) + (user_id % 10 = 0)::INT)::INT AS arrival, min(ts) AS ts FROM events GROUP BY ALL),
      tops AS (SELECT arrival, max(ts) AS top FROM d GROUP BY arrival), marks AS (SELECT t.arrival, max(u.top) - INTERVAL {BOUND} DAY AS mark FROM tops t LEFT JOIN tops u ON u.arrival < t.arrival GROUP BY t.arrival),
      m AS (SELECT d.*, mark, coalesce(ts <= mark, false) AS late, row_number() OVER (PARTITION BY link, coalesce(ts <= mark, false) ORDER BY arrival) AS i FROM d JOIN marks USING (arrival)),
      k AS (SELECT link, arrival, ts, i, true AS kept, ts + INTERVAL {BOUND} DAY AS until FROM m WHERE NOT late AND i = 1
        UNION ALL SELECT m.link, m.arrival, m.ts, m.i, k.until <= m.mark, CASE WHEN k.until <= m.mark THEN m.ts + INTERVAL {BOUND} DAY ELSE k.until END FROM k JOIN m ON m.link = k.link AND NOT m.late AND m.i = k.i + 1)
      SELECT link, arrival, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, (SELECT 2 * count(*) FROM m WHERE late)::BIGINT AS late_rows FROM k WHERE kept""",
    "post_router": "WITH o AS (SELECT o_orderkey AS n, o_orderstatus, o_orderpriority FROM orders) " + " UNION ALL ".join(_from(i, kind) for i, kind in enumerate(T.LOGS))
    + f""" UNION ALL SELECT 'rejected', '{{"type":"somethingElse","title":"t ' || n || '"}}|{RECEIVED}|unknown kind' FROM o WHERE n % 7 = 5 UNION ALL SELECT 'rejected', '{{broken ' || n || '|{RECEIVED}|no JSON object' FROM o WHERE n % 7 = 6""",
    "outbox_runs": f"WITH {ARTICLES}, r AS (SELECT ord::BIGINT AS ord, link, CASE WHEN ord % 3 = 0 THEN 'one' WHEN ord % 5 < 2 THEN 'two' WHEN ord % 2 = 0 THEN 'three' END AS run FROM articles) SELECT run, ord, link FROM r WHERE run IS NOT NULL",
    "headline_posted_bucketed": f"WITH {ARTICLES} SELECT ord, link FROM articles WHERE ord NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL)",
    "feed_arrivals": """SELECT CASE WHEN page_id % 11 = 3 THEN 'broken item' WHEN page_id % 7 = 0 THEN 'no link' ELSE 'item' END AS kind, (page_id % 2)::VARCHAR AS feed, page_id,
      CASE WHEN page_id % 11 <> 3 AND page_id % 7 <> 0 THEN url END AS link, CASE WHEN page_id % 11 <> 3 AND page_id % 7 <> 0 THEN strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(page_id), '%Y-%m-%d %H:%M:%S') END AS at FROM pages""",
    "details_over_time": """WITH days AS (SELECT unnest(['1993-06-15', '1997-06-15']) AS day), l AS (SELECT l_partkey, l_shipdate::DATE AS d, 'detail ' || l_orderkey || '/' || l_linenumber AS title FROM lineitem),
      k AS (SELECT day, l_partkey, title FROM days JOIN l ON d <= day::DATE QUALIFY row_number() OVER (PARTITION BY day, l_partkey ORDER BY d DESC, title DESC) = 1)
      SELECT days.day, p_partkey::VARCHAR AS isbn, coalesce(k.title, p_name) AS title FROM days CROSS JOIN part LEFT JOIN k ON k.day = days.day AND k.l_partkey = p_partkey WHERE k.title IS NOT NULL OR p_partkey % 2 = 0""",
    "model_translation": f"""WITH {ARTICLES}, c AS (SELECT ord, title, coalesce(nullif(CASE WHEN ord % 2 = 0 THEN text END, ''), snippet, '') AS content FROM articles), n AS (SELECT ord, length('Translate and summarise as JSON.' || chr(10) || title || chr(10) || content) AS n FROM c WHERE length(content) >= 200)
      SELECT ord, '題 ' || n AS title_ja FROM n WHERE n % 5 <> 0 AND n % 3 <> 0""",
    "model_insight": f"""WITH {ARTICLES}, n AS (SELECT ord, length(CASE WHEN ord % 2 = 0 THEN 'Trend of the last days: soil ' || ord || chr(10) ELSE '' END || 'Give an insight and questions as JSON.' || chr(10) || title || chr(10) || snippet) AS n FROM articles WHERE title IS NOT NULL),
      a AS (SELECT ord, n, n % 5 <> 0 AND n % 3 <> 0 AS ok FROM n) SELECT ord, CASE WHEN ok THEN 'why ' || n ELSE '{M.FALLBACK_INSIGHT}' END AS insight, CASE WHEN ok THEN 1 ELSE 3 END::INT AS questions, n % 5 = 0 AS failed FROM a""",
    "model_guide_summary": f"""WITH {ARTICLES}, n AS (SELECT ord, CASE WHEN ord % 4 <> 0 THEN length('Summarise as JSON what the text says.' || chr(10) || title || chr(10) || substr(text, 1, 3000)) END AS n FROM articles),
      a AS (SELECT ord, n, coalesce(n % 5 <> 0 AND n % 3 <> 0, false) AS answered FROM n) SELECT ord, CASE WHEN answered THEN 's ' || n ELSE '{M.FALLBACK_SUMMARY}' END AS summary, answered FROM a""",
}
