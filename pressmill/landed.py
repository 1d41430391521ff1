"""Queries of readers, sinks and ledgers: they land the test tables in the forms that sources have, read them back, and have SQL for the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates as D
from .functions import text as X
from .operators import ledger as L
from .operators import news as N
from .plans import pipelines as P
from .sources import fixtures as S
from .sources import readers as I
from .sources.fixtures import ARTICLES, BOOKS
from .work import place, table

AS_OF, NOW, BOOK_DAY = "TIMESTAMP_NTZ '2024-01-02 00:00:00'", "2024-01-02 00:00:00", "TIMESTAMP_NTZ '1992-02-10 09:30:00'"
WORDS = ["ring", "brass"]


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def land(lines: DataFrame, tag: str) -> str:
    path = place(lines.sparkSession, tag)
    lines.write.text(path)
    return path


# --- feeds


def feed_items(s: SparkSession, sf: str) -> DataFrame:
    """Two feeds, dates in both forms; items without a link go."""
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(page_id AS INT))")
    n, name = F.col("page_id"), F.col("page_id").cast("string")
    iso = F.when(n % 2 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    mail = F.when(n % 2 == 1, F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    pages = table(s, sf, "pages").select("page_id", F.concat(F.lit("A & B "), name).alias("title"), F.when(n % 7 != 0, F.col("url")).alias("link"), F.concat(F.lit("d"), name).alias("description"), iso.alias("isoDate"), mail.alias("pubDate"))
    feeds = []
    for feed, part in (("one", (0, 1)), ("two", (2,))):
        paths = [place(s, "feed") for _ in part]
        for i, path in zip(part, paths, strict=True):
            pages.where(n % 3 == i).drop("page_id").write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
        feeds.append(I.rss(s, paths, feed))
    return I.union_all(feeds).select("feed", "title", "link", "snippet", F.date_format("iso_ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


def titled_feed_items(s: SparkSession, sf: str) -> DataFrame:
    """Two feeds, told apart by their titles."""
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(page_id AS INT))")
    n, name = F.col("page_id"), F.col("page_id").cast("string")
    link = F.when(n % 7 != 0, F.concat(F.lit("<link>"), escaped(F.col("url")), F.lit("</link>"))).otherwise("")
    item = F.concat(F.lit("<item><title>t"), name, F.lit("</title>"), link, F.lit("<isoDate>"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</isoDate></item>"))
    feeds = table(s, sf, "pages").groupBy((n % 2).alias("feed"), (n % 30).alias("file")).agg(F.array_join(F.collect_list(item), "").alias("items"))  # files as a server writes them
    xml = F.concat(F.lit("<rss><channel><title>Feed &amp; "), F.col("feed").cast("string"), F.lit("</title>"), "items", F.lit("</channel></rss>"))
    path = place(s, "feeds")
    feeds.select(xml).write.option("maxRecordsPerFile", 1).text(path)
    return I.titled_rss(s, [path]).select("source", "title", "link", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"))


def guide_first_item(s, sf):
    return I.first_item(S.articles(s, sf)).where(N.guide_is_fresh(F.col("iso_ts"), F.expr(AS_OF))).select("feed", "ord", "link")


# --- catalogues

ANSWER = 30


def _answers(parts: DataFrame, item: Column, name: str) -> DataFrame:
    """Answers of ANSWER items, one a line."""
    return parts.groupBy(F.floor(F.col("p_partkey") / ANSWER)).agg(F.to_json(F.struct(F.collect_list(item).alias(name))).alias("value")).select("value")


def shop_answers(s, sf):
    """The search by date with reviews, and the one by sales without; sales dates in four forms."""
    day, form = F.expr("date_add(DATE '2024-01-01', p_size)"), F.col("p_partkey") % 4
    sold = F.when(form == 0, F.date_format(day, "yyyy年MM月dd日")).when(form == 1, F.date_format(day, "yyyy年MM月")).when(form == 2, "2024年13月40日").otherwise(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("頃")))
    item = F.struct(F.struct(F.col("p_name").alias("title"), F.col("p_type").alias("author"), F.col("p_brand").alias("publisherName"), F.concat(F.lit("978"), F.col("p_partkey").cast("string")).alias("isbn"), sold.alias("salesDate"), F.col("p_size").cast("int").alias("reviewCount"), F.when(form == 3, "none").otherwise("4.5").alias("reviewAverage")).alias("Item"))
    path = land(_answers(table(s, sf, "part"), item, "Items"), "shop")
    both = [I.shop_books(s, path, "2024-06-01", reviews, multi_line=False).withColumn("by_date", F.lit(reviews)) for reviews in (True, False)]
    return I.union_all(both).select("by_date", "isbn", "title", "author", "publisher", "pubdate", "review_count", "review_average")


def volume_answers(s, sf):
    """Volumes with both numbers, with the short one only, and with none."""
    n, key = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    number = lambda kind, start: F.struct(F.lit(kind).alias("type"), F.concat(F.lit(start), key).alias("identifier"))
    numbers = F.when(n == 0, F.array(number("ISBN_10", "4"), number("ISBN_13", "978"))).when(n == 1, F.array(number("ISBN_10", "4")))
    item = F.struct(F.struct(F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("authors"), F.lit("2024-01-05").alias("publishedDate"), numbers.alias("industryIdentifiers")).alias("volumeInfo"))
    found = I.volume_books(s, land(_answers(table(s, sf, "part"), item, "items"), "volumes"), multi_line=False)
    return found.select("title", "author", "isbn", "pubdate").dropDuplicates()


def library_answers(s, sf):
    """Items without an ISBN, or with one that is too short, go."""
    n, key = F.col("p_partkey") % 4, F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    isbn = F.when(n == 0, F.concat(F.lit('<dc:identifier xsi:type="dcndl:ISBN">978-4'), key, F.lit("</dc:identifier>"))).when(n == 1, F.concat(F.lit('<rdfs:seeAlso rdf:resource="urn:isbn:4'), key, F.lit('"/>'))).otherwise("")
    item = F.concat(F.lit("<channel><item><title> "), F.col("p_name"), F.lit(" </title><author>"), F.col("p_type"), F.lit("</author><dc:publisher>"), F.col("p_brand"), F.lit("</dc:publisher>"), isbn, F.lit("<pubDate>2024</pubDate></item></channel>"))
    return I.search_items(table(s, sf, "part").select(item.alias("xml"))).select("title", "author", "publisher", "isbn", "pubdate")


def release_page(s, sf):
    """Hints of links and what stands around them, filtered by WORDS before and after the details come in."""
    key = F.lpad(F.col("p_partkey").cast("string"), 10, "0")
    link = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit('<img alt="'), F.col("p_name"), F.lit('">'))).otherwise(F.col("p_name"))
    html = F.concat(F.lit('<ul><li><a href="https://shop.example/bd/isbn/978'), key, F.lit('">'), link, F.lit("</a> 著者："), F.replace("p_type", F.lit(" "), F.lit("-")), F.lit(" 出版社："), F.col("p_brand"), F.lit(" 2024年1月5日</li></ul>"))
    p = table(s, sf, "part")
    known = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("978"), key).alias("isbn"), F.concat(F.lit("Full "), "p_name").alias("title"), F.lit("someone").alias("author"), F.col("p_brand").alias("publisher"), F.lit("20240105").alias("pubdate"), F.lit("").alias("description"))
    return I.with_details(I.release_hints(p.select(html.alias("html")), WORDS), known, WORDS).select("isbn", "title", "author", "publisher", "pubdate")


# --- pages


def _page(c: Column) -> Column:
    n = F.col("doc_id") % 4
    around = [("<article>", "</article><p>no</p>"), ('<p>no</p><div id="content">', "</div>"), ("<div><p>", "</p></div>"), ("<article></article><main>no</main><p>", "</p>")]
    return F.coalesce(*(F.when(n == i, F.concat(F.lit(a), c, F.lit(b))) for i, (a, b) in enumerate(around)))


def body_selectors(s, sf):
    """The first selector that matches, and paragraphs where it holds nothing."""
    return table(s, sf, "documents").select("doc_id", F.md5(X.page_body(_page(escaped(F.col("text")))).cast("binary")).alias("body_md5"))


def guide_bodies(s, sf):
    """Without menus and scripts; short ones give way to the snippet."""
    html = F.concat(F.lit("<header>no</header><main><nav><ul><li>menu</li></ul></nav>"), escaped(F.col("text")), F.lit("<script>no()</script></main>"))
    return table(s, sf, "documents").select("doc_id", F.md5(X.guide_body(html, F.concat(F.lit("snippet "), F.col("doc_id").cast("string"))).cast("binary")).alias("body_md5"))


def enrich_gate(s, sf):
    """A stub in place of a model; texts under 200 characters are not asked about."""
    pages = table(s, sf, "documents").select("doc_id", F.concat(F.lit("<article>"), escaped(F.col("text")), F.lit("</article>")).alias("html"))
    answer = lambda prompt: F.concat(F.lit('Sure: {"size": '), F.char_length(prompt).cast("string"), F.lit("}"))
    return P.enrich(pages, answer, F.col("content"), "size bigint").select("doc_id", F.col("answer.size").alias("size"))


# --- ledgers and sinks


def _posted_books(s, sf) -> DataFrame:
    """A ledger written twice over; the second time adds nothing."""
    path = place(s, "ledger")
    missing = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    rows = S.books(s, sf).where("ord % 3 = 0").groupBy("isbn").agg(F.min("title").alias("title"), F.min("ord").alias("score"))
    rows = rows.select("isbn", F.when(F.col("score") % 2 == 0, F.col("title")).alias("title"), F.when(F.col("score") % 5 > 0, F.col("score")).alias("score"), *missing("timestamp", "author", "publisher", "pubdate", "categories", "book_type"))
    rows = L.book_row(rows, F.lit(NOW))
    for _ in range(2):
        L.append_once(rows, path, "isbn")
    return I.ledger(s, path, rows.schema.simpleString()[7:-1].replace(":", " "))


def ledger_book_rows(s, sf):
    return _posted_books(s, sf).select("timestamp", "isbn", "title", "author", F.col("score").cast("long").alias("score"))


def posted_isbn_antijoin(s, sf):
    posted = _posted_books(s, sf).where("trim(isbn) <> ''")
    return N.not_in(S.books(s, sf).where("isbn <> ''"), posted, "isbn").select("ord", "isbn")


def recent_news_ledger(s, sf):
    """The news of the last seven days; a ledger that does not exist adds no rows."""
    path = place(s, "news")
    S.recent_news(s, sf).write.parquet(path)
    schema = "ord long, title string, at timestamp_ntz"
    both = I.union_all([I.ledger(s, path, schema), I.ledger(s, f"{path}-absent", schema)])
    return both.where(N.recent(F.col("at"), F.expr("TIMESTAMP_NTZ '2024-01-08 12:00:00'"), 7 * 24)).select("ord", "title")


def discussion_ledger(s, sf):
    """Posts appended by kind, and the engagement worked out from what is read back."""
    path = place(s, "logs")
    posts = table(s, sf, "conversations").select(F.when(F.col("role") == "user", "Discussion").otherwise("news").alias("type"), F.col("text").alias("content"), F.col("conv_id").cast("string").alias("news_url"), F.col("turn").alias("score"), *(F.lit(None).cast("string").alias(c) for c in ("timestamp", "url", "title", "pub_date", "priority", "user_id", "username", "news_title", "news_post_date")))
    rows = L.log_rows(posts, F.lit(NOW))
    L.append_typed(rows, path, "sink")
    log = I.ledger(s, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))
    return N.engagement(log.where("sink = 'discussion'"), url="news_url").select("url", "posts", "total_length", "mean_length")


def guide_draft(s, sf):
    """The draft's one row, overwritten by each guide."""
    path, pages = place(s, "draft"), table(s, sf, "pages")
    for page in (2, 1):
        L.overwrite_guide(pages.where(F.col("page_id") == page).select(F.concat(F.lit("guide "), F.col("page_id").cast("string")).alias("rendered"), F.concat("url", F.lit("?utm_source=x")).alias("url")), path)
    return I.ledger(s, path, "rendered string, url string")


def sheet_cells(s, sf):
    """The cells that a mail is made of, from a sheet with a row for each benchmark item."""
    sheet = table(s, sf, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("A"), F.md5(F.col("text").cast("binary")).alias("B"))
    return I.cells(sheet, {"article": "A1", "url": "A2", "subject": "B1", "body": "B2", "post": "B4", "absent": "B999999"})


def sheet_list(s, sf):
    sheet = table(s, sf, "customer").select(F.col("c_custkey").alias("ord"), F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")).alias("A"))
    return I.sheet_column(sheet, "A")


def registration_details(s, sf):
    """Forms as JSON, the address under either of its names; what is missing is a dash."""
    address, name = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.com")), F.col("o_orderkey").cast("string")
    n = F.col("o_orderkey") % 3
    body = F.to_json(F.struct(F.when(n == 0, address).alias("email"), F.when(n == 1, address).alias("Email"), name.alias("name"), F.col("o_orderpriority").alias("registration_type")))
    return L.detail_row(I.registration(table(s, sf, "orders").select(body.alias("body"))), ["name", "email", "registration_type", "page_url"])


def mail_counts(s, sf):
    """What the log says of a run: recipients, and articles by group."""
    a, t = S.articles(s, sf), F.col("text")
    return N.group_counts(a, {"articles": F.lit(True), "with_that": F.contains(t, F.lit("that")), "fresh": N.recent(F.col("iso_ts"), F.expr(AS_OF), 24)})


# --- texts and dates


def text_rules(s, sf):
    day = F.date_format(F.expr("date_add(DATE '2024-01-01', p_size)"), "yyyyMMdd")
    return table(s, sf, "part").select("p_partkey", X.shorten(F.col("p_name"), 9).alias("short"), X.japanese_date(day).alias("day"), X.escape_brackets(F.concat(F.lit("["), "p_brand", F.lit("]"))).alias("plain"), X.bullets(F.split("p_type", " ")).alias("listed"), X.strip_isbn(F.concat(F.lit("978-4-"), F.col("p_size").cast("string"), F.lit("-0"))).alias("isbn"))


def far_future_books(s, sf):
    b = S.books(s, sf).withColumn("pubdate", F.regexp_replace("pubdate", "[-/年月日]", ""))
    return b.where(D.not_far_future(F.col("pubdate"), F.expr(BOOK_DAY))).select("ord", "pubdate")


NAMES = """feed_items titled_feed_items guide_first_item shop_answers volume_answers library_answers release_page body_selectors guide_bodies enrich_gate
ledger_book_rows posted_isbn_antijoin recent_news_ledger discussion_ledger guide_draft sheet_cells sheet_list registration_details
mail_counts text_rules far_future_books"""
QUERIES = {n: globals()[n] for n in NAMES.split()}

_WIDE = r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ENDS = r"[\x{09}-\x{0D}\x{20}\x{A0}\x{3000}\x{FEFF}]"
_trim = lambda c: f"regexp_replace({c}, '^{_ENDS}+|{_ENDS}+$', '', 'g')"
_body = f"substr({_trim(f'''regexp_replace(text, '{_WIDE}{_WIDE}+', ' ', 'g')''')}, 1, 8000)"
_guide = _trim(f"regexp_replace(regexp_replace(text, '{_WIDE}+', ' ', 'g'), '[0-9]{{4}}年[0-9]{{1,2}}月[0-9]{{1,2}}日', '', 'g')")
_names = lambda *cs: "(" + " OR ".join(f"contains(lower(concat_ws(' ', {', '.join(cs)})), '{w}')" for w in WORDS) + ")"
_posted = "posted AS (SELECT isbn, min(title) AS t, min(ord) AS k FROM books WHERE ord % 3 = 0 GROUP BY isbn)"
_isbn = "'978' || lpad(p_partkey::VARCHAR, 10, '0')"
_day = "(DATE '2024-01-01' + p_size::INT)"

ORACLES = {
    "feed_items": "SELECT CASE WHEN page_id % 3 = 2 THEN 'two' ELSE 'one' END AS feed, 'A & B ' || page_id AS title, url AS link, 'd' || page_id AS snippet, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(page_id), '%Y-%m-%d %H:%M:%S') AS at FROM pages WHERE page_id % 7 <> 0",
    "titled_feed_items": "SELECT 'Feed & ' || (page_id % 2) AS source, 't' || page_id AS title, url AS link, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(page_id), '%Y-%m-%d %H:%M:%S') AS published FROM pages WHERE page_id % 7 <> 0",
    "guide_first_item": f"WITH {ARTICLES}, f AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY ord) AS n FROM articles) SELECT feed, ord, link FROM f WHERE n = 1 AND iso_ts >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR",
    "shop_answers": f"""SELECT by_date, '978' || p_partkey AS isbn, p_name AS title, p_type AS author, p_brand AS publisher, CASE p_partkey % 4 WHEN 1 THEN strftime({_day}, '%Y%m') WHEN 2 THEN '' ELSE strftime({_day}, '%Y%m%d') END AS pubdate,
      CASE WHEN by_date THEN p_size::INT END AS review_count, CASE WHEN by_date AND p_partkey % 4 <> 3 THEN 4.5::DOUBLE END AS review_average FROM part, (VALUES (true), (false)) AS v(by_date)""",
    "volume_answers": "SELECT DISTINCT p_name AS title, p_brand || ', ' || p_type AS author, CASE p_partkey % 3 WHEN 0 THEN '978' || p_partkey WHEN 1 THEN '4' || p_partkey ELSE '' END AS isbn, '20240105' AS pubdate FROM part",
    "library_answers": "SELECT p_name AS title, p_type AS author, p_brand AS publisher, CASE p_partkey % 4 WHEN 0 THEN '9784' ELSE '4' END || lpad(p_partkey::VARCHAR, 9, '0') AS isbn, '2024' AS pubdate FROM part WHERE p_partkey % 4 < 2",
    "release_page": f"""WITH h AS (SELECT p_partkey, p_name AS n, replace(p_type, ' ', '-') AS a, p_brand AS b, {_isbn} AS isbn FROM part), k AS (SELECT * FROM h WHERE {_names("n", "a", "b")}),
      d AS (SELECT isbn, CASE WHEN p_partkey % 3 = 0 THEN 'Full ' || n ELSE n END AS title, CASE WHEN p_partkey % 3 = 0 THEN 'someone' ELSE a END AS author, b AS publisher, CASE WHEN p_partkey % 3 = 0 THEN '20240105' ELSE '2024-1-5' END AS pubdate FROM k)
      SELECT * FROM d WHERE {_names("title", "author", "publisher")}""",
    "body_selectors": f"SELECT doc_id, md5(nullif({_body}, '')) AS body_md5 FROM documents",
    "guide_bodies": f"SELECT doc_id, md5(CASE WHEN length({_guide}) > 200 THEN {_guide} ELSE 'snippet ' || doc_id END) AS body_md5 FROM documents",
    "enrich_gate": f"SELECT doc_id, CASE WHEN length({_body}) >= 200 THEN length({_body})::BIGINT END AS size FROM documents",
    "ledger_book_rows": f"WITH {BOOKS}, {_posted} SELECT '{NOW}' AS timestamp, isbn, CASE WHEN k % 2 = 0 THEN t ELSE '' END AS title, '' AS author, CASE WHEN k % 5 > 0 THEN k ELSE 0 END::BIGINT AS score FROM posted",
    "posted_isbn_antijoin": f"WITH {BOOKS}, {_posted} SELECT ord, isbn FROM books WHERE isbn <> '' AND isbn NOT IN (SELECT isbn FROM posted WHERE trim(isbn) <> '')",
    "recent_news_ledger": "SELECT item_id AS ord, text AS title FROM benchmark WHERE TIMESTAMP '2024-01-01 00:00:00' + to_hours(item_id) >= TIMESTAMP '2024-01-08 12:00:00' - INTERVAL 7 DAY",
    "discussion_ledger": "SELECT conv_id::VARCHAR AS url, count(*)::BIGINT AS posts, sum(length(coalesce(text, '')))::BIGINT AS total_length, floor(sum(length(coalesce(text, '')))::DOUBLE / count(*) + 0.5)::BIGINT AS mean_length FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL GROUP BY conv_id",
    "guide_draft": "SELECT 'guide 1' AS rendered, split_part(url, '?utm', 1) AS url FROM pages WHERE page_id = 1",
    "sheet_cells": "SELECT " + ", ".join(f"max(CASE WHEN item_id = {n} THEN {v} END) AS {c}" for c, n, v in (("article", 1, "text"), ("url", 2, "text"), ("subject", 1, "md5(text)"), ("body", 2, "md5(text)"), ("post", 4, "md5(text)"), ("absent", 999999, "text"))) + " FROM benchmark",
    "sheet_list": "SELECT c_custkey AS ord, c_name AS value FROM customer WHERE c_custkey >= 2 AND NOT coalesce(c_acctbal < 0, false) AND c_name <> ''",
    "registration_details": "SELECT o_orderkey::VARCHAR AS name, CASE WHEN o_orderkey % 3 < 2 THEN 'c' || o_custkey || '@example.com' ELSE '-' END AS email, o_orderpriority AS registration_type, '-' AS page_url, '未対応' AS status FROM orders",
    "mail_counts": f"WITH {ARTICLES} SELECT count(*)::BIGINT AS articles, count(*) FILTER (contains(text, 'that'))::BIGINT AS with_that, count(*) FILTER (iso_ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR)::BIGINT AS fresh FROM articles",
    "text_rules": f"SELECT p_partkey, CASE WHEN length(p_name) > 9 THEN substr(p_name, 1, 9) || '...' ELSE p_name END AS short, strftime({_day}, '%Y年%m月%d日') AS day, '［' || p_brand || '］' AS plain, array_to_string(['・' || x FOR x IN string_split(p_type, ' ')], chr(10)) AS listed, '9784' || p_size || '0' AS isbn FROM part",
    "far_future_books": f"WITH {BOOKS} SELECT ord, ds AS pubdate FROM dated WHERE coalesce(length(ds) < 8, true) OR pub_date::TIMESTAMP <= TIMESTAMP '1992-08-10 09:30:00'",
}
