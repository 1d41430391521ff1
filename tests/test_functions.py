"""Literal cases of the scalar functions and small brute-force checks of the operators."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pressmill.functions import dates as D
from pressmill.functions import keywords as K
from pressmill.functions import text as X
from pressmill.operators import books as B
from pressmill.operators import ledger as L
from pressmill.operators import news as N
from pressmill.plans import pipelines as P
from pressmill.sources import readers
from pressmill.sources import rulepacks as R
from pressmill.streaming.discussion import append_batches, discussion_rows


def value(spark, column, **fields):
    df = spark.range(1)
    for k, v in fields.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,word,hit", [("training maintain", "ai", False), ("農業ai活用", "ai", True), ("c++入門", "c++", True), ("web3.0", "web3", True), ("aweb3", "web3", False), ("abc", "", False)])
def test_boundary(spark, text, word, hit):
    assert value(spark, K.boundary_hit(F.col("t"), word), t=text) is hit


def test_many_keywords_are_one_alternation(spark):
    words = [f"key{i}.x" for i in range(150)]
    assert value(spark, K.contains_any(F.col("t"), words), t="a key149.x b") is True
    assert value(spark, K.contains_any(F.col("t"), words), t="a key149-x b") is False


@pytest.mark.parametrize(
    "text,day",
    [("2024", "2024-01-01"), ("202405", "2024-05-01"), ("20240230", "2024-03-01"), ("20241301", "2025-01-01"), ("2024-05-06", "2024-05-06"), ("2024年05月06日", "2024-05-06"), ("20241", None), ("2024051", None), ("", None), ("abcd", None), ("abcdefgh", None)],
)
def test_pubdate(spark, text, day):
    got = value(spark, D.parse_pubdate(F.col("t")), t=text)
    assert got == (dt.date.fromisoformat(day) if day else None)


@pytest.mark.parametrize("text,want", [("2025年1月2日", "202512"), ("2025年01月上旬", ""), ("2025年01月02日頃", "20250102"), ("2025/01/02", "20250102"), ("1999年01月02日", ""), ("2025年13月01日", ""), ("2025年01月", "202501"), (None, "")])
def test_sales_date(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(D.sales_date(F.col("t"), F.lit("2025-06-01 00:00:00").cast("timestamp_ntz"))).first()[0]
    assert got == want


def test_window_bounds_carry_the_time_of_day(spark):
    now = F.lit("2025-03-15 10:00:00").cast("timestamp_ntz")
    days = spark.createDataFrame([("20250301",), ("20250302",), ("20250315",), ("20250316",), ("20250322",), ("20250323",), ("20251001",), (None,), ("202503",)], "d string")
    past = [r[0] for r in days.where(D.in_window(F.col("d"), now, 14)).collect()]
    both = [r[0] for r in days.where(D.in_window(F.col("d"), now, 14, True, 7)).collect()]
    assert past == ["20250302", "20250315"] and both == ["20250302", "20250315", "20250316", "20250322"]


def test_months_run_over(spark):
    assert value(spark, D.months_after(F.lit("2025-08-31 09:00:00").cast("timestamp_ntz"), 6)) == dt.datetime(2026, 3, 3, 9)


@pytest.mark.parametrize("days,bonus", [(91, -10), (31, 1), (1, 5), (0, 5), (-7, 5), (-8, 4), (-30, 3), (-60, 2), (-90, 1), (-91, 0)])
def test_freshness(spark, days, bonus):
    day = dt.date(2025, 1, 1) + dt.timedelta(days)
    assert value(spark, D.freshness_bonus(F.col("d"), F.lit(dt.date(2025, 1, 1))), d=day) == bonus


@pytest.mark.parametrize("n,avg,text,bonus", [(100, 4.5, "x", 12), (30, 3.0, "x", 6), (10, 4.0, "", 5), (3, 5.0, "x", 2), (0, 0.0, "", -3)])
def test_quality(spark, n, avg, text, bonus):
    assert value(spark, D.quality_bonus(F.col("n"), F.col("a"), F.col("t")), n=n, a=avg, t=text) == bonus


def test_rounding(spark):
    assert [value(spark, D.rounded(F.lit(x))) for x in (2.5, -2.5, 2.4)] == [3, -2, 2]


def test_urls(spark):
    assert value(spark, X.without_utm(F.col("u")), u="http://a/b?utm_source=x&y=1") == "http://a/b"
    at = F.lit("2025-01-31 00:00:00").cast("timestamp_ntz")
    assert value(spark, X.tracked(F.col("u"), at), u="https://a.b/c?x=1&utm_source=old#top") == "https://a.b/c?x=1&utm_source=newsletter&utm_medium=email&utm_campaign=ai_guide_20250131&utm_content=a_b#top"
    assert value(spark, X.tracked(F.col("u"), at), u="mailto:x") == "mailto:x"
    assert value(spark, X.encode_component(F.col("u")), u="a b!'()*~c&é") == "a%20b!'()*~c%26%C3%A9"
    assert value(spark, X.host(F.col("u")), u="https://a.b:80/c") in ("a.b", "a.b:80")


def test_html(spark):
    page = "<html><nav>menu</nav><div class='content'><p>one<p>two <b>three</b></div><article>  main\n\n text&amp; </article><script>x()</script></html>"
    assert value(spark, X.page_body(F.col("h")), h=page) == "main text&"
    assert value(spark, X.page_body(F.col("h")), h="<p>a</p><p>b</p>") == "ab"
    assert value(spark, X.page_body(F.col("h")), h="") is None
    long = "<article><nav>menu</nav>" + "word " * 60 + "2025年1月2日</article>"
    assert value(spark, X.guide_body(F.col("h"), F.lit("snippet")), h=long) == ("word " * 60).strip()
    assert value(spark, X.guide_body(F.col("h"), F.lit("snippet")), h="<article>short</article>") == "snippet"
    assert value(spark, X.strip_tags(F.col("h")), h="a<br/>b<i>c</i>") == "a\nbc"


def test_texts(spark):
    assert value(spark, X.trim_all(F.col("t")), t="　 a b \n") == "a b"
    assert value(spark, X.japanese_date(F.col("t")), t="20250102") == "2025年01月02日"
    assert value(spark, X.shorten(F.col("t"), 3), t="abcdef") == "abc..."
    assert value(spark, X.json_object(F.col("t"), "a int"), t='x {"a": 1} y')["a"] == 1
    assert value(spark, X.json_object(F.col("t"), "a int"), t="none") is None
    assert value(spark, X.bullets(F.array(F.lit("a"), F.lit("b")))) == "・a\n・b"


def test_similarity(spark):
    assert value(spark, N.similarity(F.lit(""), F.lit(""))) == 100
    assert value(spark, N.similarity(F.lit("abcdefghij"), F.lit("abcdefgxyz"))) == 70


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_leaders_against_the_loop(spark):
    rng = random.Random(7)
    base = ["".join(rng.choices("abc ", k=rng.randrange(3, 14))) for _ in range(12)] + [""]
    titles = [t if rng.random() < 0.3 else t[: rng.randrange(len(t) + 1)] + rng.choice("abc") + t[rng.randrange(len(t) + 1) :] for t in rng.choices(base, k=70)]
    want: list[int] = []
    for i, t in enumerate(titles):
        like = lambda u, t=t: 100 if not max(len(t), len(u)) else int((max(len(t), len(u)) - distance(t, u)) / max(len(t), len(u)) * 100 + 0.5)
        if not any(like(titles[j]) >= 70 for j in want):
            want.append(i)
    got = sorted(r["ord"] for r in N.leaders(spark.createDataFrame(list(enumerate(titles)), "ord long, title string")).collect())
    assert got == want


def test_dynamic_bonus(spark):
    metrics = spark.createDataFrame([("a", 5, 200), ("b", 2, 900)], "url string, posts long, mean_length long")
    scored = spark.createDataFrame([(1, 10)], "ord long, score int")
    assert N.dynamic_score(scored, metrics).first()["final_score"] == 13
    assert N.dynamic_score(scored, metrics.where("posts > 9")).first()["final_score"] == 10


def test_tiers_and_branches(spark):
    df = spark.createDataFrame([(1, True, False, True), (2, True, False, False), (3, False, True, True)], "ord int, p boolean, t boolean, u boolean")
    assert [(r["ord"], r["tier"]) for r in N.tiered(df, F.col("p"), F.col("t"), F.col("u")).collect()] == [(1, 3)]
    none = df.where("ord > 5")
    assert {r["branch"] for r in B.first_branch([none, df]).collect()} == {1}


def test_adaptive_window_against_the_loop(spark):
    rng = random.Random(1)
    now = dt.datetime(2025, 3, 15, 10)
    for n in (0, 1, 2, 5, 30):
        days = [(i, (dt.date(2025, 3, 15) + dt.timedelta(rng.randrange(-300, 100))).strftime("%Y%m%d")) for i in range(n)]
        inside = lambda d, w: now - dt.timedelta(w[0]) <= dt.datetime.strptime(d, "%Y%m%d") <= now + dt.timedelta(w[1])
        hits = [[i for i, d in days if inside(d, w)] for w in B.AGRI_WINDOWS]
        want = next((h for h in hits if len(h) >= 3), hits[-1] or [i for i, _ in days])
        df = spark.createDataFrame(days, "ord int, pubdate string")
        assert sorted(r["ord"] for r in B.adaptive_window(df, F.lit(now), B.AGRI_WINDOWS).collect()) == want


def test_book_scores_of_the_production_lists(spark):
    book = lambda **x: Row(**({"ord": 1, "title": "", "author": "", "publisher": "", "series": "", "description": ""} | x))
    df = spark.createDataFrame([book(ord=1, title="農業とAI活用"), book(ord=2, title="農業の試験"), book(ord=3, title="training"), book(ord=4, title="異世界の農業", publisher="x")])
    agri = {r["ord"]: (r["keyword_score"], r["exclude_reason"]) for r in B.agri_score(df).collect()}
    assert agri == {1: (8, None), 2: (-1, "exam"), 3: (-1, "no required theme"), 4: (-1, "off topic")}
    popular = spark.createDataFrame([book(ord=1, title="生成AIで変わる経営", description="実践と事業承継"), book(ord=2, title="異世界"), book(ord=3, title="x")])
    got = {r["ord"]: (r["keyword_score"], r["exclude_reason"]) for r in B.popular_score(popular).collect()}
    assert got[2] == (-1, "light novel") and got[3] == (-1, "no theme")
    # two themes: 12 + 1 and 10; several themes 4, engaging 6, human nature 4, practical 4, own books 3, page views 2
    assert got[1] == (12 + 1 + 10 + 4 + 6 + 4 + 4 + 3 + 2, None)


def test_trend_repeats_count_twice(spark):
    news = spark.createDataFrame([(1, "新しい挑戦")], "ord long, title string")
    assert N.trend_counts(news, R.HUMAN_STORY).first()["hits"] == 2


def test_rotation():
    assert K.rotate_by_day(list("abcde"), 2, 2) == ["e", "a"] and K.rotate_by_day(["a", "a", ""], 5, 9) == ["a"]


def test_ledger_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "url string, score int")
    at = str(tmp_path / "ledger")
    L.append_once(rows, at, "url")
    L.append_once(rows, at, "url")
    assert spark.read.parquet(at).count() == 2
    L.append_typed(rows.withColumn("type", F.lit("news")), str(tmp_path / "typed"))
    assert spark.read.parquet(str(tmp_path / "typed")).where("type = 'news'").count() == 3
    L.overwrite_guide(spark.createDataFrame([("text", "http://a?utm_x=1")], "rendered string, url string"), str(tmp_path / "guide"))
    assert spark.read.parquet(str(tmp_path / "guide")).first()["url"] == "http://a"


def test_registration(spark):
    raw = spark.createDataFrame([(json.dumps({"Email": "a@b", "registration_type": "スターターキット特典登録"}),), ("{}",), ("broken",)], "body string")
    got = [(r["email"], r["detail"], r["mail"]) for r in L.route(readers.registration(raw)).collect()]
    assert got == [("a@b", "starter_kit", "starter_kit"), (None, None, None), (None, None, None)]
    assert L.detail_row(readers.registration(raw), ["email", "name"]).first().asDict() == {"email": "a@b", "name": "-", "status": "未対応"}


def test_pick(spark):
    books = spark.createDataFrame([(i, 10 - i, None) for i in range(4)], "ord int, total int, pub_date date")
    answer = lambda text: lambda best: best.groupBy().agg(F.lit(text).alias("answer"))
    assert P.pick(books, None).first()["ord"] == 0
    assert P.pick(books, answer('{"index": 3}')).first()["ord"] == 2
    assert P.pick(books, answer("nonsense")).first()["ord"] == 0
    assert P.pick(books, answer('{"index": 7}')).first()["ord"] == 0


def test_readers(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>A</title><link>http://a</link><description>d</description><pubDate>Wed, 01 Jan 2025 10:00:00 +0000</pubDate></item><item><title>B</title></item></channel></rss>")
    rows = readers.rss(spark, [str(tmp_path / "feed.xml")], "f").collect()
    assert [(r["title"], r["link"], r["iso_ts"]) for r in rows] == [("A", "http://a", dt.datetime(2025, 1, 1, 10))]
    (tmp_path / "shop.json").write_text(json.dumps({"Items": [{"Item": {"title": "T", "isbn": "978", "salesDate": "2025年01月02日", "reviewCount": 3, "reviewAverage": "4.5"}}]}))
    r = readers.shop_books(spark, str(tmp_path / "shop.json"), "2025-01-01").first()
    assert (r["pubdate"], r["review_count"], r["review_average"]) == ("20250102", 3, 4.5)
    (tmp_path / "vol.json").write_text(json.dumps({"items": [{"volumeInfo": {"title": "T", "authors": ["a", "b"], "publishedDate": "2025-01", "industryIdentifiers": [{"type": "ISBN_10", "identifier": "1"}, {"type": "ISBN_13", "identifier": "2"}]}}, {"volumeInfo": {"title": "U"}}]}))
    got = [(r["isbn"], r["author"], r["pubdate"]) for r in readers.volume_books(spark, str(tmp_path / "vol.json")).collect()]
    assert got[0] == ("2", "a, b", "202501") and got[1][0] == ""
    page = spark.createDataFrame([('<a href="/bd/isbn/9780000000001"><b>One</b></a><a href="/bd/isbn/9780000000001">again</a><a href="/bd/isbn/9780000000002"><img alt="Two"></a><a href="/bd/isbn/9780000000003"></a>',)], "html string")
    details = spark.createDataFrame([("9780000000001", "Full", "a", "p", "2025", "d")], "isbn string, title string, author string, publisher string, pubdate string, description string")
    assert sorted((r["isbn"][-1], r["title"]) for r in readers.with_details(readers.release_hints(page), details).collect()) == [("1", "Full"), ("2", "Two")]
    xml = spark.createDataFrame([('<item><title>T</title><author>A</author><dc:publisher>P</dc:publisher><dc:identifier xsi:type="dcndl:ISBN">978-4-00-000000-1</dc:identifier></item><item><title>N</title></item>',)], "xml string")
    assert [(r["title"], r["isbn"]) for r in readers.search_items(xml).collect()] == [("T", "9784000000001")]


def test_stream_equals_batch(spark, tmp_path):
    schema = "message_id long, ts timestamp_ntz, author_id string, username string, is_bot boolean, in_guild boolean, thread_id string, content string, roles array<string>"
    rows = [(i, dt.datetime(2025, 1, 1), f"u{i}", "n", i % 5 == 0, i % 7 != 0, str(i % 4), "c", ["m"] if i % 2 else ["g"]) for i in range(60)]
    starters = spark.createDataFrame([("1", "own", "t", "u1", dt.datetime(2025, 1, 1)), ("2", "else", "t", "u2", dt.datetime(2025, 1, 1)), ("3", "own", "t", None, None)], "thread_id string, author_id string, title string, url string, embed_ts timestamp_ntz")
    batch = spark.createDataFrame(rows, schema)
    batch.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run adds nothing
        append_batches(discussion_rows(stream, starters, "own", "m", "g"), str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
    got = sorted(r["message_id"] for r in spark.read.parquet(str(tmp_path / "log")).collect())
    assert got == sorted(r["message_id"] for r in discussion_rows(batch, starters, "own", "m", "g").collect()) == [i for i in range(60) if i % 5 and i % 7 and i % 4 == 1]


def a_few_books(spark, n=40):
    return spark.range(n).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("red ring "), F.col("id")).alias("title"), *(F.lit("steel").alias(c) for c in ("author", "publisher", "series", "description")), F.concat(F.lit("2001-10-0"), F.col("id") % 9 + 1).alias("pubdate"), F.lit(9).alias("review_count"), F.lit(4.5).alias("review_average"))


RINGS = {"themes": [("metal", 12, ["ring"]), ("colour", 10, ["red"])], "people": (0, 1), "tale": 1}


@pytest.mark.parametrize("score", [lambda b: B.popular_score(b, **RINGS), B.agri_score])
def test_few_bytes_of_books_are_scored_in_many_tasks(spark, score):
    assert score(a_few_books(spark).coalesce(1)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert score(a_few_books(spark)).columns == [*a_few_books(spark).columns, "exclude_reason", "keyword_score", "categories"]


def test_pick_asks_for_its_candidates_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def total(ord):
        seen.add(1)
        return ord

    candidates = a_few_books(spark).select("ord", "pubdate", total.asNondeterministic()("ord").alias("total")).withColumn("pub_date", F.lit(None).cast("date"))
    assert P.pick(candidates, lambda best: best.agg(F.lit('{"index": 2}').alias("answer"))).first()["ord"] == 38
    assert seen.value == 40


def test_dates_of_reposts_are_read_once(spark):
    books = a_few_books(spark)
    plan = P.repost(books, F.lit("2001-10-15 00:00:00").cast("timestamp_ntz"), **RINGS)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("[-/年月日]" in line for line in plan.splitlines()) == 1


def test_pages_go_to_python_in_small_groups(spark):
    pages = spark.range(1).select(F.lit("<article>a  b</article>").alias("html"))
    for body in (X.page_body(F.col("html")), X.guide_body(F.col("html"), F.lit("none"))):
        plan = pages.select(body.alias("body"))._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert pages.select(X.page_body(F.col("html")).alias("body")).first()["body"] == "a b"
