"""Feeds that arrive as files, details over time, and calls of a model."""

import datetime as dt
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pressmill.operators import models
from pressmill.sources import arriving, readers
from pressmill.streaming.store import BatchStore


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- feeds

GOOD = '<item a="1"><title>A &amp; B</title><link> http://a </link><description>d</description><pubDate>Wed, 01 Jan 2025 10:00:00 +0900</pubDate></item>'
FILES = {
    "one/a.xml": f"<rss><channel><item>\n<title>first</title><link>http://1</link><isoDate>2025-01-01T00:00:00Z</isoDate></item>{GOOD}</channel></rss>",
    "feed=two/b.xml": "<rss><item><title>no link</title></item><item><title>broken</titel><link>x</link></item><item><title>cut",
    "two/c.xml": "no feed at all",
    "two/d.xml": "",
}


def land(folder, names):
    for name in names:
        at = folder / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(FILES[name])


def test_feeds_in_arrivals_equal_the_batch_reader_and_nothing_is_lost(spark, tmp_path):
    store, checkpoint = BatchStore(spark, str(tmp_path / "out")), str(tmp_path / "check")
    run = lambda: arriving.run_feeds(arriving.landed_files(spark, str(tmp_path / "in"), str(tmp_path / "archive")), store, checkpoint).awaitTermination()
    for names in (["one/a.xml"], ["feed=two/b.xml", "two/c.xml"], ["two/d.xml"]):
        land(tmp_path / "in", names)
        run()
    for name in ("0", ".0.crc"):
        Path(checkpoint, "commits", name).unlink(missing_ok=True)
    for p in Path(checkpoint, "commits").iterdir():
        p.unlink()
    run()  # every batch again
    got = store.read("items", arriving.ITEMS).drop("batch")
    (tmp_path / "batch").mkdir()
    (tmp_path / "batch" / "a.xml").write_text(FILES["one/a.xml"])
    want = readers.rss(spark, [str(tmp_path / "batch")], "one")
    assert rows(got) == rows(want) and got.count() == 2
    assert {r["iso_ts"] for r in got.collect()} == {dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 1, 1)}
    bad = rows(store.read("rejected", arriving.REJECTED).select("feed", "reason"))
    assert bad == [("two", "broken item"), ("two", "no items"), ("two", "no link"), ("two", "unclosed item")]  # an empty file is no row of a text source
    assert "cut" in " ".join(r["text"] for r in store.read("rejected", arriving.REJECTED).collect())


# --- details over time


def test_a_run_joins_what_was_known_at_its_time(spark):
    day = lambda d: dt.date(2025, 1, d)
    none = (None,) * 4
    details = spark.createDataFrame([("1", day(1), "old", *none), ("1", day(5), "new", *none), ("1", day(5), "also new", *none), ("2", day(9), "later", *none), (None, day(1), "x", *none), ("3", None, "y", *none)], "isbn string, known_at date, title string, author string, publisher string, pubdate string, description string")
    hints = spark.createDataFrame([(1, "1", "h1"), (2, "2", "h2"), (3, "3", "")], "ord int, isbn string, title string")
    joined = lambda d: rows(readers.with_details(hints, readers.details_as_of(details, F.lit(day(d)).cast("date"))).select("isbn", "title"))
    assert joined(4) == [("1", "old"), ("2", "h2")]
    assert joined(5) == joined(8) == [("1", "new"), ("2", "h2")]
    assert joined(9) == [("1", "new"), ("2", "later")]
    assert readers.details_as_of(details.limit(0), F.lit(day(9)).cast("date")).count() == 0


# --- models


class Client:
    def __init__(self, fails=0, poison=(), wrong=False):
        self.calls, self.fails, self.poison, self.wrong = [], fails, poison, wrong

    def __call__(self, prompts):
        self.calls.append(list(prompts))
        if len(self.calls) <= self.fails or set(prompts) & set(self.poison):
            raise TimeoutError("too slow")
        return ["one"] if self.wrong else [p.upper() if p != "none" else None for p in prompts]


def test_retries_and_single_questions():
    c = Client(fails=2)
    assert models.answered(c, ["a", "b"], 3, 0) == [("A", None), ("B", None)] and len(c.calls) == 3
    c = Client(poison=["b"])
    assert models.answered(c, ["a", "b", "none"], 2, 0) == [("A", None), (None, "TimeoutError: too slow"), (None, None)]
    assert c.calls == [["a", "b", "none"]] * 2 + [["a"], ["b"], ["none"]]
    c = Client(wrong=True)
    assert models.answered(c, ["a", "b"], 1, 0) == [("one", None), ("one", None)]  # asked one by one, the answer fits
    assert [e is not None for _, e in models.answered(lambda p: [1] * len(p), ["a"], 1, 0)] == [True]
    began = time.time()
    models.answered(Client(fails=9), ["a"], 3, 0.1)
    assert 0.3 <= time.time() - began < 2


@pytest.mark.parametrize("batch", [1, 3, 100])
def test_ask_keeps_all_rows_and_makes_one_client_a_partition(spark, tmp_path, batch):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else f"p{i}", "x") for i in range(40)], "answer int, row string, error string")  # clashing names
    made = str(tmp_path / "made")
    Path(made).mkdir()

    def factory():
        import uuid

        open(f"{made}/{uuid.uuid4().hex}", "w").close()

        def client(prompts):
            if "p7" in prompts:
                raise ValueError("seven")
            return [p + "!" for p in prompts]

        return client

    out = models.ask(df.repartition(3), F.col("row"), factory, batch=batch, attempts=2, pause=0).collect()
    assert len(list(Path(made).iterdir())) == 3
    got = {r["row"]["answer"]: (r["row"]["row"], r["row"]["error"], r["answer"], r["error"]) for r in out}
    assert got == {i: (None if i % 4 == 0 else f"p{i}", "x", None if i % 4 == 0 or i == 7 else f"p{i}!", "ValueError: seven" if i == 7 else None) for i in range(40)}
    assert models.ask(df.limit(0), F.col("row"), factory).count() == 0 and len(list(Path(made).iterdir())) == 3


def test_fallbacks(spark):
    a = spark.createDataFrame([("t", "s" * 300, "body", "trend"), (None, None, None, models.NO_TREND)], "title string, snippet string, body string, trend string")
    seen = lambda: lambda prompts: ['{"insight": "%s", "questions": []}' % p.split("\n")[0] for p in prompts]
    assert [r["insight"]["insight"] for r in models.with_insight(a, F.col("trend"), seen).orderBy(F.desc("title")).collect()] == ["Trend of the last days: trend", "Give an insight and questions as JSON."]
    deaf = lambda: lambda prompts: [None for _ in prompts]
    out = models.with_insight(a, F.col("trend"), deaf).collect()
    assert {(r["insight"]["insight"], len(r["insight"]["questions"]), r["error"]) for r in out} == {(models.FALLBACK_INSIGHT, 3, None)}
    assert {r["summary"] for r in models.with_guide_summary(a, deaf).collect()} == {models.FALLBACK_SUMMARY}
    assert models.translated(a, deaf).count() == 0
    said = lambda: lambda prompts: ['x {"titleJa": "T", "technicalTerms": {"a": "b"}} y' for _ in prompts]
    got = models.translated(a.withColumn("body", F.lit(None).cast("string")), said).collect()
    assert [(r["title"], r["translation"]["titleJa"], r["translation"]["technicalTerms"]) for r in got] == [("t", "T", {"a": "b"})]


def test_hints_are_read_once_and_in_many_tasks(spark):
    html = '<ul><li><a href="https://shop.example/bd/isbn/9780000000001">ring</a> 著者：a-b 出版社：c 2024年1月5日</li></ul>'
    pages = spark.createDataFrame([(html,)], "html string").coalesce(1)
    out = readers.release_hints(pages, ["ring"])
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("tr|li|div" in line for line in plan) == 1 and sum("著者" in line for line in plan) == 1
    assert any("Repartition" in line for line in plan)
    assert [tuple(r) for r in out.select("isbn", "title", "author", "publisher", "pubdate").collect()] == [("9780000000001", "ring", "a-b", "c", "2024-1-5")]


def test_a_model_is_asked_in_whole_batches_and_bounded_groups(spark):
    """Nulls between prompts do not make batches smaller; no more than some batches of answers are held."""
    pa = pytest.importorskip("pyarrow")

    calls, given = [], []

    class Rows:
        """What ask() needs of a table, to hand it one batch of rows."""

        columns = ["n"]

        def select(self, row, prompt):
            return self

        schema = {"row": models.T.StructField("row", models.T.LongType())}

        def mapInArrow(self, run, schema):
            texts = [None if i % 3 == 0 else str(i) for i in range(3000)]
            given.extend(run(iter([pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], names=["row", "prompt"]), pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string())], names=["row", "prompt"])])))

    models.ask(Rows(), F.lit("prompt"), lambda: lambda prompts: calls.append(len(prompts)) or prompts)
    assert calls == [16] * 125
    whole = pa.Table.from_batches(given)
    assert whole["row"].to_pylist() == list(range(3000)) and whole["answer"].to_pylist() == [None if i % 3 == 0 else str(i) for i in range(3000)]
    assert max(b.num_rows for b in given) <= 400


def test_prompts_alone_go_through_python_once(spark, tmp_path):
    """Rows of whatever type and name stay as they are; a filter and two readers of an answer do not ask twice."""
    made = str(tmp_path / "asked")
    Path(made).mkdir()

    def factory():
        def client(prompts):
            import uuid

            for p in prompts:
                Path(f"{made}/{uuid.uuid4().hex}").write_text(p)
            return ["no" if "t1" in p else None if "t2" in p else '{"titleJa": "T", "insight": "I", "questions": [], "summary": "S"}' for p in prompts]

        return client

    a = spark.range(30, numPartitions=3).select(
        F.concat(F.lit("t"), F.col("id") % 3).alias("title"), F.lit("s" * 300).alias("snippet"), F.when(F.col("id") > 3, "b" * 300).alias("body"), F.col("id").alias("answer"), F.lit("own").alias("a.b"),
        F.expr("make_ym_interval(1, CAST(id AS INT))").alias("span"), F.expr("TIMESTAMP '2024-10-27 01:30:00' + make_dt_interval(0, CAST(id AS INT))").alias("at"),
    )
    text = lambda df: sorted(map(tuple, df.select("answer", F.col("`a.b`"), F.col("span").cast("string"), F.col("at").cast("string"), "title").collect()))
    for out, prompts, kept in ((models.translated(a, factory), 30, "id % 3 = 0"), (models.with_insight(a, F.lit("x"), factory), 30, "true"), (models.with_guide_summary(a, factory), 26, "true")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and plan.count("ArrowEvalPython [") == 1
        before = len(list(Path(made).iterdir()))
        assert len(out.drop("span").collect()) == (10 if kept != "true" else 30) and len(list(Path(made).iterdir())) - before == prompts
        assert text(out) == text(a.where(kept.replace("id", "answer")))


@pytest.mark.parametrize("batch", [1, 3, 100])
def test_replies_are_those_of_ask(spark, tmp_path, batch):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else f"p{i}") for i in range(1000)], "i int, p string").repartition(3)
    made = str(tmp_path / "made")
    Path(made).mkdir()

    def factory():
        import uuid

        open(f"{made}/{uuid.uuid4().hex}", "w").close()

        def client(prompts):
            if "p7" in prompts:
                raise ValueError("seven")
            return [None if p == "p9" else p + "!" for p in prompts]

        return client

    calls = {"batch": batch, "attempts": 2, "pause": 0}
    got = rows(df.select("i", models.reply(F.col("p"), factory, **calls).alias("r")).select("i", "r.answer", "r.error"))
    assert len(list(Path(made).iterdir())) == 3
    assert got == rows(models.ask(df, F.col("p"), factory, **calls).select("row.i", "answer", "error"))
    assert got == sorted(((i, None if i % 4 == 0 or i in (7, 9) else f"p{i}!", "ValueError: seven" if i == 7 else None) for i in range(1000)), key=str)
    none = df.limit(0).select(models.reply(F.col("p"), factory).alias("r"))
    assert none.collect() == [] and len(list(Path(made).iterdir())) == 6
