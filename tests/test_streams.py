"""Streams that run again, stores that are read meanwhile, runs that die half way, and ledgers in buckets."""

import datetime as dt
import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pressmill import work
from pressmill.operators.bucketed import BucketedLedger
from pressmill.operators.outbox import Outbox
from pressmill.queries import QUERIES
from pressmill.streaming import router, running
from pressmill.streaming.store import BatchStore, KeyedTable

T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_batch_is_all_there_or_not_at_all(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path))
    one = spark.createDataFrame([(1,)], "x int")
    broken = one.select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    with pytest.raises(Exception, match="no"):
        store.write(0, {"a": one, "b": broken})
    assert store.committed() == [] and rows(store.read("a", "x int")) == []
    assert store.write(0, {"a": one, "b": one}) and not store.write(0, {"a": one.unionAll(one)})
    assert store.write(2, {"a": spark.createDataFrame([(None,)], "x int")})
    assert rows(store.read("a", "x int")) == [(1, 0), (None, 2)] and rows(store.read("b", "x int")) == [(1, 0)] and rows(store.read("c", "x int")) == []


@pytest.mark.parametrize("fold", [1, 2, 3, 50])
def test_the_newest_row_of_a_key_stands(spark, tmp_path, fold):
    kept = KeyedTable(spark, str(tmp_path), "k", "k string, n long, note string", fold)
    assert rows(kept.latest()) == []
    want = {}
    for n in range(9):
        some = [(f"k{i}", 10 * n + i, None if i % 2 else f"at {n}") for i in range(n % 4 + 1)]
        want |= {r[0]: r for r in some}
        assert kept.upsert(n, spark.createDataFrame(some, kept.schema))
        assert not kept.upsert(n, spark.createDataFrame([("k0", -1, None)], kept.schema))  # a replay
        assert not kept.upsert(0, spark.createDataFrame([("k0", -1, None)], kept.schema))  # folded long ago
        assert rows(kept.latest()) == sorted(want.values(), key=str)
    assert len(list(Path(tmp_path, "rows").iterdir())) <= max(2 * fold, 1) + 1 or fold == 50


def replayed(checkpoint, number):
    """The engine forgets that it finished a batch, as if it had died before noting it."""
    for name in (f"{number}", f".{number}.crc"):
        Path(checkpoint, "commits", name).unlink(missing_ok=True)


def test_running_engagement_is_the_batch_and_a_replay_changes_nothing(spark, tmp_path):
    posts = [("u1", "abc"), ("u1", None), ("", "no"), (None, "no"), ("u2", "😀x"), ("u1", "de"), ("u3", "a"), ("u2", "")]
    kept = running.engagement_table(spark, str(tmp_path / "kept"), fold=2)
    run = lambda: running.run_engagement(spark.readStream.schema("url string, content string").parquet(str(tmp_path / "in")), kept, str(tmp_path / "check")).awaitTermination()
    for i in range(3):
        spark.createDataFrame(posts[i * 3 : i * 3 + 3], "url string, content string").write.mode("append").parquet(str(tmp_path / "in"))
        run()
    want = [("u1", 3, 5, 2), ("u2", 2, 2, 1), ("u3", 1, 1, 1)]
    assert rows(running.engagement_now(kept)) == want
    replayed(tmp_path / "check", 2)
    run()
    assert rows(running.engagement_now(kept)) == want
    assert spark.conf.get(running.PROVIDER, None) != running.ROCKS  # put back


def test_running_trends_count_listed_twice_and_first_seen(spark, tmp_path):
    kept = running.trends_table(spark, str(tmp_path / "kept"))
    for part in ([(1, "Soil and AI"), (2, None)], [(3, "soil"), (4, "ai farm")]):
        spark.createDataFrame(part, "ord long, title string").write.mode("append").parquet(str(tmp_path / "in"))
        running.run_trends(spark.readStream.schema("ord long, title string").parquet(str(tmp_path / "in")), ["farm", "soil", "AI", "soil"], kept, str(tmp_path / "check")).awaitTermination()
    assert rows(running.trends_now(kept).select("rank", "keyword", "hits")) == [(1, "soil", 4), (2, "ai", 2), (3, "farm", 1)]


def test_repeats_within_the_bound_go_and_late_rows_are_counted(spark, tmp_path):
    day = lambda d: T0 + dt.timedelta(days=d)
    arrivals = [[("a", day(1)), ("a", day(1)), ("b", day(1))], [("a", day(3)), ("c", day(9))], [("a", day(4.9)), ("a", day(5.5)), ("b", day(8))]]
    kept, late = BatchStore(spark, str(tmp_path / "kept")), BatchStore(spark, str(tmp_path / "late"))
    schema = "k string, ts timestamp"
    for part in arrivals:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = running.run_distinct(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["k"], "ts", "4 days", kept, str(tmp_path / "check"))
        query.awaitTermination()
        running.record_late(query, late)
    # the watermark of the third arrival is day 5: a's first repeat is late, its second comes after the bound, and b's too
    assert sorted((r["k"], r["ts"]) for r in kept.read("distinct", schema).collect()) == [("a", day(1)), ("a", day(5.5)), ("b", day(1)), ("b", day(8)), ("c", day(9))]
    assert late.read("late", running.LATE).agg(F.sum("rows")).first()[0] == 1


POSTS = [
    {"type": "newBook", "isbn": "1", "title": "T", "score": "7"},
    {"type": "newBook", "score": "many", "postedDate": ""},
    {"type": "discussion", "timestamp": "then", "userId": "u", "content": "line\nline", "userRole": 0},
    {"type": "news", "title": "n", "discussionQuestions": ["a", "b"], "insight": "plain"},
    {"type": "addArticles", "articles": [{"url": "x", "score": 3}, {"title": "no url"}]},
    {"type": "addArticles", "articles": []},
    {"type": "addArticles"},
    {"type": "globalResearch", "titleJa": "題", "keyPoints": "k1\nk2"},
    {"type": "news ", "title": "n"},
    {"title": "no type"},
    ["a list"],
    "text",
]


def test_router_kinds_defaults_and_rejects(spark, tmp_path):
    bodies = [(json.dumps(p, ensure_ascii=False), "now") for p in POSTS] + [("{broken", "now"), (None, "now"), ("", "now")]
    posts = spark.createDataFrame(bodies, "body string, received_at string")
    got = {k: rows(df) for k, df in router.routed(posts).items()}
    assert got["newBook"] == [("now", "", "", "", "", "", 0.0, "", "", "now"), ("now", "1", "T", "", "", "", 7.0, "", "", "now")]
    assert got["discussion"] == [("then", "u", None, "line\nline", None, None, None, 0)]
    assert got["news"] == [("now", "n", None, None, "plain", "a\nb")]
    assert got["addArticles"] == [("now", "x", None, None, None, 3.0), ("now", None, "no url", None, None, None)]
    assert got["globalResearch"] == [("now", None, "題", None, None, "k1\nk2", None, None)]
    assert sorted(r[2] for r in got["rejected"]) == ["no JSON object"] * 5 + ["no articles"] + ["unknown kind"] * 2
    assert {k: router.routed(posts.limit(0))[k].count() for k in got} == dict.fromkeys(got, 0)

    posts.write.parquet(str(tmp_path / "in"))
    store = BatchStore(spark, str(tmp_path / "logs"))
    run = lambda: router.run_router(spark.readStream.schema(posts.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "check")).awaitTermination()
    run()
    replayed(tmp_path / "check", 0)
    run()
    assert {k: rows(router.log(store, k)) for k in got} == got


def test_outbox_sends_once_whatever_happens(spark, tmp_path):
    schema = "ord long, link string"
    box = lambda: Outbox(spark, str(tmp_path / "box"), "link", schema)
    some = lambda *links: spark.createDataFrame([(i, x) for i, x in enumerate(links)], schema)
    sent = []

    def dies(df):
        raise ConnectionError

    take = lambda df: sent.append(rows(df.select("link")))
    assert box().emit("r1", some("a", "b", "a", None), take) and not box().emit("r1", some("z"), take)
    with pytest.raises(ConnectionError):
        box().emit("r2", some("b", "c"), dies)
    assert box().emit("r3", some("c", "d"), take)  # c was logged by r2 first, which sends it when it runs again
    assert box().emit("r2", some("other", "rows"), take)
    assert box().emit("r4", some(), take)
    assert sent == [[("a",), ("b",)], [("d",)], [("c",)], []]
    assert rows(box().ledger()) == [("a",), ("b",), ("c",), ("d",)] and box().claims() == ["r1", "r2", "r3", "r4"]
    shutil.rmtree(tmp_path / "box" / "entries" / "r4")  # a claim that never got its name is void
    Path(tmp_path, "box", "_claims", "4").touch()
    assert box().claims() == ["r1", "r2", "r3", "r4"]


def test_outbox_shows_tables_of_sent_runs_only(spark, tmp_path):
    box = Outbox(spark, str(tmp_path), "link", "ord long, link string")
    assert rows(box.messages()) == []
    day = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b")], "ord long, link string")
    box.append("r1", day)
    assert rows(box.messages()) == []
    box.emit("r1", day)
    box.emit("r1", day)
    assert rows(box.messages()) == [(1, "a", "r1"), (3, "b", "r1")]


def test_bucketed_ledger_is_not_shuffled(spark, tmp_path):
    ledger = BucketedLedger(spark, "ledger_of_the_test", str(tmp_path / "one"), "link", 4)
    day = spark.createDataFrame([(i, f"l{i}") for i in range(50)] + [(99, None)], "ord int, link string")
    assert ledger.absent(day).count() == 51
    for part in range(2):
        ledger.append(day.where(F.col("ord") % 4 == part))
    ledger.append(spark.createDataFrame([(1, None)], "ord int, link string"))
    for path in ("two", "three"):
        out = ledger.absent(day)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan
        assert plan.index("Exchange") < plan.index("Scan ExistingRDD") < plan.index("FileScan")  # the day's side alone
        assert sorted(r["ord"] for r in out.collect()) == [i for i in range(50) if i % 4 > 1] + [99]
        ledger.compact(str(tmp_path / path))
        assert len(list((tmp_path / path).glob("*.parquet"))) == 4
    with pytest.raises(ValueError):
        ledger.compact(str(tmp_path / "three"))
    spark.sql("DROP TABLE ledger_of_the_test")


@pytest.mark.parametrize("name", ["running_engagement", "stream_distinct_links", "post_router", "outbox_runs", "headline_posted_bucketed", "discussion_stream_log"])
def test_nothing_is_left_behind(spark, sf, name):
    before, folder = work.mark(spark), Path(work.work_dir(spark))
    there = {p.name for p in folder.iterdir()}
    QUERIES[name](spark, sf).count()
    assert work.mark(spark) - before and {p.name for p in folder.iterdir()} > there
    work.release(spark, but=before)
    assert {p.name for p in folder.iterdir()} == there


def test_posts_are_judged_once(spark, tmp_path, monkeypatch):
    """Six tables, but each post's kind is read from its text one time."""
    posts = spark.createDataFrame([('{"type":"news","title":"t"}', "now"), ('{"type":"none"}', "now"), ("{broken", "now"), (None, "now")], "body string, received_at string")
    posts.write.parquet(str(tmp_path / "posts"))
    plans, fanned = [], router._fanned
    monkeypatch.setattr(router, "_fanned", lambda read: plans.extend(d._jdf.queryExecution().optimizedPlan().toString() for d in fanned(read).values()) or fanned(read))
    store = BatchStore(spark, str(tmp_path / "logs"))
    router.run_router(spark.readStream.schema(posts.schema).parquet(str(tmp_path / "posts")), store, str(tmp_path / "checkpoint")).awaitTermination()
    assert len(plans) == 6 and all(p.splitlines().index(next(x for x in p.splitlines() if "InMemoryRelation" in x)) < min(i for i, x in enumerate(p.splitlines()) if "$.type" in x) for p in plans)
    assert router.log(store, "news").count() == 1
    assert sorted(r["reason"] for r in router.log(store, "rejected").collect()) == ["no JSON object", "no JSON object", "unknown kind"]
