"""The scheduled pipelines, each a plan over source tables and an as_of, none with a side effect of its own."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import freshness_bonus, not_far_future, parse_pubdate, quality_bonus
from ..functions.keywords import contains_any
from ..functions.once import computed
from ..functions.text import escape_brackets, host, json_object, page_body, shorten
from ..operators import books as B
from ..operators import news as N
from ..sources import rulepacks as R
from ..work import save


def headlines(articles: DataFrame, posted: DataFrame, metrics: DataFrame, as_of: Column, pack=None, exclusion: Sequence[str] = R.EXCLUSION, k: int = 3) -> DataFrame:
    """24 hours, not posted, scored with the engagement factor, one of each group of similar titles, the k best."""
    fresh = N.not_in(articles.where(N.recent(F.col("iso_ts"), as_of, 24)), posted, "link")
    scored = N.dynamic_score(N.score_news(fresh, pack, exclusion), metrics)
    order = [F.desc("final_score"), F.desc("iso_ts"), F.col("ord")]
    scored, first = save(scored, "scored"), 64
    while True:
        # whether a title leads depends on better ones only, so the best few are enough once they hold k leaders
        best = N.top(scored, first, *order).withColumnRenamed("rank", "place")
        lead = save(N.leaders(best.select(F.col("place").alias("ord"), F.lower("title").alias("title"))), "leaders")
        if lead.count() >= k or first >= scored.count():
            break
        first *= 4
    kept = best.join(lead, best["place"] == lead["ord"], "left_semi")
    return N.top(kept, k, *order).select("rank", "ord", "title", "link", "score", "final_score", "label")


def daily_news(articles: DataFrame, as_of: Column, primary: Sequence[str] = R.TIER_PRIMARY, tech: Sequence[str] = R.TIER_TECH, use: Sequence[str] = R.TIER_USE, exclusion: Sequence[str] = R.EXCLUSION, seed: int = 0) -> DataFrame:
    """24 hours, the best tier, one article picked by a seeded hash."""
    t = F.col("text")
    fresh = articles.where(N.recent(F.col("iso_ts"), as_of, 24) & ~N.excluded(t, exclusion))
    return N.pick_seeded(N.tiered(fresh, contains_any(t, primary), contains_any(t, tech), contains_any(t, use)), "link", seed)


def roblox(articles: DataFrame, as_of: Column, k: int = 5) -> DataFrame:
    out = N.score_roblox(articles.where(N.recent(F.col("iso_ts"), as_of, 24)))
    return N.top(out, k, F.desc("score"), F.col("ord")).withColumn("title", escape_brackets(F.col("title")))


def global_research(articles: DataFrame, posted: DataFrame, as_of: Column, k: int = 3, **words) -> DataFrame:
    fresh = N.not_in(articles.where(N.recent(F.col("iso_ts"), as_of, 48)), posted, "link")
    return N.top(N.score_global(fresh, **words), k, F.desc("score"), F.col("ord")).withColumn("site", host(F.col("link")))


def scored_books(books: DataFrame, as_of: Column, popular: bool, **rules) -> DataFrame:
    """keyword score, bonuses and total of all books."""
    out = computed((B.popular_score if popular else B.agri_score)(books, **rules), pub_date=parse_pubdate(F.col("pubdate")))
    fresh, good = freshness_bonus(F.col("pub_date"), F.to_date(as_of)), quality_bonus(F.col("review_count"), F.col("review_average"), F.col("description"))
    return out.withColumns({"freshness": fresh, "quality": good}).withColumn("total", F.col("keyword_score") + F.col("freshness") + F.col("quality"))


AGRI_LEAST, POPULAR_LEAST, REPOST_LEAST = (8, 12), (10, 18), 12


def book_of_the_day(agri: DataFrame, popular: DataFrame, posted: DataFrame, as_of: Column, agri_rules: dict | None = None, popular_rules: dict | None = None, least=(AGRI_LEAST, POPULAR_LEAST)) -> DataFrame:
    """Ranked candidates: the specialist branch, or the general one where it has none."""
    out = []
    for source, windows, is_popular, rules, (words, total) in ((agri, B.AGRI_WINDOWS, False, agri_rules, least[0]), (popular, B.POPULAR_WINDOWS, True, popular_rules, least[1])):
        near = B.adaptive_window(B.merge_by_isbn(source.where(not_far_future(F.col("pubdate"), as_of))), as_of, windows)
        scored = scored_books(N.not_in(near, posted, "isbn"), as_of, is_popular, **(rules or {}))
        out.append(scored.where((F.col("keyword_score") >= words) & (F.col("total") >= total)))
    return B.first_branch(out)


def repost(books: DataFrame, as_of: Column, least: int = REPOST_LEAST, **rules) -> DataFrame:
    """Where nothing new qualifies: the newest book of enough points, whether posted or not."""
    scored = scored_books(books, as_of, True, **rules).where((F.col("keyword_score") >= 0) & (F.col("total") >= least))
    return scored.orderBy(*B.by_date(scored)).limit(1)


def pick(candidates: DataFrame, chooser: Callable[[DataFrame], DataFrame] | None, k: int = 8) -> DataFrame:
    """One of the k best: the number that a chooser's JSON answer names, else the first. The chooser sees k rows."""
    best = save(N.top(candidates, k, F.desc("total"), *B.by_date(candidates)), "best")  # so that the candidates are scored once
    if chooser is None:
        return best.where("rank = 1")
    named = chooser(best).select(json_object(F.col("answer"), "index int, reason string")["index"].alias("_index")).agg(F.max("_index").alias("_index"))
    valid = F.when(F.col("_index").between(1, F.lit(k)), F.col("_index"))
    both = best.crossJoin(F.broadcast(named))  # one row
    n = best.agg(F.max("rank").alias("_n"))
    both = both.crossJoin(F.broadcast(n))  # one row
    return both.where(F.col("rank") == F.when(valid <= F.col("_n"), valid).otherwise(1)).drop("_index", "_n")


def guide(items: DataFrame, as_of: Column) -> DataFrame:
    """The first item of a feed, if it is not older than 48 hours."""
    return items.orderBy("ord").limit(1).where(N.guide_is_fresh(F.col("iso_ts"), as_of))


def enrich(articles: DataFrame, model: Callable[[Column], Column], prompt: Column, schema: str, least: int = 200) -> DataFrame:
    """A model's JSON answer for texts that are long enough; null where it fails. The model is a column function, so a
    pandas UDF or a stub fits."""
    body = page_body(F.col("html"))
    asked = articles.withColumn("content", F.coalesce(body, F.lit("")))
    return asked.withColumn("answer", F.when(F.char_length("content") >= least, json_object(model(prompt), schema)))


def trend_context(prompt: Column, trend: Column, none: str = "トレンドキーワードなし") -> Column:
    """The trend text before the prompt, where there is one."""
    return F.when(trend != none, F.concat(trend, F.lit("\n"), prompt)).otherwise(prompt)


def render_headline(df: DataFrame) -> DataFrame:
    return df.withColumn("message", F.concat(F.col("rank").cast("string"), F.lit(". ["), escape_brackets(shorten(F.col("title"), 80)), F.lit("]("), F.col("link"), F.lit(") "), F.coalesce(F.col("label"), F.lit("")), F.lit(" "), F.col("score").cast("string")))
