"""Article selection: scores, tiers, ledgers, engagement, trends, similar titles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import rounded
from ..functions.keywords import contains_any, points
from ..sources import rulepacks as R
from ..work import forget, save
from .similar import similar_pairs


def recent(at: Column, as_of: Column, hours: int) -> Column:
    return F.coalesce(at >= as_of - F.make_dt_interval(hours=F.lit(hours)), F.lit(False))


def guide_is_fresh(at: Column, as_of: Column) -> Column:
    """No more than 48 hours old; an unreadable date passes."""
    return ~F.coalesce(at < as_of - F.make_dt_interval(hours=F.lit(48)), F.lit(False))


def excluded(text: Column, words: Sequence[str] = R.EXCLUSION, own_names: Sequence[str] = ()) -> Column:
    return contains_any(text, [*words, *own_names])


def score_news(articles: DataFrame, pack: dict[str, list[str]] | None = None, exclusion: Sequence[str] = R.EXCLUSION, own_names: Sequence[str] = ()) -> DataFrame:
    """Scored articles that pass the exclusion and the gate (the first category); of equal links the first of them."""
    pack = pack or R.DOMESTIC
    score, cats = points(F.col("text"), [(k, p, pack[k]) for k, p in R.NEWS_POINTS])
    gate = R.NEWS_POINTS[0][0]
    kept = articles.where(~excluded(F.col("text"), exclusion, own_names)).withColumns({"score": score, "cats": cats}).where(F.array_contains("cats", gate))
    first = Window.partitionBy("link").orderBy("ord")
    return kept.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn("label", F.array_join("cats", " + "))


def score_global(articles: DataFrame, agri: Sequence[str] = R.GLOBAL_AGRI, tech: Sequence[str] = R.GLOBAL_TECH, research: Sequence[str] = R.GLOBAL_RESEARCH) -> DataFrame:
    """Gate Agri 5, Tech 5, Research 3, both of the first +10."""
    a, t, r = (contains_any(F.col("text"), w) for w in (agri, tech, research))
    score = F.lit(5) + F.when(t, 5).otherwise(0) + F.when(r, 3).otherwise(0) + F.when(t, 10).otherwise(0)
    label = F.concat_ws(" + ", F.lit("Agri"), F.when(t, "Tech"), F.when(r, "Research"), F.when(t, "Agri-Tech Synergy"))
    return articles.where(a).withColumns({"score": score.cast("int"), "label": label})


def score_roblox(articles: DataFrame, least: int = 5) -> DataFrame:
    score, cats = points(F.col("text"), R.ROBLOX)
    return articles.withColumns({"score": score, "label": F.array_join(cats, " & ")}).where(F.col("score") >= least)


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first with their rank: limit before rank, so only k rows are ever in one task."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def tiered(df: DataFrame, primary: Column, tech: Column, use: Column) -> DataFrame:
    """The first of P and T and U, P and T, P and U, P that has rows."""
    tier = F.when(primary & tech & use, 1).when(primary & tech, 2).when(primary & use, 3).when(primary, 4)
    flagged = save(df.withColumn("tier", tier).where("tier IS NOT NULL"), "tiers")  # so that the texts are matched once
    least = flagged.agg(F.min("tier").alias("_least"))
    return flagged.join(F.broadcast(least), flagged["tier"] == least["_least"]).drop("_least")  # one row


def not_in(df: DataFrame, ledger: DataFrame, key: str, ledger_key: str | None = None) -> DataFrame:
    """Anti-join against a ledger. The planner broadcasts a ledger that is small and sorts a large one."""
    keys = ledger.select(F.col(ledger_key or key).alias("_key")).where("_key IS NOT NULL").distinct()
    return df.join(keys, df[key] == keys["_key"], "left_anti")


def pick_seeded(df: DataFrame, key: str, seed: int) -> DataFrame:
    """One row, picked by a hash of the seed and the key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(1)


def interesting(words: Sequence[str], *texts: Column) -> Column:
    """Any of the words in any of the texts, joined by spaces, whatever the case."""
    return contains_any(F.lower(F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts))), words)


def group_counts(df: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """One row: how many rows each condition holds for."""
    return df.agg(*(F.count_if(c).alias(name) for name, c in groups.items()))


# --- engagement and trends


def engagement(posts: DataFrame, url: str = "url", content: str = "content") -> DataFrame:
    """Posts and their mean length (rounded) by URL."""
    size = F.sum(F.char_length(F.coalesce(F.col(content), F.lit("")))).alias("total_length")
    out = posts.where(F.coalesce(F.col(url).cast("string"), F.lit("")) != "").groupBy(F.col(url).alias("url")).agg(F.count(F.lit(1)).alias("posts"), size)
    return out.withColumn("mean_length", rounded(F.col("total_length").cast("double") / F.col("posts")).cast("long"))


def dynamic_score(scored: DataFrame, metrics: DataFrame) -> DataFrame:
    """One factor for all, from the URLs with at least three posts: their mean number of posts and mean mean length."""
    means = metrics.where("posts >= 3").agg(F.avg("posts").alias("_p"), F.avg("mean_length").alias("_l"))
    share = F.when(F.col("_p") >= 10, 0.20).when(F.col("_p") >= 5, 0.15).when(F.col("_p") >= 3, 0.10).otherwise(0.0).cast("double")
    base = F.col("score").cast("double")
    more = rounded(base * F.coalesce(share, F.lit(0.0))) + F.when(F.col("_l") >= 200, rounded(base * F.lit(0.10).cast("double"))).otherwise(0)
    return scored.crossJoin(F.broadcast(means)).withColumn("final_score", (F.col("score") + more).cast("int")).drop("_p", "_l")  # one row


def keyword_hits(news: DataFrame, words: Sequence[str]) -> DataFrame:
    """(ord, n, keyword): a row for each list entry that a title holds."""
    listed = F.array(*(F.struct(F.lit(i).alias("n"), F.lit(w.lower()).alias("keyword")) for i, w in enumerate(words)))
    title = F.lower(F.coalesce(F.col("title"), F.lit("")))
    hit = F.filter(listed, lambda s: F.contains(title, s["keyword"]))
    return news.select(*news.columns, F.inline(hit))


def trend_counts(news: DataFrame, words: Sequence[str]) -> DataFrame:
    """How often each keyword hits, entries listed twice counting twice; rank by count, first seen first."""
    hits = keyword_hits(news, words).groupBy("keyword").agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("ord", "n")).alias("first"))
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hits"), "first"))).drop("first")  # a row a keyword


def merged_terms(answers: DataFrame, k: int = 5) -> DataFrame:
    """answers (ord, terms: map): the terms of all, in the order first seen, each as last explained, the first k."""
    terms = answers.select("ord", F.posexplode("terms").alias("at", "term", "meaning"))
    once = terms.groupBy("term").agg(F.min(F.struct("ord", "at")).alias("first"), F.max_by("meaning", F.struct("ord", "at")).alias("meaning"))
    return top(once, k, F.col("first")).select("rank", "term", "meaning")


def recent_topics(news: DataFrame, words: Sequence[str], as_of: Column, days: int = 3, k: int = 5) -> DataFrame:
    """The first k keywords, in the order seen, of the news of the last days."""
    fresh = news.where(F.col("at") >= as_of - F.make_dt_interval(F.lit(days)))
    seen = keyword_hits(fresh, words).groupBy("keyword").agg(F.min(F.struct("ord", "n")).alias("first"))
    return top(seen, k, F.col("first")).select("keyword", "rank")


# --- similar titles


def similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(most == 0, 100).otherwise(rounded((most - F.levenshtein(a, b)).cast("double") / most * 100)).cast("int")


def leaders(items: DataFrame, least: int = 70) -> DataFrame:
    """items (ord, title) in order of ord: the greedy representatives, ord of those with no earlier representative of a
    similar title. Equal titles are taken together; then, round by round, a title without an undecided earlier neighbour is
    decided, so the result is the sequential one."""
    titles = save(items.groupBy("title").agg(F.min("ord").alias("key")), "titles")
    pairs = save(similar_pairs(titles, least), "pairs")
    state = save(titles.select("key", F.lit(None).cast("boolean").alias("lead")), "state")
    while state.where("lead IS NULL").limit(1).count():
        earlier = pairs.join(state, pairs["a"] == state["key"]).groupBy("b").agg(F.bool_or(F.coalesce("lead", F.lit(False))).alias("led"), F.bool_or(F.col("lead").isNull()).alias("open"))
        after = state.join(earlier, state["key"] == earlier["b"], "left")
        lead = F.when(F.col("lead").isNotNull(), F.col("lead")).when(F.col("led"), False).when(~F.coalesce("open", F.lit(False)), True)
        before, state = state, save(after.select("key", lead.alias("lead")), "state")
        forget(before)
    forget(titles, pairs)
    return state.where("lead").select(F.col("key").alias("ord"))
