"""Book dedup, scoring and window selection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import in_window
from ..functions.keywords import boundary_any, contains_any, count_matches, points
from ..functions.once import computed, spread
from ..sources import rulepacks as R
from ..work import save


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def merge_by_isbn(books: DataFrame) -> DataFrame:
    """For each ISBN the first book with a cover, else the first; ord becomes the place where the ISBN came first."""
    w = Window.partitionBy("isbn").orderBy(filled(F.col("cover")).desc(), "ord")
    first = F.min("ord").over(Window.partitionBy("isbn"))
    return books.where(filled(F.col("isbn"))).withColumns({"_rank": F.row_number().over(w), "_first": first}).where("_rank = 1").withColumn("ord", F.col("_first")).drop("_rank", "_first")


def identity_key(isbn: Column, title: Column, author: Column) -> Column:
    t, a = F.lower(F.trim(F.coalesce(title, F.lit("")))), F.lower(F.trim(F.coalesce(author, F.lit(""))))
    return F.when(filled(isbn), F.concat(F.lit("isbn:"), isbn)).when(t != "", F.concat(F.lit("meta:"), t, F.lit("::"), a))


def dedupe_by_identity(books: DataFrame) -> DataFrame:
    """For each identity the most complete book, the earliest of equals; books without one go."""
    complete = filled(F.col("cover")).cast("int") + filled(F.col("description")).cast("int") + filled(F.col("pubdate")).cast("int") + (F.coalesce("review_count", F.lit(0)) > 0).cast("int")
    keyed = books.withColumns({"identity": identity_key(F.col("isbn"), F.col("title"), F.col("author")), "completeness": complete}).where("identity IS NOT NULL")
    w = Window.partitionBy("identity").orderBy(F.desc("completeness"), "ord")
    return keyed.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def first_by(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_rank = 1").drop("_rank")


def adaptive_window(books: DataFrame, as_of: Column, windows: Sequence[tuple[int, int]], least: int = 3) -> DataFrame:
    """The first window that holds `least` books, else the widest if it holds any, else all. One aggregate counts all."""
    flagged = books.withColumns({f"_w{i}": in_window(F.col("pubdate"), as_of, back, True, ahead) for i, (back, ahead) in enumerate(windows)})
    counts = flagged.agg(*(F.count_if(f"_w{i}").alias(f"_n{i}") for i in range(len(windows))))
    last = len(windows) - 1
    pick = reduce(lambda c, i: c.when(F.col(f"_n{i}") >= least, i), range(1, last + 1), F.when(F.col("_n0") >= least, 0))
    pick = F.coalesce(pick, F.when(F.col(f"_n{last}") >= 1, last), F.lit(-1))
    out = flagged.crossJoin(F.broadcast(counts.select(pick.alias("window_no"))))  # one row
    keep = reduce(lambda a, i: a | ((F.col("window_no") == i) & F.col(f"_w{i}")), range(last + 1), F.col("window_no") == -1)
    return out.where(keep).drop(*(f"_w{i}" for i in range(last + 1)))


AGRI_WINDOWS = [(14, 30), (30, 60), (90, 90), (180, 90)]
POPULAR_WINDOWS = [(7, 7), (14, 14), (30, 30), (90, 60)]


def _low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def agri_score(books: DataFrame, pack: dict[str, list[str]] | None = None, required: Sequence[str] = R.AGRI_STRICT_REQUIRED, exclusion: Sequence[str] = R.EXCLUSION, tech_exclusion: Sequence[str] = R.BOOK_TECH_EXCLUSION) -> DataFrame:
    """books (title, author, publisher, series, description) with keyword_score (-1 where excluded), categories and
    exclude_reason, the first that applies."""
    pack = pack or R.DOMESTIC
    full = F.concat_ws(" ", _low("title"), _low("author"), _low("publisher"), _low("series"))
    text = F.concat_ws(" ", _low("title"), _low("author"), _low("series"), _low("description"))
    noise = {w.lower() for w in R.BOOK_SCORING_NOISE}
    books = computed(spread(books), _full=full, _text=text)
    full, text = F.col("_full"), F.col("_text")
    score, cats = points(text, [(k, p, [w for w in pack[k] if w.lower() not in noise]) for k, p in R.BOOK_POINTS], boundary_any)
    books = computed(books, _points=F.struct(score.alias("score"), cats.alias("cats")))
    score, cats = F.col("_points.score"), F.col("_points.cats")
    reason = F.when(contains_any(full, exclusion), "generic").when(contains_any(full, tech_exclusion), "off topic").when(contains_any(full, R.EXAM_EXCLUSION), "exam").when(~boundary_any(text, required), "no required theme")
    reason = reason.when(~F.arrays_overlap(cats, F.array(*map(F.lit, ("core", "tech", "consumer", "social", "policy")))), "no core domain")
    judged = computed(books, exclude_reason=reason)
    reason = F.col("exclude_reason")
    return judged.withColumns({"keyword_score": F.when(reason.isNull(), score).otherwise(-1), "categories": F.when(reason.isNull(), cats).otherwise(F.array(reason))}).drop("_full", "_text", "_points")


def popular_score(books: DataFrame, themes=R.REVIEW_THEMES, hooks: Sequence[str] = R.REVIEW_PRIORITY_HOOK, engaging: Sequence[str] = R.REVIEW_HIGH_ENGAGEMENT, practical: Sequence[str] = R.REVIEW_PRACTICAL_APPLICATION, series: Sequence[str] = R.REVIEW_SERIES_FRIENDLY, own: Sequence[str] = R.REVIEW_SELF_CONNECTION, pv: Sequence[str] = R.REVIEW_PV, story: Sequence[str] = R.REVIEW_STORY_LEARNING, exclusion: Sequence[str] = R.EXCLUSION, people: tuple[int, ...] = (0, 5), tale: int = 7) -> DataFrame:
    """The same for general books: themes count matches, several themes and signals add bonuses. people, tale: numbers of the
    themes whose readers respond to engaging words, and of the stories."""
    full = F.concat_ws(" ", _low("title"), _low("author"), _low("publisher"))
    text = F.concat_ws(" ", _low("title"), _low("author"), _low("description"))
    columns, books = books.columns, computed(spread(books), _full=full, _text=text)
    full, text = F.col("_full"), F.col("_text")
    counted = [count_matches(text, words) for _, _, words in themes]
    flags = [boundary_any(text, w) for w in (hooks, engaging, practical, series, own, pv, story)]
    excludes = [contains_any(full, exclusion), contains_any(full, R.LIGHT_NOVEL_EXCLUSION), contains_any(full, R.EXAM_EXCLUSION), contains_any(text, R.REVIEW_TARGET_EXCLUSION)]
    n = len(themes)

    def judged(seen: Column) -> Column:
        """From the counts and flags, each worked out once: reason, score and categories."""
        hits = [F.get(seen, F.lit(i)) for i in range(n)]
        hook, engaged, useful, serial, linked, viewed, learns = (F.get(seen, F.lit(n + i)) > 0 for i in range(7))
        reason = F.coalesce(*(F.when(F.get(seen, F.lit(n + 7 + i)) > 0, name) for i, name in enumerate(("generic", "light novel", "exam", "format"))))
        axes = F.size(F.filter(F.slice(seen, 1, n), lambda h: h > 0))
        worth = reduce(lambda a, b: a + b, [F.when(h > 0, p + F.least(h - 1, F.lit(3))).otherwise(0) for h, (_, p, _) in zip(hits, themes, strict=True)])
        bonuses = [
            ("several themes", axes >= 2, 4),
            ("many sides", axes >= 3, 3),
            ("engaging", engaged, 6),
            ("human nature", engaged & reduce(lambda a, b: a | b, [hits[i] > 0 for i in people]), 4),
            ("practical", useful, 4),
            ("series", serial, 4),
            ("own books", linked, 3),
            ("page views", viewed, 2),
            ("learning story", (hits[tale] > 0) & learns, 3),
        ]
        score = reduce(lambda a, b: a + F.when(b[1], b[2]).otherwise(0), bonuses, worth)
        cats = F.array_compact(F.array(*(F.when(h > 0, F.lit(label)) for h, (label, _, _) in zip(hits, themes, strict=True)), *(F.when(c, F.lit(name)) for name, c, _ in bonuses)))
        reason = F.coalesce(reason, F.when(axes == 0, "no theme"), F.when((axes < 2) & ~hook, "no hook"))
        return F.struct(reason.alias("exclude_reason"), F.when(reason.isNull(), score).otherwise(-1).cast("int").alias("keyword_score"), F.when(reason.isNull(), cats).otherwise(F.array(reason)).alias("categories"))

    seen = computed(books, _seen=F.array(*counted, *(f.cast("int") for f in (*flags, *excludes))))
    out = computed(seen, _judged=F.get(F.transform(F.array("_seen"), judged), F.lit(0)))
    return out.select(*columns, "_judged.exclude_reason", "_judged.keyword_score", "_judged.categories")


def first_branch(branches: Sequence[DataFrame]) -> DataFrame:
    """The rows of the first branch that has any, tagged with its number."""
    tagged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("branch", F.lit(i)) for i, d in enumerate(branches)])
    tagged = save(tagged, "branches")  # so that the books are scored once
    least = tagged.agg(F.min("branch").alias("_least"))
    return tagged.join(F.broadcast(least), tagged["branch"] == least["_least"]).drop("_least")  # one row


def by_date(books: DataFrame, day: str = "pub_date") -> list[Column]:
    """Newest first, without a date last, then by source order."""
    return [F.col(day).desc_nulls_last(), F.col("ord")]
