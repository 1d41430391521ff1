"""Rules as data: a table of keywords, of any number, matched against texts in one reading of each text.

Rules are rows (ruleset, category, points, ordinal, keyword, match_mode). Those of a rule set are measured, collected and compiled into
multi-pattern automata of at most `most_bytes` of keywords each, which are broadcast; texts pass through them in Arrow batches. A rule
set of one automaton, some tens of thousands of keywords, costs one reading of a text however many keywords it has; a larger one
is dealt to several automata by ordinal, each of a bounded size, and costs a reading for each.

Modes: `substring` finds a keyword anywhere; `boundary` finds a short one (up to four characters of a-z, 0-9, `+`, `#`, `.` and `-`) only where neither neighbour is
one of a-z and 0-9, and others anywhere. Texts are given lowered, keywords are lowered here.

Defined results: `hits` lists the ordinals of the matching rules in ascending order, an entry that is listed twice having two ordinals and
hitting twice; a null text has none; null and empty keywords, and other modes, match nothing; rules of one ordinal are all matched, the ordinal comes
once; a rule set without rules matches nothing; an empty table of texts gives none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keywords import SHORT

RULES = "ruleset string, category string, points int, ordinal int, keyword string, match_mode string"
MODES = ("substring", "boundary")
#: Keywords of one automaton, in bytes with 16 more each; the rules of a set that may reach the driver.
MOST_BYTES, MOST_RULES = 4 << 20, 5_000_000
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def rule_rows(ruleset: str, packs: Sequence[tuple[str, int, Sequence[str]]], match_mode: str = "substring") -> list[tuple]:
    """Rows of a rule table from categories with points and keywords; ordinals run through all of them."""
    rows = [(name, points, w) for name, points, words in packs for w in words]
    return [(ruleset, name, points, i, w, match_mode) for i, (name, points, w) in enumerate(rows)]


def rule_table(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), RULES)


class Matcher:
    """The ordinals and the categories (by number) of the rules that a text matches."""

    def __init__(self, rules: Sequence[tuple[int, int, str, bool]]) -> None:
        """rules: (ordinal, number of the category, lowered keyword, whether it must stand alone)."""
        import ahocorasick

        by_word: dict[str, tuple[list, list]] = {}
        for ordinal, category, word, alone in rules:
            by_word.setdefault(word, ([], []))[alone].append((ordinal, category))
        self.automaton = ahocorasick.Automaton()
        for n, (word, (free, alone)) in enumerate(by_word.items()):
            self.automaton.add_word(word, (n, len(word), free, alone))
        self.some = bool(by_word)
        if self.some:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> tuple[list[int], list[int]]:
        if not text or not self.some:
            return [], []
        found: set[tuple[int, int]] = set()
        free_done, alone_done = set(), set()
        for end, (n, size, free, alone) in self.automaton.iter(text):
            if free and n not in free_done:
                free_done.add(n)
                found.update(free)
            if alone and n not in alone_done:
                start = end + 1 - size
                if (start == 0 or text[start - 1] not in WORD) and (end + 1 == len(text) or text[end + 1] not in WORD):
                    alone_done.add(n)
                    found.update(alone)
        return sorted({o for o, _ in found}), sorted({c for _, c in found})


@lru_cache(maxsize=8)
def _matcher(rules: tuple) -> Matcher:
    return Matcher(rules)


class RuleSet:
    """A rule set, measured and collected: its categories, in the order of their first rules, and its rules for each automaton."""

    def __init__(self, rules: DataFrame, ruleset: str, most_bytes: int = MOST_BYTES) -> None:
        usable = F.col("match_mode").isin(*MODES) & (F.coalesce("keyword", F.lit("")) != "")
        own = rules.where((F.col("ruleset") == ruleset) & usable).select("ordinal", "category", "points", F.lower("keyword").alias("keyword"), "match_mode")
        count, size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("keyword") + 16), F.lit(0))).first()
        if count > MOST_RULES:
            raise ValueError(f"rule set {ruleset} has {count} rules; at most {MOST_RULES} are compiled")
        rows = sorted(own.collect(), key=lambda r: (r["ordinal"], r["keyword"]))
        points: dict[str, int] = {}
        for r in rows:
            points.setdefault(r["category"], r["points"] or 0)
        self.names, self.points = list(points), list(points.values())
        number = {c: i for i, c in enumerate(self.names)}
        listed = [(r["ordinal"], number[r["category"]], r["keyword"], r["match_mode"] == "boundary" and bool(SHORT.match(r["keyword"]))) for r in rows]
        parts = max(1, -(-size // most_bytes))
        self.parts = [tuple(listed[i::parts]) for i in range(parts)]


def _finder(held) -> Column:
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = _matcher(held.value)
        kind = pa.struct([("hits", pa.list_(pa.int32())), ("cats", pa.list_(pa.int32()))])
        for texts in batches:
            yield pa.array([dict(zip(("hits", "cats"), find(t), strict=True)) for t in texts.to_pylist()], kind)

    return F.arrow_udf(found, "struct<hits: array<int>, cats: array<int>>")


def match(texts: DataFrame, rules: RuleSet, text: str = "text") -> DataFrame:
    """texts with `hits`, the ordinals of the rules that the column matches, `categories`, those of the rules in their order, and `score`, the points of
    each of these categories once."""
    found = [_finder(texts.sparkSession.sparkContext.broadcast(part))(F.col(text)) for part in rules.parts]  # of a measured size, see RuleSet
    out = texts.select(*texts.columns, *(f.alias(f"_found{i}") for i, f in enumerate(found)))
    merged = lambda c: F.col(f"_found0.{c}") if len(found) == 1 else F.array_sort(F.array_distinct(F.concat(*(F.col(f"_found{i}.{c}") for i in range(len(found))))))
    listed = lambda values, kind: F.array(*map(F.lit, values)).cast(f"array<{kind}>")
    cats = merged("cats")
    names, points = listed(rules.names, "string"), listed(rules.points, "int")
    score = F.aggregate(cats, F.lit(0), lambda total, i: total + F.get(points, i))
    return out.select(*texts.columns, merged("hits").alias("hits"), F.transform(cats, lambda i: F.get(names, i)).alias("categories"), score.alias("score"))


def score_news(articles: DataFrame, rules: RuleSet, excluded: RuleSet, gate: str) -> DataFrame:
    """Scored articles (link, text, ord, ...) that match no excluded keyword and have the gate's category; of equal links the first: the
    rows of news.score_news, from rule tables."""
    seen = match(match(articles, excluded).where(F.size("hits") == 0).drop("hits", "categories", "score"), rules)
    kept = seen.where(F.array_contains("categories", gate))
    first = Window.partitionBy("link").orderBy("ord")
    return kept.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "hits").withColumn("label", F.array_join("categories", " + "))


def keyword_counts(news: DataFrame, rules: RuleSet, table: DataFrame, ruleset: str) -> DataFrame:
    """news (ord, title): hits of each keyword of the rule table, entries listed twice counting twice; rank by hits, first seen first."""
    hits = match(news.select("ord", F.lower(F.coalesce("title", F.lit(""))).alias("text")), rules).select("ord", F.explode("hits").alias("ordinal"))
    counted = hits.groupBy("ordinal").agg(F.count(F.lit(1)).alias("hits"), F.min("ord").alias("ord"))
    words = table.where(F.col("ruleset") == ruleset).select("ordinal", F.lower("keyword").alias("keyword"))
    both = counted.join(words, "ordinal").groupBy("keyword").agg(F.sum("hits").alias("hits"), F.min(F.struct("ord", "ordinal")).alias("first"))
    return both.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hits"), "first"))).drop("first")  # a row a keyword
