"""Keyword rules compiled to column expressions: substring, boundary and count matching."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: keywords of this form, lowered, match whole words only in boundary mode.
SHORT = re.compile(r"^[a-z0-9+#.\-]{1,4}$")


def article_text(title: Column, snippet: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(snippet, F.lit(""))))


def _any(hits: list[Column]) -> Column:
    return reduce(or_, hits) if hits else F.lit(False)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Any of the words is a substring of a lowered text. Up to 100 words are an OR, which stops at the first hit; more are
    one alternation."""
    words = list(dict.fromkeys(w.lower() for w in words if w))
    if len(words) > 100:
        return text.rlike("|".join(map(re.escape, words)))
    return _any([F.contains(text, F.lit(w)) for w in words])


def boundary_hit(text: Column, word: str) -> Column:
    word = word.lower()
    if not word:
        return F.lit(False)
    if not SHORT.match(word):
        return F.contains(text, F.lit(word))
    # the substring test comes first: it is cheap and rules most texts out
    return F.contains(text, F.lit(word)) & text.rlike(f"(?<![a-z0-9]){re.escape(word)}(?![a-z0-9])")


def boundary_any(text: Column, words: Sequence[str]) -> Column:
    return _any([boundary_hit(text, w) for w in dict.fromkeys(words) if w])


def count_matches(text: Column, words: Sequence[str]) -> Column:
    """How many list entries hit, repeats counted as often as they are listed."""
    return reduce(lambda a, b: a + b, [boundary_hit(text, w).cast("int") for w in words if w], F.lit(0))


def points(text: Column, rules: Sequence[tuple[str, int, Sequence[str]]], hit=contains_any) -> tuple[Column, Column]:
    """(score, categories): the points of each category that hits, once; the categories in the order of the rules."""

    def judged(seen: Column) -> Column:
        flags = [(name, worth, F.get(seen, F.lit(i))) for i, (name, worth, _) in enumerate(rules)]
        score = reduce(lambda a, b: a + b, [F.when(f, F.lit(worth)).otherwise(0) for _, worth, f in flags], F.lit(0))
        return F.struct(score.cast("int").alias("score"), F.array_compact(F.array(*(F.when(f, F.lit(name)) for name, _, f in flags))).alias("cats"))

    # lambda variables hold the text and the flags, so neither is worked out once for each keyword
    seen = F.get(F.transform(F.array(text), lambda t: F.array(*(F.coalesce(hit(t, words), F.lit(False)) for _, _, words in rules))), F.lit(0))
    out = F.get(F.transform(F.array(seen), judged), F.lit(0))
    return out["score"], out["cats"]


def distinct_words(words: Sequence[str], limit: int | None = None) -> list[str]:
    return list(dict.fromkeys(w for w in words if w))[:limit]


def rotate_by_day(words: Sequence[str], count: int, day_of_year: int) -> list[str]:
    """`count` keywords, starting further on each day."""
    words = distinct_words(words)
    if len(words) <= count:
        return words
    at = day_of_year * count % len(words)
    return (words[at:] + words[:at])[:count]
