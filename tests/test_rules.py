"""Rule tables against the compiled expressions and brute force; similar titles against all pairs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pressmill.functions import keywords as K
from pressmill.operators import meeting as G
from pressmill.operators import rules as U
from pressmill.operators import similar as M


def in_order(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_modes_repeats_and_categories(spark):
    rows = [("a", "x", 3, 0, "AI", "boundary"), ("a", "y", 5, 1, "ai", "substring"), ("a", "x", 3, 2, "c++", "boundary"), ("a", "y", 5, 3, "ai", "substring"), ("a", "z", 2, 4, "農業", "boundary"), ("a", "z", 2, 5, "longword", "boundary"), ("b", "other", 9, 0, "ai", "substring"), ("a", "x", 3, 6, None, "substring"), ("a", "x", 3, 7, "", "boundary"), ("a", "x", 3, 8, "odd", "regex")]
    texts = [(1, "training with ai."), (2, "training"), (3, "c++ and c++11, 農業ai活用"), (4, "alongwords odd"), (5, ""), (6, None), (7, "ai")]
    table = U.rule_table(spark, rows)
    want = [(1, [0, 1, 3], ["x", "y"], 8), (2, [1, 3], ["y"], 5), (3, [0, 1, 2, 3, 4], ["x", "y", "z"], 10), (4, [5], ["z"], 2), (5, [], [], 0), (6, [], [], 0), (7, [0, 1, 3], ["x", "y"], 8)]
    for most in (1 << 20, 20):  # one automaton, and one a rule
        rules = U.RuleSet(table, "a", most)
        assert (len(rules.parts) > 4) == (most == 20)
        df = spark.createDataFrame(texts, "n int, text string")
        assert in_order(U.match(df, rules)) == [(n, t, *w) for (n, t), (_, *w) in zip(texts, want, strict=True)] or in_order(U.match(df, rules).drop("text")) == sorted(map(tuple, want), key=str)
    nothing = U.match(spark.createDataFrame(texts, "n int, text string"), U.RuleSet(table, "absent"))
    assert {(len(r["hits"]), r["score"]) for r in nothing.collect()} == {(0, 0)}
    assert U.match(spark.createDataFrame([], "n int, text string"), U.RuleSet(table, "a")).count() == 0


def test_like_the_compiled_expressions(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc+") for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    texts = spark.createDataFrame([(i, "".join(rng.choice("abc+ -9") for _ in range(60))) for i in range(300)], "n int, text string")
    table = U.rule_table(spark, U.rule_rows("w", [("all", 1, words)], "boundary") + U.rule_rows("s", [("all", 1, words)]))
    for ruleset, hit in (("w", K.boundary_hit), ("s", lambda t, w: F.contains(t, F.lit(w)))):
        want = texts.select("n", F.array_compact(F.array(*(F.when(hit(F.col("text"), w), F.lit(i)) for i, w in enumerate(words)))).alias("hits"))
        assert in_order(U.match(texts, U.RuleSet(table, ruleset)).select("n", "hits")) == in_order(want)


def test_twenty_thousand_words_in_one_reading(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 9))) for _ in range(21_000)})[:20_000]
    texts = [(i, " ".join(rng.choice(words) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40))) for i in range(200)]
    rules = U.RuleSet(U.rule_table(spark, U.rule_rows("big", [("all", 1, words)])), "big")
    assert len(rules.parts) == 1
    known, sizes = {w: i for i, w in enumerate(words)}, range(5, 9)
    for r in U.match(spark.createDataFrame(texts, "n int, text string"), rules).collect():
        t = r["text"]
        assert r["hits"] == sorted({known[t[i : i + k]] for k in sizes for i in range(len(t)) if t[i : i + k] in known})
        assert r["score"] == (1 if r["hits"] else 0)


def alike(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            row.append(min(row[j] + 1, before[j + 1] + 1, before[j] + (x != y)))
        before = row
    longest = max(len(a), len(b))
    return 100 if longest == 0 else int((longest - before[-1]) / longest * 100 + 0.5)


@pytest.mark.parametrize("least", [30, 50, 70, 85, 95])
def test_similar_pairs_against_all_pairs(spark, least):
    rng = random.Random(least)
    titles = ["".join(rng.choice("ab c") for _ in range(rng.randrange(0, 14))) for _ in range(150)]
    titles += ["".join(rng.choice("aé😀") if rng.random() < 0.1 else c for c in t * 3) for t in titles[:60]]
    titles = list(dict.fromkeys(titles))
    df = spark.createDataFrame([*enumerate(titles), (-1, None)], "key long, title string")
    want = {(i, j, alike(titles[i], titles[j])) for i in range(len(titles)) for j in range(i + 1, len(titles))}
    got = list(map(tuple, M.similar_pairs(df, least).collect()))
    assert len(got) == len(set(got)) and set(got) == {w for w in want if w[2] >= least}


@pytest.mark.parametrize("least", [50, 70, 90])
def test_titles_too_long_for_the_index(spark, least):
    rng = random.Random(least)
    titles = ["".join(rng.choice("abc ") for _ in range(rng.choice([30, 70, 90, 140, 260]))) for _ in range(16)]
    titles += ["".join(rng.choice("xyz") if rng.random() < 0.15 else c for c in t) for t in titles]
    titles = [*dict.fromkeys(titles), "q" * 9000, "q" * 8800]
    df = spark.createDataFrame(list(enumerate(titles)), "key long, title string")
    want = {(i, j, alike(titles[i], titles[j])) for i in range(len(titles) - 2) for j in range(i + 1, len(titles) - 2)}
    want = {w for w in want if w[2] >= least} | {(len(titles) - 2, len(titles) - 1, 98)}
    assert set(map(tuple, M.similar_pairs(df, least).collect())) == want


def test_few_pairs_are_compared(spark):
    rng = random.Random(9)
    titles = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randrange(40, 61))) for _ in range(300)]
    titles += [t[:20] + "x" + t[21:] for t in titles[:30]]
    df = spark.createDataFrame(list(enumerate(titles)), "key long, title string")
    pairs = len(titles) * (len(titles) - 1) / 2
    assert M.candidates(df, 85).count() < 0.01 * pairs and M.candidates(df, 75).count() < 0.1 * pairs
    assert Counter(len(titles) - 30 <= r["b"] for r in M.similar_pairs(df, 85).collect()) == {True: 30}


def test_no_titles(spark):
    empty = spark.createDataFrame([], "key long, title string")
    assert M.similar_pairs(empty, 70).count() == 0
    with pytest.raises(ValueError):
        M.similar_pairs(empty, 0)


def test_titles_that_differ_in_digits_are_one_form(spark, monkeypatch):
    """Addresses share nearly all segments; their numbers must not make candidates of all pairs."""
    titles = [f"https://{host}.example.org/en/{1000 + i}" for host in ("m", "news.of.the.day") for i in range(60)]
    df = spark.createDataFrame(list(enumerate(titles)), "key int, title string")
    asked, candidates = [], M.candidates
    monkeypatch.setattr(M, "candidates", lambda t, least: asked.append(t.count()) or candidates(t, least))
    got = sorted(map(tuple, M.similar_pairs(df, 85).collect()))
    assert got == [(a, b, s) for a in range(120) for b in range(a + 1, 120) if (s := alike(titles[a], titles[b])) >= 85]
    assert asked == [2]


def addresses(rng, many):
    ends = ["", "/", "#top", ".html", "?page=2&ref=x", "#größe😀"]
    return [*dict.fromkeys(f"http{rng.choice(['', 's'])}://{rng.choice(['', 'm.', 'blog.'])}{rng.choice(['tion', 'ther'])}.example.org/{rng.randrange(10 ** rng.randrange(1, 6))}{rng.choice(ends)}" for _ in range(many))]


@pytest.mark.parametrize("least,few", [(60, 10_000), (85, 10_000), (85, 0)])
def test_addresses_by_lengths_and_by_the_index(spark, monkeypatch, least, few):
    """Groups dealt to several rows; titles below, at and beyond a word of 64 letters, an empty one and a null."""
    titles = [*addresses(random.Random(least), 60), "", *("x" * (n - 3) + t for n in (63, 64, 65, 90) for t in ("abc", "abd", "a1d", "a2d"))]
    df = spark.createDataFrame([*((f"k{i:03}", t) for i, t in enumerate(titles)), ("none", None)], "key string, title string")
    want = {(f"k{i:03}", f"k{j:03}", s) for i in range(len(titles)) for j in range(i + 1, len(titles)) if (s := alike(titles[i], titles[j])) >= least}
    monkeypatch.setattr(M, "FEW", few)
    monkeypatch.setattr(M, "WORTH", 10 if few else 0)
    monkeypatch.setattr(G, "CHUNK", 3)
    got = list(map(tuple, M.similar_pairs(df, least).collect()))
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("few", [10_000, 0])
def test_segments_that_nearly_all_share_bring_no_candidates(spark, monkeypatch, few):
    rng = random.Random(few)
    titles = ["https://www." + "".join(rng.choice("abcdefgh") for _ in range(12)) + ".example.org/" for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(titles)), "key long, title string")
    monkeypatch.setattr(M, "FEW", few)
    assert M.candidates(df, 85).count() < 100  # of 19,900


@pytest.mark.parametrize("letters", ["ab", "abcé😀\0", "".join(map(chr, range(0x4E00, 0x4F00)))])
def test_similarity_by_words_of_bits(letters):
    rng = random.Random(letters)
    slots = np.zeros(0x110000, np.uint32)
    for size in (1, 7, 63, 64, 65, 130):
        base = "".join(rng.choice(letters) for _ in range(size))
        titles = [base, *(base[: size // 2] + "".join(rng.choice(letters) for _ in range(size - size // 2)) for _ in range(3))]
        visitors = ["".join(rng.choice(letters + "z") if rng.random() < 0.3 else c for c in base[:n]) for n in (1, 62, 63, 64)]
        home = G.Home(pa.array(titles), slots)
        got = {(i, j): s for v, h, similarity in home.alike(pa.array(["z", *visitors])[1:], 1) for i, j, s in zip(v, h, similarity, strict=True)}
        assert got == {(i, j): s for i, v in enumerate(visitors) for j, t in enumerate(titles) if (s := alike(v, t)) >= 1}
        home.leave()
        assert not slots.any()
