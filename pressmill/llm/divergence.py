"""How far the sources of a language diverge in their terms, by inclusion and exclusion over the terms that they hold.

Every group (a source of a language) gives every kept term of its language a smoothed weight p that depends on the term's count there,
so all terms that a group lacks weigh the same, p0. The divergence of two groups a and b, a sum of f(p_a, p_b) over all V kept terms,
is therefore never summed term by term:

* one-sided terms: f(p_a, p0_b) for every term of a and f(p0_a, p_b) for every term of b, priced from the histogram of counts of each
  group (how many terms occur so often), not from its terms;
* overlaps: the terms that both hold were priced twice, each time with the other's p0; a join of the postings (who holds the term, how
  often) adds f(p_a, p_b) - f(p_a, p0_b) - f(p0_a, p_b) + f(p0_a, p0_b) for each;
* the rest, terms that neither holds, is the constant (V - |a| - |b|) f(p0_a, p0_b), as the overlap's last term gives back what it takes
  twice.

Terms are counted in Arrow batches into partial counts (a bounded table a task, written out when it is full), so only these are shuffled.
All else is DataFrame work in integers: weights through decimals, which never overflow, everything after in long.

Defined results: a null text, language or source is the empty string, and the empty language or source is one like any other; every row
of the table is a document, repeated rows and null ids included; a group without terms weighs every kept term p0; a language without
kept terms has pairs of value 0 and no terms; ties in value go by the item in order of its UTF-8 bytes; texts and terms may be of any
length; bytes that are no UTF-8 are read as U+FFFD; an empty table gives no rows; columns other than text, lang and source are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, save, table

LEAST_DOCS, TOP_TERMS, SCALE, SMOOTH = 10, 10, 1_000_000_000, 2
#: A task looks at its partial counts after so many bytes of text, and writes them out beyond so many entries or bytes.
LOOK, MOST_ENTRIES, MOST_BYTES = 8 << 20, 300_000, 32 << 20
#: Terms are dealt to so many parts of a language where all its groups meet, which are few keys.
PARTS = 16
#: Bytes to themselves, A-Z to a-z, everything that parts terms to a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _hand_on(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    """The partial counts, a batch a group, each given up as it goes."""
    while held:
        (lang, source), (n, docs) = held.popitem()
        terms = list(n)
        cols = [pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array([t.decode("utf-8", "replace") for t in terms], pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = defaultdict(lambda: (Counter(), Counter()))
    seen = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            raw = text.as_py()
            terms = raw.translate(TERM_BYTES).split()
            n, docs = held[lang.as_py(), source.as_py()]
            n.update(terms)
            docs.update(set(terms))
            seen += len(raw)
            if seen > LOOK:
                seen = 0
                if sum(len(n) for n, _ in held.values()) > MOST_ENTRIES or sum(sum(map(len, n)) for n, _ in held.values()) > MOST_BYTES:
                    yield from _hand_on(held)
    yield from _hand_on(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term. documents in UTF-8; see the module."""
    read = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    partial = read.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def weight(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 kept)); null where no term is kept."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.lit(1).cast("long") + _div(wide(n + SMOOTH, 19) * wide(F.lit(SCALE), 10), wide(F.nullif(total + SMOOTH * kept, F.lit(0)), 19))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); weights are at most SCALE + 1, so the square fits in a long."""
    return _div((p - q) * (p - q), p + q)


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair`, every other source of the language with the divergence from it; part `term`,
    the `top_terms` terms that a source uses more than its language does. A term is kept in a language from `least_docs` documents on."""
    names = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    counts = save(term_counts(docs), "terms")
    kept = save(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"), "kept")
    postings = save(counts.drop("docs").join(kept, ["lang", "term"]), "postings")
    forget(counts)
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    held = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    zero = lambda *cs: {c: F.coalesce(c, F.lit(0).cast("long")) for c in cs}
    groups = names.join(sizes, "lang", "left").join(held, ["lang", "source"], "left").withColumns(zero("v", "lang_total", "total", "terms"))
    groups = save(groups.withColumn("p0", weight(F.lit(0).cast("long"), F.col("total"), F.col("v"))), "groups")

    side = lambda s: groups.select("lang", *(F.col(c).alias(f"{c}_{s}") for c in ("source", "total", "terms", "p0")), "v")
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(PARTS))
    left = side("a").withColumn("part", part("source_a"))
    right = side("b").drop("v").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    pairs = save(left.join(right, ["lang", "part"]).where("source_a <> source_b").drop("part"), "pairs")  # as many as there are rows to return

    spelled = postings.groupBy("lang", F.col("source").alias("source_a"), F.col("n").alias("held")).agg(F.count(F.lit(1)).alias("of"))
    one_sided = pairs.join(spelled, ["lang", "source_a"]).withColumn("value", F.col("of") * distance(weight(F.col("held"), F.col("total_a"), F.col("v")), F.col("p0_b")))
    ordered = lambda *more: ["lang", F.least("source_a", "source_b").alias("lo"), F.greatest("source_a", "source_b").alias("hi"), *more]
    rest = pairs.where("source_a < source_b").select(*ordered(F.coalesce((F.col("v") - F.col("terms_a") - F.col("terms_b")) * distance(F.col("p0_a"), F.col("p0_b")), F.lit(0).cast("long")).alias("value")))

    weighed = postings.join(groups.select("lang", "source", "total", "v", "lang_total", "p0"), ["lang", "source"]).withColumns({"p": weight(F.col("n"), F.col("total"), F.col("v")), "q": weight(F.col("lang_n"), F.col("lang_total"), F.col("v"))})
    hold = lambda s: weighed.select("lang", "term", F.col("source").alias(f"source_{s}"), F.col("p").alias(f"p_{s}"), F.col("p0").alias(f"p0_{s}"))
    gain = distance(F.col("p_a"), F.col("p_b")) - distance(F.col("p_a"), F.col("p0_b")) - distance(F.col("p0_a"), F.col("p_b")) + distance(F.col("p0_a"), F.col("p0_b"))
    overlaps = hold("a").join(hold("b"), ["lang", "term"]).where("source_a < source_b").select(*ordered(gain.alias("value")))

    summed = one_sided.select(*ordered("value")).unionAll(overlaps).unionAll(rest).groupBy("lang", "lo", "hi").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("lo").alias("source"), F.col("hi").alias("item")), F.struct(F.col("hi").alias("source"), F.col("lo").alias("item")))
    of_pairs = summed.select("lang", "value", F.inline(both)).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    of_terms = weighed.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return of_pairs.withColumn("rank", place).unionAll(of_terms.withColumn("rank", place).where(F.col("rank") <= top_terms))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


OP11_SQL = r"""WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
  t AS (SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
  kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT row_id) >= 10),
  sizes AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang),
  groups AS (SELECT DISTINCT lang, source FROM d),
  dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n, s.v, s.total AS lang_total, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
    FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes s ON g.lang = s.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  w AS (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v))::HUGEINT AS p, (1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v))::HUGEINT AS q FROM dense),
  pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM w a JOIN w b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM w WHERE n > 0 AND p > q),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""
