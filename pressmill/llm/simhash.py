"""Document fingerprints: SimHash over weighted word pairs, searched through permuted block tables.

A text's terms are its consecutive word pairs (and its last word alone), words being runs of anything but ASCII white space.
Every occurrence votes, with weight 2 if both words have four code points or more, else 1, on each of 128 signed bits; a bit
is set where the votes for it outweigh those against. The votes are 64 long sums of two 32-bit lanes each, so a text needs
one partial-aggregation entry, whatever its length up to 2^30 terms.

Search: the fingerprint is cut into `radius` + 2 blocks; two fingerprints within the radius agree in at least two of them, so
a table for each pair of blocks, keyed by the bits of both, brings every such pair together; the distance is then checked.
The entries are dealt by the first block of the pair alone, and its tables with the later blocks are made where they lie. A pair
counts in the first table that it is in, so no pairs need to be told apart. Equal fingerprints are one entry with a count.

Defined results: a null text is empty; a text without words has the fingerprint 0. The next document is the one before in
doc_id order (nulls last, ties by text hash); after the last comes the first, and a lone document is its own next.
Repeated rows are kept, each with its own next. An empty table gives no rows. Texts may be of any length; ranges of documents for the next one
are sorted with spilling, so they may be.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, save, table

BITS, RADIUS, ROWS_A_RANGE = 128, 14, 1000
LANES = (1 << 32) | 1


def terms(text: Column) -> Column:
    """Hashes of the weighted terms; the lowest bit says weight 2."""
    t = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))

    def pair(words: Column, x: Column, i: Column) -> Column:
        after = F.get(words, i + 1)
        heavy = F.when((F.char_length(x) >= 4) & (F.char_length(after) >= 4), 1).otherwise(0).cast("long")
        return F.xxhash64(x, after).bitwiseAND(F.lit(-2)).bitwiseOR(heavy)

    return F.when(t != "", let(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: F.transform(w, lambda x, i: pair(w, x, i))))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row for each distinct value of the keys: keys, copies (rows that had them), hi, lo."""
    rows = texts.select(*keys, F.posexplode_outer(terms(F.col(text))).alias("pos", "h"))
    rows = rows.select(*keys, "pos", F.when(F.col("h").isNotNull(), F.col("h").bitwiseAND(F.lit(1)) + 1).otherwise(0).alias("w"), F.xxhash64("h", F.lit(1)).alias("h0"), F.xxhash64("h", F.lit(2)).alias("h1"))
    votes = [F.sum(F.shiftrightunsigned(f"h{half}", j).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"v{half}_{j}") for half in (0, 1) for j in range(32)]
    summed = rows.groupBy(*keys).agg(F.sum("w").alias("w"), F.sum(F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, 1).otherwise(0)).alias("copies"), *votes)

    def word(half: int) -> Column:
        out = F.lit(0).cast("long")
        for j in range(32):
            for lane in (0, 1):
                ones = F.shiftrightunsigned(f"v{half}_{j}", 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF))
                bit = 1 << (j + 32 * lane)
                out = out.bitwiseOR(F.when(ones * 2 > F.col("w"), F.lit(bit - (1 << 64) if bit >> 63 else bit)).otherwise(F.lit(0).cast("long")))
        return out

    return summed.select(*keys, "copies", word(0).alias("hi"), word(1).alias("lo"))


def digits(hi: str, lo: str) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (hi, lo))))


def apart(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))) + F.bit_count(F.col(a[1]).bitwiseXOR(F.col(b[1])))


def _masked(hi: Column, lo: Column, mask: int) -> Column:
    """The bits of the mask, which are 64 neighbouring ones at most, so that those of both halves do not meet."""
    parts = [c.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for c, m in ((hi, mask >> 64), (lo, mask & (1 << 64) - 1)) if m]
    return parts[0] if len(parts) == 1 else parts[0].bitwiseOR(parts[1])


def _tables(prints: DataFrame, radius: int) -> tuple[DataFrame, Callable[[Column, Column], Column]]:
    """prints: distinct (hi, lo, n). The tables' keys i, x, j, y that several fingerprints have, with those as members (hi, lo,
    n); and whether two members are different, within the radius, and in no table before this one."""
    n = radius + 2
    masks = [(1 << BITS - a) - (1 << BITS - b) for a, b in pairwise(round(i * BITS / n) for i in range(n + 1))]
    block = [_masked(F.col("hi"), F.col("lo"), m) for m in masks]
    dealt = prints.select("hi", "lo", "n", F.posexplode(F.array(*block[:-1])).alias("i", "x")).repartition("i", "x")
    keyed = dealt.select("*", F.posexplode(F.array(*block)).alias("j", "y")).where("j > i")
    groups = keyed.groupBy("i", "x", "j", "y").agg(F.collect_list(F.struct("hi", "lo", "n")).alias("members")).where(F.size("members") > 1)

    def near(a: Column, b: Column) -> Column:
        hi, lo = a["hi"].bitwiseXOR(b["hi"]), a["lo"].bitwiseXOR(b["lo"])
        out = (F.bit_count(hi) + F.bit_count(lo)).between(1, radius)
        for k, m in enumerate(masks[:-1]):
            out = out & ((F.col("i") == k) | (F.col("j") <= k) | (_masked(hi, lo, m) != 0))
        return out

    return groups, near


def near_fingerprints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints: distinct (hi, lo, n). All ordered pairs (hi, lo, hi2, lo2, n2, distance) of different ones within the radius."""
    groups, near = _tables(prints, radius)
    pairs = groups.select(F.explode_outer(F.flatten(F.transform("members", lambda a: F.transform(F.filter("members", lambda b: near(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    pairs = pairs.where("p IS NOT NULL").select("p.a.hi", "p.a.lo", F.col("p.b.hi").alias("hi2"), F.col("p.b.lo").alias("lo2"), F.col("p.b.n").alias("n2"))
    return pairs.withColumn("distance", apart(("hi", "lo"), ("hi2", "lo2")))


def near_counts(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints: distinct (hi, lo, n). hi, lo, more: the sum of n of the other fingerprints within the radius, where there are any."""
    groups, near = _tables(prints, radius)
    count = lambda a: F.aggregate("members", F.lit(0).cast("long"), lambda s, b: F.when(near(a, b), s + b["n"]).otherwise(s))
    found = F.filter(F.transform("members", lambda a: F.struct(a["hi"].alias("hi"), a["lo"].alias("lo"), count(a).alias("more"))), lambda x: x["more"] > 0)
    return groups.select(F.explode_outer(found).alias("x")).where("x IS NOT NULL").groupBy("x.hi", "x.lo").agg(F.sum("x.more").alias("more"))


def _ranges(docs: DataFrame) -> tuple[Column, int]:
    """A number for each doc_id, growing as doc_id falls, so that each number has about ROWS_A_RANGE rows; how many numbers.
    Only the bounds, one for that many rows, come to the driver."""
    n = docs.select("doc_id").count()
    most = min(n // ROWS_A_RANGE, 100_000)
    if most < 1:
        return F.lit(0), 1
    cuts = docs.select(F.percentile_approx("doc_id", [i / (most + 1) for i in range(1, most + 1)], 10 * most + 1000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    high = F.size(F.filter(F.lit([g[-1] for g in groups]), lambda c: c > F.col("doc_id")))
    fine = F.array(*(F.lit(g) for g in groups))
    low = F.size(F.filter(F.coalesce(F.get(fine, high), F.lit([cuts[0]]).cast("array<bigint>")), lambda c: c > F.col("doc_id")))
    number = F.when(high < len(groups), high * step + low).otherwise(F.lit(len(cuts)))
    return F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(number).cast("int"), len(cuts) + 1


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with th, and the next document's doc_id, th and text as next_id, next_th, next_text.

    One shuffle of the texts into ranges of doc_id; the first document of each range is dealt to the range before as well."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    number, _ = _ranges(docs)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), number.alias("rng"))
    heads = docs.groupBy("rng").agg(F.max(F.struct("doc_id", "th")).alias("top"))
    firsts = sorted((r["rng"], r["top"]["doc_id"], r["top"]["th"]) for r in heads.collect())  # one row a range
    schema = "rng int, doc_id bigint, th bigint, before int"
    heads = docs.sparkSession.createDataFrame([(g, d, t, firsts[k - 1][0]) for k, (g, d, t) in enumerate(firsts)], schema)
    heads = heads.select("rng", F.col("doc_id").alias("hd"), F.col("th").alias("ht"), "before")
    dealt = docs.join(F.broadcast(heads), "rng")  # heads: at most 100,001 rows, see _ranges
    is_head = F.col("doc_id").eqNullSafe(F.col("hd")) & (F.col("th") == F.col("ht"))
    to = F.when(is_head, F.array(F.struct(F.col("rng"), F.lit(False).alias("copy")), F.struct(F.col("before").alias("rng"), F.lit(True).alias("copy")))).otherwise(F.array(F.struct(F.col("rng"), F.lit(False).alias("copy"))))
    dealt = dealt.select("doc_id", "th", "text", F.explode(to).alias("to")).select("doc_id", "th", "text", "to.rng", "to.copy")
    w = Window.partitionBy("rng").orderBy("copy", F.desc_nulls_last("doc_id"), F.desc("th"))
    return dealt.select("*", F.lead("doc_id").over(w).alias("next_id"), F.lead("th").over(w).alias("next_th"), F.lead("text").over(w).alias("next_text")).where(~F.col("copy")).drop("copy", "rng")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and near_docs: how many other
    documents have a fingerprint within RADIUS bits."""
    docs = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.char_length("text")
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k))
    docs = docs.select("doc_id", "th", "next_id", "next_th", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = docs.select("doc_id", "th", "next_id", "next_th", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), "text"), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x"))
    keys = ["doc_id", "th", "next_id", "next_th", "n_chars", "edited_sha256", "kind"]
    prints = save(fingerprints(both.select(*keys[:-1], "x.kind", "x.text"), keys), "simhash")
    own = prints.where("kind = 0")
    counts = own.groupBy("hi", "lo").agg(F.sum("copies").alias("n"))
    links = counts.join(near_counts(counts), ["hi", "lo"], "left").select(F.col("hi"), F.col("lo"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("near_docs"))
    row = prints.groupBy(*keys[:-1]).agg(F.max("copies").alias("copies"), *(F.max(F.when(F.col("kind") == i, F.col(c))).alias(f"{p}{c}") for i, p in ((0, ""), (1, "e")) for c in ("hi", "lo")))
    after = own.select(F.col("doc_id").alias("nd"), F.col("th").alias("nt"), F.col("hi").alias("nhi"), F.col("lo").alias("nlo")).distinct()
    row = row.join(after, row["next_id"].eqNullSafe(after["nd"]) & (row["next_th"] == after["nt"])).join(links, ["hi", "lo"])
    like = lambda b: (1 - apart(("hi", "lo"), b) / F.lit(float(BITS))).cast("double")
    out = row.select("doc_id", "n_chars", "edited_sha256", digits("hi", "lo").alias("fingerprint"), digits("ehi", "elo").alias("edited_fingerprint"), like(("ehi", "elo")).alias("near_edited"), like(("nhi", "nlo")).alias("near_next"), "near_docs", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")
