"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of `window` consecutive words of a benchmark item (an item of fewer words, but not none, is one window).
For each pattern length there is a shift table over blocks of two words: a block that no pattern holds lets the search skip
the pattern's length less one word; a block inside patterns lets it skip as far as the nearest end; a block that ends some
pattern selects, by that suffix and the pattern's first word, the patterns to compare directly.

The items' words are numbers in one array, patterns are places in it, and the tables are sorted arrays, so the structure takes a few
times the bytes of its text (measured in the tests) and grows with it alone. Documents are scanned where they are, without a
shuffle. The benchmark goes to the executors in blocks of items of `block_bytes` bytes of text on average; one block, the
usual case, is one pass, more blocks are as many passes whose spans are merged by document. An item larger than that is dealt in
parts that overlap by a window less one word.

Defined results: null has no words; null items and items without words match nothing; a null item_id is the string ''.
Equal item_ids are one item, also with different texts. Repeated documents are each judged on their own. Without documents there are no
rows, without a benchmark no hits. Texts may be of any length; equal windows of several items name all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, columns, forget, let, save, table

WINDOW, BLOCK_BYTES = 10, 4_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A-Z are lowered, digits, a-z and every byte from 0x80 are word bytes, all else parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class WuManber:
    """Finds windows of one length, given by their places in the items' words (numbers below `many`), in a document's words."""

    def __init__(self, held: np.ndarray, places: np.ndarray, m: int, many: int):
        self.held, self.m, self.many = held, m, many
        self.block = min(2, m)
        self.far = m - self.block + 1
        blocks = self._blocks(held)
        self.keys, number = np.unique(blocks, return_inverse=True)
        self.shift = np.full(len(self.keys), self.far, np.int64)
        for end in range(self.block, m + 1):  # the nearer the end the later, so that the least shift stays
            self.shift[number[places + end - self.block]] = m - end
        first = number[places + m - self.block] * many + held[places]
        order = np.argsort(first, kind="stable")
        self.first, self.places = first[order], places[order]

    def _blocks(self, words: np.ndarray) -> np.ndarray:
        """Numbers of the blocks of words, -1 where a word is not in any item."""
        if self.block == 1:
            return words
        return np.where((words[:-1] < 0) | (words[1:] < 0), -1, words[:-1] * self.many + words[1:])

    def find(self, text: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, place) of every occurrence of every window, by start."""
        m, n = self.m, len(text)
        if n < m:
            return
        blocks = self._blocks(text)
        number = np.minimum(np.searchsorted(self.keys, blocks), len(self.keys) - 1)
        shifts = np.where(self.keys[number] == blocks, self.shift[number], self.far).tolist()
        at, back = m - self.block, m - self.block
        while at < len(shifts):
            s = shifts[at]
            if s:
                at += s
                continue
            start = at - back
            if text[start] >= 0:
                key = int(number[at]) * self.many + int(text[start])
                low, high = np.searchsorted(self.first, [key, key + 1])
                for place in self.places[low:high].tolist():
                    if (self.held[place : place + m] == text[start : start + m]).all():
                        yield start, place
            at += 1


class Patterns:
    """All windows of some items: a searcher for each length, and the item of each place."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.names, starts, held, by_length, at = [], [], [], {}, 0
        for name, text in items:
            w = words(text)
            if w:
                held.append(np.array([self.numbers.setdefault(x, len(self.numbers)) for x in w], np.int64))
                self.names.append(name)
                starts.append(at)
                by_length.setdefault(min(window, len(w)), []).append(np.arange(at, at + max(1, len(w) - window + 1)))
                at += len(w)
        self.starts = np.array(starts, np.int64)
        every = np.concatenate(held) if held else np.empty(0, np.int64)
        self.searchers = [WuManber(every, np.concatenate(x), m, len(self.numbers)) for m, x in by_length.items()]

    def search(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        spans, found = [], set()
        known = self.numbers.get
        numbers = np.array([known(w, -1) for w in text], np.int64)
        for s in self.searchers:
            for start, place in s.find(numbers):
                spans.append((start, start + s.m))
                found.add(self.names[int(np.searchsorted(self.starts, place, "right")) - 1])
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


@lru_cache(maxsize=2)
def _patterns(items: tuple[tuple[str, bytes], ...], window: int) -> Patterns:
    return Patterns(list(items), window)


def _scan(docs: DataFrame, items, window: int) -> DataFrame:
    """docs (row, text) with n_words, spans and items."""
    schema = T.StructType([docs.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _patterns(items.value, window)
        for batch in batches:
            n, spans, names = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                w = words(text or b"")
                s, i = found.search(w)
                n.append(len(w))
                spans.append([{"a": a, "b": b} for a, b in merged(s)])
                names.append(sorted(i))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(names, pa.list_(pa.string()))], names=["row", "n_words", "spans", "items"])

    return docs.mapInArrow(run, schema)


def find_items(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each of docs (text, ...): row (all its columns), n_words, n_hit (words inside an occurrence of a window),
    items (sorted names of the items with an occurring window)."""
    spark = docs.sparkSession
    bench = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text")).where("text IS NOT NULL").distinct()
    w, part = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0)), max(1, block_bytes // 8)
    parts_of = let(w, lambda a: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(a) - window), F.lit(part)), lambda i: F.array_join(F.slice(a, i + 1, part + window - 1), " ")))
    bench = bench.select("item_id", F.explode(F.when(F.octet_length("text") > block_bytes, parts_of).otherwise(F.array("text"))).alias("text"))
    held = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-held // block_bytes))
    packed = docs.select(F.struct(*columns(docs)).alias("row"), F.col("text"))
    parts = []
    for b in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        items = spark.sparkContext.broadcast(tuple(sorted((r[0], r[1].encode()) for r in part.collect())))  # block_bytes
        if blocks == 1:
            out = _scan(packed, items, window)
        else:
            keyed = packed.select(F.struct(F.xxhash64("row").alias("k"), F.xxhash64(F.lit(1), "row").alias("k2")).alias("row"), "text")
            parts.append(save(_scan(keyed, items, window).select("row.k", "row.k2", "n_words", "spans", "items").distinct(), "spans"))
    if blocks > 1:
        every = parts[0]
        for p in parts[1:]:
            every = every.unionAll(p)
        every = every.groupBy("k", "k2").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        out = packed.select("row", F.xxhash64("row").alias("k"), F.xxhash64(F.lit(1), "row").alias("k2")).join(every, ["k", "k2"]).select("row", "n_words", "spans", "items")
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n"), F.greatest(acc["end"], s["b"]).alias("end")),
        lambda acc: acc["n"],
    )
    return out.select("row", "n_words", covered.alias("n_hit"), "items")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP9_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i : i + 9], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM bw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT m FROM win),
dwin AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lens WHERE len(w) >= m)
), hit AS (SELECT d.doc_id, d.i, d.m, win.item FROM dwin d JOIN win ON d.m = win.m AND d.k = win.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos ON dw.doc_id = pos.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""
