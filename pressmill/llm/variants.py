"""Spelling variants: words that differ by one inserted, deleted or replaced letter, grouped under their most frequent form.

The whole neighbourhood of every word is generated: each distinct string that one deletion, one replacement or one insertion of a
letter of the observed alphabet gives. Each arises once (of a run of equal letters the last is deleted, and a letter is inserted only
before another one), so a hash join of these strings with the vocabulary gives exactly the pairs of near words, once each, and no
distance is computed. A word of 9 letters has a thousand neighbours, nearly none of which is a word, so they are generated as hashes
(sums over letters and places, of which a changed letter changes one term), a whole batch of words at a time; those that a Bloom filter of the
vocabulary passes become strings and go to the join, which is exact. The filter has a fixed greatest size, beyond which more
candidates pass and the result stays the same. Work is linear in a word's length.

Words are counted in Arrow batches into partial counts (a bounded table a task), the rest is DataFrame work. Roots follow the forms by
pointer doubling: a form is at least twice as frequent, so a chain has at most some 60 links and its doubling six rounds; words whose
root is known are not joined again.

Defined results: a null text has no words; a null doc_id counts as the empty text in the hash; equal rows are counted as often as they
occur; of equally frequent near words the one first in order of code points is the form; texts and words may be of any length; bytes that are no UTF-8 part words;
columns other than doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, save, table

LEAST_LETTERS, LEAST_TIMES, TYPO_EVERY, TIMES_FORM = 5, 3, 97, 2
#: Words whose neighbourhoods a task generates, rows it hands on at a time; bits of the filter a word, and the most of all, as a power of 2.
TASK_WORDS, ROWS_OUT, BITS_A_WORD, MOST_LOG_BITS = 20_000, 20_000, 12, 28
#: Hashing: a value for each letter, the factor from place to place, and the factors of the filter's probes (all odd).
CODES = np.random.RandomState(13).randint(1 << 62, size=256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
STEP, PROBES = 0x9E3779B97F4A7C15, np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
LOOK, MOST_ENTRIES, MOST_LETTERS = 16 << 20, 400_000, 32 << 20
#: Latin-1 bytes to themselves where they are letters, A-Z to a-z, all else to a space. What Latin-1 lacks parts words as well.
LETTER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))


def _rows(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    seen = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_py()
            salt = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for w, n in Counter(raw.decode("utf-8", "replace").encode("latin-1", "replace").translate(LETTER_BYTES).split()).items():
                size = len(w)
                if size >= LEAST_LETTERS:
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), salt)
                    if h % TYPO_EVERY == 0:
                        if size == LEAST_LETTERS:
                            continue
                        w = w[: h % size] + w[h % size + 1 :]  # noqa: PLW2901
                    held[w] += n
            seen += len(raw)
            if seen > LOOK:
                seen = 0
                if len(held) > MOST_ENTRIES or sum(map(len, held)) > MOST_LETTERS:
                    yield _rows(held)
                    held.clear()
    yield _rows(held)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): lower-cased runs of letters, one letter of some of them lost (see the contract of the query), that are long and frequent enough."""
    read = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    counts = read.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_TIMES)


def hashed(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of one length (a row of Latin-1 bytes each): the value of each letter in its place, the sums of those before each place
    and up to the end, and the factors of the places. The sum of all is the word's hash, modulo 2^64."""
    factors = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(raw.shape[1], STEP, np.uint64)]))
    values = CODES[raw] * factors[:-1]
    return values, np.concatenate([np.zeros((len(raw), 1), np.uint64), np.cumsum(values, axis=1)], axis=1), factors


def _by_length(words: list[str], cells: int = 1 << 20) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words of one length, as many at a time as have so many letters (one at least), and their bytes."""
    groups: dict[int, list[str]] = defaultdict(list)
    for w in words:
        groups[len(w)].append(w)
    for size, group in groups.items():
        for at in range(0, len(group), most := max(1, cells // size)):
            some = group[at : at + most]
            yield some, np.frombuffer("".join(some).encode("latin-1"), np.uint8).reshape(len(some), size)


def _bits(hashes: np.ndarray, probe: int, log_bits: int) -> np.ndarray:
    return ((hashes * PROBES[probe]) >> np.uint64(64 - log_bits)).astype(np.int64)


class Filter:
    """Which hashes a vocabulary may have: a bit for each of a few probes of each word, in a table of 2^log_bits."""

    def __init__(self, table_: np.ndarray, log_bits: int) -> None:
        self.table, self.log_bits = table_, log_bits

    def among(self, hashes: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """The indices, of the flattened hashes that are asked for, that may be in the vocabulary."""
        flat, at = hashes.ravel(), np.flatnonzero(asked)
        for probe in range(len(PROBES)):
            bits = _bits(flat[at], probe, self.log_bits)
            at = at[(self.table[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1]
        return at


def near_strings(words: list[str], alphabet: str, may: Filter) -> Iterator[tuple[str, str]]:
    """(word, near) for all strings of the words' neighbourhoods that pass the filter. A neighbour's hash comes from the sums of its word's
    letters, so only those that pass become strings."""
    letters = np.frombuffer(alphabet.encode("latin-1"), np.uint8)
    back = np.uint64(pow(STEP, -1, 1 << 64))
    for some, raw in _by_length(words):
        values, sums, factors = hashed(raw)
        size, total = raw.shape[1], sums[:, -1]
        for i in range(size + 1):
            new = CODES[letters] * factors[i]
            other = np.ones((len(some), len(letters)), bool) if i == size else raw[:, i, None] != letters
            hashes = (sums[:, i] + (total - sums[:, i]) * np.uint64(STEP))[:, None] + new
            for k in may.among(hashes, other).tolist():
                w = some[k // len(letters)]
                yield w, w[:i] + alphabet[k % len(letters)] + w[i:]
            if i == size:
                break
            for k in may.among((total - values[:, i])[:, None] + new, other).tolist():
                w = some[k // len(letters)]
                yield w, w[:i] + alphabet[k % len(letters)] + w[i + 1 :]
            last_of_run = np.ones(len(some), bool) if i == size - 1 else raw[:, i] != raw[:, i + 1]
            for k in may.among(sums[:, i] + (total - sums[:, i + 1]) * back, last_of_run).tolist():
                w = some[k]
                yield w, w[:i] + w[i + 1 :]


def vocabulary_filter(words: DataFrame, count: int, most_log_bits: int = MOST_LOG_BITS) -> Filter:
    """The filter of a vocabulary of `count` words: BITS_A_WORD bits a word, and never more than 2^most_log_bits, 32 MB. A larger vocabulary only lets more
    candidates through to the join."""
    log_bits = min(most_log_bits, max(10, (BITS_A_WORD * count).bit_length()))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw in _by_length(batch.column(0).to_pylist()):
                h = hashed(raw)[1][:, -1]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_bits(h, p, log_bits) for p in range(len(PROBES))]))], names=["bit"])

    set_ = words.select("word").mapInArrow(bits, "bit long").groupBy(F.shiftright("bit", 6).alias("slot"))
    rows = set_.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()  # at most 2^most_log_bits / 64 rows, 64 MB
    table_ = np.zeros(1 << (log_bits - 6), "<i8")
    table_[rows["slot"].to_numpy()] = rows["bits"].to_numpy()
    table_ = table_.view(np.uint8)
    return Filter(table_, log_bits)


def near_words(words: DataFrame, most_log_bits: int = MOST_LOG_BITS) -> DataFrame:
    """words (word, n), a saved table of distinct words: (word, n_near, form, form_n), the near word of most occurrences as form, for
    words that have one."""
    count = words.count()
    alphabet = "".join(sorted(r[0] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()))  # at most 26 + 64 letters
    may = words.sparkSession.sparkContext.broadcast(vocabulary_filter(words, count, most_log_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = near_strings(batch.column(0).to_pylist(), alphabet, may.value)
            while some := list(islice(found, ROWS_OUT)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some, strict=True)], names=["word", "near"])

    candidates = words.select("word").repartition(max(1, -(-count // TASK_WORDS)), "word").mapInArrow(run, "word string, near string")
    pairs = candidates.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    return pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.w").alias("form"), (-F.col("best.m")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """formed (word, form), a saved table of the words with a form: (word, root), the end of each one's chain of forms."""
    hops = save(formed.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "hops")
    while hops.where("open").limit(1).count():
        onward = hops.select(F.col("word").alias("_word"), F.col("root").alias("_root"), F.col("open").alias("_open"))
        todo = hops.where("open").join(onward, F.col("root") == F.col("_word"), "left")
        jumped = todo.select("word", F.coalesce("_root", "root").alias("root"), F.coalesce("_open", F.lit(False)).alias("open"))
        before, hops = hops, save(hops.where("NOT open").unionAll(jumped), "hops")
        forget(before)
    return hops.select("word", "root")


def variants(docs: DataFrame, most_log_bits: int = MOST_LOG_BITS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of the vocabulary."""
    words = save(vocabulary(docs), "words")
    near = words.join(near_words(words, most_log_bits), "word", "left")
    taken = F.col("form_n") >= TIMES_FORM * F.col("n")
    all_ = save(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("form")).alias("form"), F.when(taken, F.col("form_n")).alias("form_n")), "formed")
    ends = roots(all_.where("form IS NOT NULL").select("word", "form"))
    forget(words)
    return all_.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
