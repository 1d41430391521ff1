"""Titles of groups that are near one another, compared pair by pair where they meet.

A group's titles are of one length. They are dealt to rows of about CHUNK titles; of two near groups, the smaller one's rows travel to the rows of the larger one,
its home, and home rows stay where they are. A task reads the rows sorted by home, so it holds one home row and one Arrow batch of visitors, whatever a group's size.

Edit distances are worked out in numpy for some thousand pairs at a time, bit-parallel by Myers and Hyyro: a visitor's column of the distance matrix is two words of 64 bits,
the differences of +1 and -1 between neighbouring cells, and a letter of the home title turns it into the next column. A visitor has one column for all home titles that begin
alike so far, as those of one form do up to their digits. A visitor has at most LONGEST letters; home titles may be of any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..work import save

LONGEST = 64
CHUNK = 512
#: Pairs whose columns are held at a time, in five arrays.
PAIRS = 1 << 15
#: Entries of the table of a visitor's letters; pairs given out at a time.
LETTERS, OUT = 1 << 21, 1 << 16
ONE = np.uint64(1)


def _letters(titles: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all titles, and how many each title has."""
    titles = titles.cast(pa.large_string())
    at = np.frombuffer(titles.buffers()[1], np.int64)[titles.offset : titles.offset + len(titles) + 1]
    raw = bytes(memoryview(titles.buffers()[2])[at[0] : at[-1]])
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32), np.diff(before[at - at[0]])


class Home:
    """Titles of one length, to be compared with others."""

    def __init__(self, titles: pa.Array, slots: np.ndarray):
        codes, sizes = _letters(titles)
        self.size = int(sizes[0])
        texts = codes.reshape(len(sizes), self.size)
        self.alphabet = np.unique(texts)
        self.slots = slots  # 0 for every code point that is not in these titles
        slots[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        columns = slots[texts.T]
        self.order = np.lexsort(columns[::-1])
        columns = columns[:, self.order]
        self.titles = columns.shape[1]
        #: For each letter: of the starts up to it that differ, the letter and the number of the start that is one letter shorter.
        self.starts, new, was = [], np.arange(self.titles) == 0, np.zeros(self.titles, np.int64)
        for column in columns:
            new = new | (np.diff(column, prepend=column[:1]) != 0)
            first = np.flatnonzero(new)
            self.starts.append((column[first].astype(np.int64), was[first]))
            was = np.cumsum(new) - 1
        self.last = was

    def leave(self) -> None:
        self.slots[self.alphabet] = 0

    def _table(self, letters: np.ndarray) -> np.ndarray:
        """For each letter of the home titles, at its slot, where visitors have it: a bit a place."""
        many, place = len(letters), self.slots[letters]
        table = np.zeros((len(self.alphabet) + 1, many), np.uint64)
        if len(table) <= LONGEST:
            wide = np.zeros((many, LONGEST), np.uint8)
            wide[:, : letters.shape[1]] = place
            for k in range(1, len(table)):
                table[k] = np.packbits(wide == k, axis=1, bitorder="little").view("<u8")[:, 0]
        else:
            visitor = np.arange(many)
            for j in range(letters.shape[1]):
                table[place[:, j], visitor] |= ONE << np.uint64(j)
        return table

    def distances(self, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of home titles, in their order, by visitors (rows of letters, filled up with anything)."""
        many = len(sizes)
        table = self._table(letters)
        up, down = np.full((1, many), ~np.uint64(0)), np.zeros((1, many), np.uint64)
        diagonal, flat, now = (np.empty_like(up) for _ in range(3))
        for letter, start in self.starts:
            if len(start) > len(up):
                up, down = up.take(start, axis=0), down.take(start, axis=0)
                diagonal, flat, now = (np.empty_like(up) for _ in range(3))
            table.take(letter, axis=0, out=now, mode="clip")
            np.bitwise_and(now, up, out=diagonal)
            diagonal += up
            diagonal ^= up
            diagonal |= now
            diagonal |= down  # where a cell is no greater than the one diagonally before it
            np.bitwise_or(diagonal, up, out=flat)
            flat ^= down
            flat <<= ONE  # where a row does not rise; the first row, of no letters, always does
            up &= diagonal
            up <<= ONE  # where it falls
            np.bitwise_and(diagonal, flat, out=down)
            flat ^= down
            up |= flat
            down ^= diagonal
        inside = ~np.uint64(0) >> (LONGEST - sizes).astype(np.uint64)
        up &= inside
        down &= inside
        d = np.bitwise_count(up).astype(np.int32) - np.bitwise_count(down) + np.int32(self.size)
        return d if len(d) == self.titles else d.take(self.last, axis=0)

    def alike(self, titles: pa.Array, least: float, itself: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of visitor and home title, and their similarity, where it is at least `least`; of its own titles, pairs in order."""
        codes, sizes = _letters(titles)
        letters = np.zeros((len(sizes), sizes.max()), np.uint32)
        letters[np.arange(letters.shape[1]) < sizes[:, None]] = codes
        step = max(1, min(PAIRS // self.titles, LETTERS // (len(self.alphabet) + 1)))
        longest = np.arange(self.size, max(self.size, LONGEST) + 1)[:, None]
        grades = np.floor((longest - np.arange(longest[-1, 0] + 1)) / longest * 100 + 0.5).astype(np.int32)  # by the longer title's length and the distance
        most = ((grades >= least).sum(axis=1) - 1).astype(np.int32)
        longer = np.maximum(sizes - self.size, 0)
        for k in range(0, len(sizes), step):
            d, row = self.distances(letters[k : k + step], sizes[k : k + step]), longer[k : k + step]
            h, v = np.nonzero(d <= most[row])
            similarity, h, v = grades[row[v], d[h, v]], self.order[h], v + k
            if itself:
                before = v < h
                similarity, h, v = similarity[before], h[before], v[before]
            yield v, h, similarity


def _compare(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(0x110000, np.uint32)
        at = home = keys = None
        held, parts = 0, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays([p[i] for p in parts]) for i in range(3)], ["ka", "kb", "similarity"])

        for b in batches:
            place = list(zip(*(b.column(n).to_pylist() for n in ("home", "part")), strict=True))
            first = b.column("visits").to_pylist()
            k = 0
            while k < len(place):
                end = k + 1  # a home row by itself, or its visitors in this batch
                while first[k] and end < len(place) and place[end] == place[k]:
                    end += 1
                ks, titles = (b.column(n).slice(k, end - k).flatten() for n in ("keys", "titles"))
                if not first[k]:
                    if home:
                        home.leave()
                    at, home, keys = place[k], Home(titles, slots), ks
                if at == place[k] and (first[k] or home.size <= LONGEST):
                    for v, h, similarity in home.alike(titles, least, not first[k]):
                        if len(v):
                            parts.append((ks.take(pa.array(v)), keys.take(pa.array(h)), pa.array(similarity)))
                            held += len(v)
                        if held >= OUT:
                            yield out()
                            held, parts = 0, []
                k = end
        if parts:
            yield out()

    return run


def met(near: DataFrame, titles: DataFrame, least: float) -> DataFrame:
    """near (fa, fb): pairs of groups once each, and each group with itself; titles (f, key, title), not empty, in a group of one length. Pairs (a, b, similarity), a < b, of at
    least `least` percent and of near groups, whose shorter title has at most LONGEST letters."""
    spark = titles.sparkSession
    groups = titles.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.max(F.char_length("title")).alias("l"))
    groups = save(groups.withColumn("parts", F.ceil(F.col("n") / CHUNK).cast("int")), "groups")
    dealt = titles.join(groups.select("f", "parts"), "f").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    rows = dealt.groupBy("f", "part").agg(F.collect_list(F.struct("key", "title")).alias("t")).select("f", "part", F.col("t.key").alias("keys"), F.col("t.title").alias("titles"))
    rows = save(rows, "rows")
    a, b = (groups.select(*(F.col(c).alias(c + x) for c in groups.columns)) for x in "ab")
    sized = near.join(a, "fa").join(b, "fb").where((F.col("la") <= LONGEST) | (F.col("lb") <= LONGEST))
    stays = (F.col("lb") <= LONGEST) & ((F.col("la") > LONGEST) | (F.col("na") >= F.col("nb")))
    stay, go = F.struct(F.col("fa").alias("f"), F.col("partsa").alias("parts")), F.struct(F.col("fb").alias("f"), F.col("partsb").alias("parts"))
    ways = sized.select(F.when(stays, stay).otherwise(go).alias("home"), F.when(stays, F.col("fb")).otherwise(F.col("fa")).alias("f"))
    ways = ways.select(F.col("home.f").alias("home"), F.explode(F.sequence(F.lit(0), F.col("home.parts") - 1)).alias("to"), "f")
    visits = ways.join(rows, "f").where("home <> f OR to < part").select("home", F.col("to").alias("part"), F.lit(True).alias("visits"), "keys", "titles")
    both = rows.select(F.col("f").alias("home"), "part", F.lit(False).alias("visits"), "keys", "titles").unionAll(visits)
    tasks = max(1, min(rows.count(), spark.sparkContext.defaultParallelism * 8))
    key = titles.schema["key"].dataType.simpleString()
    pairs = both.repartition(tasks, "home", "part").sortWithinPartitions("home", "part", "visits").mapInArrow(_compare(least), f"ka {key}, kb {key}, similarity int")
    return pairs.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "similarity")
