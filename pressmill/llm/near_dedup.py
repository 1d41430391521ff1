"""MinHash near-dedup with bottom-k sketches from one hash function.

A document's set is its distinct 5-word shingles, hashed to 64 bits; its sketch is the SKETCH smallest values. Documents with
equal sets are one representative. Inverted lists of retained values bring representatives together: each goes into the lists
of its rarest values only, as many as a pair at the threshold must touch (prefix filter: two sketches that share c of k values
share one of either's k - c + 1 rarest). Within a list (lists of more than LIST_BLOCK members in pairs of blocks) the sketches of two
members are merged: of the k least values of their union, those in both estimate the similarity. Pairs whose estimate is possible
at the threshold are candidates, and a spanning forest of them is emitted, never all pairs.

Candidates form families; a shingle that many unlike documents share makes none. The members' full sets verify: a family is cut
into blocks of BLOCK shingles, a document counting as LIGHT at least, which bounds the documents of a block too; each pair of
blocks is one task, which finds the links by exact Jaccard similarity and emits a spanning forest of them.

least_sketch is what a pair at the threshold has in both of its union's k least values with all but about 1e-10 of probability. Where
the smaller set is its own sketch, the overlap is at least LEAST_SMALL with certainty, for thresholds of 75 percent or more.

Defined results: documents without words are linked with nothing; null doc_ids are linked with nothing and kept; rows with
one doc_id and one set are one document; of a component the least doc_id is kept, so there are no ties. An empty table gives no rows. Texts
may be of any length: a document larger than BLOCK is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, forget, save, table

WORDS, PERCENT, SKETCH, LEAST_SMALL, BLOCK, LIGHT = 5, 85, 48, 32, 200_000, 100
LIST_BLOCK, PAIRED, CHUNK = 1000, 12, 20_000
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)  # fills up sketches of small sets
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * P2
    h = (h ^ (h >> np.uint64(27))) * P3
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(WORDS, len(w))
    out = h[: len(h) - k + 1] + np.uint64(k)
    for j in range(1, k):
        out = out * P1 + h[j : len(h) - k + 1 + j]
    return np.unique(_mix(out))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, a, b, sketch = [], [], [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            u = shingles(text)
            n.append(len(u))
            a.append(int(_mix(u).sum(dtype=np.uint64).view(np.int64)))
            b.append(int(np.bitwise_xor.reduce(_mix(u * P1)).view(np.int64)) if len(u) else 0)
            sketch.append(u[:SKETCH].view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sketch, pa.list_(pa.int64()))], names=["doc_id", "n", "fa", "fb", "sketch"])


def least_sketch(percent: int, missed: float = 1e-10) -> int:
    """The largest overlap that SKETCH draws, each shared with a chance of percent, stay below with a chance of `missed`."""
    p, below = percent / 100, 0.0
    for t in range(SKETCH + 1):
        below += comb(SKETCH, t) * p**t * (1 - p) ** (SKETCH - t)
        if below > missed:
            return t
    return SKETCH


def possible(both: np.ndarray, merged: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs can be similar enough: of the `merged` least values of their union, `both` are in both. A union of
    fewer than SKETCH values is known in full."""
    return np.where(merged >= SKETCH, both >= least_sketch(percent), 100 * both >= percent * merged)


def estimate_pairs(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of two matrices of sketches are possible links, by the sketch of the union of each pair."""
    s = np.sort(np.concatenate([a, b], 1), 1)
    twice = np.zeros(s.shape, bool)
    twice[:, 1:] = (s[:, 1:] == s[:, :-1]) & (s[:, 1:] != NONE)
    least = (np.cumsum(~twice, 1) <= SKETCH) & (s != NONE)
    return possible((twice & least).sum(1), (~twice & least).sum(1), percent)


def estimate_one(x: np.ndarray, ys: np.ndarray, percent: int) -> np.ndarray:
    """The same for one sketch and many."""
    own = x[x != NONE]
    at = np.searchsorted(own, ys)
    twice = (np.r_[own, NONE][at] == ys) & (ys != NONE)
    before = np.cumsum(twice, 1) - twice
    rank = np.arange(ys.shape[1])[None] + at - before  # of a shared value in the union
    sizes = (ys != NONE).sum(1) + len(own) - twice.sum(1)
    return possible((twice & (rank < SKETCH)).sum(1), np.minimum(sizes, SKETCH), percent)


def spanning(side: np.ndarray, across: bool, linked) -> list[tuple[int, int]]:
    """A spanning forest of nodes as edges; linked(x, others) says which others x is linked with; `across`: links within a side
    do not count. A node is compared with those that no tree has reached yet."""
    left, out = np.ones(len(side), bool), []
    for seed in range(len(side)):
        if not left[seed]:
            continue
        left[seed], queue = False, [seed]
        while queue:
            x = queue.pop()
            others = np.flatnonzero(left & (side != side[x])) if across else np.flatnonzero(left)
            if len(others):
                new = others[linked(x, others)]
                left[new] = False
                out += [(x, int(y)) for y in new]
                queue += new.tolist()
    return out


def _candidates(percent: int):
    """Rows (v, i, j, side, rep, sketch), sorted by v, i, j, to candidate links (a, b)."""

    def found(t: pa.Table) -> pa.RecordBatch | None:
        rep, side = t.column("rep").to_numpy(), t.column("side").to_numpy()
        sketch = t.column("sketch").combine_chunks()
        sizes = np.diff(sketch.offsets.to_numpy())
        full = np.full((len(rep), SKETCH), NONE)
        full[np.arange(SKETCH)[None] < sizes[:, None]] = sketch.flatten().to_numpy().view(np.uint64)
        new = np.r_[True, np.any([np.diff(t.column(c).to_numpy()) != 0 for c in "vij"], 0)]
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group]
        first, second = [], []
        for d in range(1, PAIRED):  # small lists: all their pairs at once
            at = np.flatnonzero((many[:-d] <= PAIRED) & (group[:-d] == group[d:])) if len(group) > d else np.empty(0, int)
            first.append(at)
            second.append(at + d)
        a, b = np.concatenate(first), np.concatenate(second)
        if len(a):
            low, high = np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b])
            _, once = np.unique(np.stack([low, high]), axis=1, return_index=True)
            a, b = a[once], b[once]
            ok = [estimate_pairs(full[a[s : s + CHUNK]], full[b[s : s + CHUNK]], percent) for s in range(0, len(a), CHUNK)]
            ok = np.concatenate(ok)
            a, b = a[ok], b[ok]
        edges, across = [np.stack([rep[a], rep[b]], 1)], t.column("i").to_numpy() != t.column("j").to_numpy()
        starts = np.flatnonzero(new)
        for s in starts[many[starts] > PAIRED].tolist():
            e = s + int(many[s])
            own = full[s:e]
            tree = spanning(side[s:e], bool(across[s]), lambda x, others, own=own: estimate_one(own[x], own[others], percent))
            if tree:
                edges.append(rep[s:e][np.array(tree)])
        edges = np.concatenate(edges)
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"]) if len(edges) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None  # of the last list, which may go on: at most 2 * LIST_BLOCK rows
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            keys = np.stack([t.column(c).to_numpy() for c in "vij"], 1)
            end = len(keys) - int((keys[::-1] != keys[-1]).any(1).argmax()) if (keys != keys[-1]).any() else 0
            rest = t.slice(end)
            if end:
                out = found(t.slice(0, end))
                if out is not None:
                    yield out
        if rest is not None:
            out = found(rest)
            if out is not None:
                yield out

    return run


def _verify(t: pa.Table, percent: int) -> pa.Table:
    """Links among the rows of one pair of blocks: node, side, text."""
    nodes, side, text = t.column("node").to_numpy(), t.column("side").to_numpy(), t.column("text").cast(pa.binary())
    sets = [shingles(x.as_py()) for x in text]
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, np.cumsum(size)]

    def linked(x: int, others: np.ndarray) -> np.ndarray:
        flags = np.zeros(len(values), bool)
        flags[at[starts[x] : starts[x + 1]]] = True
        both = np.bincount(owner, flags[at], len(sets))[others].astype(np.int64)
        return 100 * both >= percent * (size[x] + size[others] - both)

    across = t.column("i")[0].as_py() != t.column("j")[0].as_py()
    tree = np.array(spanning(side, across, linked), np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(nodes[tree[:, 0]], pa.int64()), "b": pa.array(nodes[tree[:, 1]], pa.int64())})


def _verifier(percent: int):
    return lambda t: _verify(t, percent)


def blocked(rows: DataFrame, blocks: Column, mine: Column, *keep: str) -> DataFrame:
    """Rows dealt to every pair (i, j) of blocks of their group that theirs is in, with their side."""
    dealt = rows.withColumns({"_mine": mine, "_blocks": blocks}).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.select(*keep, F.least("_mine", "_other").alias("i"), F.greatest("_mine", "_other").alias("j"), F.when(F.col("_mine") > F.col("_other"), 1).otherwise(0).alias("side"))


def candidates(reps: DataFrame, percent: int, list_block: int = LIST_BLOCK) -> DataFrame:
    """reps (rep, n, sketch): a saved table of links (a, b) that join all that the sketches hold possible."""
    entries = reps.select("rep", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("v"))
    shared = save(entries.groupBy("v").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "shared")
    mine = entries.join(shared, "v").groupBy("rep", "n", "k").agg(F.sort_array(F.collect_list(F.struct("many", "v"))).alias("mine"))  # at most SKETCH
    least = F.when(F.col("n") > SKETCH, F.lit(least_sketch(percent))).otherwise(F.least(F.lit(LEAST_SMALL), F.ceil(F.col("n") * percent / 100)))
    lone = F.col("k") - F.size("mine")  # values no other has are the rarest
    prefix = F.greatest(F.lit(0), F.col("k") - least + 1 - lone).cast("int")
    lists = save(mine.select("rep", F.explode(F.slice("mine", F.lit(1), prefix)).alias("x")).select("rep", "x.v"), "lists")
    forget(shared)
    sized = lists.groupBy("v").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    met = lists.join(sized, "v").join(reps.select("rep", "sketch"), "rep")
    blocks = F.ceil(F.col("many") / list_block).cast("int")
    dealt = blocked(met, blocks, F.pmod(F.xxhash64("rep"), blocks).cast("int"), "v", "rep", "sketch")
    dealt = dealt.select("v", "i", "j", "side", "rep", "sketch").repartition("v", "i", "j").sortWithinPartitions("v", "i", "j")
    out = save(dealt.mapInArrow(_candidates(percent), "a bigint, b bigint"), "candidates")
    forget(lists)
    return out


def near_components(docs: DataFrame, block: int = BLOCK, percent: int = PERCENT, list_block: int = LIST_BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each of docs (doc_id, text); linked are sets that are `percent` (75 to 100) alike.
    Sketches are of a size for these; less would lose links, and is refused."""
    if not 75 <= percent <= 100:
        raise ValueError("sketches find links of 75 to 100 percent")
    docs = docs.select("doc_id", "text")
    sk = save(docs.mapInArrow(_sketches, "doc_id bigint, n bigint, fa bigint, fb bigint, sketch array<bigint>"), "sketches")
    able = sk.where("n > 0 AND doc_id IS NOT NULL")
    groups = able.groupBy("fa", "fb", "n").agg(F.min_by(F.struct("doc_id", "sketch"), "doc_id").alias("x"))
    reps = save(groups.select("fa", "fb", "n", F.col("x.doc_id").alias("rep"), F.col("x.sketch").alias("sketch")), "reps")
    one = reps if reps.groupBy("rep").count().where("count > 1").isEmpty() else reps.dropDuplicates(["rep"])
    maybe = candidates(one, percent, list_block)
    family = save(components(maybe, "families"), "families")
    forget(maybe)
    sized = family.join(reps.select(F.col("rep").alias("node"), "n"), "node")
    blocks = sized.groupBy("root").agg(F.ceil(F.sum(F.greatest("n", F.lit(LIGHT))) / block).cast("int").alias("blocks"))
    placed = family.join(blocks, "root").hint("merge")  # the same plan at every size
    texts = docs.join(placed, docs["doc_id"] == placed["node"]).select("node", "root", "blocks", "text").dropDuplicates(["node"])
    dealt = blocked(texts, F.col("blocks"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), "root", "node", "text")
    found = save(dealt.groupBy("root", "i", "j").applyInArrow(_verifier(percent), "a bigint, b bigint"), "found")
    forget(family)
    linked = components(found)
    forget(found)
    named = reps.join(linked, reps["rep"] == linked["node"], "left").select(F.col("fa").alias("ga"), F.col("fb").alias("gb"), F.col("n").alias("gn"), F.coalesce("root", "rep").alias("component_id"))
    both = sk.join(named, (sk["fa"] == named["ga"]) & (sk["fb"] == named["gb"]) & (sk["n"] == named["gn"]) & (sk["n"] > 0) & sk["doc_id"].isNotNull(), "left")
    return both.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


#: Equal sets are one class, so copies are never paired; a class links to classes that hold one of its shingles.
OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END), lambda i: array_to_string(w[i + 1 : i + 5], ' ')))) AS s FROM words
), keyed AS (
  SELECT doc_id, len(s)::BIGINT AS n, CASE WHEN len(s) > 0 THEN sha256(array_to_string(s, chr(10))) ELSE 'none ' || doc_id END AS k, s FROM sets
), classes AS (
  SELECT k, n, min(doc_id) AS rep, first(s) AS s FROM keyed GROUP BY k, n
), entries AS (
  SELECT rep, n, unnest(s) AS v FROM classes
), pairs AS (
  SELECT a.rep AS a, b.rep AS b FROM entries a JOIN entries b ON a.v = b.v AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT rep AS a, rep AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), roots AS (
  SELECT a, min(b) AS root FROM reach GROUP BY a
)
SELECT doc_id, keyed.n AS n_shingles, root AS component_id, doc_id = root AS kept
FROM keyed JOIN classes ON keyed.k = classes.k AND keyed.n = classes.n JOIN roots ON roots.a = classes.rep
"""
