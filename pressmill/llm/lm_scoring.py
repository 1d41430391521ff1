"""LM scoring by subword lattice likelihood.

A word (with a space before it) is a lattice of the pieces of an existing vocabulary with stored scores; its probability is the
sum over all segmentations of the product of their pieces' probabilities, by the forward recursion in log space. A text's
probability is that of its words and one end token, so it is found from the probabilities of distinct words.

The stored scores are ranks below zero, not logarithms of probabilities, so a piece of score s weighs 1 / (SHIFT - s), as by
Zipf's law; a byte piece weighs as much as the last piece. What is learned from the training documents, beside the counts of
the base score, are the pieces' probabilities: ROUNDS of expectation-maximisation over all words, each as often as it occurs,
with PRIOR uses' worth of the start, so no piece has probability 0 and, as all single bytes are pieces, no word either.

Documents are dealt into ranges of about RANGE_BYTES of text. One pass over the texts counts the words of each range; summed
over ranges these are the corpus counts; joined back they give each range the table it needs. Nothing is broadcast but the
piece probabilities, of which there are as many as the vocabulary has. Quantiles of doc_id part the input into at most COARSE ranges, and equal
steps of doc_id within those into as many as it takes; a range that still has more than twice RANGE_BYTES, as where long texts have near ids or many rows one id, is
dealt to several by hash, so that no range is larger but one of a single document, or of equal rows.

Defined results: a null text is empty and has the end token alone; without training documents N and V are 0 and the pieces
keep their start; repeated rows are scored each; null doc_ids are not held out; columns other than doc_id and text are not read; an empty table gives no rows. A word may be of any length:
those beyond LONG bytes go through the recursion in blocks, in memory of a few numbers a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, save, table

SHIFT, ROUNDS, PRIOR, RANGE_BYTES, COARSE, FLUSH = 20.0, 2, 1000.0, 12_000_000, 20_000, 400_000
BASE, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
WORD_BATCH, LONG, BLOCK = 4096, 200, 4096


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def read_pieces(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """The pieces of a sentencepiece model as bytes, the word mark as a space, and their starting probabilities. Pieces that no
    word can hold (controls, several word marks or one after the start) are left out; a character and its byte are one piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    weights: dict[bytes, float] = {}
    scores = [model.get_score(i) for i in range(model.get_piece_size()) if not model.is_byte(i)]
    last = min(x for x in scores if x > -1e6)
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        if model.is_byte(i):
            piece, score = bytes([int(model.id_to_piece(i)[3:5], 16)]), last
        else:
            piece, score = model.id_to_piece(i).replace("\u2581", " ").encode(), max(model.get_score(i), last)
        if b" " not in piece[1:]:
            weights[piece] = weights.get(piece, 0.0) + 1 / (SHIFT - score)
    for b in range(256):
        weights.setdefault(bytes([b]), 1 / (SHIFT - last))
    w = np.array(list(weights.values()))
    return list(weights), w / w.sum()


class Lattice:
    """Finds pieces in batches of words of one length by rolling hashes, and sums over all segmentations."""

    def __init__(self, pieces: list[bytes]):
        self.most = max(map(len, pieces))
        keys = np.array([self._hash(p) for p in pieces], np.uint64)
        self.order = np.argsort(keys)
        keys = keys[self.order]
        assert (keys[1:] != keys[:-1]).all()
        self.bits, self.reach = 21, 0
        self.keys = np.zeros((1 << self.bits) + 64, np.uint64)
        self.ids = np.full((1 << self.bits) + 64, -1, np.int32)
        for k, i in zip(keys.tolist(), self.order.tolist(), strict=True):
            s = k >> (64 - self.bits)
            d = 0
            while self.ids[s + d] >= 0:
                d += 1
            self.keys[s + d], self.ids[s + d] = k, i
            self.reach = max(self.reach, d)

    @staticmethod
    def _hash(p: bytes) -> int:
        h = 0
        for b in p:
            h = (h * BASE + b + 1) % (1 << 64)
        return h * MIX % (1 << 64)

    def _look_up(self, k: np.ndarray) -> np.ndarray:
        """Pieces of mixed hashes, -1 where there is none."""
        at = (k >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[at] == k, self.ids[at], -1)
        for d in range(1, self.reach + 1):
            out = np.where((out < 0) & (self.keys[at + d] == k), self.ids[at + d], out)
        return out

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """words: (n, L) bytes. For every substring of at most `most` bytes: its piece or -1, as (n, substrings); the
        substrings' starts and ends."""
        n, length = words.shape
        h = np.zeros((n, length + 1), np.uint64)
        power = np.r_[np.uint64(1), np.cumprod(np.full(length, BASE, np.uint64))]
        for i in range(length):
            h[:, i + 1] = h[:, i] * np.uint64(BASE) + words[:, i] + np.uint64(1)
        spans = [(j, i) for i in range(1, length + 1) for j in range(max(0, i - self.most), i)]
        a, b = np.array([s[0] for s in spans]), np.array([s[1] for s in spans])
        return self._look_up((h[:, b] - h[:, a] * power[b - a]) * np.uint64(MIX)), a, b

    def arcs(self, word: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The pieces in one word of any length, in blocks by end: starts, ends and pieces."""
        x = np.frombuffer(word, np.uint8).astype(np.uint64) + np.uint64(1)
        inverse = np.cumprod(np.full(len(x), pow(BASE, -1, 1 << 64), np.uint64))
        power = np.r_[np.uint64(1), np.cumprod(np.full(max(len(x), self.most), BASE, np.uint64))]
        h = np.r_[np.uint64(0), np.cumsum(x * inverse)] * power[: len(x) + 1]
        out = []
        for s in range(1, len(word) + 1, BLOCK):
            ends = np.arange(s, min(s + BLOCK, len(word) + 1))
            starts = ends[:, None] - np.arange(1, self.most + 1)[None]
            k = (h[ends][:, None] - h[np.maximum(starts, 0)] * power[1 : self.most + 1][None]) * np.uint64(MIX)
            ids = np.where(starts >= 0, self._look_up(k), -1)
            r, c = np.nonzero(ids >= 0)
            out.append((starts[r, c].astype(np.int64), ends[r], ids[r, c].astype(np.int32)))
        return out

    @staticmethod
    def _sweep(blocks, length: int, logp: np.ndarray, back: bool = False) -> list[float]:
        """Log-sums over all segmentations of each prefix, or of each suffix."""
        total = [-np.inf] * (length + 1)
        total[length if back else 0] = 0.0
        for a, b, ids in reversed(blocks) if back else blocks:
            into, out = (a, b) if back else (b, a)
            order = np.lexsort((b, -a)) if back else slice(None)  # suffixes: from the last start
            at, terms = -1, []
            for i, j, p in zip(into[order].tolist(), out[order].tolist(), logp[ids][order].tolist(), strict=True):
                if i != at:
                    if terms:
                        _close(total, at, terms)
                    at, terms = i, []
                terms.append(total[j] + p)
            if terms:
                _close(total, at, terms)
        return total

    def forward_long(self, word: bytes, logp: np.ndarray) -> float:
        return self._sweep(self.arcs(word), len(word), logp)[-1]

    def forward(self, words: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Log-probability of each word; logp has -inf appended for -1."""
        if words.shape[1] > LONG:
            return np.array([self.forward_long(w.tobytes(), logp) for w in words])
        ids, a, b = self.find(words)
        return self._run(logp[ids], a, b, words.shape[1])[:, -1]

    @staticmethod
    def _run(lp: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        alpha = np.full((len(lp), length + 1), -np.inf)
        alpha[:, 0] = 0
        for i in range(1, length + 1):
            s, e = np.searchsorted(b, [i, i + 1])
            x = alpha[:, a[s:e]] + lp[:, s:e]
            top = x.max(1)
            top[np.isneginf(top)] = 0
            with np.errstate(divide="ignore"):
                alpha[:, i] = top + np.log(np.exp(x - top[:, None]).sum(1))
        return alpha

    def expect(self, words: np.ndarray, counts: np.ndarray, logp: np.ndarray, into: np.ndarray) -> None:
        """Add the expected number of times each piece is used in these words, each met so many times."""
        if words.shape[1] > LONG:
            for w, c in zip(words, counts, strict=True):
                blocks = self.arcs(w.tobytes())
                alpha, beta = (np.array(self._sweep(blocks, len(w), logp, back)) for back in (False, True))
                for a, b, ids in blocks:
                    into += np.bincount(ids, c * np.exp(alpha[a] + logp[ids] + beta[b] - alpha[-1]), len(into))
            return
        ids, a, b = self.find(words)
        length = words.shape[1]
        lp = logp[ids]
        alpha = self._run(lp, a, b, length)
        order = np.lexsort((a, length - a))
        back = self._run(lp[:, order], (length - b)[order], (length - a)[order], length)[:, ::-1]  # the same, from the end
        with np.errstate(invalid="ignore"):
            used = np.exp(alpha[:, a] + lp + back[:, b] - alpha[:, -1:]) * counts[:, None]
        ok = ids >= 0
        into += np.bincount(ids[ok], np.nan_to_num(used[ok]), len(into))


def _close(total: list[float], at: int, terms: list[float]) -> None:
    """Add terms to a log-sum."""
    if total[at] > -np.inf:
        terms.append(total[at])
    top = max(terms)
    total[at] = top + log(sum([exp(t - top) for t in terms])) if top > -np.inf else top


@lru_cache(maxsize=1)
def lattice(data: bytes) -> Lattice:
    return Lattice(read_pieces(data)[0])


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, bytes matrix) of the words of each length, a space before each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        if len(group):
            length = int(lengths[group[0]]) + 1
            step = max(1, WORD_BATCH * 200 // (length * length))
            for s in range(0, len(group), step):
                part = group[s : s + step]
                yield part, np.frombuffer(b"".join(b" " + words[i] for i in part.tolist()), np.uint8).reshape(len(part), length)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rng, word, c): the words of each range met here; c counts them in training documents, the empty word is the end."""
    held: dict[int, dict[bytes, int]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for r, d in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([r] * len(d), pa.int64()), pa.array(list(d), pa.binary()), pa.array(list(d.values()), pa.int64())], names=["rng", "word", "c"])

    for batch in batches:
        for r, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            d = held.setdefault(r, {})
            one, before, get = (0 if out else 1), len(d), d.get
            for w in (text or b"").lower().split():
                d[w] = get(w, 0) + one
            d[b""] = get(b"", 0) + one
            size += len(d) - before
            if size > FLUSH:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def _expected(data, logp):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat, lp = lattice(data.value), logp.value
        into = np.zeros(len(lp) - 1)
        for batch in batches:
            counts = batch.column(1).to_numpy()
            for at, m in by_length(batch.column(0).to_pylist()):
                lat.expect(m, counts[at], lp, into)
        i = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32), pa.int32()), pa.array(into[i], pa.float64())], names=["piece", "used"])

    return run


def _weigh(data, logp, stop: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat, lp = lattice(data.value), logp.value
        for batch in batches:
            words = batch.column(0).to_pylist()
            out = np.zeros(len(words))
            for at, m in by_length(words):
                out[at] = lat.forward(m, lp) + np.log1p(-stop)
            out[[not w for w in words]] = np.log(stop)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out / np.log(10))], names=["word", "c", "score"])

    return run


def _score(n: int, v: int):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        d = dict(zip(words.column("word").to_pylist(), range(words.num_rows), strict=True))
        c, score = words.column("c").to_numpy(), words.column("score").to_numpy()
        base = np.log10((c + 1) / (n + v + 1))
        stop = d[b""]
        out = []
        for text in docs.column("text").cast(pa.binary()).to_pylist():
            at = np.array([d[w] for w in (text or b"").lower().split()] + [stop])
            out.append((len(at), int((c[at] > 0).sum()), float(base[at].sum()), float(score[at].sum())))
        cols = list(zip(*out, strict=True))
        kinds = (("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out")} | {k: pa.array(x, t) for (k, t), x in zip(kinds, cols, strict=True)})

    return run


def _ranges(docs: DataFrame, range_bytes: int = RANGE_BYTES, coarse: int = COARSE) -> Column:
    """Ranges of doc_id of about range_bytes of text: near documents are often in one file, so a file's words meet in few ranges.
    Only the coarse bounds come to the driver."""
    n, low, high, size = docs.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = min(n, size // range_bytes)
    if not ranges:
        return F.lit(0).cast("long")
    many = min(ranges, coarse)
    steps = -(-ranges // many)
    cuts = docs.select(F.percentile_approx("doc_id", [i / (many + 1) for i in range(1, many + 1)], 10 * many + 1000)).first()[0]
    cuts = sorted({low - 1, *cuts, high})  # a range is from above one bound up to the next
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    of = F.col("doc_id")
    group = F.size(F.filter(F.lit([g[-1] for g in groups]), lambda c: c < of))
    at = group * step + F.size(F.filter(F.get(F.array(*(F.lit(g) for g in groups)), group), lambda c: c < of))
    spread = F.pmod(F.xxhash64("text"), F.lit(ranges))  # for documents without an id
    if steps == 1:
        return F.when(of.isNull(), spread).otherwise(at).cast("long")
    bound = lambda i: F.get(F.get(F.array(*(F.lit(g) for g in groups)), F.floor(i / step).cast("int")), F.pmod(i, F.lit(step)).cast("int")).cast("double")
    part = F.floor((of - bound(at - 1) - 1) * steps / (bound(at) - bound(at - 1)))
    return F.when(of.isNull(), spread).otherwise(at * steps + part).cast("long")


def _split_large(docs: DataFrame, range_bytes: int, rounds: int = 4) -> DataFrame:
    """docs (doc_id, text, rng) with the ranges of more than twice range_bytes dealt to several by hash, again where a part is still so large: long texts whose ids are near
    and rows of one id come apart. One document, or equal rows, stay together."""
    for r in range(rounds):
        h = F.xxhash64("doc_id", "text")
        large = docs.groupBy("rng").agg(F.sum(F.octet_length("text")).alias("bytes"), F.min(h).alias("low"), F.max(h).alias("high")).where((F.col("bytes") > 2 * range_bytes) & (F.col("low") < F.col("high")))
        large = save(large.select("rng", F.ceil(F.col("bytes") * 2 / range_bytes).alias("parts")), "large")
        if large.isEmpty():
            break
        part = F.pmod(F.xxhash64("doc_id", "text", F.lit(r)), F.col("parts"))
        told = docs.join(F.broadcast(large), "rng", "left")  # a row for each 2 * range_bytes of text at most
        docs = told.withColumn("rng", F.when(F.col("parts").isNull(), F.col("rng")).otherwise(F.xxhash64("rng", F.lit(r), part))).drop("parts")
    return docs


def score_documents(docs: DataFrame, vocabulary: str | None = None, rounds: int = ROUNDS, range_bytes: int = RANGE_BYTES, coarse: int = COARSE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each of docs (doc_id, text)."""
    spark = docs.sparkSession
    with open(vocabulary or default_vocabulary(), "rb") as f:
        raw = f.read()
    data = spark.sparkContext.broadcast(raw)  # one vocabulary file, about 0.5 MB
    docs = docs.select("doc_id", "text")
    docs = _split_large(docs.select("doc_id", "text", _ranges(docs, range_bytes, coarse).alias("rng")), range_bytes)
    docs = docs.withColumn("held_out", held_out(F.col("doc_id")))
    ranged = save(docs.select("rng", "held_out", "text").mapInArrow(_counts, "rng long, word binary, c bigint"), "words")
    words = save(ranged.groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")
    n, v, ends = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.sum(F.when(F.col("word") == F.lit(b""), F.col("c"))), F.lit(0))).first()
    p = prior = read_pieces(raw)[1]
    with_none = lambda x: spark.sparkContext.broadcast(np.r_[np.log(x), -np.inf])
    trained = words.where((F.col("c") > 0) & (F.octet_length("word") > 0))
    for _ in range(rounds if n else 0):
        used = trained.select("word", "c").mapInArrow(_expected(data, with_none(p)), "piece int, used double").groupBy("piece").agg(F.sum("used").alias("used")).collect()
        e = np.zeros(len(p))
        for r in used:  # at most as many as there are pieces
            e[r["piece"]] = r["used"]
        p = (e + PRIOR * prior) / (e.sum() + PRIOR)
    stop = (ends + 1) / (n + 2)
    weighed = save(words.mapInArrow(_weigh(data, with_none(p), stop), "word binary, c bigint, score double"), "weighed")
    forget(words)
    needed = ranged.select("rng", "word").join(weighed, "word").select("rng", "word", "c", "score")  # a range's repeats meet in _score
    out = docs.groupBy("rng").cogroup(needed.groupBy("rng")).applyInArrow(_score(n, v), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
