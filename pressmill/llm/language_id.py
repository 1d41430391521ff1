"""Language ID by a byte convolutional network, trained in numpy.

Filters of widths 2, 3 and 4 run over the bytes (A-Z lowered) of fixed-length windows; the maximum of each filter over the
window goes through a rectifier and a softmax layer. A document's class is the one with the highest mean log-probability over
all windows of its whole text. The filters are sums of one table row per byte, so for prediction they are folded into one
table over byte pairs, in 16-bit integers, and a window costs a gather, two additions and three maxima a byte.

Training takes at most DOCS_A_LANG labelled documents of each language, those with the smallest hash of doc_id, and
WINDOWS_A_DOC windows of each, spread evenly over its whole text: a bound on what reaches the driver, not on what is predicted.

Defined results: null texts and texts without a letter are `und` with score 0; so is everything where nothing was learned. Repeated
rows are judged each, and alike; of equally probable languages the first by name is taken; an empty table gives no rows. Texts may be of any
length: their windows are read in parts of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import columns, table

WINDOW, FILTERS, DOCS_A_LANG, WINDOWS_A_DOC, EPOCHS, BATCH, SEED = 128, 16, 300, 6, 3, 128, 7
PAIR_SHARE = 1e-4
WIDTHS = (2, 3, 4)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, the last of each filled up with spaces; how many each text has."""
    counts = np.array([max(1, -(-len(t) // size)) for t in texts], np.int64)
    data = b"".join(t.ljust(int(n) * size, b" ") for t, n in zip(texts, counts, strict=True)).translate(LOWER)
    return np.frombuffer(data, np.uint8).reshape(-1, size), counts


class ByteNet:
    def __init__(self, labels: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {f"w{w}": rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.p |= {"b": np.zeros(len(WIDTHS) * FILTERS, np.float32), "v": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32), "c": np.zeros(len(labels), np.float32)}

    def _features(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        tops, at = [], []
        for w in WIDTHS:
            t = self.p[f"w{w}"]
            y = sum(t[j][x[:, j : x.shape[1] - w + 1 + j]] for j in range(w))
            at.append(y.argmax(1))
            tops.append(np.take_along_axis(y, at[-1][:, None, :], 1)[:, 0])
        return np.concatenate(tops, 1) + self.p["b"], at

    def step(self, x: np.ndarray, y: np.ndarray, state: dict, rate: float) -> None:
        raw, at = self._features(x)
        h = np.maximum(raw, 0)
        z = h @ self.p["v"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(y)), y] -= 1
        z /= len(y)
        d = (z @ self.p["v"].T) * (raw > 0)
        grad = {"v": h.T @ z, "c": z.sum(0), "b": d.sum(0)}
        rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None]
        for k, w in enumerate(WIDTHS):
            g = np.zeros_like(self.p[f"w{w}"])
            part = d[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                np.add.at(g[j], (x[rows, at[k] + j], np.broadcast_to(cols, part.shape)), part)
            grad[f"w{w}"] = g
        state["t"] = t = state.get("t", 0) + 1
        for k, g in grad.items():
            m, v = state.setdefault(k, [np.zeros_like(g), np.zeros_like(g)])
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            self.p[k] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> ByteNet:
        rng, state = np.random.default_rng(SEED), {}
        for e in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), BATCH):
                i = order[s : s + BATCH]
                self.step(x[i], y[i], state, 0.02 / (1 + e))
        return self

    def folded(self) -> dict:
        """Tables over byte pairs: [w2 | w3 first two | w3 last | w4 first two | w4 last two], scaled to 16 bits."""
        one = {w: self.p[f"w{w}"] for w in WIDTHS}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        zero = np.zeros((256, FILTERS), np.float32)
        full = np.concatenate([pair(one[2][0], one[2][1]), pair(one[3][0], one[3][1]), pair(zero, one[3][2]), pair(one[4][0], one[4][1]), pair(one[4][2], one[4][3])], 1)
        scale = 16000 / max(1e-6, float(np.abs(full).max()))
        return {"table": np.round(full * scale).astype(np.int16), "scale": np.float32(scale), "labels": self.labels} | {k: self.p[k] for k in "bvc"}


def predict(model: dict, texts: list[bytes], chunk: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Class numbers and probabilities."""
    x, counts = windows(texts)
    logs = np.empty((len(x), len(model["labels"])), np.float32)
    f, table_ = FILTERS, model["table"]
    for s in range(0, len(x), chunk):
        part = np.ascontiguousarray(x[s : s + chunk].T)
        g = table_[(part[:-1].astype(np.uint16) << 8) | part[1:]]
        tops = [g[:, :, :f].max(0), (g[:-1, :, f : 2 * f] + g[1:, :, 2 * f : 3 * f]).max(0), (g[:-2, :, 3 * f : 4 * f] + g[2:, :, 4 * f :]).max(0)]
        h = np.maximum(np.concatenate(tops, 1) / model["scale"] + model["b"], 0)
        z = h @ model["v"] + model["c"]
        z -= z.max(1, keepdims=True)
        logs[s : s + chunk] = z - np.log(np.exp(z).sum(1, keepdims=True))
    mean = np.add.reduceat(logs.astype(np.float64), np.r_[0, np.cumsum(counts)[:-1]], 0) / counts[:, None]
    p = np.exp(mean - mean.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return best, p[np.arange(len(p)), best]


def letter_pairs(text: bytes) -> np.ndarray:
    """The pairs of following bytes that both belong to letters (or to what UTF-8 writes with several bytes), A-Z lowered."""
    b = np.frombuffer(text.translate(LOWER), np.uint8).astype(np.int32)
    letter = ((b >= 97) & (b <= 122)) | (b >= 128)
    return ((b[:-1] << 8) | b[1:])[letter[:-1] & letter[1:]]


def familiar_pairs(x: np.ndarray) -> np.ndarray:
    """Which letter pairs make up at least PAIR_SHARE of those in the training windows."""
    counts = np.bincount(letter_pairs(b" ".join(w.tobytes() for w in x)), minlength=65536)
    return counts >= max(1, PAIR_SHARE * counts.sum())


def familiar(model: dict, text: bytes) -> float:
    """The share of a text's letter pairs that the training windows made familiar; 1 where it has none. Scores cannot tell an unlearned language, as
    they are shares of the learned ones."""
    pairs = letter_pairs(text)
    return float(model["pairs"][pairs].mean()) if len(pairs) else 1.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, docs_a_lang: int = DOCS_A_LANG) -> dict | None:
    """A folded model from labelled docs (doc_id, text, lang), or None where there are none."""
    asked = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = asked.select("doc_id", "lang").withColumn("i", F.row_number().over(w)).where(F.col("i") <= docs_a_lang).select("doc_id", "lang")
    sample = asked.select("doc_id", "lang", "text").join(F.broadcast(chosen.distinct()), ["doc_id", "lang"])  # docs_a_lang rows a language
    n, size, text = WINDOWS_A_DOC, WINDOW, F.col("text")
    spread = F.greatest(F.lit(0), F.char_length(text) - size) / (n - 1)
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * spread).cast("int") + 1))
    parts = F.transform(starts, lambda p: F.encode(F.substring(text, p, F.lit(size)), "utf-8"))
    found = sample.select("doc_id", "lang", F.col("text").rlike(r"\p{L}").alias("ok"), parts.alias("parts")).where("ok").collect()
    labels = sorted({r["lang"] for r in found})
    if not labels:
        return None
    xs, ys = [], []
    for r in sorted(found, key=lambda r: (r["doc_id"], bytes(r["parts"][0]))):
        xs += [windows([bytes(p)])[0][:1] for p in r["parts"]]
        ys += [labels.index(r["lang"])] * len(r["parts"])
    x = np.concatenate(xs)
    return ByteNet(labels).fit(x, np.array(ys)).folded() | {"pairs": familiar_pairs(x)}


def identify(docs: DataFrame, model: dict | None, with_familiar: bool = False) -> DataFrame:
    """For each of docs (text, ...): row (all its columns), lang_pred, score, and on demand familiar (0 where nothing is predicted)."""
    packed = docs.select(F.struct(*columns(docs)).alias("row"), F.col("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("ok"))
    if model is None:
        return packed.select("row", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), *([F.lit(0.0).alias("familiar")] if with_familiar else []))
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: 65536 rows of 80 numbers
    schema = T.StructType([packed.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())] + ([T.StructField("familiar", T.DoubleType())] if with_familiar else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = batch.column(2).to_pylist()
            texts = [t for t, y in zip(batch.column(1).cast(pa.binary()).to_pylist(), ok, strict=True) if y]
            names, scores = ["und"] * len(ok), [0.0] * len(ok)
            at = [i for i, y in enumerate(ok) if y]
            for s in range(0, len(at), 64):
                for i, c, p in zip(at[s : s + 64], *predict(held.value, texts[s : s + 64]), strict=True):
                    names[i], scores[i] = held.value["labels"][c], float(p)
            out = {"row": batch.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}
            if with_familiar:
                shares = np.zeros(len(ok))
                shares[at] = [familiar(held.value, t) for t in texts]
                out["familiar"] = pa.array(shares)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return packed.mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
