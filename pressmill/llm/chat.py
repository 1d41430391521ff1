"""Chat formatting: transcripts are parsed by a hidden Markov model and rendered as canonical turns.

A transcript is a list of lines. A state is a role and whether the line begins a turn or goes on with it; an observation is
the line's speaker marker (many styles, or none), whether a blank line is before it, and its length class. Viterbi finds the
roles. Probabilities are counted, with smoothing, on at most SAMPLE labelled conversations.

Conversations may have any number of lines, so they are cut into blocks of LINES lines: each block is reduced to its max-plus
matrix (best score from any state before it to any state at its end), a scan over a conversation's matrices gives each block
its entry and exit states, and each block is decoded between those; a conversation of one block needs no scan. The result is the best path of the whole conversation.

Defined results: null texts are empty lines; lines before the first marker get the role that fits best; all rows with a null
conv_id are one conversation; rows of equal conv_id and turn follow each other by text, repeated ones too; an empty table gives no
turns. Texts may have any number of lines, in training too, which reads the whole of its conversations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, save, table

ROLES = ("system", "user", "assistant")
STATES, LINES, SAMPLE = 2 * len(ROLES), 512, 400
#: Speaker markers at the start of a line, by the class they are observed as.
MARKERS = {
    "system": r"(?:system|instructions?)\s*:|\[system\]|<\|system\|>|###\s*system\s*:?",
    "user": r"(?:user|human|q|me|customer)\s*:|\[user\]|<\|user\|>|###\s*(?:user|human)\s*:?|>>\s",
    "assistant": r"(?:assistant|ai|bot|a|agent)\s*:|\[assistant\]|<\|assistant\|>|###\s*(?:assistant|response)\s*:?|<<\s",
}
CLASSES, LENGTHS = len(MARKERS) + 1, 4
SYMBOLS = CLASSES * 2 * LENGTHS


def observe(line: Column, blank: Column) -> Column:
    """The number of a line's observation."""
    marker = F.lit(0)
    for i, pattern in enumerate(MARKERS.values()):
        marker = F.when(line.rlike(r"(?i)^\s*(?:" + pattern + ")"), i + 1).otherwise(marker)
    n = F.char_length(line)
    length = F.when(n < 40, 0).when(n < 160, 1).when(n < 400, 2).otherwise(3)
    return ((marker * 2 + blank.cast("int")) * LENGTHS + length).cast("int")


def unmarked(line: Column) -> Column:
    return F.regexp_replace(line, r"(?i)^\s*(?:" + "|".join(MARKERS.values()) + r")\s?", "")


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def of(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        """From counts, smoothed; a turn goes on only with its own role."""
        log = lambda x: np.log(x / x.sum(-1, keepdims=True))
        start, move = log(start + 0.1), log(move + 0.5)
        for s in range(STATES):
            for t in range(1, STATES, 2):
                if t // 2 != s // 2:
                    move[s, t] = -np.inf
        start[1::2] = -np.inf
        return cls(start, move, log(emit + 0.05))

    @classmethod
    def count(cls, paths: list[tuple[list[int], list[int]]]) -> Model:
        """From (states, observations)."""
        start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, SYMBOLS))
        for states, seen in paths:
            start[states[0]] += 1
            np.add.at(move, (states[:-1], states[1:]), 1)
            np.add.at(emit, (states, seen), 1)
        return cls.of(start, move, emit)

    def steps(self, seen: np.ndarray, first: bool) -> np.ndarray:
        """(lines, states, states) scores of each step; before the first line all states are alike."""
        m = self.move[None] + self.emit[:, seen].T[:, None, :]
        if first:
            m[0] = self.start[None] + self.emit[:, seen[0]][None]
        return m

    def matrix(self, seen: np.ndarray, first: bool) -> np.ndarray:
        steps = self.steps(seen, first)
        out = steps[0]
        for m in steps[1:]:
            out = (out[:, :, None] + m[None]).max(1)
        return out

    def path(self, seen: np.ndarray, first: bool, entry: int = 0, leave: int | None = None) -> list[int]:
        """The best path from the entry state to the exit state, by default to the best one."""
        steps = self.steps(seen, first)
        score, back = steps[0][entry], []
        for m in steps[1:]:
            all_ = score[:, None] + m
            back.append(all_.argmax(0))
            score = all_.max(0)
        out = [int(score.argmax()) if leave is None else leave]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def scan(matrices: np.ndarray) -> tuple[list[int], list[int]]:
    """Entry and exit states of the blocks of one conversation."""
    score, scores = np.zeros(STATES), []
    for m in matrices:
        scores.append(score)
        score = (score[:, None] + m).max(0)
    leave, entries, exits = int(score.argmax()), [], []
    for m, s in zip(matrices[::-1], scores[::-1], strict=True):
        exits.append(leave)
        leave = int((s + m[:, leave]).argmax())
        entries.append(leave)
    return entries[::-1], exits[::-1]


def numbered(lines: DataFrame) -> DataFrame:
    """lines (conv_id, turn, at, line, ...) with pos, their number in the conversation, blk, and total, the conversation's lines,
    without a window over a whole conversation: turns are numbered in ranges, the ranges' totals are added up."""
    ranged = lines.withColumn("rng", F.floor(F.col("turn") / LINES))
    inner = Window.partitionBy("conv_id", "rng").orderBy("turn", "at", "line")
    sums = ranged.groupBy("conv_id", "rng").count()
    sums = sums.select(F.col("conv_id").alias("c"), F.col("rng").alias("r"), F.coalesce(F.sum("count").over(Window.partitionBy("conv_id").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("count").over(Window.partitionBy("conv_id")).alias("total"))
    out = ranged.withColumn("i", F.row_number().over(inner))
    out = out.join(sums, out["conv_id"].eqNullSafe(sums["c"]) & out["rng"].eqNullSafe(sums["r"]))
    pos = F.col("i") - 1 + F.col("before")
    return out.withColumn("pos", pos).withColumn("blk", F.floor(pos / LINES)).drop("rng", "i", "before", "c", "r")


def _arrow(t: pa.Table) -> tuple[np.ndarray, pa.Table]:
    t = t.take(pa.array(np.argsort(t.column("pos").to_numpy(), kind="stable")))
    return t.column("seen").to_numpy(), t


def parse(lines: DataFrame, model: Model) -> DataFrame:
    """lines (conv_id, turn, at, line, blank): one row for each recovered turn: conv_id, seg, role_pred, n_lines, content,
    rendered."""
    seen = save(numbered(lines.withColumn("seen", observe(F.col("line"), F.col("blank")))), "lines")
    args = lines.sparkSession.sparkContext.broadcast(model)

    def reduce(t: pa.Table) -> pa.Table:
        obs, t = _arrow(t)
        m = args.value.matrix(obs, t.column("blk")[0].as_py() == 0)
        return pa.table({"conv_id": t.column("conv_id")[:1], "blk": t.column("blk")[:1], "m": pa.array([m.ravel()], pa.list_(pa.float64()))})

    def bounds(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("blk").to_numpy(), kind="stable")))
        a, b = scan(np.array(t.column("m").to_pylist()).reshape(-1, STATES, STATES))
        return pa.table({"conv_id": t.column("conv_id"), "blk": t.column("blk"), "entry": pa.array(a, pa.int32()), "leave": pa.array(b, pa.int32())})

    def decode(t: pa.Table) -> pa.Table:
        obs, t = _arrow(t)
        states = args.value.path(obs, t.column("blk")[0].as_py() == 0, t.column("entry")[0].as_py() or 0, t.column("leave")[0].as_py())
        begins = np.cumsum([s % 2 == 0 for s in states])
        return pa.table({"conv_id": t.column("conv_id"), "blk": t.column("blk"), "pos": t.column("pos"), "state": pa.array(states, pa.int32()), "begins": pa.array(begins, pa.int64()), "line": t.column("line")})

    wide = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, but seconds of work each: not to be coalesced
    several = seen.where(F.col("total") > LINES)  # a conversation of one block is decoded at once
    blocks = several.select("conv_id", "blk", "pos", "seen").repartition(wide, "conv_id", "blk").groupBy("conv_id", "blk").applyInArrow(reduce, "conv_id bigint, blk bigint, m array<double>")
    ends = save(blocks.repartition(wide, "conv_id").groupBy("conv_id").applyInArrow(bounds, "conv_id bigint, blk bigint, entry int, leave int"), "bounds").withColumnsRenamed({"conv_id": "c", "blk": "b"})
    given = seen.join(ends, seen["conv_id"].eqNullSafe(ends["c"]) & (seen["blk"] == ends["b"]), "left").select("conv_id", "blk", "pos", "seen", "entry", "leave", "line")
    found = save(given.groupBy("conv_id", "blk").applyInArrow(decode, "conv_id bigint, blk bigint, pos bigint, state int, begins bigint, line string"), "decoded")
    totals = found.groupBy("conv_id", "blk").agg(F.max("begins").alias("n"))
    totals = totals.select(F.col("conv_id").alias("c"), F.col("blk").alias("b"), F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    seg = found.join(totals, found["conv_id"].eqNullSafe(totals["c"]) & (found["blk"] == totals["b"])).select("conv_id", (F.col("begins") + F.col("before") - 1).alias("seg"), "pos", "state", F.when(F.col("state") % 2 == 0, unmarked(F.col("line"))).otherwise(F.col("line")).alias("line"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.floor(F.col("state") / 2) + 1).cast("int"))
    turns = seg.groupBy("conv_id", "seg").agg(F.min_by(role, "pos").alias("role_pred"), F.count(F.lit(1)).alias("n_lines"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    content = F.rtrim(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    return turns.select("conv_id", "seg", "role_pred", "n_lines", content.alias("content")).withColumn("rendered", F.concat(F.lit("<|"), F.col("role_pred"), F.lit("|>\n"), F.col("content"), F.lit("\n<|end|>\n")))


#: The markers that the query writes, by style and role; style and gaps come from hashes of the ids.
STYLES = [("System: ", "User: ", "Assistant: "), ("[system] ", "[user] ", "[assistant] "), ("### System: ", "### Human: ", "### Response: "), ("SYSTEM: ", "Q: ", "A: "), ("<|system|> ", "<|user|> ", "<|assistant|> "), ("Instructions: ", "Human: ", "AI: ")]


def transcripts(conversations: DataFrame) -> DataFrame:
    """Lines of transcripts written from (conv_id, turn, role, text): a style of markers by conversation, no marker at one
    turn in five but the first, a blank line between most turns. Also the true state of each line."""
    c = conversations.select("conv_id", F.coalesce("turn", F.lit(0)).alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    number = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")), F.lit(2)).cast("int")
    number = F.when(number == 0, 2).otherwise(number) - 1
    style = F.element_at(F.array(*(F.array(*map(F.lit, s)) for s in STYLES)), (F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))) + 1).cast("int"))
    gap = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0) & (F.col("turn") > 0)
    c = c.withColumn("number", number).withColumn("text", F.concat(F.when(gap, "").otherwise(F.element_at(style, F.col("number") + 1)), "text"))
    lines = c.select("conv_id", "turn", "number", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    blank = (F.col("at") == 0) & (F.col("turn") > 0) & (F.pmod(F.xxhash64("turn", "conv_id"), F.lit(10)) > 0)
    return lines.select("conv_id", "turn", "at", "line", blank.alias("blank"), (F.col("number") * 2 + (F.col("at") > 0).cast("int")).alias("state"))


def train(lines: DataFrame, sample: int = SAMPLE) -> Model:
    """Count over all lines of at most `sample` conversations, however long those are; only the counts come to the driver."""
    ids = lines.select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(sample)
    seen = lines.join(F.broadcast(ids), "conv_id").select("conv_id", "turn", "at", "line", "state", observe(F.col("line"), F.col("blank")).alias("seen"))  # ids: `sample` rows
    rows = save(numbered(seen).select("conv_id", "pos", "state", "seen"), "train")
    after = rows.select(F.col("conv_id").alias("c"), (F.col("pos") - 1).alias("p"), F.col("state").alias("to"))
    counts = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect()  # noqa: E731  a row for each pair of states or symbols
    start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, SYMBOLS))
    for r in counts(rows.where("pos = 0"), "state"):
        start[r["state"]] = r["n"]
    for r in counts(rows.join(after, (rows["conv_id"] == after["c"]) & (rows["pos"] == after["p"])), "state", "to"):
        move[r["state"], r["to"]] = r["n"]
    for r in counts(rows, "state", "seen"):
        emit[r["state"], r["seen"]] = r["n"]
    forget(rows)
    return Model.of(start, move, emit)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = transcripts(table(spark, sf_dir, "conversations"))
    return parse(lines.drop("state"), train(lines))
