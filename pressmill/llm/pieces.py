"""Subword pieces of a SentencePiece BPE model with the bytes of the original text that each stands for, and back.

Encoding keeps offsets: the text is normalised by the longest prefix that the model's compiled character map (a double array, walked
byte by byte) knows at each place, and every byte written remembers the byte of the source it came from; the merges then run on
the normalised text, and the ends of each piece are projected through that alignment to a span of the original bytes. Without a
character map (the `identity` rule) a character is its own prefix, and text and alignment are built a text at a time instead of
a prefix at a time.

No merge brings together two characters that follow each other in no piece, so a text is cut there into chunks (words, runs of
marks), and the pieces of a chunk are worked out once a worker (a bounded table of short chunks); long chunks take n log n steps.

Defined results: a null text is empty, with no pieces; texts may be of any length, with any characters, written-out special pieces
(`<s>`) being plain text; bytes that are no UTF-8 are read as U+FFFD; equal texts give equal rows; repeated rows and null ids are kept;
ties between merges go to the left; columns other than doc_id and text are not read; an empty table gives no rows. Models that are not BPE, lack
byte pieces, or name symbols of their users are refused with a ValueError, as are maps for decoding.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed values of the model format: the mark that stands for a space, the kinds of pieces, the character for unreadable bytes.
MARK, NORMAL, UNKNOWN, CONTROL, OWN, BYTE, UNUSED, BPE = "▁", 1, 2, 3, 4, 6, 5, 2
UNREADABLE = "�"
#: Chunks up to this length are kept, this many of them; a task hands on its rows after so many bytes of text.
KEPT_LENGTH, KEPT, HAND_ON = 64, 400_000, 4 << 20
#: Chunks up to this length are merged by looking at all their pairs, longer ones by a heap.
SHORT, NEVER = 100, float("-inf")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at += 1
        if data[at - 1] < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a message in the protocol-buffer wire format."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _number(data, at)
        else:
            if kind == 2:
                size, at = _number(data, at)
            else:
                size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharMap:
    """A compiled character map: the size of a double array, the array, and the texts that its values point at, each ended by a zero."""

    def __init__(self, data: bytes) -> None:
        (size,) = struct.unpack_from("<I", data)
        self.units, self.texts = np.frombuffer(data[4 : 4 + size], "<u4").tolist(), data[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """What the longest known prefix of data[at:] becomes, and its length."""
        units, found = self.units, None
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node = step(units[0])
        for i in range(at, len(data)):
            unit = units[node ^ data[i]]
            if unit & 0x800000FF != data[i]:
                break
            node ^= data[i] ^ step(unit)
            if unit & 256:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]


def chunk_pattern(several: list[str]) -> re.Pattern:
    """A pattern of chunks that no merge goes across: characters that follow each other in some piece of several are of one family, and
    a chunk is a run of one family with the marks before it, a run of marks, or a character of no family."""
    parent = {c: c for t in several for c in t}

    def find(c: str) -> str:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    over_marks = any(MARK in t.lstrip(MARK) for t in several)  # pieces go over the start of a word
    for t in several:
        t = t if over_marks else t.lstrip(MARK)
        for a, b in zip(t, t[1:], strict=False):
            parent[find(a)] = find(b)
    families: dict[str, list[str]] = {}
    for c in parent:
        if c != MARK or over_marks:
            families.setdefault(find(c), []).append(c)
    runs = [f"[{''.join(map(re.escape, sorted(f)))}]+" for f in sorted(families.values(), key=len, reverse=True)]
    return re.compile("|".join(([] if over_marks else [f"{MARK}*(?:{'|'.join(runs)})"] if runs else []) + (runs if over_marks else []) + [f"{MARK}+", "[\\s\\S]"]))


class PieceModel:
    """The pieces, rules and merges of a model file."""

    def __init__(self, data: bytes) -> None:
        pieces, trainer, rules, undo = [], {}, {}, {}
        for field, value in _fields(data):
            if field == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                rules = dict(_fields(value))
            elif field == 5:
                undo = dict(_fields(value))
        kinds = {k for _, _, k in pieces}
        if trainer.get(3, 1) != BPE or not trainer.get(35, 0) or kinds & {OWN, UNUSED} or undo.get(2):
            raise ValueError("only BPE models with byte pieces and without symbols of users or a map for decoding are read")
        self.map = CharMap(rules[2]) if rules.get(2) else None
        self.prefix, self.squeeze, self.escape, self.suffix = bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1)), bool(trainer.get(24, 0))
        self.ids = {t: i for i, (t, _, k) in enumerate(pieces) if k == NORMAL}
        self.scores = {t: s for t, s, k in pieces if k == NORMAL}
        self.bytes = {int(t[3:5], 16): i for i, (t, _, k) in enumerate(pieces) if k == BYTE}
        unknown = trainer.get(44, " ⁇ ".encode())
        self.texts = [unknown if k == UNKNOWN else b"" if k == CONTROL else bytes([int(t[3:5], 16)]) if k == BYTE else t.replace(MARK, " ").encode() for t, _, k in pieces]
        self.is_byte = [k == BYTE for _, _, k in pieces]
        self.is_control = [k == CONTROL for _, _, k in pieces]
        self.marked = [k == NORMAL and t.startswith(MARK) for t, _, k in pieces]
        self.chunks = chunk_pattern([t for t in self.ids if len(t) > 1])
        self.kept: dict[str, tuple[bytes, bytes]] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the byte of the text it comes from."""
        data = text.encode()
        if self.map is None and not self.squeeze:
            return self._plain(text, data)
        out, origin, at = bytearray(), [], 0
        mark, end = MARK.encode() if self.escape else b" ", len(data)

        def take(at: int) -> tuple[bytes, int]:
            found = self.map.longest(data, at) if self.map else None
            if found:
                return found
            lead = data[at]
            n = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
            return data[at : at + n], n

        def write(piece: bytes, at: int) -> None:
            out.extend(piece)
            origin.extend([at] * len(piece))

        while self.squeeze and at < end:
            piece, n = take(at)
            if piece != b" ":
                break
            at += n
        if at == end:
            return "", np.array([at])
        if self.prefix and not self.suffix:
            write(mark, at)
        space = self.squeeze
        while at < end:
            piece, n = take(at)
            if space:
                piece = piece.lstrip(b" ")
            if piece:
                write(piece.replace(b" ", mark), at)
                space = piece.endswith(b" ")
            at += n
            space = space and self.squeeze
        while self.squeeze and out.endswith(mark):
            at = origin[len(out) - len(mark)]
            del out[-len(mark) :], origin[-len(mark) :]
        if self.prefix and self.suffix:
            write(mark, at)
        return out.decode(), np.array([*origin, at])

    def _plain(self, text: str, data: bytes) -> tuple[str, np.ndarray]:
        """normalise() where every character stays but for spaces."""
        if not data:
            return "", np.zeros(1, np.int32)
        mark = MARK if self.escape else " "
        raw = np.frombuffer(data, np.uint8)
        body = np.arange(len(data), dtype=np.int32)
        if self.escape:
            body = np.repeat(body, np.where(raw == 32, np.uint8(3), np.uint8(1)))
        front, back = (len(mark.encode()) * (self.prefix and on) for on in (not self.suffix, self.suffix))
        out = (mark if front else "") + text.replace(" ", mark) + (mark if back else "")
        return out, np.concatenate([np.zeros(front, np.int32), body, np.full(back + 1, len(data), np.int32)])

    def merged(self, chunk: str) -> list[str]:
        """The symbols of a chunk after all merges, the best score first and the leftmost of equal ones."""
        if len(chunk) <= SHORT:
            return self._merged_short(chunk)
        text: list[str] = list(chunk)
        n = len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            pair = text[a] + text[b]
            score = self.scores.get(pair)
            if score is not None:
                heapq.heappush(heap, (-score, a, b, pair))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, pair = heapq.heappop(heap)
            if not text[a] or not text[b] or after[a] != b or len(text[a]) + len(text[b]) != len(pair):
                continue  # one of them has been merged since
            text[a], text[b] = pair, ""
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        return [t for t in text if t]

    def _merged_short(self, chunk: str) -> list[str]:
        """merged() by looking at all pairs again after each merge."""
        text, scores = list(chunk), self.scores
        pairs = [scores.get(a + b, NEVER) for a, b in zip(text, text[1:], strict=False)]
        while pairs:
            best = max(pairs)
            if best == NEVER:
                break
            i = pairs.index(best)
            text[i] += text.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = scores.get(text[i - 1] + text[i], NEVER)
            if i < len(pairs):
                pairs[i] = scores.get(text[i] + text[i + 1], NEVER)
        return text

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """Ids and lengths in bytes of a chunk's pieces, as 32-bit numbers. Of a character's byte pieces the last has its whole length."""
        got = self.kept.get(chunk)
        if got is None:
            ids, sizes = [], []
            for t in self.merged(chunk):
                raw = t.encode()
                known = self.ids.get(t)
                if known is not None:
                    ids.append(known)
                    sizes.append(len(raw))
                else:
                    ids += [self.bytes[b] for b in raw]
                    sizes += [0] * (len(raw) - 1) + [len(raw)]
            got = array("i", ids).tobytes(), array("i", sizes).tobytes()
            if len(chunk) <= KEPT_LENGTH and len(self.kept) < KEPT:
                self.kept[chunk] = got
        return got

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each piece begins and ends in the bytes of the text."""
        normal, origin = self.normalise(text)
        kept, work = self.kept, self._chunk
        found = [kept.get(c) or work(c) for c in self.chunks.findall(normal)]
        ids = np.frombuffer(b"".join([f[0] for f in found]), "i4")
        sizes = np.frombuffer(b"".join([f[1] for f in found]), "i4").astype(np.int64)
        ends = np.cumsum(sizes)
        return ids, origin[ends - sizes], origin[ends]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts in front."""
        ids = [i for i in ids if not self.is_control[i]]
        texts = self.texts
        out = b"".join([texts[i] for i in ids])
        if ids and self.marked[ids[0]] and (self.prefix or self.squeeze):
            out = out.lstrip(b" ") if self.squeeze else out[1:]
        try:
            return out.decode()
        except UnicodeDecodeError:  # ids that no text gives
            return "".join(_readable(out))


def _readable(data: bytes) -> Iterator[str]:
    """Characters, and U+FFFD for each byte that is part of none."""
    at = 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                c = data[at : at + n].decode()
            except UnicodeDecodeError:
                continue
            break
        else:
            c, n = UNREADABLE, 1
        yield c
        at += n


@lru_cache(maxsize=2)
def read_model(data: bytes) -> PieceModel:
    return PieceModel(data)


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("decoded", pa.string())])


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, starts, ends, decoded) of each row: the pieces of the whole text, the byte spans of the text (UTF-8) that they stand for, and
    what the ids decode to."""
    with open(model or default_model(), "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())  # a model file, half a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = read_model(data.value)
        for batch in batches:
            ids, rows, size = [], [], 0

            def out() -> pa.RecordBatch:
                at = pa.array(np.cumsum([0, *(len(r[0]) for r in rows)]), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, np.int32), *(r[k] for r in rows)]).astype(np.int32))) for k in range(3)]  # noqa: B023
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists, pa.array([r[3] for r in rows], pa.string())], schema=ENCODED)  # noqa: B023

            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py()
                found = pieces.encode(raw.decode("utf-8", "replace"))
                ids.append(d)
                rows.append((*found, pieces.decode(found[0].tolist())))
                size += len(raw)
                if size > HAND_ON:
                    yield out()
                    ids, rows, size = [], [], 0
            yield out()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return read.mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string")


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`text_end`: the byte of the text that the last piece's span ends at."""
    out = encode_documents(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"), F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("text_end"),
    )
