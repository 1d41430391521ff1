"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans to them.

Base spans (email, ip, card, phone) come from patterns, leftmost and non-overlapping by kind. The field works on regions: runs
of words that hold a digit or '@', or spell it out as (at) or [at], with the words that such a form joins and with words of
marks alone between them, single spaces between all; all other words are outside by definition. Within a region it
scores whole segments of at most SEGMENT tokens (runs of digits, runs of letters, single other characters) by features of the
whole span (digits, groups, separators, marks, neighbours, the word before), and a dynamic program over boundaries chooses
segments and types jointly. Base spans of a region are fixed; segments may not overlap them. A region of any length is decoded
as one: segments are scored as they come and not kept, so time and memory grow with its tokens.

The weights are trained here by maximum likelihood (forward sums over all segmentations) on written-out forms of each kind,
on counterexamples, and on at most LINES_A_DOC stretches of at most SAMPLE documents of the corpus whose base spans are the labels.

Defined results: a null text is empty and has no spans; spans count code points, end exclusive; repeated rows are judged each;
of equally good segmentations the one with the earlier cut is taken; texts may be of any length, with or without a region; columns other
than doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
SEGMENT, SAMPLE, SEED = 24, 300, 11
#: Of a training document: so many stretches around a digit or @, of at most so many characters before and behind it.
LINES_A_DOC, BEFORE, AFTER = 4, 60, 80

# The base patterns. The address pattern is run from each @, see base_spans.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") < 256


def base_spans(text: str) -> list[Span]:
    """Spans by kind as listed, then by start."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        a = at
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_octet, m.groups()))]
        for m in CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


# --- regions and segments

TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\W\d_]+|[\s\S]")
SPELLED = r"(?:[^\s(\[]+\x20)?[^\s(\[]*[(\[]at[)\]](?:\x20?[^\s(\[]+)?(?:\x20?[(\[]dot[)\]]\x20?[^\s(\[]+)*"
ITEM = rf"(?:\S*[0-9@]\S*|{SPELLED})"
ACTIVE = re.compile(rf"(?<!\S){ITEM}(?:\x20(?:[^\w\s@]+\x20)*{ITEM})*")  # starts at words only, so that a word is read a few times at most
AT, DOT = re.compile(r"@|\(at\)|\[at\]"), re.compile(r"\.|\(dot\)|\[dot\]")
CUES = {w: k for k, ws in {"phone": "tel telephone phone call mobile cell fax whatsapp sms", "email": "mail email contact write", "card": "card visa mastercard amex credit debit", "ip": "ip host server address"}.items() for w in ws.split()}
#: Digit groups in which the kinds are usually written.
FORMS = {"3-3-4": "phone", "1-3-3-4": "phone", "2-4-4": "phone", "2-3-3-3": "phone", "2-2-2-2-2": "phone", "4-4-4-4": "card", "4-6-5": "card", "4-4-4-4-3": "card"}


def regions(text: str) -> Iterator[tuple[int, int]]:
    for m in ACTIVE.finditer(text):
        yield m.span()


def _tokens(text: str, a: int, b: int) -> list[int]:
    """Boundaries of the tokens of a region, both ends included."""
    return [m.start() for m in TOKEN.finditer(text, a, b)] + [b]


def features(text: str, a: int, b: int, kind: str) -> list[str]:
    """Names of the features of text[a:b] as one span of the kind."""
    s = text[a:b]
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    n = len(digits)
    before, after = text[a - 1 : a], text[b : b + 1]
    cue = re.search(r"([A-Za-z]+)[\s:.#=-]*$", text[max(0, a - 24) : a])
    form = "-".join(str(len(g)) for g in groups) if len(groups) < 7 else "many"
    marks = re.sub(r"[0-9A-Za-z]", "", s)
    f = ["bias", f"n{n if n < 20 else 20}", f"form={FORMS.get(form, 'other')}", f"groups{min(len(groups), 6)}"]
    f += [f"starts={'digit' if s[0].isdigit() else 'letter' if s[0].isalpha() else s[0]}", f"ends={'digit' if s[-1].isdigit() else 'letter' if s[-1].isalpha() else 'mark'}"]
    f += [f"mark{c}" for c in set(marks) if c in " .()-+@_%/:,"] + ["mark other"] * any(c not in " .()-+@_%/:," for c in marks) + ["letters"] * any(c.isalpha() for c in s)
    f += ["open left"] * bool(before and (before.isalnum() or before in "+@._-/")) + ["open right"] * bool(after and (after.isalnum() or after in "@_-/" or (after in ".:," and text[b + 1 : b + 2].isdigit())))
    f += [f"cue={CUES.get(cue[1].lower(), 'none') if cue else 'none'}"]
    f += ["one kind of gap"] * (len(set(re.findall(r"(?<=[0-9])[^0-9]+(?=[0-9])", s))) <= 1)
    if kind == "card":
        f += ["luhn" if 13 <= n <= 19 and luhn(digits) else "luhn fails"] + ["issuer"] * (digits[:1] in "3456" and bool(digits))
    elif kind == "ip":
        f += ["octets"] * (len(groups) == 4 and all(map(_octet, groups)))
    elif kind == "phone":
        f += ["area code"] * bool(re.match(r"\(?[2-9][0-9]{2}\)?[ .-]", s)) + ["parentheses match"] * (s.count("(") == s.count(")") <= 1)
    else:
        f += ["address"] * bool(re.fullmatch(r"[\w.%+-]+ ?(?:@|\(at\)|\[at\]) ?[\w-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]+)+", s))
    return [f"{kind} {x}" for x in f]


def _possible(s: str) -> tuple[str, ...]:
    """The kinds that a span can be of at all."""
    if not (s[0].isalnum() or s[0] in "(+") or not s[-1].isalnum() or "\n" in s:
        return ()
    n = sum(c in "0123456789" for c in s)
    out = ("email",) if s[0] not in "(+" and AT.search(s) and DOT.search(s) else ()
    if 4 <= n <= 19 and not any(c.isalpha() for c in s):
        out += ("ip",) * (s.count(".") >= 3 and s[0].isdigit()) + ("card",) * (n >= 13 and s[0].isdigit()) + ("phone",) * (7 <= n <= 15)
    return out


class SemiCRF:
    def __init__(self, weights: dict[str, float] | None = None):
        self.w = weights or {}

    def arcs(self, text: str, cuts: list[int], fixed: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, list[str]]]:
        """(from, to, kind, features) of the possible segments of a region, by from; all other tokens are segments outside, of score 0."""
        inside = [False] * (len(cuts) - 1)
        for a, b in fixed:
            for i in range(max(0, bisect_right(cuts, a) - 1), min(bisect_left(cuts, b), len(inside))):
                inside[i] = True
        for i in range(len(cuts) - 1):
            first = text[cuts[i]]
            if inside[i] or not (first.isalnum() or first in "(+"):
                continue
            for j in range(i + 1, min(i + SEGMENT, len(cuts) - 1) + 1):
                if inside[j - 1]:
                    break
                for k in _possible(text[cuts[i] : cuts[j]]):
                    yield i, j, k, features(text, cuts[i], cuts[j], k)

    def score(self, f: list[str]) -> float:
        return sum(self.w.get(x, 0.0) for x in f)

    def decode(self, text: str, a: int, b: int, fixed: list[tuple[int, int]]) -> list[Span]:
        """The added spans of text[a:b]; fixed: base spans there, by start."""
        cuts = _tokens(text, a, b)
        best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(-np.inf, 0, "")] * (len(cuts) - 1)
        done = 0

        def settle(i: int) -> None:
            nonlocal done
            while done < i:
                best[done + 1] = max(best[done + 1], (best[done][0], done, ""))
                done += 1

        for i, j, k, f in self.arcs(text, cuts, fixed):
            s = self.score(f)
            if s > 0:
                settle(i)
                best[j] = max(best[j], (best[i][0] + s, i, k))
        settle(len(cuts) - 1)
        out, j = [], len(cuts) - 1
        while j:
            _, i, k = best[j]
            if k:
                out.append((k, cuts[i], cuts[j]))
            j = i
        return out[::-1]

    def fit(self, cases: list[tuple[str, list[Span]]], rounds: int = 60, rate: float = 0.5, decay: float = 1e-3) -> SemiCRF:
        """Maximum likelihood by gradient steps; a case is a text and its true spans."""
        names: dict[str, int] = {}
        lattices = []
        for text, gold in cases:
            wanted = {(a, b, k) for k, a, b in gold}
            for a, b in regions(text):
                cuts = _tokens(text, a, b)
                arcs = list(self.arcs(text, cuts, []))
                if arcs:
                    lattices.append((len(cuts), [(i, j, [names.setdefault(x, len(names)) for x in f], (cuts[i], cuts[j], k) in wanted) for i, j, k, f in arcs]))
        w, power = np.zeros(len(names)), np.zeros(len(names))
        flat = np.concatenate([np.array(f) for _, arcs in lattices for *_, f, _ in arcs]) if lattices else np.empty(0, int)
        sizes = np.array([len(f) for _, arcs in lattices for *_, f, _ in arcs])
        true = np.array([g for _, arcs in lattices for *_, g in arcs], float)
        for _ in range(rounds if lattices else 0):
            score = np.add.reduceat(w[flat], np.r_[0, np.cumsum(sizes)[:-1]])
            chance, at = np.zeros(len(sizes)), 0
            for n, arcs in lattices:
                s = score[at : at + len(arcs)]
                into: list[list[tuple[int, int]]] = [[] for _ in range(n)]
                for q, (i, j, _, _) in enumerate(arcs):
                    into[j].append((i, q))
                alpha = np.zeros(n)
                for j in range(1, n):
                    alpha[j] = np.logaddexp.reduce([alpha[j - 1], *(alpha[i] + s[q] for i, q in into[j])])
                beta = np.full(n, -np.inf)
                beta[-1] = 0
                for j in range(n - 1, 0, -1):
                    beta[j - 1] = np.logaddexp(beta[j - 1], beta[j])
                    for i, q in into[j]:
                        beta[i] = np.logaddexp(beta[i], beta[j] + s[q])
                for q, (i, j, _, _) in enumerate(arcs):
                    chance[at + q] = np.exp(alpha[i] + s[q] + beta[j] - alpha[-1])
                at += len(arcs)
            g = np.bincount(flat, np.repeat(true - chance, sizes), len(w)) - decay * w * len(lattices)
            power += g * g
            w += rate * g / np.sqrt(power + 1e-8)
        self.w = {x: float(w[i]) for x, i in names.items()}
        return self


def written_cases(n: int = 220, seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """Texts with written-out personal data in usual forms, and with numbers that are none."""
    rng = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdeghilmnoprstu"), rng.integers(2, 8)))
    octet = lambda: str(rng.integers(0, 256))

    def card() -> str:
        body = str(rng.integers(3, 7)) + d(14)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def spaced(s: str, gap: str) -> str:
        return gap.join(s[i : i + 4] for i in range(0, len(s), 4))

    area = lambda: str(rng.integers(2, 10)) + d(2)
    kinds = {
        "phone": [lambda: f"({area()}) {d(3)}-{d(4)}", lambda: f"{area()}-{d(3)}-{d(4)}", lambda: f"{area()}.{d(3)}.{d(4)}", lambda: f"+1 ({area()}) {d(3)}-{d(4)}", lambda: f"+{d(2)} {d(3)} {d(3)} {d(3)}", lambda: f"1-{area()}-{d(3)}-{d(4)}"],
        "email": [lambda: f"{word()}.{word()}@{word()}.com", lambda: f"{word()}{d(2)}@{word()}.example.org", lambda: f"{word()}_{word()}@{word()}.{word()}.net", lambda: f"{word()}.{word()} (at) {word()} (dot) com", lambda: f"{word()}{d(2)} [at] {word()}.org"],
        "card": [lambda: card(), lambda: spaced(card(), " "), lambda: spaced(card(), "-")],
        "ip": [lambda: ".".join(octet() for _ in range(4))],
    }
    none = [lambda: f"20{d(2)}-0{rng.integers(1, 10)}-{rng.integers(10, 29)}", lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"{d(4)}-{d(4)}", lambda: f"{d(5)}-{d(2)}", lambda: d(int(rng.integers(1, 24))), lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"{d(3)},{d(3)},{d(3)}", lambda: f"{d(2)} {d(3)} {d(2)}", lambda: f"{d(3)}.{d(3)}.{d(3)}.{d(3)}.{d(3)}", lambda: f"{d(3)} {d(3)} {d(4)} {d(3)} {d(4)}", lambda: f"{d(4)} {d(4)}", lambda: f"#{d(7)}", lambda: f"id{d(10)}", lambda: f"{d(7)}", lambda: f"{d(8)}", lambda: f"{d(9)}", lambda: f"{d(10)}", lambda: f"{d(12)}", lambda: spaced(d(16), " "), lambda: f"@{word()}{d(2)}", lambda: f"{d(2)}.{d(4)}, {d(3)}.{d(4)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"/{word()}/{d(3)}-{d(3)}-{d(4)}x", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{word()} (at) {word()}. {word()}"]
    out = []
    for _ in range(n):
        for k, forms in kinds.items():
            for form in forms:
                lead, tail = f"{word()} " * int(rng.integers(0, 3)), rng.choice([".", ",", "", " " + word(), "\n"])
                s = form()
                out.append((f"{lead}{s}{tail}", [(k, len(lead), len(lead) + len(s))]))
        out += [(f"{word()} {x()} {word()}", []) for x in none]
    keep = rng.permutation(len(out))[: 6 * n]
    return [out[i] for i in keep]


def train(docs: DataFrame, sample: int = SAMPLE, lines: int = LINES_A_DOC, before: int = BEFORE, after: int = AFTER) -> SemiCRF:
    """Train on written-out cases and on at most `sample` documents with digits: of each the first `lines` stretches around a digit or @, with up to
    `before` characters in front and `after` behind, labelled by the base patterns. These bound what reaches the driver for training; prediction reads whole texts."""
    able = docs.where(F.col("text").rlike("[0-9@]"))
    ids = able.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    rows = able.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", F.slice(F.regexp_extract_all("text", F.lit(rf"([^\n]{{0,{before}}}[0-9@][^\n]{{0,{after}}})"), F.lit(1)), 1, lines).alias("lines")).collect()
    cases = [(line, base_spans(line)) for r in sorted(rows, key=lambda r: (r["doc_id"], r["lines"])) for line in r["lines"]]
    return SemiCRF().fit(written_cases() + cases)


def spans_of(text: str, model: SemiCRF) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: those and what the model adds outside of them."""
    base = base_spans(text)
    if not AT.search(text) and not DIGIT.search(text):
        return base, base
    added: list[Span] = []
    taken = sorted((a, b) for _, a, b in base)
    at = 0
    for a, b in regions(text):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        fixed = []
        for i in range(at, len(taken)):
            if taken[i][0] >= b:
                break
            fixed.append(taken[i])
        added += model.decode(text, a, b, fixed)
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, model: SemiCRF) -> DataFrame:
    """doc_id, counts of base spans by kind, base and spans (written kind:start:end) of each of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model.w)  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = SemiCRF(held.value)
        for batch in batches:
            counts, base, spans = [], [], []
            for text in batch.column(1).to_pylist():
                b, s = spans_of(text or "", crf)
                counts.append([sum(x[0] == k for x in b) for k in KINDS])
                base.append(hashlib.sha256(digest(b).encode()).hexdigest())
                spans.append(digest(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(base, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_personal_data(docs, train(docs))
