"""Source divergence, subword pieces and spelling variants against SQL, the installed library and brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pressmill.llm import divergence, pieces, variants
from pressmill.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


# --- divergence of sources


def test_divergence_of_nulls_ties_and_bare_groups(same_as_sql, tables):
    rng = random.Random(3)
    words = ["alpha", "Alpha", "beta", "émile", "ÉMILE", "日本", "x" * 300, "b-c", "gamma9delta"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None, ""]), 1) for i in range(200)]
    docs += [(None, None, "en", "empty", None), (7, "", "fr", "only", 0), (8, "rare words here", "fr", "other", 1), (9, "!!! 123", None, "digits", 1)]
    docs += docs[:20]  # repeated rows are documents of their own
    got = same_as_sql(QUERIES["op11_divergence"], ORACLES["op11_divergence"], tables(docs))
    bare = got[(got.lang == "fr")]
    assert list(bare.value) == [0, 0] and set(bare.part) == {"pair"}  # two sources, no term kept
    assert {"empty", "digits"} <= set(got[got.part == "pair"].source)


def test_partial_counts_add_up(monkeypatch):
    texts = [f"word{i % 50} other w{'a' * (i % 7)}".encode() for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 2000), pa.array([f"s{i % 3}" for i in range(2000)]), pa.array(texts, pa.binary())], names=["lang", "source", "text"])

    def total():
        n, docs = Counter(), Counter()
        parts = 0
        for out in divergence._count(iter([batch])):
            parts += 1
            for r in out.to_pylist():
                n[r["source"], r["term"]] += r["n"]
                docs[r["source"], r["term"]] += r["docs"]
        return parts, n, docs

    whole = total()
    monkeypatch.setattr(divergence, "LOOK", 500)
    monkeypatch.setattr(divergence, "MOST_ENTRIES", 5)
    small = total()
    assert small[0] > 10 * whole[0] and small[1:] == whole[1:]


# --- subword pieces


@pytest.fixture(scope="module")
def models():
    """The public model, and the same with a compiled character map, squeezed spaces and a space at the end."""
    import sentencepiece

    data = open(pieces.default_model(), "rb").read()

    def field(number, value):
        size, n = b"", len(value)
        while True:
            size += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return bytes([number << 3 | 2]) + size + value

    def flag(number, on):
        return bytes([number << 3, on])

    parts = [(f, v) for f, v in pieces._fields(data) if isinstance(v, bytes)]
    body = b"".join(field(f, v) for f, v in parts if f != 3)
    rules = dict(pieces._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]
    table = dict(pieces._fields(rules))[2]
    out = {"identity": data}
    for squeeze in (0, 1):
        for prefix in (0, 1):
            out[f"map-{squeeze}{prefix}"] = body + field(3, field(1, b"own") + field(2, table) + flag(3, prefix) + flag(4, squeeze))
    out["squeezed"] = body + field(3, field(1, b"identity") + flag(3, 1) + flag(4, 1))
    return {k: (pieces.PieceModel(v), sentencepiece.SentencePieceProcessor(model_proto=v)) for k, v in out.items()}


HARD_TEXTS = ["", "a", " ", "  a  b ", "\n\n x", "日本語のテキスト 😀 é", "▁a ▁", "<s> <0x0A> </s>", "\x00a\x00", "a　b\t\tc", "x" * 3000, " " * 50, "é" * 300 + "ß ő", "ﬁ ①② ｱｲｳ ﾊﾟ ㍿ é  ​ z", "½ Å K ＡＢ", "▁"]


@pytest.mark.parametrize("name", ["identity", "map-00", "map-01", "map-10", "map-11", "squeezed"])
def test_pieces_and_spans_of_the_library(models, texts, name):
    own, library = models[name]
    rng = random.Random(1)
    alphabet = "ab cdefg   \n\tXYZ0123,.é日本😀▁́ñﬁ①ｱﾞ ​Å½"
    for text in HARD_TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)] + [t or "" for t in texts[:100]]:
        ids, starts, ends = own.encode(text)
        want = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in want], (name, text[:60])
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(p.begin, p.end) for p in want], (name, text[:60])
        assert own.decode(ids.tolist()) == library.decode(ids.tolist())


def test_decoding_of_any_ids(models):
    rng = random.Random(2)
    for name in ("identity", "map-11"):
        own, library = models[name]
        for _ in range(500):
            ids = [rng.choice([rng.randrange(32000), rng.randrange(260)]) for _ in range(rng.randrange(8))]
            assert own.decode(ids) == library.decode(ids)


def test_kept_chunks_change_nothing(models, texts, monkeypatch):
    own, _ = models["identity"]
    monkeypatch.setattr(pieces, "KEPT", 0)
    bare = pieces.PieceModel(open(pieces.default_model(), "rb").read())
    for t in texts[:20]:
        assert all(np.array_equal(a, b) for a, b in zip(own.encode(t or ""), bare.encode(t or ""), strict=True))
    assert not bare.kept


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.PieceModel(b"")


def test_pieces_query(spark, sf, models, hard):
    import hashlib

    _, library = models["identity"]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for at in (sf, hard):
        docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
        rows = QUERIES["op12_pieces"](spark, at).collect()
        assert {r["doc_id"] for r in rows} == set(docs)
        for r in rows:
            ids = library.encode(docs[r["doc_id"]])
            want = (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)), len(docs[r["doc_id"]].encode()))
            assert tuple(r[c] for c in ("n_tokens", "ids_sha256", "decoded_sha256", "text_end")) == want


# --- spelling variants


def neighbours(word, alphabet):
    at = range(len(word) + 1)
    near = {word[:i] + word[i + 1 :] for i in at} | {word[:i] + a + word[i + 1 :] for i in at[:-1] for a in alphabet} | {word[:i] + a + word[i:] for i in at for a in alphabet}
    return near - {word}


def brute_variants(docs):
    n = Counter()
    for d, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.encode().lower().decode()
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    alphabet = {c for w in n for c in w}
    form, count = {}, {}
    for w in n:
        near = [x for x in neighbours(w, alphabet) if x in n]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w], count[w] = best if best and n[best] >= 2 * n[w] else None, len(near)
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, n[w], count[w], form[w], n[form[w]] if form[w] else None, root))
    return sorted(rows, key=str)


def in_order(frame):
    return sorted((tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in frame.collect()), key=str)


def test_variants_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert in_order(QUERIES["op13_variants"](spark, sf)) == brute_variants(docs)


def test_variants_of_chains_ties_accents_and_long_words(spark, tables):
    rng = random.Random(5)
    base = ["aaaaa", "aaaaab", "aaaab", "abcde", "abcdé", "ÀÿÖ×÷", "colour", "color", "colours", "y" * 700, "y" * 699]
    docs = [(rng.choice([None, *range(40)]), " ".join(w for w in base for _ in range(rng.choice([0, 1, 2, 4]))), "en", "s", 1) for _ in range(60)]
    chain = [("longword" + "x" * i, 3 * 2**i) for i in range(9)]  # each form is twice as frequent as the one before
    docs += [(100 + i, " ".join([w] * n), None, None, 1) for i, (w, n) in enumerate(chain)] + [(999, None, None, None, None), (999, "", None, None, None)]
    docs += docs[:10]
    got = in_order(variants.variants(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")))
    assert got == brute_variants([d[:2] for d in docs])
    assert max(len(r[5]) - len(r[0]) for r in got if r[0].startswith("longword")) >= 6
    tight = variants.variants(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), most_log_bits=10)
    assert in_order(tight) == got  # a crowded filter only costs work


def test_every_neighbour_once():
    words, alphabet = ["aabba", "aaaaa", "abcab", "éabab", "bbbbbb"], "abcé"
    all_pass = variants.Filter(np.full(1 << 7, 255, np.uint8), 10)
    got = list(variants.near_strings(words, alphabet, all_pass))
    assert len(got) == len(set(got))
    for w in words:
        assert {n for x, n in got if x == w} == neighbours(w, alphabet)


def test_hashes_of_neighbours_are_those_of_words():
    words, alphabet = ["aabba", "abcab", "éabab", "zz" * 40], "abcéz"
    log_bits = 20
    for w in words:
        for n in neighbours(w, alphabet):
            table = np.zeros(1 << (log_bits - 3), np.uint8)
            for _, raw in variants._by_length([n]):
                for p in range(len(variants.PROBES)):
                    bit = variants._bits(variants.hashed(raw)[1][:, -1], p, log_bits)
                    np.bitwise_or.at(table, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
            assert (w, n) in set(variants.near_strings([w], alphabet, variants.Filter(table, log_bits)))


def test_partial_word_counts_add_up(monkeypatch):
    texts = [f"Words{'x' * (i % 9)} again, more words é{'b' * (i % 5)}éé".encode() for i in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(500)]), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    total = lambda: sum((Counter({r["word"]: r["n"] for r in b.to_pylist()}) for b in variants._count(iter([batch]))), Counter())
    whole = total()
    monkeypatch.setattr(variants, "LOOK", 300)
    monkeypatch.setattr(variants, "MOST_ENTRIES", 3)
    assert total() == whole
