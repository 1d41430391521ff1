"""The pipeline against a plain version of its stages."""

import random
import re
from collections import defaultdict

import corpus_pipeline
from pressmill.llm.language_id import identify, train


def test_stages_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    langs = {r["row"]["doc_id"]: (r["lang_pred"], r["score"], r["familiar"]) for r in identify(docs, train(docs), with_familiar=True).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    text = {d: t for d, t in text.items() if langs[d][0] != "und" and langs[d][1] >= corpus_pipeline.MIN_SCORE and langs[d][2] >= corpus_pipeline.MIN_FAMILIAR}
    assert len(text) > 0.95 * len(langs)
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    for d, t in text.items():
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(d)
    text = {d: "\n".join(x for x in t.split("\n") if len(holders[key(x)]) < 5 or max(holders[key(x)]) == d) for d, t in text.items()}
    from test_operators import brute_components

    root, _ = brute_components(text, corpus_pipeline.NEAR)
    text = {d: t for d, t in text.items() if root[d] == d}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower().decode())
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    text = {d: t for d, t in text.items() if not any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in sizes for i in range(len(w)))}
    from pressmill import work

    before = work.mark(spark)
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert set(out.doc_id) == set(text)
    assert len(work.mark(spark) - before) == 1  # the result alone
    work.release(spark, but=before)
    assert work.mark(spark) == before
    from pressmill.llm import packing

    encode = packing.encoder(open(packing.default_tokenizer(), "rb").read())
    assert dict(out.groupby("doc_id").length.sum()) == {d: len(encode(t)) + 1 for d, t in text.items()}


def test_nothing_learned_drops_nothing(spark, tables):
    at = tables([(i, text, None, "s", 1) for i, text in enumerate(["some words of a text", "other words", None])])
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert sorted(corpus_pipeline.language_id(spark, docs, at).collect()) == sorted(docs.collect())


def test_unlearned_languages_go_and_labelled_documents_stay(spark, sf):
    rng = random.Random(1)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    junk = [text("bcdfghjklmnpqrstvwxz ", rng.randrange(60, 400)) for _ in range(60)] + [text("абвгдежзиклмнопрстуфхцчшщыэюя ", 100) for _ in range(20)] + [text([chr(c) for c in range(0x3041, 0x3097)], 80) for _ in range(20)]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(10**6 + i, t, None, "junk", len(t)) for i, t in enumerate(junk)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionAll(more), sf).collect()}
    assert len([d for d in kept if d >= 10**6]) <= 5
    labelled = {r["doc_id"] for r in docs.where("lang IS NOT NULL AND text RLIKE '[A-Za-z]'").collect()}
    assert len(labelled - kept) <= 0.01 * len(labelled)
