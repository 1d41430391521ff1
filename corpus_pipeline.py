"""A training-data pipeline over `documents`: STAGES in order, each written as Parquet and reread as the next one's input.

language_id drops documents without a recognised language: those without a letter, those whose letter pairs are mostly unfamiliar (below MIN_FAMILIAR; other scripts,
random letters: a probability over the learned languages cannot tell these), and those of a mean window probability below MIN_SCORE; none where no document is
labelled, so that nothing could be learned;
line_dedup rewrites the texts without the repeated lines (and n_chars with them); near_dedup keeps one document of each group
of near duplicates, whose shingles are NEAR percent alike or more; decontaminate drops documents that hold a benchmark passage; packing returns the pieces of the sequences.
The last stage has no SQL form, as it runs a tokenizer.

Defined results: a document with a null or letterless text goes in the first stage (where a language could be learned); null ids are kept, and
never near duplicates; a repeated row is a document of its own until near_dedup, which keeps repeated rows of a kept document, and
packs each of them; of copies the least doc_id stays, so there are no ties; further columns of documents go along untouched,
whatever their names; an empty table gives no pieces. Texts may be of any length. What a stage wrote for itself is deleted when its
result is written, and that result when the next one is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.llm.common import forget, mark, release, save, table
from pressmill.llm.decontaminate import find_items
from pressmill.llm.language_id import identify, train
from pressmill.llm.line_dedup import dedup_lines
from pressmill.llm.near_dedup import near_components
from pressmill.llm.packing import pack_documents

MIN_SCORE, MIN_FAMILIAR, NEAR = 0.3, 0.5, 80
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs)
    if model is None:
        return docs
    found = identify(docs, model, with_familiar=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE) & (F.col("familiar") >= MIN_FAMILIAR)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs)
    new = {"text": F.when(F.col("row.text").isNull() & (F.col("kept") == ""), F.lit(None)).otherwise(F.col("kept")), "n_chars": F.char_length("kept").cast("long")}
    return out.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a doc_id that its component does not keep go."""
    gone = save(near_components(docs, percent=NEAR).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return find_items(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = mark(spark)
        out = save(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, but=before | {out._pressmill_path})
        forget(docs)
        docs = out
    return docs
