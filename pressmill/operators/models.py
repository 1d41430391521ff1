"""Calls of an outside model over a table: one client a partition, prompts in batches, bounded retries, an error column, fallbacks.

The client is made where the rows are (a factory travels, connections do not) and gets lists of prompts. A list that fails is tried again, each time after a longer
pause, and if it fails for good its prompts are asked one by one, so that one bad prompt costs one row. A row without a prompt is not asked about. Calls
are made once a task; a task that is run again asks again, so what must be paid for once is saved before it is used further.

Defined results: every row comes back once, its columns untouched (of ask(), in `row`); `answer` and `error` are both null for a null prompt; a client that gives another number of
answers than it got prompts, or anything but texts and nulls, has failed; a null answer is no error; an empty table makes no client.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import json_object

Client = Callable[[list[str]], Sequence[str | None]]
BATCH, ATTEMPTS, PAUSE, LONGEST_ERROR = 16, 3, 0.5, 500
#: Batches of prompts whose rows go on together.
GROUPS = 16


def _asked(client: Client, prompts: list[str], attempts: int, pause: float) -> Sequence[str | None]:
    """The client's answers, or what its last attempt raised."""
    for attempt in range(attempts):
        try:
            answers = client(prompts)
            if len(answers) != len(prompts) or not all(a is None or isinstance(a, str) for a in answers):
                raise ValueError(f"{len(prompts)} prompts need as many texts as answers")
            return answers
        except Exception:
            if attempt + 1 == attempts:
                raise
            time.sleep(pause * (attempt + 1))
    raise ValueError("no attempt is allowed")


def answered(client: Client, prompts: list[str], attempts: int, pause: float) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each prompt."""
    try:
        return [(a, None) for a in _asked(client, prompts, attempts, pause)]
    except Exception as e:
        if len(prompts) == 1:
            return [(None, f"{type(e).__name__}: {e}"[:LONGEST_ERROR])]
        return [r for p in prompts for r in answered(client, [p], 1, pause)]


def _caller(factory: Callable[[], Client], batch: int, attempts: int, pause: float) -> Callable[[pa.Array], Iterator[tuple[int, int, pa.Array, pa.Array]]]:
    """(start, stop, answers, errors) of an array of prompts, group by group in their order. The client is made at the first prompt."""
    client = None

    def groups(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array, pa.Array]]:
        nonlocal client
        start, at = 0, [i for i, there in enumerate(texts.is_valid().to_pylist()) if there]
        for s in range(0, max(len(at), 1), batch * GROUPS):  # only so many answers are held besides the rows
            here = at[s : s + batch * GROUPS]
            stop = at[s + len(here)] if s + len(here) < len(at) else len(texts)
            got: list[tuple[str | None, str | None]] = [(None, None)] * (stop - start)
            if here and client is None:
                client = factory()
            for g in range(0, len(here), batch):
                some = here[g : g + batch]
                for i, r in zip(some, answered(client, texts.take(pa.array(some)).to_pylist(), attempts, pause), strict=True):
                    got[i - start] = r
            yield start, stop, pa.array([a for a, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())
            start = stop

    return groups


def ask(df: DataFrame, prompt: Column, factory: Callable[[], Client], batch: int = BATCH, attempts: int = ATTEMPTS, pause: float = PAUSE) -> DataFrame:
    """row (all columns of df), answer, error. Whole rows go through Python, and every prompt is asked, whatever is read of the result."""
    packed = df.select(F.struct(*_own(df)).alias("row"), prompt.cast("string").alias("prompt"))
    schema = T.StructType([packed.schema["row"], T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _caller(factory, batch, attempts, pause)
        for rows in batches:
            for start, stop, answers, errors in groups(rows.column(1)):
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(start, stop - start), answers, errors], names=["row", "answer", "error"])
            del rows  # before the next ones are read

    return packed.mapInArrow(run, schema)


def reply(prompt: Column, factory: Callable[[], Client], batch: int = BATCH, attempts: int = ATTEMPTS, pause: float = PAUSE) -> Column:
    """(answer, error) of a prompt, as ask() gives them, for a select(). Prompts alone go through Python, and rows stay where they are; what is not read is not asked."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        groups = _caller(factory, batch, attempts, pause)
        for texts in batches:
            for _, _, answers, errors in groups(texts):
                yield pa.StructArray.from_arrays([answers, errors], names=["answer", "error"])
            del texts  # before the next ones are read

    # not deterministic, so that a filter on the answer does not ask a second time
    return F.arrow_udf(run, "struct<answer: string, error: string>").asNondeterministic()(prompt.cast("string"))


#: What a reader gets where the model fails, and what says that there is no trend.
FALLBACK_INSIGHT = "このニュースは農業とテクノロジーの融合における新たな可能性を示しています。"
FALLBACK_QUESTIONS = ["このアプローチは皆さんの現場でどう活用できそうですか？", "実装における課題や懸念点はありますか？", "5年後、この技術はどのように進化していると思いますか？"]
FALLBACK_SUMMARY = "記事の詳細はリンクをご覧ください。"
NO_TREND = "トレンドキーワードなし"
TRANSLATION = "titleJa string, summary string, keyPoints array<string>, implications string, technicalTerms map<string, string>"
INSIGHT = "insight string, questions array<string>"
GUIDE = "summary string, keyPoints array<string>, actionable string, facts array<string>, evidence array<string>"


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts))


def _own(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def _replied(df: DataFrame, prompt: Column, factory: Callable[[], Client], **calls) -> DataFrame:
    return df.select(*_own(df), reply(prompt, factory, **calls).alias("_reply"))


def translated(articles: DataFrame, factory: Callable[[], Client], least: int = 200, **calls) -> DataFrame:
    """articles (title, body, snippet, ...): those that a model has translated, with `translation`. A body that is missing gives way to the snippet; texts under
    `least` characters are not asked about; what fails or cannot be read goes."""
    content = F.coalesce(F.nullif("body", F.lit("")), F.col("snippet"), F.lit(""))
    prompt = F.when(F.char_length(content) >= least, _text("Translate and summarise as JSON.\n", F.col("title"), "\n", content))
    out = _replied(articles, prompt, factory, **calls)
    return out.select(*_own(articles), json_object(F.col("_reply.answer"), TRANSLATION).alias("translation")).where("translation IS NOT NULL")


def with_insight(articles: DataFrame, trend: Column, factory: Callable[[], Client], **calls) -> DataFrame:
    """articles (title, snippet, ...) with `insight` (a text and questions) and `error`. The trend goes before the prompt where there is one; a failure, or an
    answer that is no JSON, gives the fallback."""
    context = F.when(trend != NO_TREND, _text("Trend of the last days: ", trend, "\n")).otherwise("")
    out = _replied(articles, _text(context, "Give an insight and questions as JSON.\n", F.col("title"), "\n", F.col("snippet")), factory, **calls)
    own = json_object(F.col("_reply.answer"), INSIGHT)
    canned = F.struct(F.lit(FALLBACK_INSIGHT).alias("insight"), F.array(*map(F.lit, FALLBACK_QUESTIONS)).alias("questions"))
    return out.select(*_own(articles), F.coalesce(own, canned).alias("insight"), "_reply.error")


def with_guide_summary(items: DataFrame, factory: Callable[[], Client], longest: int = 3000, **calls) -> DataFrame:
    """items (title, body, ...) with `guide` (null where the model failed), and `summary`, which is then the fallback. The first `longest` characters are sent; items
    without a body are not asked about."""
    body = F.nullif("body", F.lit(""))
    prompt = F.when(body.isNotNull(), _text("Summarise as JSON what the text says.\n", F.col("title"), "\n", F.substring(body, 1, longest)))
    out = _replied(items, prompt, factory, **calls)
    guide = json_object(F.col("_reply.answer"), GUIDE)
    return out.select(*_own(items), guide.alias("guide")).withColumn("summary", F.coalesce(F.nullif("guide.summary", F.lit("")), F.lit(FALLBACK_SUMMARY)))
