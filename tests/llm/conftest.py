import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A function that writes documents and benchmark rows as the tables of a folder."""

    def write(docs, bench=(), schema=DOCS, conversations=()):
        at = tmp_path_factory.mktemp("tables")
        spark.createDataFrame(list(docs), schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(list(bench), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        spark.createDataFrame(list(conversations), "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
        return str(at)

    return write


LONG = " ".join(f"word{i}" for i in range(60))
HARD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, "one", "en", "s", 3),
    (4, LONG, "en", "s", len(LONG)),
    (5, LONG, None, "s", len(LONG)),
    (6, LONG + "\n" + "x" * 3000 + "\n\n " + LONG.upper(), "en", "s", None),
    (7, "日本語のテキスト 😀 é", "ja", "s", 16),
    (8, "!!! 123 ###", "en", "s", 11),
    (None, LONG, "en", "s", 1),
    (9, "a b@c.de 10.0.0.1 +1 (555) 123-4567", "en", "s", 1),
    (9, "a b@c.de 10.0.0.1 +1 (555) 123-4567", "en", "s", 1),
    (10, " ".join(f"tok{i % 7}" for i in range(30000)), "en", "s", 1),
]


@pytest.fixture(scope="session")
def hard(tables):
    return tables(HARD, [(1, LONG[:200]), (2, None), (3, "one"), (None, "tok1 tok2")], conversations=[(1, 0, "user", "hi"), (1, 1, None, None), (None, 0, "user", "x\n\ny"), (2, None, "assistant", "z"), (2, None, "assistant", "z")])


@pytest.fixture(scope="session")
def empty(tables):
    return tables([])
