import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def plain(value):
    if value is None or str(value) in ("nan", "NaT", "<NA>"):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if type(value).__name__ in ("int", "int32", "int64", "float", "float64"):
        return round(float(value), 9)
    return str(value)


def rows_of(frame, columns):
    return sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compare a query with its SQL over the tables of a folder."""
    import duckdb

    def check(query, sql, folder):
        got = query(spark, folder).toPandas()
        con = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
        want = con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        assert rows_of(got, columns) == rows_of(want, columns)
        return got

    return check
