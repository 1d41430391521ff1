"""For work that is large for the bytes it reads: every column worked out once, and rows dealt out whatever their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each worked out once a row. A filter or another column that uses them does not bring a copy of their expression with it, as
    it would from a projection; they do not see one another."""
    return df.select("*", F.inline_outer(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def spread(df: DataFrame, times: int = 4) -> DataFrame:
    """Rows dealt out to some tasks a core. A table of few bytes is one split, and a small shuffle is drawn together, however long its rows take."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * times)
