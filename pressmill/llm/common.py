"""What the corpus operators share: work tables, row keys and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..work import forget, mark, release, save, save_bucketed, table, work_dir

__all__ = ["ascii_lower", "columns", "components", "forget", "let", "mark", "release", "save", "save_bucketed", "table", "work_dir"]

ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def columns(df: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII strings take the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable stands for it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def components(edges: DataFrame, tag: str = "components", most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) for each node that has an edge to another; root is the
    least node of the component. Alternating large-star and small-star rounds; every round is a saved table of edges, so
    nothing is collected but its count and checksum."""
    e = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    mark = None
    for _ in range(most_rounds):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.u", "s.v").where("u <> v").distinct()
        after = save(small, tag)
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(e)
        e = after
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
