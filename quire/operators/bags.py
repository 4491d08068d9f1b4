"""Multisets as long frames (key..., value, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in a table's cells: no sign; a point or comma only between digits.
NUMBER = r"\d+(?:[.,]\d+)*"


def printed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, value, n): each number as printed in each key's texts, a row of n = 1 each time: a multiset that isn't counted yet."""
    return rows.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(NUMBER), F.lit(0))).alias("value"), F.lit(1).cast("long").alias("n"))


def numbers(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, value, n): how often each number, as printed, occurs in each key's texts."""
    return printed(rows, key, text).groupBy(key, "value").agg(F.count(F.lit(1)).alias("n"))


def compare(left: DataFrame, right: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """(key, shared, only_left, only_right): sizes of the multisets' intersection and differences; a null key or value equals none.

    Both sides are counted together, so a value's rows on either side, counted before or not, meet by one grouping and no join. With ``parts``
    the rows are dealt by key into as many, once: a task then holds its part's distinct values, however large the tables are.
    """
    zero = F.lit(0).cast("long")
    both = left.select(key, "value", F.col("n").alias("_l"), zero.alias("_r")).unionByName(right.select(key, "value", zero.alias("_l"), F.col("n").alias("_r")))
    both = both.repartition(parts, key) if parts else both
    counted = both.groupBy(key, "value").agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    shared = F.when(F.col(key).isNotNull() & F.col("value").isNotNull(), F.least("_l", "_r")).otherwise(zero)
    return counted.groupBy(key).agg(F.sum(shared).alias("shared"), F.sum(F.col("_l") - shared).alias("only_left"), F.sum(F.col("_r") - shared).alias("only_right"))


def samples(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """(key, samples): the k smallest values of each key, comma-joined."""
    return rows.groupBy(key).agg(F.array_join(F.slice(F.array_sort(F.collect_set(value)), 1, k), ",").alias("samples"))
