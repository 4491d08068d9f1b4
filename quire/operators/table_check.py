"""Tables read twice: which reading to keep, and whether readings agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a number as tables print it, without its sign.
NUMBER = r"\d+(?:[.,]\d+)*"


def numbers(body: Column) -> Column:
    """The numbers of a table's text, sorted, repeats kept; none for null."""
    return F.array_sort(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(NUMBER), F.lit(0)))


def choose_reading(native: Column, ocr: Column, lost_glyphs: Column) -> Column:
    """(body, alternative, outcome) of a table read natively and again from its picture.

    The second reading is taken where the first has lost glyphs and both hold the same numbers; the first
    then stays as the alternative. Otherwise the first is kept: ``kept`` without lost glyphs, ``unread``
    without a second reading, ``differs`` where numbers do.
    """
    outcome = F.when(~F.coalesce(lost_glyphs, F.lit(False)), "kept").when(ocr.isNull(), "unread").when(numbers(native) == numbers(ocr), "replaced").otherwise("differs")
    taken = outcome == "replaced"
    return F.struct(F.when(taken, ocr).otherwise(native).alias("body"), F.when(taken, native).alias("alternative"), outcome.alias("outcome"))


def cross_check(tables: DataFrame, reference: DataFrame, pairs: DataFrame) -> DataFrame:
    """(table_id, reference_id, outcome) of tables (table_id, body) and independent ones (reference_id, body).

    ``pairs`` (table_id, reference_id) matches them one to one. Matched tables are AGREED where their numbers
    are the same with repeats, else DISAGREED; a table alone is UNMATCHED, a reference alone EXTRA.
    """
    left = tables.select("table_id", numbers(F.col("body")).alias("_left")).join(pairs, "table_id", "left")
    right = reference.select(F.col("reference_id").alias("_other"), numbers(F.col("body")).alias("_right"))
    found = left.join(right, F.col("reference_id") == F.col("_other"), "full_outer")
    outcome = F.when(F.col("table_id").isNull(), "EXTRA").when(F.col("_other").isNull(), "UNMATCHED").when(F.col("_left") == F.col("_right"), "AGREED").otherwise("DISAGREED")
    return found.select("table_id", F.col("_other").alias("reference_id"), outcome.alias("outcome"))
