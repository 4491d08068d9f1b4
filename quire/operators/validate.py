"""Strict fields, record versions, file integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.shared import small_side


def exact_keys(json: Column, keys: list[str]) -> Column:
    """Whether a JSON object has exactly these keys."""
    found = F.json_object_keys(json)
    want = F.array(*map(F.lit, keys))
    return (F.size(F.array_except(found, want)) == 0) & (F.size(F.array_except(want, found)) == 0)


def kind(value: Column, path: str) -> Column:
    """The JSON type at a path, booleans apart from numbers."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def non_blank(text: Column) -> Column:
    return text.isNotNull() & (F.btrim(text, F.lit(" \t\r\n")) != "")


def finite(number: Column) -> Column:
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))


def strict_integer(json: Column, name: str, least: int = 1) -> Column:
    """(value, state): the integer that is a JSON object's only member; accepted from ``least`` on, no booleans or fractions."""
    v = F.try_parse_json(json)
    value = F.try_variant_get(v, f"$.{name}", "bigint")
    good = (F.json_object_keys(json) == F.array(F.lit(name))) & (kind(v, f"$.{name}") == "BIGINT") & (value >= least)
    return F.struct(value.alias("value"), F.when(good, "accepted").otherwise("rejected").alias("state"))


def record_state(records: DataFrame, versions: DataFrame) -> DataFrame:
    """Adds ``state``: current, older or unsupported, by (schema, version) against (schema, oldest, current)."""
    state = F.when(F.col("schema_version") == F.col("current"), "current").when(F.col("schema_version").between(F.col("oldest"), F.col("current")), "outdated").otherwise("unsupported")
    return records.join(small_side(versions), "schema", "left").withColumn("state", F.when(F.col("current").isNull(), "unsupported").otherwise(state)).drop("oldest", "current")


def integrity(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem) of files (path, size, sha256) that are missing, changed or not listed."""
    both = listed.select("path", F.col("size").alias("s"), F.col("sha256").alias("d"), F.lit(True).alias("l")).join(found.select("path", "size", "sha256", F.lit(True).alias("f")), "path", "full")
    problem = F.when(F.col("f").isNull(), "missing").when(F.col("l").isNull(), "unlisted").when((F.col("s") != F.col("size")) | (F.col("d") != F.col("sha256")), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def worst(states: Column) -> Column:
    """damaged > unsupported > outdated > current, of an array of states."""
    order = ["damaged", "unsupported", "outdated"]
    return reduce(lambda w, s: w.when(F.array_contains(states, s), s), order[1:], F.when(F.array_contains(states, order[0]), order[0])).otherwise("current")
