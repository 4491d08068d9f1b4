"""A library's folder as frames: papers' records, stored registry responses, settings, the ledger of model calls."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A paper's records, by the column of ``papers`` that holds their text.
RECORDS = {"manifest": "manifest.json", "metadata": "metadata.json", "validation": "validation.json", "extraction": "extraction.json", "document": "document.json", "bibtex": "citation.bib"}
#: Where a library keeps what isn't a paper.
PRIVATE = "."
RESPONSES = "url string, provider string, doi string, query string, status int, retrieved_utc string, body string"
LEDGER = "at string, figure string, model string, input_tokens long, output_tokens long, usd double"


def _files(spark: SparkSession, library: str, name: str) -> DataFrame:
    """(directory, content) of the files ``name`` in the library's folders, and in folders one level deeper."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(library)
    root = library.rstrip("/").rsplit("/", 1)[-1]
    inside = F.substring_index(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), f"/{root}/", -1)
    directory = F.regexp_replace(inside, r"/[^/]+$", "")
    depth = F.size(F.split(directory, "/"))
    return read.select(directory.alias("directory"), F.decode("content", "UTF-8").alias("content")).where((depth <= 2) & ~F.concat(F.lit("/"), directory).contains(f"/{PRIVATE}") & (F.col("directory") != name))


def paper_directories(spark: SparkSession, library: str) -> DataFrame:
    """(directory) of the library's papers: folders with a manifest, at the top or in a shard's folder, in order.

    A folder that is a paper itself isn't looked into for others; hidden folders are passed over.
    """
    found = _files(spark, library, RECORDS["manifest"]).select("directory")
    top = found.where(~F.col("directory").contains("/")).select(F.col("directory").alias("shard"))
    return found.join(top, F.substring_index("directory", "/", 1) == F.col("shard"), "left").where(F.col("shard").isNull() | (F.col("directory") == F.col("shard"))).select("directory").orderBy("directory")


def papers(spark: SparkSession, library: str) -> DataFrame:
    """The library's papers with the texts of their records, as ``catalog.catalog_rows`` takes them; null where one is missing."""
    out = paper_directories(spark, library)
    for column, name in RECORDS.items():
        out = out.join(_files(spark, library, name).select("directory", F.col("content").alias(column)), "directory", "left")
    return out


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Stored answers of registries, the latest of each address."""
    rows = spark.read.schema(RESPONSES).json(path)
    return rows.groupBy("url").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "url")), "retrieved_utc").alias("r")).select("url", "r.*")


def store_responses(rows: DataFrame, path: str) -> None:
    """Add answers to those stored; none is ever changed."""
    rows.select(*(c.split()[0] for c in RESPONSES.split(", "))).write.mode("append").json(path)


def record_spending(calls: DataFrame, path: str) -> None:
    """Add model calls to the ledger, which is only ever appended to."""
    calls.select(*(c.split()[0] for c in LEDGER.split(", "))).write.mode("append").json(path)


def spending(spark: SparkSession, path: str) -> DataFrame:
    """(model, calls, usd) of a ledger."""
    return spark.read.schema(LEDGER).json(path).groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("usd").alias("usd"))


def settings(defaults: Mapping[str, object], user_file: str | None = None, given_file: str | None = None, options: Mapping[str, object] | None = None) -> dict[str, tuple[object, str]]:
    """Each setting's value and origin: an option goes before the given file, the user's file and the default.

    Files are TOML. A setting that the defaults don't know, or one of another type, stops the reading.
    """
    layers: list[tuple[str, Mapping[str, object]]] = [("default", defaults)]
    for origin, path in (("user", user_file), ("file", given_file)):
        if path is not None and (origin == "file" or os.path.exists(path)):
            with open(path, "rb") as source:
                layers.append((origin, tomllib.load(source)))
    layers.append(("option", {k: v for k, v in (options or {}).items() if v is not None}))
    found: dict[str, tuple[object, str]] = {}
    for origin, layer in layers:
        for name, value in layer.items():
            if name not in defaults:
                raise ValueError(f"{origin}: unknown setting {name!r}")
            if defaults[name] is not None and type(value) is not type(defaults[name]):
                raise ValueError(f"{origin}: {name!r} must be {type(defaults[name]).__name__}, not {type(value).__name__}")
            found[name] = (value, origin)
    return found
