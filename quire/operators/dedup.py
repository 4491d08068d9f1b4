"""Exact duplicates by tier, supplements' papers, and what is left to extract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import ids, text

#: Normalised characters that a text needs to count as content, and the shared letters that pair two names.
LEAST_TEXT, LEAST_PREFIX = 200, 10


def identical_groups(sources: DataFrame, key: str = "sha256", path: str = "path") -> DataFrame:
    """(key, primary, aliases): sources of equal bytes; the smallest path leads.

    The largest key's paths are one array, as the report needs them; counts alone need no list.
    """
    return sources.groupBy(key).agg(F.min(path).alias("primary"), F.array_sort(F.collect_list(path)).alias("_all")).select(key, "primary", F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0))).alias("aliases"))


def content_key(body: Column) -> Column:
    """The text digest of texts long enough to compare; else null."""
    norm = text.normalized(body)
    return F.when(F.length(norm) >= LEAST_TEXT, F.sha2(norm, 256))


def content_equivalents(keyed: DataFrame, name: str, known: DataFrame | None = None) -> DataFrame:
    """(name, held_by, text_sha256) of rows whose ``text_sha256`` the library or an earlier row holds.

    ``known``: (text_sha256, directory). The library goes before the batch. Aggregates to one row a key and
    joins it back, so that a key with many rows is combined before it is shuffled.
    """
    rows = keyed.where("text_sha256 is not null")
    first = rows.groupBy("text_sha256").agg(F.min(name).cast("string").alias("first"), F.min(name).alias("_first"))
    found = rows.join(first, "text_sha256")
    if known is not None:
        library = known.groupBy("text_sha256").agg(F.min("directory").alias("directory"))
        found = found.join(library, "text_sha256", "left")
    else:
        found = found.withColumn("directory", F.lit(None).cast("string"))
    held = F.coalesce("directory", "first")
    return found.where(F.col("directory").isNotNull() | (F.col(name) != F.col("_first"))).select(name, held.alias("held_by"), "text_sha256")


def shared_first(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, n, first): values of ``key`` that two rows or more share."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("first")).where("n > 1")


def known_sources(batch: DataFrame, library: DataFrame, key: str = "sha256") -> DataFrame:
    """``batch`` with ``known_as``: the first library directory with the same digest."""
    return batch.join(library.groupBy(key).agg(F.min("directory").alias("known_as")), key, "left")


def unknown_sources(batch: DataFrame, library: DataFrame, key: str = "sha256") -> DataFrame:
    """The rows of ``batch`` whose digest the library doesn't hold."""
    return batch.join(library.select(key), key, "left_anti")


def intake_titles(batch: DataFrame, library: DataFrame) -> DataFrame:
    """(title_key, batch, in_library): keys that several rows of a batch share, or a row with the library; counts, no pairs."""
    own = batch.where("title_key <> ''").groupBy("title_key").agg(F.count(F.lit(1)).alias("batch"))
    there = library.select("title_key").distinct().withColumn("in_library", F.lit(True))
    return own.join(there, "title_key", "left").select("title_key", "batch", F.coalesce("in_library", F.lit(False)).alias("in_library")).where("batch > 1 or in_library")


def pair_supplements(files: DataFrame) -> DataFrame:
    """(name, paper, reason) for each supplement among ``files`` (name, dois).

    A paper that alone shares a DOI wins; else the paper with strictly the longest common prefix of ten
    letters or more. Every prefix of a paper's name is a key, which counts its papers before the shuffle: no pairs are made,
    however many names begin alike.
    """
    rows = files.withColumn("is_supplement", ids.supplement_name(F.col("name")))
    papers, supplements = rows.where("not is_supplement"), rows.where("is_supplement")
    named = supplements.select("name").distinct()
    only = lambda: [F.min("paper").alias("paper"), F.max("paper").alias("last")]
    of_doi = papers.select(F.col("name").alias("paper"), F.explode("dois").alias("doi")).groupBy("doi").agg(*only())
    # a DOI's first and last paper tell whether a supplement's DOIs lead to one paper
    by_doi = supplements.select("name", F.explode("dois").alias("doi")).join(of_doi, "doi").groupBy("name").agg(F.min("paper").alias("by_doi"), F.max("last").alias("last")).where("by_doi = last").drop("last")
    prefixes = F.transform(F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: i >= LEAST_PREFIX), lambda i: F.left(F.lower("name"), i))
    heads = papers.where(F.length("name") > 0).select(F.col("name").alias("paper"), F.explode(prefixes).alias("head")).groupBy("head").agg(*only())
    met = named.where(F.length("name") > 0).select("name", F.explode(prefixes).alias("head")).join(heads, "head")
    by_name = met.groupBy("name").agg(F.max_by(F.struct("paper", "last"), F.length("head")).alias("m")).where("m.paper = m.last").select("name", F.col("m.paper").alias("by_name"))
    out = supplements.select("name").join(by_doi, "name", "left").join(by_name, "name", "left")
    reason = F.when(F.col("by_doi").isNotNull(), "shared DOI").when(F.col("by_name").isNotNull(), "file name").otherwise("unpaired")
    return out.select("name", F.coalesce("by_doi", "by_name").alias("paper"), reason.alias("reason"))


def dedup_summary(groups: DataFrame) -> DataFrame:
    """Counts of an intake plan (known_as, held_by, is_supplement): one row."""
    return groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("known_as").isNotNull()).alias("known"),
        F.count_if(F.col("known_as").isNull() & F.col("held_by").isNotNull()).alias("held"),
        F.count_if(F.col("known_as").isNull() & F.col("held_by").isNull() & F.col("is_supplement")).alias("supplements"),
        F.count_if(F.col("known_as").isNull() & F.col("held_by").isNull() & ~F.col("is_supplement")).alias("to_extract"),
    )
