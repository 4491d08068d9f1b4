"""Files of a library: what is kept already, what can be used again, what is attached, and replacing a paper whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What makes a description of a figure usable again: the same model and prompt on the same picture.
DESCRIPTION_KEY = ["figure", "model", "revision", "prompt_version", "image_sha256"]
#: The steps of replacing a paper, in order; a journal holds the last one done.
STEPS = ["staged", "old_aside", "new_in_place", "done"]


def undescribed(figures: DataFrame, descriptions: DataFrame, key: list[str] = DESCRIPTION_KEY) -> DataFrame:
    """The ``figures`` without a kept description of the same figure, model, revision, prompt and picture."""
    return figures.join(descriptions.select(*key).distinct(), key, "left_anti")


def reusable(figures: DataFrame, kept: DataFrame, key: list[str], value: str) -> DataFrame:
    """``figures`` with ``value`` of the kept row of the same key, the first where several are; null without one."""
    return figures.join(kept.groupBy(*key).agg(F.min(value).alias(value)), key, "left")


def attach(files: DataFrame, kept: DataFrame) -> DataFrame:
    """Adds outcome to ``files`` (directory, sha256, name): attached, already_kept or repeated.

    A file whose bytes the paper keeps (``kept``: directory, sha256) isn't attached again; of files with the same bytes,
    the one whose name comes first is.
    """
    first = files.groupBy("directory", "sha256").agg(F.min("name").alias("_first"))
    rows = files.join(first, ["directory", "sha256"]).join(kept.select("directory", "sha256").distinct().withColumn("_kept", F.lit(True)), ["directory", "sha256"], "left")
    outcome = F.when(F.col("_kept"), "already_kept").when(F.col("name") == F.col("_first"), "attached").otherwise("repeated")
    return rows.withColumn("outcome", outcome).drop("_first", "_kept")


def missing_assets(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, block_id, asset, code): assets that ``blocks`` (doc, block_id, asset) name and the worker's ``files`` (doc, path) lack."""
    named = blocks.where("asset is not null").select("doc", "block_id", "asset")
    return named.join(files.select("doc", F.col("path").alias("asset")).distinct(), ["doc", "asset"], "left_anti").withColumn("code", F.lit("ASSET_MISSING"))


def recovery(journals: DataFrame) -> DataFrame:
    """(directory, action) for replacements (directory, step) that didn't end.

    Up to the old paper's being put aside, a replacement is rolled back; once the new one is in place, it goes forward.
    A journal of an unknown step is reported and nothing is done.
    """
    at = F.array_position(F.array(*map(F.lit, STEPS)), F.col("step"))
    action = F.when(at == 0, "report").when(at <= 2, "roll_back").when(at == 3, "roll_forward")
    return journals.select("directory", action.alias("action")).where("action is not null")


def provenance_gaps(attached: DataFrame, sources: DataFrame) -> DataFrame:
    """(directory, sha256): attached files whose source (directory, sha256, origin, attached_utc) isn't told in full."""
    told = sources.where("origin is not null and attached_utc is not null").select("directory", "sha256")
    return attached.select("directory", "sha256").join(told, ["directory", "sha256"], "left_anti")


def verified(copied: Column, source_before: Column, source_after: Column) -> Column:
    """What came of a copy by three digests: verified, changed (the source, meanwhile) or damaged (the copy)."""
    return F.when(source_before != source_after, "changed").when(copied != source_before, "damaged").otherwise("verified")
