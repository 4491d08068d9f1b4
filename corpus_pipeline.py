"""Documents through the corpus stages in order: each stage's rows are written and read again as the next one's.

Every stage takes all rows of ``docs``, whatever their columns: nulls in any column, repeated rows, empty and very long
texts and empty tables have a result, which each docstring states. All stages but the last return the columns of ``docs``,
extra ones and clashing names included, with the values that they had.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import line_dedup, mixing, near_dedup, quality, segmentation
from quire.sources.shared import new_path
from quire.sources.tables import load


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Each row stays or goes by its own text, so repeated rows fare alike; null, empty and wordless texts go. Rules are learned
    from the rows with labels; without any, only the base rule rejects.
    """
    return quality.accepted(docs, load(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that too many documents of their source share.

    No row goes. Null texts stay null, a null source is a source of its own, and repeated rows count as pages each.
    """
    return line_dedup.cleaned(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest doc_id.

    Of several such rows the one whose other columns come first stays; a null id counts last. Null, empty and wordless texts
    are duplicates of nothing and stay.
    """
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in part where it takes a part.

    A null source is a source of its own, last in order. Null, empty and wordless texts have no words to take and go. Which of
    several rows alike is taken doesn't matter; reruns agree.
    """
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document: doc_id, rank, ids, log_prob, perturbed, inclusion.

    Repeated rows have as many. A null text has null ids, an empty one a single empty segmentation.
    """
    return segmentation.encode(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]
#: The learned rules and the sampler are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; the others' are written to the shared folder."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
