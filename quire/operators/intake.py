"""Deciding what an intake still has to do: captures' papers, what to extract, which search is settled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_captures(papers: DataFrame, captures: DataFrame) -> DataFrame:
    """(path, paper, reason) of each saved page of ``captures`` (path, doi).

    A page goes to the one paper of ``papers`` (paper, dois) that prints its DOI, in any case. Papers
    are counted by DOI before the join, so a DOI that many print costs one row. Supplements are to be
    left out of ``papers`` beforehand.
    """
    printed = papers.select("paper", F.explode(F.array_distinct(F.transform("dois", F.lower))).alias("_doi"))
    sharing = printed.groupBy("_doi").agg(F.min("paper").alias("_paper"), F.count_distinct("paper").alias("_n"))
    found = captures.join(sharing, F.lower("doi") == F.col("_doi"), "left")
    reason = F.when(F.col("doi").isNull(), "no DOI declared").when(F.col("_n").isNull(), "no paper prints it").when(F.col("_n") > 1, "several papers print it").otherwise("shared DOI")
    return found.select("path", F.when(F.col("_n") == 1, F.col("_paper")).alias("paper"), reason.alias("reason"))


def to_extract(groups: DataFrame, held: DataFrame, supplements: DataFrame, key: str = "sha256") -> DataFrame:
    """The ``groups`` (key, known_as) that are unknown, not held for equal text, and no supplements."""
    return groups.where("known_as is null").join(held.select(key), key, "left_anti").join(supplements.select(key), key, "left_anti")


def settled_searches(hits: DataFrame, paper: str, ordinal: str, hit: str) -> DataFrame:
    """(paper, ordinal, hit) of each paper's first query that leaves exactly one hit; others have no row."""
    # one hit alone is both the least and the greatest: nothing is counted by hit
    each = hits.groupBy(paper, ordinal).agg(F.min(hit).alias(hit), F.max(hit).alias("_most")).where(F.col(hit) == F.col("_most"))
    return each.groupBy(paper).agg(F.min(ordinal).alias(ordinal), F.min_by(hit, ordinal).alias(hit))


def description_counts(rows: DataFrame, group: str, state: str, usd: str) -> DataFrame:
    """Figures described, skipped and failed in each group, and what they cost."""
    n = lambda s: F.count_if(F.col(state) == s).alias(s)
    return rows.groupBy(group).agg(n("described"), n("skipped"), n("failed"), F.coalesce(F.sum(usd), F.lit(0.0)).alias("usd"))
