"""Comparing readings: shingle coverage, label joins, ratios, benchmark outcomes."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text
from quire.sources.shared import materialize, parts_of, small_side

#: Words of a shingle, words of a paragraph worth comparing, share of its shingles that counts as covered.
SHINGLE, LEAST_WORDS, COVERED = 6, 12, 0.5


def shingles(words: Column, width: int = SHINGLE) -> Column:
    """Distinct runs of ``width`` words, blank-joined; whole strings, so that nothing collides."""

    def runs(w: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, width), " "))
        return F.when(F.size(w) >= width, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(words), runs), 1)  # the words are a lambda's argument: computed once a row


def _exploded(rows: DataFrame, key: str, body: str) -> DataFrame:
    return rows.select(F.col(key), text.words(F.col(body)).alias("_w")).select(key, F.explode(shingles(F.col("_w"))).alias("shingle"))


def _hashes(words: Column, width: int = SHINGLE) -> Column:
    """A 64-bit hash of each run of ``width`` words, by place."""

    def runs(w: Column) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(width))))
        return F.when(F.size(w) >= width, found).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(words), runs), 1)


def coverage(paragraphs: DataFrame, others: DataFrame, key: str, other_key: str, body: str = "text") -> DataFrame:
    """(key, other_key, hits, total): pairs of rows that share a shingle, and the first's shingles.

    Only pairs that share one meet. The paragraphs' shingles go by hash, each once a row, to the shingles of
    ``others``, which are stored and sent to all tasks where they are few; what meets is then told apart by its
    words, from the paragraphs that have a hit alone. Paragraphs under ``LEAST_WORDS`` words are left out.
    ``total`` counts distinct hashes: it is one too low where two runs of one paragraph share 64 bits.
    """
    known = others.select(F.col(other_key).alias("_other"), text.words(F.col(body)).alias("_w")).select("_other", F.explode(shingles(F.col("_w"))).alias("_shingle"))
    known = materialize(known.select("_other", "_shingle", F.xxhash64(*(F.get(F.split("_shingle", " "), F.lit(j)) for j in range(SHINGLE))).alias("_h")), "shingles")
    words = lambda rows: rows.select(key, text.words(F.col(body)).alias("_w")).where(F.size("_w") >= LEAST_WORDS)
    rows = words(paragraphs).select(key, _hashes(F.col("_w")).alias("_all"))
    rows = rows.select(key, F.size(F.array_distinct("_all")).cast("long").alias("total"), F.posexplode("_all").alias("_at", "_h"))
    met = materialize(rows.join(small_side(known), "_h").select(F.col(key).alias("_key"), "total", "_at", "_other", "_shingle"), "met")
    again = paragraphs.join(small_side(met.select(F.col("_key").alias(key)).distinct()), key, "left_semi")
    sure = met.join(words(again), F.col("_key") == F.col(key)).where(F.array_join(F.slice("_w", F.col("_at") + 1, SHINGLE), " ") == F.col("_shingle"))
    return sure.groupBy(key, F.col("_other").alias(other_key)).agg(F.countDistinct("_shingle").alias("hits"), F.first("total").alias("total"))


def _prints(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, a, b): the distinct six-word runs of rows (key, _w) as two 64-bit hashes each: a run meets another one by chance once in 2**128 pairs."""
    runs = rows.select(*key, F.explode(shingles(F.col("_w"))).alias("_s"))
    return runs.select(*key, F.xxhash64("_s").alias("a"), F.xxhash64(F.lit(1), F.col("_s")).alias("b"))


def uncovered_within(paragraphs: DataFrame, others: DataFrame, key: list[str], within: list[str], body: str = "text") -> DataFrame:
    """(key, share) of paragraphs of which less than half is found in the rows of ``others`` that share ``within``; anywhere if that is empty.

    Paragraphs under ``LEAST_WORDS`` words are left out. Only hashes are shuffled: those of the others once each, to be held against a part
    of the paragraphs' as they come, neither sorted nor counted. There are as many parts as the paragraphs' hashes need.
    """
    met = [*within, "a", "b"]
    rows = materialize(_prints(paragraphs.select(*key, text.words(F.col(body)).alias("_w")).where(F.size("_w") >= LEAST_WORDS), key), "prints")
    parts = parts_of(rows)
    asked = rows.select(*met).repartition(parts, *met)
    target = _prints(others.select(*within, text.words(F.col(body)).alias("_w")), within).repartition(parts, *met)
    hits = target.join(asked.hint("shuffle_hash"), met, "left_semi").distinct().withColumn("hit", F.lit(1))
    share = rows.repartition(parts, *met).join(hits, met, "left").groupBy(*key).agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
    return share.where(F.col("share") < COVERED)


def uncovered(paragraphs: DataFrame, others: DataFrame, key: str, body: str = "text") -> DataFrame:
    """(key, share) of paragraphs of which less than half is found anywhere in ``others``."""
    return uncovered_within(paragraphs, others, [key], [], body)


def labels(left: DataFrame, right: DataFrame, label: str, value: str, position: str, same: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(label, status): a full join of labelled objects, the first of a label on either side.

    ``same`` says when two values agree: equality, unless it is given; ``captions_agree`` is for captions.
    """
    first = lambda rows, name: rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.min_by(value, position).alias(name))
    both = first(left, "l").withColumn("_l", F.lit(True)).join(first(right, "r").withColumn("_r", F.lit(True)), label, "full")
    equal = F.col("l").eqNullSafe(F.col("r")) if same is None else F.coalesce(same(F.col("l"), F.col("r")), F.lit(False))
    status = F.when(F.col("_r").isNull(), "only_reference").when(F.col("_l").isNull(), "only_other").when(equal, "agrees").otherwise("differs")
    return both.select(label, status.alias("status"))


@F.pandas_udf(T.DoubleType())
def word_ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Matching-blocks ratio of two texts' words, to three places."""
    for a, b in parts:
        yield pd.Series([None if x is None or y is None else round(difflib.SequenceMatcher(None, x.lower().split(), y.lower().split(), autojunk=False).ratio(), 3) for x, y in zip(a, b, strict=True)])


def histogram(rows: DataFrame, key: str, kind: str, kinds: list[str], size: Column) -> DataFrame:
    """(key, a count for each of ``kinds``, characters): what each document's blocks are, and how much text they hold."""
    return rows.groupBy(key).agg(*(F.count_if(F.col(kind) == k).alias(k) for k in kinds), F.sum(size).alias("characters"))


#: Captions agree from this ratio of their words on.
CAPTION_RATIO = 0.9


def captions_agree(a: Column, b: Column) -> Column:
    """Whether two captions' words match by ``CAPTION_RATIO``; equal ones need no look."""
    return F.when(a == b, True).otherwise(word_ratio(a, b) >= CAPTION_RATIO)


def word_share(words: Column, other: Column) -> Column:
    """How much of an array of words the other has, as often as it has them; 0 of none."""

    def share(pair: Column) -> Column:
        own, there = pair["own"], pair["there"]
        count = lambda array, w: F.size(F.filter(array, lambda x: x == w))
        met = F.aggregate(F.array_distinct(own), F.lit(0), lambda n, w: n + F.least(count(own, w), count(there, w)))
        return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(met / F.size(own))

    return F.element_at(F.transform(F.array(F.struct(words.alias("own"), other.alias("there"))), share), 1)


def outcome(same_scope: Column, observed: Column, same_header: Column, expected: Column, kind: Column) -> Column:
    """scope_mismatch > missing > header_mismatch > exact > normalized > mismatch. Numbers stay strings."""
    bare = lambda x: F.btrim(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit(" \t\r\n"))
    return (
        F.when(~same_scope, "scope_mismatch")
        .when(observed.isNull(), "missing")
        .when(~same_header, "header_mismatch")
        .when(observed == expected, "exact")
        .when((kind == "equation") & (bare(observed) == bare(expected)), "normalized")
        .otherwise("mismatch")
    )
