"""Quality rules: text statistics, and a decision list learned by sequential covering.

Rules are conjunctions of thresholds on the statistics. Each rule grows on two thirds of the labelled
rows by greatest FOIL gain, is pruned on the other third, and is kept while it is precise there; the rows
it covers leave, and the next rule is learned. The list becomes an ordered ``CASE WHEN``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import native
from quire.sources.shared import materialize, small_side

#: What a rule may test, as SQL over the statistics.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1L)",
    "symbol_ratio": "n_symbols / greatest(word_chars, 1L)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1L)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1L)",
    "upper_ratio": "n_upper / greatest(word_chars, 1L)",
    "digit_ratio": "n_digits / greatest(word_chars, 1L)",
    "mark_ratio": "n_marks / greatest(word_chars, 1L)",
}
#: Cut points of a feature, conditions of a rule, rules of a list; what a pruned rule must reach.
CUTS, CONDITIONS, RULES, PRECISION, SUPPORT = 64, 3, 8, 0.95, 4
BASE_FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"

#: Words of the array ``w`` in 3-word windows that occur twice or more in it. A window is packed as
#: ``hash * n + position`` so that a sort of longs brings windows that may be equal together; the hash has the bits
#: that the position leaves of 63. Windows whose hash recurs are then told apart by their words.
#: ``transform(array(x), y -> ...)`` computes x once a row.
_REPEATED = """
if(size(w) < 4, 0L, element_at(transform(array(
    sort_array(transform(sequence(0, size(w) - 3), i -> coalesce(pmod(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)), 9223372036854775807L div size(w)) * size(w) + i, 0L)))
), s -> element_at(transform(array(
    sort_array(transform(
        filter(s, (x, k) -> x div size(w) = get(s, k - 1) div size(w) or x div size(w) = get(s, k + 1) div size(w)),
        x -> named_struct('m', concat_ws(' ', get(w, cast(x % size(w) as int)), get(w, cast(x % size(w) as int) + 1), get(w, cast(x % size(w) as int) + 2)), 'p', x % size(w))))
), v -> aggregate(
    sort_array(transform(filter(v, (x, k) -> x.m = get(v, k - 1).m or x.m = get(v, k + 1).m), x -> x.p)),
    named_struct('end', 0L, 'total', 0L),
    (a, p) -> named_struct('end', p + 3, 'total', a.total + p + 3 - greatest(p, a.end)),
    a -> a.total)), 1)), 1))
"""


def statistics(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id and the statistics of the whole text (long).

    n_words, word_chars (code points in words), n_symbols (``[#*$%&|<>]``), n_lines (lines with a word),
    n_dup_lines (those equal to an earlier one), n_repeat_words (words in 3-word windows found twice or
    more), n_upper, n_digits, n_marks (``[!?]``). Null texts count 0 throughout.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("words", native.words(F.col("t"))).withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(native.SPACE)) != ""))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        native.n_of(F.col("t"), "[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"element_at(transform(array(words), w -> {_REPEATED}), 1)").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        native.n_of(F.col("t"), "[A-Z]").alias("n_upper"),
        native.n_of(F.col("t"), "[0-9]").alias("n_digits"),
        native.n_of(F.col("t"), "[!?]").alias("n_marks"),
    )


@dataclass(frozen=True)
class Condition:
    """A threshold on one feature."""

    feature: str
    above: bool
    cut: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]} {'>' if self.above else '<='} {self.cut!r}D)"


def rule_sql(rule: list[Condition]) -> str:
    """A rule as a SQL condition over the statistics."""
    return " and ".join(c.sql() for c in rule)


def decision(rules: list[list[Condition]]) -> Column:
    """True where no rule rejects: the list as ordered conditional expressions."""
    out = None
    for r in rules:
        out = F.when(F.expr(rule_sql(r)), False) if out is None else out.when(F.expr(rule_sql(r)), False)
    return F.lit(True) if out is None else out.otherwise(True)


def _bins(cuts: dict[str, list[float]]) -> list[Column]:
    """Each feature's number of cut points below its value."""
    return [F.expr(f"size(filter(array({', '.join(f'{c!r}D' for c in cuts[f])}), c -> c < {sql}))" if cuts[f] else "0").cast("int").alias(f) for f, sql in FEATURES.items()]


def _in_bins(rule: list[Condition], cuts: dict[str, list[float]]) -> str:
    return " and ".join(f"({c.feature} {'>' if c.above else '<='} {cuts[c.feature].index(c.cut)})" for c in rule)


def learn(labelled: DataFrame) -> list[list[Condition]]:
    """Rules that mark the rows of ``labelled`` (the statistics, doc_id, bad: boolean) that are bad.

    All rows are used. They are counted by binned statistics once; each step then adds up that table, and
    a few hundred sums reach the driver. No labelled rows, or none that is bad, give no rules.
    """
    labelled = labelled.where("bad is not null")
    at = [k / CUTS for k in range(1, CUTS)]
    row = labelled.agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(F.expr(sql), at, 10_000).alias(f) for f, sql in FEATURES.items())).first()
    if not row.n:
        return []
    cuts = {f: sorted(set(row[f])) for f in FEATURES}
    cells = labelled.select(*_bins(cuts), F.col("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune")).groupBy(*FEATURES, "bad", "prune").agg(F.count(F.lit(1)).alias("n"))
    cells = materialize(cells, "cells")
    stack = f"stack({len(FEATURES)}, {', '.join(f'{k!r}, {k}' for k in FEATURES)}) as (feature, bin)"

    def counts(where: str, prune: bool) -> tuple[float, float]:
        r = cells.where(("" if prune else "not ") + "prune").where(where).agg(F.sum(F.when(F.col("bad"), F.col("n"))), F.sum(F.when(~F.col("bad"), F.col("n")))).first()
        return r[0] or 0, r[1] or 0

    rules, uncovered = [], "true"
    while len(rules) < RULES:
        rule: list[Condition] = []
        p0, n0 = counts(uncovered, False)
        while len(rule) < CONDITIONS and p0 and n0:
            where = uncovered + "".join(f" and {_in_bins([c], cuts)}" for c in rule)
            found = cells.where("not prune").where(where).select(F.expr(stack), "bad", "n").groupBy("feature", "bin").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("q")).collect()
            best = None
            for f in FEATURES:
                by_bin = {r.bin: (r.p, r.q) for r in found if r.feature == f}
                low_p = low_q = 0
                for k, cut in enumerate(cuts[f]):
                    low_p, low_q = low_p + by_bin.get(k, (0, 0))[0], low_q + by_bin.get(k, (0, 0))[1]
                    for above, p, q in ((False, low_p, low_q), (True, p0 - low_p, n0 - low_q)):
                        if p >= SUPPORT:
                            gain = p * (math.log2(p / (p + q)) - math.log2(p0 / (p0 + n0)))
                            if best is None or (gain, p, f, above) > best[:4]:
                                best = (gain, p, f, above, cut, q)
            if best is None or best[0] <= 0:
                break
            rule.append(Condition(best[2], best[3], best[4]))
            p0, n0 = best[1], best[5]
        if not rule:
            break
        scored = []
        for k in range(1, len(rule) + 1):
            p, q = counts(f"{uncovered} and {_in_bins(rule[:k], cuts)}", True)
            scored.append(((p - q) / (p + q) if p + q else -1.0, p, -k))
        worth, p, k = max(scored)
        if p < 1 or (1 + worth) / 2 < PRECISION:
            break
        rules.append(rule[:-k])
        uncovered += f" and not ({_in_bins(rule[:-k], cuts)})"
    return rules


def learn_from(stats: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Rules from the labelled rows that the base doesn't fail."""
    bad = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).alias("bad"))
    return learn(stats.where("not base_failed").join(bad, "doc_id"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of each row of ``docs``, base_failed, and kept: not base_failed and by no rule rejected.

    ``labels`` (doc_id, quality: 0 bad, 1 good) teaches the rules; null ids and qualities teach nothing.
    Without usable labels there are no rules. Null and empty texts fail the base. An empty table gives an
    empty result; repeated rows are judged alike.
    """
    stats = materialize(statistics(docs).withColumn("base_failed", F.expr(BASE_FAILED)), "statistics")
    return stats.withColumn("kept", ~F.col("base_failed") & decision(learn_from(stats, labels)))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` that ``judge`` keeps.

    Rejected doc_ids are few beside the rows they leave, so they are what is joined. Where rows that
    repeat a doc_id, or have none, are judged differently, each row is judged on its own statistics. Null and
    empty texts go, repeated rows stay or go together, and extra columns of any name keep their values.
    """
    stats = materialize(statistics(docs).withColumn("base_failed", F.expr(BASE_FAILED)), "statistics")
    rules = learn_from(stats, labels)
    mixed = stats.select("doc_id", (~F.col("base_failed") & decision(rules)).alias("kept")).groupBy("doc_id").agg(F.min("kept").alias("every"), F.max("kept").alias("some"))
    rejected = materialize(mixed.where("not every"), "rejected")
    own = native.fresh(docs, "own")
    key = F.col("doc_id").cast("long").eqNullSafe(F.col(own))
    out = docs.join(small_side(rejected.select(F.col("doc_id").alias(own))), key, "left_anti")
    split = rejected.where("some")
    if split.isEmpty():
        return out
    again = materialize(docs.join(split.select(F.col("doc_id").alias(own)), key, "left_semi").withColumn(own, F.monotonically_increasing_id()), "rows")
    by_row = statistics(again.select(F.col(own).alias("doc_id"), "text"))
    good = by_row.where(~F.expr(BASE_FAILED) & decision(rules)).select(F.col("doc_id").alias(own))
    return out.unionByName(again.join(good, own, "left_semi").drop(own))
