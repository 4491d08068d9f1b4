"""The report that compares the documents several backends made of one source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import ids, text
from quire.operators import bags, compare
from quire.operators.saved_page import heading_differences, uncovered_of_own

#: Examples that a report shows of paragraphs that are absent.
EXAMPLES = 5


def summary(blocks: DataFrame, pages: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc, kinds, pages, findings, inline_math, figures, tables): what a document is made of.

    Of ``blocks`` (doc, kind, label, inline_math), ``pages`` (doc, status) and ``findings`` (doc, severity): counts by kind,
    status and severity, and the labels of figures and tables, each once, in order.
    """

    def counted(rows: DataFrame, column: str, name: str) -> DataFrame:
        each = rows.groupBy("doc", column).agg(F.count(F.lit(1)).alias("n"))
        return each.groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))

    labels = lambda kind, name: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("label")))).alias(name)
    own = blocks.groupBy("doc").agg(F.sum(F.coalesce("inline_math", F.lit(0))).alias("inline_math"), labels("figure", "figures"), labels("table", "tables"))
    return counted(blocks, "kind", "kinds").join(own, "doc").join(counted(pages, "status", "pages"), "doc", "left").join(counted(findings, "severity", "findings"), "doc", "left")


def coverage(paragraphs: DataFrame, others: DataFrame) -> DataFrame:
    """(doc, compared, absent, examples): paragraphs (doc, pos, text) of twelve words or more, and those mostly absent in ``others``."""
    long = paragraphs.where(F.size(text.words(F.col("text"))) >= compare.LEAST_WORDS)
    absent = uncovered_of_own(paragraphs, others).join(paragraphs.select("doc", "pos", F.left("text", F.lit(100)).alias("start")), ["doc", "pos"])
    lost = absent.groupBy("doc").agg(F.count(F.lit(1)).alias("absent"), F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "start"))), 1, EXAMPLES), lambda x: x["start"]).alias("examples"))
    out = long.groupBy("doc").agg(F.count(F.lit(1)).alias("compared")).join(lost, "doc", "left")
    return out.select("doc", "compared", F.coalesce("absent", F.lit(0)).alias("absent"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def equations(reference: DataFrame, other: DataFrame) -> DataFrame:
    """(doc, label, status) of numbered equations (doc, pos, label, latex): only_reference, only_other, same or different.

    LaTeX compares by its key, without the printed number that some backends leave at its end.
    """
    key = text.latex_key(F.col("latex"))
    bare = F.when(F.endswith(key, F.concat(F.lit("("), "label", F.lit(")"))), F.substr(key, F.lit(1), F.length(key) - F.length("label") - 2)).otherwise(key)
    first = lambda rows, name: rows.where("label is not null").groupBy("doc", "label").agg(F.min_by(bare, "pos").alias(name))
    both = first(reference, "a").join(first(other, "b"), ["doc", "label"], "full")
    status = F.when(F.col("b").isNull(), "only_reference").when(F.col("a").isNull(), "only_other").when(F.col("a") == F.col("b"), "same").otherwise("different")
    return both.select("doc", "label", status.alias("status"))


def tables(reference: DataFrame, other: DataFrame) -> DataFrame:
    """(doc, label, status, shared, only_left, only_right): labelled tables (doc, label, text) by the numbers they hold."""
    key = F.concat_ws("\u0001", "doc", "label")
    one = lambda rows: rows.where("label is not null").groupBy("doc", "label").agg(F.first("text").alias("text")).withColumn("_k", key)
    a, b = one(reference), one(other)
    both = a.select("_k", "doc", "label", F.lit(True).alias("_a")).join(b.select("_k", F.col("doc").alias("_d"), F.col("label").alias("_l"), F.lit(True).alias("_b")), "_k", "full")
    counts = bags.compare(bags.printed(a, "_k", "text"), bags.printed(b, "_k", "text"), "_k")
    rows = both.join(counts, "_k", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = F.when(F.col("_b").isNull(), "only_reference").when(F.col("_a").isNull(), "only_other").when(n("only_left") + n("only_right") == 0, "agrees").otherwise("differs")
    return rows.select(F.coalesce("doc", "_d").alias("doc"), F.coalesce("label", "_l").alias("label"), status.alias("status"), n("shared").alias("shared"), n("only_left").alias("only_left"), n("only_right").alias("only_right"))


def comparison(reference: dict[str, DataFrame], other: dict[str, DataFrame]) -> DataFrame:
    """(doc, section, status, n): the whole report in counts, from each side's headings, paragraphs, figures, tables, equations.

    Sections are reference_text_in_other and other_text_in_reference (compared, absent), headings, figures, tables and
    equations (their statuses). Figures (doc, label, caption, pos) agree by their captions.
    """

    def text_rows(a: DataFrame, b: DataFrame, section: str) -> DataFrame:
        each = F.explode(F.create_map(F.lit("compared"), "compared", F.lit("absent"), "absent")).alias("status", "n")
        return coverage(a, b).select("doc", each).select("doc", F.lit(section).alias("section"), "status", "n")

    def counted(rows: DataFrame, section: str) -> DataFrame:
        return rows.groupBy("doc", "status").agg(F.count(F.lit(1)).alias("n")).select("doc", F.lit(section).alias("section"), "status", "n")

    sides = heading_differences(reference["headings"], other["headings"])
    head = sides.select("doc", F.when(F.col("side") == "page", "only_reference").otherwise("only_other").alias("status"))
    joined = lambda rows: rows.withColumn("_k", F.struct("doc", "label")).where("label is not null")
    figures = compare.labels(joined(reference["figures"]), joined(other["figures"]), "_k", "caption", "pos", compare.captions_agree).select("_k.doc", "status")
    out = text_rows(reference["paragraphs"], other["paragraphs"], "reference_text_in_other").unionByName(text_rows(other["paragraphs"], reference["paragraphs"], "other_text_in_reference"))
    for rows, section in ((head, "headings"), (figures, "figures"), (tables(reference["tables"], other["tables"]), "tables"), (equations(reference["equations"], other["equations"]), "equations")):
        out = out.unionByName(counted(rows, section))
    return out


def shared_labels(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` in the order in which people sort printed labels."""
    return rows.orderBy(*ids.label_order(F.col(label)))
