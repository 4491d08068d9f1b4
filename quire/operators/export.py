"""Renderings: CSV, Markdown, CSL and BibTeX keys, and deterministic JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import ascii_fold, markdown_cell

#: Words that a directory's name and a citation key pass over.
STOP_WORDS = ["a", "an", "the", "of", "on", "in", "and", "for", "to", "with", "by", "at", "from", "via"]


def csv_field(value: Column) -> Column:
    """A CSV field, quoted where it must be."""
    return F.when(value.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def table_csv(cells: DataFrame, table: str) -> DataFrame:
    """(table, csv) of tables whose cells (row, column, row_span, column_span, text) are a full plain grid."""
    simple = cells.groupBy(table).agg(F.count(F.lit(1)).alias("n"), ((F.max("row") + 1) * (F.max("column") + 1)).alias("full"), F.bool_and((F.col("row_span") == 1) & (F.col("column_span") == 1)).alias("plain")).where("plain and n = full").select(table)
    lines = cells.join(simple, table).groupBy(table, "row").agg(F.array_sort(F.collect_list(F.struct("column", csv_field(F.col("text")).alias("text")))).alias("c")).select(table, "row", F.array_join(F.transform("c", lambda x: x["text"]), ",").alias("line"))
    return lines.groupBy(table).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("csv"))


def table_markdown(cells: Column) -> Column:
    """A row of cells as a Markdown table row."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, markdown_cell), " | "), F.lit(" |"))


def citation_key(family: Column, year: Column, title: Column) -> Column:
    """family, year and the title's first word that is no stop word, in ASCII letters and digits."""
    bare = lambda c: F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9]", "")
    words = F.filter(F.transform(F.split(title, r"\s+"), bare), lambda w: (w != "") & ~w.isin(STOP_WORDS))
    name = F.coalesce(F.nullif(bare(family), F.lit("")), F.lit("anonymous"))
    return F.concat(name, F.coalesce(year.cast("string"), F.lit("nodate")), F.coalesce(F.get(words, F.lit(0)), F.lit("untitled")))


def directory_name(named: Column, family: Column, year: Column, title: Column, sha256: Column, taken: Column) -> Column:
    """A paper's directory: family, year and the title's first three telling words, at most 96 bytes of ASCII.

    ``taken``: another source has that name, so six digits of the digest follow. Papers without a
    validated identity go by their digest.
    """
    part = lambda c: F.regexp_replace(ascii_fold(c), "[^A-Za-z0-9]", "")
    upper = lambda c: F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))
    telling = F.filter(F.split(F.coalesce(title, F.lit("")), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(STOP_WORDS))
    short = F.array_join(F.slice(F.filter(F.transform(telling, lambda w: upper(part(w))), lambda w: w != ""), 1, 3), "")
    name = F.concat_ws("_", F.coalesce(F.nullif(upper(part(family)), F.lit("")), F.lit("Anonymous")), F.coalesce(year.cast("string"), F.lit("nodate")), F.coalesce(F.nullif(short, F.lit("")), F.lit("Untitled")))
    full = F.concat(F.left(name, F.lit(96)), F.when(F.coalesce(taken, F.lit(False)), F.concat(F.lit("_"), F.left(sha256, F.lit(6)))).otherwise(""))
    return F.when(F.coalesce(named, F.lit(False)), full).otherwise(F.concat(F.lit("Unverified_"), F.left(sha256, F.lit(12))))


def csl_item(key: Column, title: Column, family: Column, year: Column) -> Column:
    """A CSL-JSON item; null members are left out."""
    return F.to_json(F.struct(key.alias("id"), F.lit("article-journal").alias("type"), title.alias("title"), F.array(F.struct(family.alias("family"))).alias("author"), F.when(year.isNotNull(), F.struct(F.array(F.array(year)).alias("date-parts"))).alias("issued")))


def yaml_front_matter(values: list[tuple[str, Column]]) -> Column:
    """A YAML block of the values that aren't null, in order."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), F.to_json(F.struct(v.alias("v"))).substr(6, 1 << 20))) for k, v in values]
    trimmed = [F.regexp_replace(x, r"\}$", "") for x in lines]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *trimmed), F.lit("\n---\n"))


def dump(document: object) -> str:
    """Deterministic JSON: sorted keys, two blanks, a newline at the end."""
    return json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n"


def validation_counts(findings: DataFrame, doc: str) -> DataFrame:
    """(doc, errors, warnings, infos, status): a document's findings by severity, and its overall state."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return findings.groupBy(doc).agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos")).withColumn("status", F.when(F.col("errors") > 0, "fail").when(F.col("warnings") > 0, "review").otherwise("pass"))


def document_markdown(blocks: DataFrame, doc: str) -> DataFrame:
    """(doc, markdown) of blocks (doc, page, pos, kind, level, text, continues): headings, paragraphs, page anchors.

    A paragraph that continues one of an earlier page is joined to it; footnotes stand at their page's end.
    One document's blocks make one text, so they meet in one row.
    """
    from pyspark.sql.window import Window

    order = Window.partitionBy(doc).orderBy("page", "pos")
    head = F.coalesce(F.when((F.col("kind") == "paragraph") & F.col("continues"), 0), F.lit(1))
    notes = F.col("kind") == "footnote"
    rows = blocks.where("kind <> 'furniture'").withColumn("_u", F.sum(F.when(notes, 1).otherwise(head)).over(order))
    units = rows.groupBy(doc, "_u").agg(F.min("page").alias("page"), F.min("pos").alias("pos"), F.min_by("kind", "pos").alias("kind"), F.min_by("level", "pos").alias("level"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "pos", "text"))), lambda x: x["text"]), " ").alias("text"))
    line = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.coalesce("level", F.lit(1)), F.lit(6))), F.lit(" "), "text")).when(F.col("kind") == "footnote", F.concat(F.lit("> "), "text")).otherwise(F.col("text"))
    first = F.row_number().over(Window.partitionBy(doc, "page").orderBy((F.col("kind") == "footnote").cast("int"), "pos")) == 1
    anchored = F.when(first, F.concat(F.lit('<a id="page-'), "page", F.lit('"></a>\n'), line)).otherwise(line)
    lines = units.select(doc, "page", (F.col("kind") == "footnote").cast("int").alias("note"), "pos", anchored.alias("line"))
    return lines.groupBy(doc).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "note", "pos", "line"))), lambda x: x["line"]), "\n\n"), F.lit("\n")).alias("markdown"))
