"""Markdown of whole documents from their blocks' runs: each block by itself, their order by windows.

What a paragraph continues, where a page begins and where footnotes go follow from a block's neighbours: the block printed before it,
and the first place behind a footnote at which its page's notes are due. Blocks of a document meet in one row in the last step only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import markdown_cell

# Marks of styles, the sign for a character without a glyph.
MARKS = {"bold": ("**", "**"), "italic": ("*", "*"), "emphasis": ("*", "*"), "strikethrough": ("~~", "~~"), "superscript": ("<sup>", "</sup>"), "subscript": ("<sub>", "</sub>")}
NO_GLYPH = "�"
DEEPEST = 6


def visible(text: Column) -> Column:
    """A text whose control characters, tabs and newlines aside, are shown as missing glyphs."""
    return F.regexp_replace(text, r"[\p{Cc}&&[^\t\n]]", NO_GLYPH)


def _styled(text: Column, styles: Column) -> Column:
    """A text within the marks of its styles, the first one innermost; blanks at its ends stay outside, and blank texts as they are."""
    body = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    lead, trail = F.regexp_extract(text, r"(?U)^(\s*)", 1), F.regexp_extract(text, r"(?U)(\s*)$", 1)
    of = lambda s, k: F.try_element_at(F.create_map(*(F.lit(x) for name, pair in MARKS.items() for x in (name, pair[k]))), s)
    marked = F.aggregate(styles, body, lambda core, s: F.concat(F.coalesce(of(s, 0), F.lit("")), core, F.coalesce(of(s, 1), F.lit(""))))
    return F.when(body == "", text).otherwise(F.concat(lead, marked, trail))


def inline(runs: Column) -> Column:
    """Runs (kind, text, styles, url) as Markdown: formulas between dollars, code between backticks, links, marks of styles."""

    def one(r: Column) -> Column:
        styled = lambda x: _styled(x, F.coalesce(r["styles"], F.array().cast("array<string>")))
        link = F.concat(F.lit("["), r["text"], F.lit("]("), r["url"], F.lit(")"))
        return F.when(r["kind"] == "math", F.concat(F.lit("$"), r["text"], F.lit("$"))).when(r["kind"] == "code", F.concat(F.lit("`"), r["text"], F.lit("`"))).when((r["kind"] == "link") & r["url"].isNotNull(), styled(link)).otherwise(styled(r["text"]))

    return visible(F.array_join(F.transform(runs, one), ""))


def grid_markdown(grid: Column) -> Column:
    """A grid (rows, columns, cells) as a Markdown table, each cell at its first place; its first row is the head."""
    cell = lambda r, c: F.coalesce(F.get(F.filter(grid["cells"], lambda x: (x["row"] == r) & (x["column"] == c)), F.lit(0))["text"], F.lit(""))
    across = lambda f: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), grid["columns"] - 1), f), " | "), F.lit(" |"))
    lines = F.transform(F.sequence(F.lit(0), grid["rows"] - 1), lambda r: across(lambda c: visible(F.trim(markdown_cell(cell(r, c))))))
    head = F.slice(lines, 1, 1)
    return F.array_join(F.concat(head, F.array(across(lambda c: F.lit("---"))), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


def block_markdown() -> Column:
    """A block's own Markdown, from the columns of a block; empty for furniture."""
    kind, runs = F.col("kind"), inline(F.col("runs"))
    named = lambda what: F.when(F.col("label").isNotNull(), F.concat(F.lit(f"**{what} "), F.col("label"), F.lit("**"))).otherwise(F.lit(f"**{what} (unlabelled)**"))
    joined = lambda *parts: F.array_join(F.array_compact(F.concat(*parts)), "\n\n")
    notes = lambda what: F.transform(F.coalesce("footnotes", F.array().cast("array<string>")), lambda n: F.concat(F.lit(f"*{what} note:* "), visible(n)))
    caption = F.concat(F.lit("**Published caption:** "), visible(F.col("caption")))
    unsure = F.when(F.col("grouping") == "unresolved", " *(panel grouping unresolved; see validation.json)*").otherwise("")
    alt = F.when(F.col("label").isNotNull(), F.concat(F.lit("Figure "), F.col("label"))).otherwise("Figure")
    image = F.when(F.col("image").isNotNull(), F.concat(F.lit("!["), alt, F.lit("]("), F.col("image"), F.lit(")"))).otherwise("*(no image asset available)*")
    figure = joined(F.array(F.concat(named("Figure"), unsure), image, F.coalesce(caption, F.lit("**Published caption:** *(none associated)*"))), notes("Figure"))
    has_grid = (F.col("grid.rows") > 0) & (F.col("grid.columns") > 0) & (F.size("grid.cells") > 0)
    body = F.when(has_grid, grid_markdown(F.col("grid"))).when(F.trim("html") != "", F.col("html")).otherwise("*(table body unavailable)*")
    spans = F.when(has_grid & F.exists("grid.cells", lambda c: (c["row_span"] > 1) | (c["column_span"] > 1)), "*Merged cells are shown once, at their first row and column; the HTML and cells files keep the exact structure.*")
    table = joined(F.array(F.concat(named("Table"), F.when(F.col("continues"), " *(continued)*").otherwise("")), caption, body), notes("Table"), F.array(spans))
    odd = F.concat(F.lit("<!-- retained backend block '"), F.col("backend_type"), F.lit("'; see document.json -->"))
    level = F.least(F.coalesce("level", F.lit(1)), F.lit(DEEPEST))
    latex = F.array_join(F.transform("runs", lambda r: r["text"]), "")
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), runs))
        .when(kind == "paragraph", F.concat(F.when(F.col("role") == "aside", "> ").otherwise(""), runs))
        .when(kind == "list", F.array_join(F.transform("items", lambda x: F.concat(F.lit("- "), inline(x))), "\n"))
        .when(kind == "equation", F.concat(F.lit("$$\n"), latex, F.lit("\n$$")))
        .when(kind == "figure", figure)
        .when(kind == "table", table)
        .when(kind == "unknown", odd)
        .otherwise("")
    )


#: Columns that a block may lack, with their types.
OPTIONAL = {"role": "string", "level": "int", "label": "string", "caption": "string", "footnotes": "array<string>", "items": "array<array<struct<kind: string, text: string, styles: array<string>, url: string>>>", "html": "string", "grid": "struct<rows: int, columns: int, cells: array<struct<row: int, column: int, row_span: int, column_span: int, text: string>>>", "grouping": "string", "image": "string", "continues": "boolean", "backend_type": "string"}


def ordered_pieces(blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, key, pos, piece): the pieces of documents' Markdown; by key, then pos, they make the text.

    ``blocks``: doc, page, pos, kind, runs, and those of ``OPTIONAL`` that they have. A paragraph that continues one, with nothing but footnotes between, is
    joined to it by a newline. A page begins with its anchor. Footnotes stand behind their page's last block, or behind the paragraph that goes on
    on the next page. Blocks that print nothing are as if they were not there.
    """
    rows = blocks
    for name, kind in OPTIONAL.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = rows.withColumn("continues", F.coalesce("continues", F.lit(False)))
    note = (F.col("kind") == "paragraph") & F.coalesce(F.col("role") == "footnote", F.lit(False))
    page = F.col("page").cast("string")
    text = F.when(note, F.concat(F.lit("*Footnote (page "), page, F.lit("):* "), inline(F.col("runs")))).otherwise(block_markdown())
    rows = rows.select(F.col(doc).alias("doc"), "page", "pos", "kind", "role", "continues", note.alias("note"), text.alias("text")).where("note or text <> ''")
    printed = Window.partitionBy("doc", "note").orderBy("pos")
    goes_on = (F.col("kind") == "paragraph") & ~F.coalesce(F.col("role") == "aside", F.lit(False)) & ~F.col("note")
    rows = rows.withColumns({"before": F.lag(goes_on, 1, False).over(printed), "last_page": F.lag("page").over(printed)})
    joins = ~F.col("note") & (F.col("kind") == "paragraph") & F.col("continues") & F.col("before")
    rows = rows.withColumns({"joins": joins, "turns": ~F.col("note") & ~F.col("page").eqNullSafe(F.col("last_page"))})
    place = F.col("pos").cast("long") * 2
    due = F.when(F.col("joins"), place + 1).when(F.col("turns"), place - 1)
    after = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    key = F.when(F.col("note"), F.coalesce(F.first(due, ignorenulls=True).over(after), F.lit(2**62))).otherwise(place)
    anchor = F.when(F.col("turns"), F.concat(F.lit("<!-- source: pdf page "), page, F.lit(" -->\n"))).otherwise("")
    piece = F.when(F.col("joins"), F.concat(F.lit("\n"), anchor, "text")).when(F.col("note"), F.concat(F.lit("\n\n"), "text")).otherwise(F.concat(F.lit("\n\n"), anchor, "text"))
    return rows.select("doc", key.alias("key"), "pos", piece.alias("piece"))


def document_markdown(blocks: DataFrame, doc: str = "doc", front: DataFrame | None = None) -> DataFrame:
    """(doc, markdown) of documents' blocks, behind their front matter (doc, front) where it is given; see ``ordered_pieces``.

    A document without a block that prints has no row, unless it has front matter.
    """
    pieces = ordered_pieces(blocks, doc)
    if front is not None:
        pieces = pieces.unionByName(front.select(F.col(doc).alias("doc"), F.lit(-(2**62)).alias("key"), F.lit(None).cast(dict(pieces.dtypes)["pos"]).alias("pos"), F.col("front").alias("piece")))
    found = pieces.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("key", "pos", "piece"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    return found.select(F.col("doc").alias(doc), F.concat(F.regexp_replace(whole, "\n+\\z", ""), F.lit("\n")).alias("markdown"))
