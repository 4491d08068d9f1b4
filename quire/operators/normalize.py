"""Native documents of JSON into blocks: one wide row a block, unknown content kept raw."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html import escape
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.functions import ids
from quire.sources.shared import materialize

PAGES = "array<struct<page_idx: int, blocks: array<struct<type: string, index: int, level: int, bbox: array<double>, text: string, html: string>>>>"
#: Native types and the kinds of blocks that they become.
KINDS = {"title": "heading", "text": "paragraph", "list": "list", "table": "table", "image": "figure", "chart": "figure", "interline_equation": "equation", "code": "code"}
FURNITURE = {"header": "header", "footer": "footer", "page_number": "page_number"}


def blocks(native: DataFrame) -> DataFrame:
    """Blocks of native documents (doc, json): doc, page, pos, kind, role, level, text, html, box, id, raw.

    Pages stand by number, blocks in their own order. Ids are digests of document, page, type and place
    among alike; a type that isn't known keeps its JSON in ``raw``.
    """
    pages = native.select("doc", F.explode(F.from_json(F.get_json_object("json", "$.pages"), PAGES)).alias("p"))
    rows = pages.select("doc", (F.col("p.page_idx") + 1).alias("page"), F.posexplode("p.blocks").alias("at", "b"))
    known = F.create_map(*(x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))))
    role = F.create_map(*(x for k, v in FURNITURE.items() for x in (F.lit(k), F.lit(v))))
    kind = F.when(role[F.col("b.type")].isNotNull(), "furniture").otherwise(F.coalesce(known[F.col("b.type")], F.lit("unknown")))
    order = Window.partitionBy("doc").orderBy("page", "at")
    alike = F.row_number().over(Window.partitionBy("doc", "page", "b.type", "b.index").orderBy("at"))
    return rows.select(
        "doc",
        "page",
        F.row_number().over(order).alias("pos"),
        kind.alias("kind"),
        role[F.col("b.type")].alias("role"),
        F.col("b.level").alias("level"),
        F.col("b.text").alias("text"),
        F.col("b.html").alias("html"),
        F.when(F.size("b.bbox") == 4, F.struct(*(F.col("b.bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))).alias("box"),
        ids.content_id("block", F.col("doc").cast("string"), F.col("page").cast("string"), F.col("b.type"), F.col("b.index").cast("string"), alike.cast("string")).alias("id"),
        F.when(kind == "unknown", F.to_json("b")).alias("raw"),
    )


def page_findings(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """(doc, page, code): requested pages (doc, page) that are missing, or empty, among (doc, page, n_blocks)."""
    both = requested.join(returned, ["doc", "page"], "left")
    return both.select("doc", "page", F.when(F.col("n_blocks").isNull(), "PAGE_MISSING").when(F.col("n_blocks") == 0, "PAGE_EMPTY").alias("code")).where("code is not null")


def flatten_tree(native: DataFrame) -> DataFrame:
    """(doc, ref, depth, path): nodes of a pointer tree (doc, ref, parent, rank) in reading order.

    Children follow their parent by rank. Levels are joined one at a time, and each is stored, so that no level's join is
    made twice; a tree needs as many joins as it has levels. Nodes of a cycle are never reached.
    """
    level = materialize(native.where("parent is null").select("doc", "ref", F.lit(0).alias("depth"), F.array(F.col("rank")).alias("path")), "level")
    levels = []
    while not level.isEmpty():
        levels.append(level)
        below = native.join(level.select("doc", F.col("ref").alias("parent"), "depth", "path"), ["doc", "parent"])
        level = materialize(below.select("doc", "ref", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("rank")).alias("path")), "level")
    return reduce(lambda a, b: a.unionByName(b), levels) if levels else level


_NODE = "struct<block_type: string, html: string, bbox: array<double>, image: string, children: {}>"
_LEAF = "struct<block_type: string, html: string, bbox: array<double>, image: string>"
MARKER_PAGES = "array<struct<id: string, children: array<" + _NODE.format(f"array<{_LEAF}>") + ">>>"
# Block types of trees of HTML blocks, and the kinds and roles that they become.
TREE_KINDS = {
    "SectionHeader": "heading", "Text": "paragraph", "TextInlineMath": "paragraph", "Reference": "paragraph", "Caption": "paragraph", "Footnote": "paragraph", "Code": "paragraph", "Handwriting": "paragraph",
    "Equation": "equation", "ListGroup": "list", "Table": "table", "TableGroup": "table", "Picture": "figure", "Figure": "figure", "PictureGroup": "figure", "FigureGroup": "figure", "PageHeader": "furniture", "PageFooter": "furniture",
}
TREE_ROLES = {"Reference": "reference", "Caption": "caption", "Footnote": "footnote", "Code": "code", "PageHeader": "header", "PageFooter": "footer"}
VISUALS = ["Picture", "Figure"]
# Fixed value: an equation's number at its end.
TRAILING_NUMBER = r"(?:\\quad|\\qquad|\s|~)*\(\s*(S?\d+[a-z]?)\s*\)\s*[.,]?\s*$"


def _tree_pages(native: DataFrame) -> DataFrame:
    """(doc, page, p): the pages of trees of HTML blocks with the number that their id gives, counted from 1."""
    pages = native.select("doc", F.explode(F.from_json(F.get_json_object("json", "$.children"), MARKER_PAGES)).alias("p"))
    number = F.nullif(F.regexp_extract("p.id", r"^/*page/(\d{1,9})(?:/|$)", 1), F.lit(""))
    return pages.select("doc", (number.cast("int") + 1).alias("page"), "p")


def malformed_pages(native: DataFrame) -> DataFrame:
    """(doc, code): a finding for each page of trees of HTML blocks (doc, json) whose id has no number."""
    return _tree_pages(native).where("page is null").select("doc", F.lit("PAGE_MALFORMED").alias("code"))


def tree_blocks(native: DataFrame) -> DataFrame:
    """Blocks of documents (doc, json) that are trees of HTML blocks: doc, page, pos, kind, role, level, label, runs, html, caption, id, raw.

    A table or figure group becomes one block with the caption of its first caption block; a list group's items are one
    block. An equation's label is the number in parentheses at its end. A page's number is in its id (``/page/3/Page/1`` is the fourth
    page); one without a number in its id has no blocks and is reported by ``malformed_pages``. Types that aren't known keep their JSON in ``raw``.
    """
    rows = _tree_pages(native).where("page is not null").select("doc", "page", F.posexplode("p.children").alias("at", "b"))
    typed = lambda table: F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    kind = F.coalesce(F.try_element_at(typed(TREE_KINDS), F.col("b.block_type")), F.lit("unknown"))
    members = F.coalesce("b.children", F.array().cast(f"array<{_LEAF}>"))
    of_type = lambda *names: F.filter(members, lambda m: m["block_type"].isin(*names))
    html = F.coalesce(F.get(of_type("Table"), F.lit(0))["html"], "b.html")
    items = F.array_join(F.transform(of_type("ListItem"), lambda m: m["html"]), "\n")
    own = F.when(kind == "list", F.coalesce(F.nullif(items, F.lit("")), "b.html")).when(kind == "table", html).otherwise(F.col("b.html"))
    rows = rows.select("doc", "page", "at", "b", kind.alias("kind"), own.alias("html"), F.get(of_type("Caption"), F.lit(0))["html"].alias("caption_html"), F.size(of_type(*VISUALS)).alias("panels"))
    read = rows.withColumns({"runs": html_runs("html"), "caption_runs": html_runs("caption_html")})
    plain = lambda runs: F.array_join(F.transform(runs, lambda r: r["text"]), "")
    caption = F.nullif(plain(F.col("caption_runs")), F.lit(""))
    latex = F.array_join(F.transform(F.filter("runs", lambda r: r["kind"] == "math"), lambda r: r["text"]), " ")
    label = F.when(F.col("kind") == "equation", F.nullif(F.regexp_extract(latex, TRAILING_NUMBER, 1), F.lit(""))).when(F.col("kind") == "figure", ids.figure_label(caption)).when(F.col("kind") == "table", ids.table_label(caption))
    level = F.when(F.col("kind") == "heading", F.coalesce(F.nullif(F.regexp_extract("html", "(?i)<h([1-6])\\b", 1), F.lit("")).cast("int"), F.lit(2)))
    alike = F.row_number().over(Window.partitionBy("doc", "page", "b.block_type").orderBy("at"))
    return read.select(
        "doc",
        "page",
        F.row_number().over(Window.partitionBy("doc").orderBy("page", "at")).alias("pos"),
        "kind",
        F.try_element_at(typed(TREE_ROLES), F.col("b.block_type")).alias("role"),
        level.alias("level"),
        label.alias("label"),
        "runs",
        "html",
        caption.alias("caption"),
        ids.content_id("block", F.col("doc").cast("string"), F.col("page").cast("string"), F.col("b.block_type"), alike.cast("string")).alias("id"),
        F.when(F.col("kind") == "unknown", F.to_json("b")).alias("raw"),
    )


def tree_findings(blocks: DataFrame) -> DataFrame:
    """(doc, page, id, code) of blocks of ``tree_blocks``: captions that are missing or alone, and equations without or with broken LaTeX."""
    from quire.operators.scanners import latex_balance

    latex = F.array_join(F.transform(F.filter("runs", lambda r: r["kind"] == "math"), lambda r: r["text"]), " ")
    rows = blocks.withColumn("_latex", F.when(F.col("kind") == "equation", latex))
    rows = rows.withColumn("_broken", F.size(latex_balance("_latex")) > 0)
    code = F.when(F.col("kind").isin("figure", "table") & F.col("caption").isNull(), "CAPTION_UNMATCHED").when(F.col("role") == "caption", "CAPTION_UNATTACHED").when((F.col("kind") == "equation") & (F.trim("_latex") == ""), "EQUATION_EMPTY").when((F.col("kind") == "equation") & F.col("_broken"), "EQUATION_UNBALANCED").when(F.col("kind") == "unknown", "BLOCK_UNCLASSIFIED")
    return rows.select("doc", "page", "id", code.alias("code")).where("code is not null")


RUN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("styles", T.ArrayType(T.StringType())), T.StructField("url", T.StringType())])
#: Elements that style text, that hold none, and that part words.
STYLED = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "sub": "subscript", "sup": "superscript"}
SILENT, PARTING = {"script", "style", "content-ref"}, {"br", "p", "li", "div"}


class _Runs(HTMLParser):
    """Pieces of text with what is open around them; pieces alike are joined afterwards."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str | None]] = []
        self.pieces: list[tuple[tuple, str]] = []
        self.formulas = 0

    def _state(self) -> tuple:
        tags = [t for t, _ in self.open]
        if "math" in tags:
            return "math", (), None, self.formulas
        url = next((u for t, u in reversed(self.open) if t == "a"), None)
        return "link" if url else "text", tuple(sorted({STYLED[t] for t in tags if t in STYLED})), url, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in PARTING and self.pieces and not any(t == "math" for t, _ in self.open):
            self.pieces.append((self._state(), " "))
        if tag == "math":
            self.formulas += 1
        if tag in STYLED or tag in SILENT or tag in ("a", "math"):
            self.open.append((tag, dict(attrs).get("href")))

    def handle_endtag(self, tag: str) -> None:
        last = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if last is not None:
            del self.open[last]

    def handle_data(self, data: str) -> None:
        if not any(t in SILENT for t, _ in self.open):
            self.pieces.append((self._state(), data))


def runs_of(html: str) -> list[dict]:
    """Rich-text runs of a block's HTML: text, links and formulas with their styles; white space collapsed, none at the ends."""
    reader = _Runs()
    reader.feed(html)
    reader.close()
    runs = []
    for (kind, styles, url, _), pieces in groupby(reader.pieces, key=lambda p: p[0]):
        text = "".join(t for _, t in pieces)
        text = text.strip() if kind == "math" else re.sub(r"\s+", " ", text)
        if text.strip() or (text and runs):
            runs.append({"kind": kind, "text": text, "styles": list(styles), "url": url})
    while runs and runs[-1]["kind"] != "math" and not runs[-1]["text"].strip():
        runs.pop()
    for at, strip in ((0, str.lstrip), (-1, str.rstrip)):
        if runs and runs[at]["kind"] != "math":
            runs[at]["text"] = strip(runs[at]["text"])
    return runs


@F.pandas_udf(T.ArrayType(RUN))
def html_runs(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``runs_of`` of each block's HTML; null gives none."""
    for values in parts:
        yield pd.Series([runs_of(v or "") for v in values])


def grid_html(cells: DataFrame, table: str) -> DataFrame:
    """(table, html, problems) of cells (table, row, column, row_span, column_span, header, text), places that none covers filled.

    A cell repeated at its own place counts once. A cell that would cover a place of one before it (by row, then column) is
    left out and reported. One table's cells make one text, so they meet in one row.
    """
    once = cells.groupBy(table, "row", "column").agg(F.first(F.struct("row_span", "column_span", "header", "text")).alias("c")).select(table, "row", "column", "c.*")
    grid = once.groupBy(table).agg(F.array_sort(F.collect_list(F.struct("row", "column", "row_span", "column_span", "header", "text"))).alias("_cells"))
    return grid.select(table, _grid_html("_cells").alias("g")).select(table, "g.html", "g.problems")


#: Places that a written grid has at most: one that claims more is reported and not written.
MOST_PLACES = 1_000_000


def written_grid(cells: list[dict], rows: int | None = None, columns: int | None = None) -> dict:
    """HTML of cells in the order given, on a grid of the given size or of the cells' own; see ``grid_html``."""
    spans = lambda c: (max(1, c["row_span"]), max(1, c["column_span"]))
    height = max((c["row"] + spans(c)[0] for c in cells), default=0) if rows is None else rows
    width = max((c["column"] + spans(c)[1] for c in cells), default=0) if columns is None else columns
    if height * width > MOST_PLACES:
        return {"html": "", "problems": [f"a grid of {height} by {width} places is not written"]}
    taken, kept, problems = np.zeros((height, width), bool), {}, []
    for c in cells:
        spot, (down, across) = (c["row"], c["column"]), spans(c)
        if spot in kept:
            continue
        area = taken[spot[0] : spot[0] + down, spot[1] : spot[1] + across]
        if area.any():
            problems.append(f"the cell {c['text']!r} at {spot[0]}, {spot[1]} lies over another one and is left out")
            continue
        kept[spot] = c
        area[:] = True

    def element(spot: tuple[int, int]) -> str:
        if spot not in kept:
            return "" if taken[spot] else "<td></td>"
        c = kept[spot]
        given = "".join(f' {name}="{c[key]}"' for name, key in (("rowspan", "row_span"), ("colspan", "column_span")) if c[key] > 1)
        tag = "th" if c["header"] else "td"
        return f"<{tag}{given}>{escape(c['text'] or '', quote=False)}</{tag}>"

    lines = ("<tr>" + "".join(element((r, k)) for k in range(width)) + "</tr>" for r in range(height))
    return {"html": "<table>" + "".join(lines) + "</table>", "problems": problems}


GRID_HTML = T.StructType([T.StructField("html", T.StringType()), T.StructField("problems", T.ArrayType(T.StringType()))])


@F.pandas_udf(GRID_HTML)
def _grid_html(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for tables in parts:
        yield pd.DataFrame([written_grid(list(t)) for t in tables], columns=["html", "problems"])


@F.pandas_udf(GRID_HTML)
def cells_html(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """``written_grid`` of cells, rows and columns."""
    for cells, rows, columns in parts:
        found = [written_grid(list(c) if c is not None else [], int(r), int(k)) for c, r, k in zip(cells, rows, columns, strict=True)]
        yield pd.DataFrame(found, columns=["html", "problems"])


def refined(blocks: DataFrame) -> DataFrame:
    """Blocks (doc, page, pos, kind, role, key, x0, y0, text) after the fixed chain of rewrites, with new_pos and lost_glyphs.

    Lines that other pages repeat at their place become furniture first; then earlier runs of references move before the last
    one; then characters that lost their glyph are counted.
    """
    from quire.functions.text import control_characters, glyph_codes
    from quire.operators.layout import reference_order, repeated_furniture

    body = blocks.where("kind <> 'furniture'")
    found = repeated_furniture(body, blocks).select("doc", "page", "pos", F.col("role").alias("_role"))
    rows = blocks.join(found, ["doc", "page", "pos"], "left").withColumns({"kind": F.when(F.col("_role").isNotNull(), "furniture").otherwise(F.col("kind")), "role": F.coalesce("_role", "role")}).drop("_role")
    rows = rows.withColumn("_reference", F.coalesce(F.col("role") == "reference", F.lit(False)))
    moved = reference_order(rows, ["doc"], "pos", "_reference").drop("_reference")
    return moved.withColumn("lost_glyphs", control_characters(F.col("text")) + glyph_codes(F.col("text")))
