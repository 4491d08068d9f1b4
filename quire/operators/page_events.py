"""Articles of saved pages from their elements as intervals.

One scan of a page gives a row for each element that can matter, with its first and last place in the page, and a row for each piece
of text with the elements whose text it belongs to. All else is relational: what an element stands in is a running count of the
elements opened before it, how much prose an element holds is the difference of a running sum at its two ends, captions meet
figures, and tables what is printed above them, by their places. Rows of a page share one key; none is gathered whole after the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import ids
from quire.operators.html import VOID, parse_table
from quire.sources.shared import materialize, spread

# Elements whose content is no text, those that part words, those that an element ends, and names of classes.
SILENT = {"script", "style", "noscript", "template", "button", "nav", "form", "select", "iframe", "svg", "mjx-assistive-mml", "mjx-speech", "canvas"}
MATH = {"math", "mjx-container"}
PARTING = {"p", "div", "li", "td", "th", "tr", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "br"}
ENDED_BY = {
    "p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "figure"},
    "li": {"li"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "tr": {"tr"},
}
KEPT_OPEN = {"table", "ul", "ol", "div", "section", "article"}
WIDGETS = r"(?i)recommend|related.subjects|advert|nomad|rights.and.permissions|about.this.article|bibliographic.information|supplementary.information"
CAPTIONS = r"(?i)caption|figure-title|fig-title|figure-description|fig-desc"
REFERENCE_BOX = r"(?i)(?:^|[-_\s])(?:references?|ref-list|bibliography|bibl)(?:$|[-_\s])"
REFERENCE_ITEM = r"(?i)^(?:ref|b|bib|cr)[-_]?\d+$"
LINKS = r"(?i)(?:^|[-_\s])links?(?:$|[-_\s])|nomad"
PAGE_DOI = r"\b(10\.\d{4,9}/[^\s\"<>]+)"
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
#: Characters of a paragraph of the body, containers above a table that are searched for its caption, rows of an Arrow batch that leaves a scan.
LEAST_PARAGRAPH, LEVELS, ROWS = 40, 4, 4096

SCHEMA = "doc string, n int, last int, parent int, tag string, names string, id string, boxed string, quiet boolean, shown boolean, text string, owners array<int>, above array<int>, dois array<string>"
_FIELDS = [("n", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("names", pa.string()), ("id", pa.string()), ("boxed", pa.string()), ("quiet", pa.bool_()), ("shown", pa.bool_()), ("text", pa.string()), ("owners", pa.list_(pa.int32())), ("above", pa.list_(pa.int32())), ("dois", pa.list_(pa.string()))]
_WIDGETS, _CAPTIONS, _BOX, _ITEM, _LINKS, _DOI = (re.compile(x) for x in (WIDGETS, CAPTIONS, REFERENCE_BOX, REFERENCE_ITEM, LINKS, PAGE_DOI))
_EMITTED = {"p", "li", "table", "figure", "article", "main", "caption", "figcaption", "img", *HEADINGS}


def _entry(n: int) -> int:
    """The number under which an element's text as a reference stands; it is its own inverse."""
    return -n - 2


class _Scan(HTMLParser):
    """Rows of a page's elements and pieces of text, as they stand."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open = [{"n": -1, "tag": "#root", "owner": False, "quiet": False, "link": False, "item": False, "box": False, "row": None, "table": False, "math": False, "tex": False, "pushed": True}]
        self.places = 0
        self.markup: list[str] | None = None
        self.math: dict | None = None

    def _owners(self) -> list[int]:
        """The open elements whose text the place is part of: none whose text ends at something silent further inside.

        A reference's own text, under the number ``_entry`` gives, leaves out only links directly below it and whatever is silent
        below its own children.
        """
        found, silent = [], 0
        for k in range(len(self.open) - 1, -1, -1):
            e = self.open[k]
            if e["owner"] and silent <= k:
                found.append(e["n"])
            if e["item"] and silent <= k + 1 and not (k + 1 < len(self.open) and self.open[k + 1]["link"]):
                found.append(_entry(e["n"]))
            silent = max(silent, k if e["quiet"] else 0)
        return found[::-1]

    def _piece(self, text: str, owners: list[int] | None = None) -> None:
        owners = self._owners() if owners is None else owners
        if owners:
            last = self.rows[-1] if self.rows else None
            if last is not None and last["tag"] == "#text" and last["owners"] == owners:
                last["text"] += text
            else:
                self.rows.append({"n": self.places, "tag": "#text", "text": text, "owners": owners})
        self.places += 1

    def _doi(self, value: str) -> None:
        item = next((e for e in reversed(self.open) if e["item"]), None)
        if item is not None:
            for doi in (m.rstrip(".,;)").lower() for m in _DOI.findall(value)):
                if doi not in item["row"]["dois"]:
                    item["row"]["dois"].append(doi)

    def _close(self, at: int) -> None:
        while len(self.open) > at:
            e = self.open.pop()
            if e["row"] is not None:
                e["row"]["last"] = self.places
            if e["math"]:
                tex = e["row"]["text"] = " ".join((self.math["tex"] or self.math["alt"] or "").split()) or None
                self.math = None
                if self.markup is not None:
                    self.markup.append(f"<math>{escape(tex or '', quote=False)}</math>")
            elif e["table"]:
                e["row"]["text"] = f"<table>{''.join(self.markup)}</table>"
                self.markup = None
            elif self.markup is not None and self.math is None and e["tag"] not in SILENT and e["pushed"]:
                self.markup.append(f"</{e['tag']}>")
            if self.open[-1]["item"] and not e["link"]:
                self._piece(" ", [_entry(self.open[-1]["n"])])

    def _start(self, tag: str, attrs: list[tuple[str, str | None]], stays: bool) -> None:
        own = {k: v or "" for k, v in attrs}
        names, id_ = own.get("class", ""), own.get("id", "")
        below_item = self.open[-1]["item"]
        labels = " ".join(own.get(k, "") for k in ("class", "data-title", "aria-labelledby", "id"))
        hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower() or bool(_WIDGETS.search(labels))
        silent = tag in SILENT or hidden
        link = bool(_LINKS.search(names))
        if below_item and not link:
            self._piece(" ", [_entry(self.open[-1]["n"])])
        if tag in MATH or (tag in PARTING and not silent):
            self._piece(" ")
        caption = tag in ("figcaption", "caption") or bool(_CAPTIONS.search(names))
        boxed = " ".join((id_, names, own.get("data-title", "")))
        item = (tag == "li" and any(e["box"] for e in self.open)) or (tag in ("p", "li", "div") and bool(_ITEM.match(id_)))
        box, outer_table, outer_math = bool(_BOX.search(boxed)), tag == "table" and self.markup is None, tag in MATH and self.math is None
        display = "equation" in names.lower() or tag == "disp-formula"
        row = None
        if tag == "meta":
            row = {"tag": tag, "names": (own.get("name") or own.get("property") or "").lower(), "text": " ".join(own.get("content", "").split())}
        elif tag in _EMITTED or caption or item or box or silent or display or outer_math or (tag in ("div", "p") and "fig" in names.lower()):
            row = {"tag": "math" if outer_math else tag, "names": names, "id": id_, "boxed": boxed, "dois": [], "quiet": silent, "shown": display or (outer_math and own.get("display") in ("block", "true"))}
            row |= {"text": own.get("src") or own.get("data-src", "") if tag == "img" else None, "above": [e["n"] for e in self.open[::-1][:LEVELS]] if outer_table else None}
        if row is not None:
            row |= {"n": self.places, "last": self.places + 1, "parent": self.open[-1]["n"]}
            self.rows.append(row)
        if outer_math:
            self.math = {"tex": None, "alt": own.get("alttext")}
        elif self.markup is not None and self.math is None and tag not in SILENT:
            self.markup.append(f"<{tag}" + "".join(f' {k}="{escape(own[k])}"' for k in ("rowspan", "colspan") if k in own) + ">")
        entry = {"n": self.places, "tag": tag, "owner": caption or tag == "p" or tag in HEADINGS, "quiet": silent or tag in MATH, "link": link, "item": item, "box": box, "row": row, "table": outer_table, "math": outer_math, "pushed": tag not in VOID}
        entry["tex"] = tag == "annotation" and "tex" in own.get("encoding", "").lower() and self.math is not None and self.math["tex"] is None
        if entry["tex"]:
            self.math["tex"] = ""
        self.places += 1
        if outer_table:
            self.markup = []
        self.open.append(entry)
        for value in (unquote(own.get("href", "")), own.get("data-doi", "")):
            if value:
                self._doi(value)
        if not stays or tag in VOID:
            self._close(len(self.open) - 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at]["tag"]
            if tag in ENDED_BY.get(name, ()):
                self._close(at)
                break
            if name in KEPT_OPEN:
                break
        self._start(tag, attrs, True)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._start(tag, attrs, False)

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at]["tag"] == tag:
                self._close(at)
                return

    def handle_data(self, data: str) -> None:
        if self.markup is not None and self.math is None and not any(e["tag"] in SILENT for e in self.open):
            self.markup.append(escape(data, quote=False))
        if self.math is not None and any(e["tex"] for e in self.open):
            self.math["tex"] += data
        self._piece(data)
        self._doi(data)


def scanned(html: str | None) -> list[dict]:
    """The rows of one page."""
    scan = _Scan()
    scan.feed(html or "")
    scan.close()
    scan._close(1)
    return scan.rows


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, html in zip(batch["doc"].to_pylist(), batch["html"].to_pylist(), strict=True):
            rows = scanned(html)
            for at in range(0, len(rows), ROWS):
                part = rows[at : at + ROWS]
                yield pa.record_batch({"doc": pa.array([doc] * len(part), pa.string())} | {name: pa.array([r.get(name) for r in part], kind) for name, kind in _FIELDS})


def page_rows(pages: DataFrame) -> DataFrame:
    """Elements and pieces of text of pages (doc, html), stored; see the module. Nulls and junk give no rows or few."""
    return materialize(pages.select(F.col("doc").cast("string").alias("doc"), F.col("html").cast("string").alias("html")).mapInArrow(_scan, SCHEMA), "page_rows")


def _squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _texts(rows: DataFrame) -> DataFrame:
    """(doc, n, text): the text of each element that has any, without what is hidden inside it."""
    pieces = rows.where("tag = '#text'").select("doc", F.col("n").alias("at"), "text", F.explode("owners").alias("n"))
    found = pieces.groupBy("doc", "n").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"))
    return found.select("doc", "n", _squash(F.array_join(F.transform("p", lambda x: x["text"]), "")).alias("text"))


def elements(rows: DataFrame) -> DataFrame:
    """(doc, n, last, parent, tag, names, above, dois, src, text, entry (its text as a reference), caption, item, excluded, in_*, prose, prose_inside) of elements, stored.

    ``in_excluded``, ``in_captions``, ``in_items`` and ``in_tables`` count the elements of that kind around one; ``prose`` is the
    length of all paragraphs that it holds.
    """
    texts = _texts(rows)
    entries = texts.where("n < -1").select("doc", (F.lit(-2) - F.col("n")).alias("n"), F.col("text").alias("entry"))
    found = rows.where("tag not in ('#text', 'meta')").withColumnRenamed("text", "src").join(texts, ["doc", "n"], "left").join(entries, ["doc", "n"], "left")
    caption = F.col("tag").isin("figcaption", "caption") | F.col("names").rlike(CAPTIONS)
    found = found.withColumns({"caption": caption, "box": F.col("boxed").rlike(REFERENCE_BOX), "text": F.coalesce("text", F.lit("")), "entry": F.coalesce("entry", F.lit(""))})
    ends = F.explode(F.array(F.struct(F.col("n").alias("at"), F.lit(1).alias("step")), F.struct(F.col("last").alias("at"), F.lit(-1).alias("step")))).alias("e")
    # an end needs no texts; dealt by page into as many parts as a shuffle has, so that what a task sorts stays small
    at_start = {c: F.when(F.col("e.step") == 1, F.col(c)) for c in ("names", "above", "dois", "src", "text", "entry")}
    found = found.withColumn("item_id", F.col("id").rlike(REFERENCE_ITEM)).drop("id", "boxed", "owners")
    events = spread(found.select("*", ends).withColumns(at_start).select("*", "e.at", "e.step").drop("e"), "doc")
    # an end comes before a start at its place; of several ends the inner one comes first
    order = Window.partitionBy("doc").orderBy("at", "step", F.col("n") * F.col("step"))
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("step"))).over(before), F.lit(0))
    events = events.withColumns({"in_boxes": count(F.col("box")), "in_captions": count(F.col("caption")), "in_tables": count(F.col("tag") == "table"), "in_shown": count(F.col("shown") & (F.col("tag") != "math"))})
    opened = (F.col("step") == 1) & (((F.col("tag") == "li") & (F.col("in_boxes") > 0)) | (F.col("item_id") & F.col("tag").isin("p", "li", "div")))
    # what an element is, is known at its start: its end takes it from there
    of_element = Window.partitionBy("doc", "n")
    events = events.withColumn("item", F.max(opened).over(of_element))
    excluded = F.col("tag").isin("figure", "table") | F.col("caption") | F.col("item") | F.col("quiet")
    prose = F.coalesce(F.sum(F.when((F.col("tag") == "p") & (F.col("step") == 1), F.length("text"))).over(upto), F.lit(0))
    events = events.withColumns({"excluded": excluded}).withColumns({"in_items": count(F.col("item")), "in_excluded": count(F.col("excluded")), "upto": prose})
    held = (F.max(F.when(F.col("step") == -1, F.col("upto"))).over(of_element) - F.max(F.when(F.col("step") == 1, F.col("upto"))).over(of_element)).alias("prose")
    return materialize(events.select("doc", "n", "last", "parent", "tag", "names", "above", "dois", "src", "text", "entry", "caption", "item", "excluded", "in_captions", "in_tables", "in_items", "in_excluded", "in_shown", "shown", "step", held).where("step = 1").drop("step"), "elements")


def _bodies(found: DataFrame) -> DataFrame:
    """(doc, body_n, body_last): the article or main element with the most prose, the first of several; else the whole page."""
    best = F.max_by(F.struct("n", "last"), F.struct("prose", (-F.col("n")).alias("first")))
    chosen = found.where("tag in ('article', 'main') and prose > 0").groupBy("doc").agg(best.alias("b"))
    every = found.select("doc").distinct().join(chosen, "doc", "left")
    return every.select("doc", F.coalesce("b.n", F.lit(-1)).alias("body_n"), F.coalesce("b.last", F.lit(2147483647)).alias("body_last"))


def meta(rows: DataFrame) -> DataFrame:
    """(doc, doi, title): what a page declares of its work: the first value of ``citation_doi``, or else ``dc.identifier``, that holds a DOI; the first title."""
    named = rows.where("tag = 'meta' and text <> ''").select("doc", "n", F.col("names").alias("name"), "text")
    doi = F.lower(F.nullif(F.regexp_extract("text", PAGE_DOI, 1), F.lit("")))
    first = lambda value, *names: [F.min_by(value, F.when((F.col("name") == n) & value.isNotNull(), F.col("n"))) for n in names]
    has = F.max(F.col("name") == "citation_doi")
    citation, other = first(doi, "citation_doi", "dc.identifier")
    title = F.coalesce(*first(F.col("text"), "citation_title", "dc.title"))
    return named.groupBy("doc").agg(F.when(has, citation).otherwise(other).alias("doi"), title.alias("title"))


def figures(found: DataFrame) -> DataFrame:
    """(doc, pos, label, caption, images) of figures in the body (``found`` with body_n, body_last): one a printed label, the first."""
    holder = (F.col("tag") == "figure") | (F.col("tag").isin("div", "p") & F.lower("names").contains("fig"))
    own = found.where(holder & (F.col("n") >= F.col("body_n")) & (F.col("n") < F.col("body_last"))).select("doc", F.col("n").alias("f"), F.col("last").alias("f_last"))
    inner = found.where("caption or tag in ('p', 'img')").select("doc", "n", "parent", "tag", "caption", "in_captions", "text", "src")
    met = own.join(inner, "doc").where("n > f and n < f_last").unionByName(own.join(inner, "doc").where("n = f and tag = 'p'"))
    told = F.col("caption") & (F.col("n") > F.col("f")) & ((F.col("in_captions") == 0) | (F.col("parent") == F.col("f")))
    listed = lambda test, value: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("n", F.col(value).alias("v"))))), lambda x: x["v"])
    joined = lambda test: _squash(F.array_join(listed(test, "text"), " "))
    text = met.groupBy("doc", "f").agg(joined(told).alias("own"), joined(F.col("tag") == "p").alias("other"), listed(F.col("tag") == "img", "src").alias("images"))
    text = text.withColumn("caption", F.coalesce(F.nullif("own", F.lit("")), "other")).withColumn("label", ids.figure_label(F.col("caption"))).where("label is not null")
    first = text.groupBy("doc", "label").agg(F.min_by(F.struct("f", "caption", "images"), "f").alias("x"))
    return first.select("doc", F.col("x.f").alias("pos"), "label", "x.caption", "x.images")


def tables(found: DataFrame) -> DataFrame:
    """(doc, pos, label, caption, html, grid) of a page's outer tables: one a printed label, the first, and unlabelled ones of two rows or more.

    The caption is the table's own, or what captions and headings say in front of it, within the nearest of the four
    containers around it where that begins with a table's label.
    """
    own = found.where("tag = 'table' and in_tables = 0").select("doc", F.col("n").alias("t"), F.col("last").alias("t_last"), "above", F.col("src").alias("html"))
    said = found.where(F.col("caption") | F.col("tag").isin(HEADINGS)).select("doc", "n", "last", "parent", "tag", "text")
    inside = own.join(said.where("tag = 'caption'").withColumnRenamed("parent", "t"), ["doc", "t"]).groupBy("doc", "t").agg(F.min_by("text", "n").alias("inner"))
    levels = own.select("doc", "t", F.posexplode("above").alias("level", "box"))
    before = levels.join(said, "doc").where("n > box and n < t and last <= t").groupBy("doc", "t", "level").agg(_squash(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ")).alias("c"))
    near = before.where(ids.table_label(F.col("c")).isNotNull()).groupBy("doc", "t").agg(F.min_by("c", "level").alias("outer"))
    rows = own.join(inside, ["doc", "t"], "left").join(near, ["doc", "t"], "left")
    rows = rows.withColumn("caption", F.coalesce("inner", "outer", F.lit(""))).withColumns({"label": ids.table_label(F.col("caption")), "grid": parse_table("html")})
    labelled = rows.where("label is not null").groupBy("doc", "label").agg(F.min_by(F.struct("t", "caption", "html", "grid"), "t").alias("x")).select("doc", F.col("x.t").alias("pos"), "label", "x.caption", "x.html", "x.grid")
    return labelled.unionByName(rows.where("label is null and grid.rows >= 2").select("doc", F.col("t").alias("pos"), "label", "caption", "html", "grid"))


def equations(found: DataFrame) -> DataFrame:
    """(doc, pos, display, tex) of the body's formulas; TeX where the page gives it."""
    own = found.where("tag = 'math' and n >= body_n and n < body_last")
    return own.select("doc", F.col("n").alias("pos"), (F.col("shown") | (F.col("in_shown") > 0)).alias("display"), F.col("src").alias("tex"))


def article(pages: DataFrame) -> dict[str, DataFrame]:
    """What saved pages (doc, html) hold, by part: meta, headings, paragraphs, figures, tables, equations and references.

    headings and paragraphs: doc, pos, text; references: doc, pos, text, dois; the others as ``meta``, ``figures`` and ``tables`` say. The body is the
    article or main element with the most prose, or the page. Headings (of levels 2 to 4) and paragraphs (40 characters or more) stand outside
    figures, tables, captions, references and hidden or publishers' parts. A page without any of a part has no rows of it.
    """
    rows = page_rows(pages)
    found = elements(rows)
    found = found.join(F.broadcast(small) if (small := materialize(_bodies(found), "bodies")).count() <= 1_000_000 else small, "doc")
    body = found.where("n >= body_n and n < body_last")
    prose = body.where("not excluded and in_excluded = 0")
    return {
        "meta": meta(rows),
        "headings": prose.where("tag in ('h2', 'h3', 'h4') and text <> ''").select("doc", F.col("n").alias("pos"), "text"),
        "paragraphs": prose.where(F.col("tag") == "p").where(F.length("text") >= LEAST_PARAGRAPH).select("doc", F.col("n").alias("pos"), "text"),
        "figures": figures(found),
        "tables": tables(found),
        "equations": equations(found),
        "references": body.where("item and in_items = 0 and entry <> ''").select("doc", F.col("n").alias("pos"), F.col("entry").alias("text"), "dois"),
    }


def checkable(parts: dict[str, DataFrame], papers: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """What ``saved_page.check`` asks of pages: a row a page beside its paper's (doc, doi, title), and the page's side of each part."""
    body = parts["paragraphs"].groupBy("doc").agg(F.sum(F.length("text")).alias("characters"))
    of_page = parts["meta"].select("doc", F.col("doi").alias("page_doi"), F.col("title").alias("page_title"))
    of_paper = papers.select(F.col("doc").cast("string").alias("doc"), F.col("doi").alias("paper_doi"), F.col("title").alias("paper_title"))
    pages = of_paper.join(of_page, "doc", "left").join(body, "doc", "left").withColumn("characters", F.coalesce("characters", F.lit(0)))
    cells = F.array_join(F.transform("grid.cells", lambda c: c["text"]), " ")
    return pages, parts | {"tables": parts["tables"].select("doc", "label", cells.alias("text")), "figures": parts["figures"].select("doc", "label", "caption")}
