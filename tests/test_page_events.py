"""Saved pages' articles against a plain reading of a tree of elements."""

import re
from html.parser import HTMLParser
from random import Random

import pytest
from pyspark.sql import functions as F

from quire.operators import page_events, saved_page
from quire.operators.html import VOID

FIGURE, TABLE = r"\s*(?:Supplementary\s+)?(?:Fig\.?|Figure|FIG\.?)\s*(S?\d+[A-Za-z]?)\b", r"\s*(?:Supplementary\s+)?(?:Table|TABLE|Tab\.)\s*(S?(?:\d+|[IVXLC]+)[A-Za-z]?)\b"


class Tree(HTMLParser):
    """Elements as lists: [tag, attributes, children, parent]."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.at = self.root = ["#root", {}, [], None]
        self.feed(html)
        self.close()

    def up(self, test, stop):
        e = self.at
        while e[3] is not None and not test(e[0]) and e[0] not in stop:
            e = e[3]
        if e[3] is not None and test(e[0]):
            self.at = e[3]

    def add(self, tag, attrs):
        self.at[2].append([tag, {k: v or "" for k, v in attrs}, [], self.at])

    def handle_starttag(self, tag, attrs):
        self.up(lambda name: tag in page_events.ENDED_BY.get(name, ()), page_events.KEPT_OPEN)
        self.add(tag, attrs)
        if tag not in VOID:
            self.at = self.at[2][-1]

    def handle_startendtag(self, tag, attrs):
        self.add(tag, attrs)

    def handle_endtag(self, tag):
        self.up(lambda name: name == tag, ())

    def handle_data(self, data):
        self.at[2].append(data)


def squash(x):
    return " ".join(x.split())


def inner(e):
    for c in e[2]:
        if isinstance(c, list):
            yield c
            yield from inner(c)


def around(e):
    while e[3] is not None:
        e = e[3]
        yield e


def name(e, *keys):
    return " ".join(e[1].get(k, "") for k in keys)


def hidden(e):
    return "hidden" in e[1] or e[1].get("aria-hidden") == "true" or "display:none" in e[1].get("style", "").replace(" ", "").lower() or bool(re.search(page_events.WIDGETS, name(e, "class", "data-title", "aria-labelledby", "id")))


def text(e):
    def parts(e):
        for c in e[2]:
            if isinstance(c, str):
                yield c
            elif c[0] in page_events.MATH:
                yield " "
            elif c[0] not in page_events.SILENT and not hidden(c):
                yield " " if c[0] in page_events.PARTING else ""
                yield from parts(c)

    return squash("".join(parts(e)))


def caption(e):
    return e[0] in ("figcaption", "caption") or bool(re.search(page_events.CAPTIONS, name(e, "class")))


def item(e):
    boxed = any(re.search(page_events.REFERENCE_BOX, name(x, "id", "class", "data-title")) for x in around(e))
    return (e[0] == "li" and boxed) or (e[0] in ("p", "li", "div") and bool(re.match(page_events.REFERENCE_ITEM, e[1].get("id", ""))))


def reference(e):
    return squash("".join(c if isinstance(c, str) else "" if re.search(page_events.LINKS, name(c, "class")) else f" {text(c)} " for c in e[2]))


def plain(html):
    root = Tree(html).root
    every = list(inner(root))
    weight = lambda e: sum(len(text(p)) for p in inner(e) if p[0] == "p")
    body = max((e for e in every if e[0] in ("article", "main")), key=weight, default=root)
    body = body if body is root or weight(body) else root
    inside = [*([body] if body is not root else []), *inner(body)]
    out = lambda e: e[0] in {"figure", "table", *page_events.SILENT} or caption(e) or item(e) or hidden(e)
    prose = [e for e in inside if not out(e) and not any(map(out, around(e)))]
    figures, tables = {}, {}
    for e in inside:
        if e[0] == "figure" or (e[0] in ("div", "p") and "fig" in name(e, "class").lower()):
            told = squash(" ".join(text(c) for c in inner(e) if caption(c) and (c[3] is e or not any(map(caption, around(c))))))
            told = told or squash(" ".join(text(c) for c in [e, *inner(e)] if c[0] == "p"))
            if m := re.match(FIGURE, told):
                figures.setdefault(m[1], (m[1], told, [c[1].get("src") or c[1].get("data-src", "") for c in inner(e) if c[0] == "img"]))
    for e in every:
        if e[0] == "table" and not any(x[0] == "table" for x in around(e)):
            told = next((text(c) for c in e[2] if isinstance(c, list) and c[0] == "caption"), None)
            if told is None:
                told = ""
                for box in list(around(e))[:4]:
                    before = [c for c in inner(box) if (caption(c) or re.fullmatch("h[1-6]", c[0]))]
                    before = [c for c in before if position(root, c) < position(root, e) and not any(x is c for x in around(e))]
                    joined = squash(" ".join(text(c) for c in before))
                    if re.match(TABLE, joined):
                        told = joined
                        break
            m = re.match(TABLE, told)
            if m:
                tables.setdefault(m[1], (m[1], told))
    return {
        "headings": [text(e) for e in prose if e[0] in ("h2", "h3", "h4") and text(e)],
        "paragraphs": [text(e) for e in prose if e[0] == "p" and len(text(e)) >= 40],
        "figures": sorted(figures.values()),
        "tables": sorted(tables.values()),
        "references": [reference(e) for e in inside if item(e) and not any(map(item, around(e))) and reference(e)],
    }


def position(root, e):
    return next(i for i, x in enumerate(inner(root)) if x is e)


def made(random):
    """Random markup: unclosed and crossing tags, captions, tables, references, hidden and publishers' parts."""
    words = lambda: " ".join(random.choice(["wave", "of", "light", "Fig. 2 b", "Table 1.", "Table IV x", "Figure S3:", "10.1000/ab.c", "field strength measured here in detail", "&amp;"]) for _ in range(random.randint(1, 6)))
    attrs = ["", "", "", ' class="fig-box"', ' class="caption"', ' id="references"', ' id="ref-3"', " hidden", ' class="links"', ' style="Display: none"', ' class="recommended"', ' data-title="bibliography"', ' class="fig caption-x"', ' id="b12"']
    tags = ["p", "p", "p", "div", "div", "li", "ul", "section", "article", "main", "figure", "figcaption", "h2", "h3", "table", "tr", "td", "caption", "span", "math", "button", "b", "script", "em"]

    def part(depth):
        out = []
        for _ in range(random.randint(1, 4)):
            if depth > 5 or random.random() < 0.35:
                out.append(words())
            elif random.random() < 0.1:
                out.append(random.choice(["<br>", '<img src="a.png">', "<div/>", '<img data-src="b">', "</p>", "</div>", '<a href="https://doi.org/10.2000%2Fx">y</a>']))
            else:
                tag = random.choice(tags)
                out.append(f"<{tag}{random.choice(attrs)}>{part(depth + 1)}" + (f"</{tag}>" if random.random() < 0.85 or tag == "script" else ""))
        return "".join(out)

    return f"<html><body>{part(0)}{part(0)}{part(0)}</body></html>"


def read(parts):
    found = {k: {} for k in parts}
    rows = lambda k, *columns: parts[k].select("doc", "pos", *columns).collect()
    for k in ("headings", "paragraphs", "references"):
        for r in sorted(rows(k, "text"), key=lambda r: r.pos):
            found[k].setdefault(r.doc, []).append(r.text)
    for k, columns in (("figures", ("label", "caption", "images")), ("tables", ("label", "caption"))):
        for r in rows(k, *columns):
            if r.label is not None:
                found[k].setdefault(r.doc, []).append(tuple(r[2:]))
    return found


def test_random_pages(spark):
    random = Random(8)
    pages = {str(i): made(random) for i in range(250)}
    frame = spark.createDataFrame(list(pages.items()), "doc string, html string")
    found = read({k: v for k, v in page_events.article(frame).items() if k not in ("meta", "equations")})
    want = {d: plain(h) for d, h in pages.items()}
    for k in found:
        for d, h in pages.items():
            got = found[k].get(d, [])
            assert (sorted(got) if k in ("figures", "tables") else got) == want[d][k], (k, h)
        assert sum(len(w[k]) for w in want.values()) > 20, k


PAGE = """<html><head><meta name="citation_doi" content="doi:10.1000/ABC"><meta name="DC.Title" content="Other"><meta name="citation_title" content="A  Wave"></head><body><nav><p>Navigation that is long enough to be taken for a paragraph</p></nav>
<main><p>A short main with few words in it, but more than forty.</p></main><article><h1>A Wave</h1><h2>Methods</h2><p>The light field is measured with <math alttext="E=mc"><mi>E</mi><annotation encoding="application/x-tex">E = m</annotation></math> a detector of small size here.
<div class="advert"><p>Buy this long advertisement that has more than forty characters.</p></div><figure id="f1"><img src="1.png"><figcaption><b>Fig. 1</b> Setup of the experiment</figcaption></figure>
<div class="equation"><math><mi>x</mi></math></div><div><h4>Table 1 Sums</h4><div><table><tr><th>a</th><td rowspan="2">1.5 <math alttext="y"></math></td></tr><tr><td>2</td></tr></table></div></div>
<section id="references"><ol><li>Ada, B. Title. 10.1000/x. <span class="links"><a href="https://doi.org/10.1000/Y%29">link</a></span></li><li>Other one</li></ol></section></article></body></html>"""


def test_one_page(spark):
    pages = spark.createDataFrame([("p", PAGE), ("q", None), ("r", "no markup"), ("s", "")], "doc string, html string")
    parts = page_events.article(pages)
    assert [tuple(r) for r in parts["meta"].collect()] == [("p", "10.1000/abc", "A Wave")]
    assert [r.text for r in parts["headings"].orderBy("pos").collect()] == ["Methods", "Table 1 Sums"]
    assert [r.text for r in parts["paragraphs"].collect()] == ["The light field is measured with a detector of small size here."]
    assert [tuple(r)[2:] for r in parts["figures"].collect()] == [("1", "Fig. 1 Setup of the experiment", ["1.png"])]
    (table,) = parts["tables"].collect()
    assert (table.label, table.caption, table.html) == ("1", "Table 1 Sums", '<table><tr><th>a</th><td rowspan="2">1.5 <math>y</math></td></tr><tr><td>2</td></tr></table>')
    assert [(c.row, c.column, c.text) for c in table.grid.cells] == [(0, 0, "a"), (0, 1, "1.5 y"), (1, 0, "2")]
    assert [(r.display, r.tex) for r in parts["equations"].orderBy("pos").collect()] == [(False, "E = m"), (True, None), (False, "y")]
    assert [(r.text, r.dois) for r in parts["references"].orderBy("pos").collect()] == [("Ada, B. Title. 10.1000/x.", ["10.1000/x", "10.1000/y"]), ("Other one", [])]


def test_page_against_paper(spark):
    """A page's parts feed the check: what the paper lacks is found, what agrees is not."""
    pages = spark.createDataFrame([("p", PAGE)], "doc string, html string")
    papers = spark.createDataFrame([("p", "10.1000/abc", "A wave"), ("z", None, "gone")], "doc string, doi string, title string")
    rows, own = page_events.checkable(page_events.article(pages), papers)
    one = lambda **v: spark.createDataFrame([tuple(v.values())], [*v])
    paper = {"headings": one(doc="p", text="Results"), "paragraphs": one(doc="p", pos=1, text="nothing of it"), "figures": one(doc="p", label="1", caption="Setup of quite another thing"), "tables": one(doc="p", label="1", text="a 1.5 2"), "references": one(doc="p", pos=1, text="x")}
    found = saved_page.check(rows, {k: (own[k], paper[k]) for k in paper})
    codes = sorted((r.doc, r.code, r.detail) for r in found.collect())
    assert codes == [("p", "HTML_CAPTION_DIFFERS", "1"), ("p", "HTML_HEADING_NOT_IN_PDF", "Methods"), ("p", "HTML_HEADING_NOT_IN_PDF", "Table 1 Sums"), ("p", "HTML_INCOMPLETE", str(len("The light field is measured with a detector of small size here."))), ("p", "HTML_REFERENCES_DIFFER", "2 / 1"), ("p", "HTML_TABLE_AGREED", "1"), ("p", "HTML_TEXT_NOT_IN_PDF", "1"), ("z", "HTML_IDENTITY_UNCONFIRMED", "unconfirmed")]


def test_tall_page(spark):
    """Thousands of open elements and of paragraphs: a running count a page, no pairs."""
    html = "<div class='fig'>" * 300 + "<p>Fig. 7 deep inside</p>" + "</div>" * 300 + "<article>" + "<p>" + "paragraph " * 6 + "</p>" * 1 + "<p>another paragraph that is long enough to count</p>" * 3000 + "</article>"
    parts = page_events.article(spark.createDataFrame([("t", html)], "doc string, html string"))
    assert parts["paragraphs"].count() == 3001 and parts["figures"].count() == 0
    assert parts["paragraphs"].agg(F.min("pos")).first()[0] > 300


@pytest.mark.parametrize("html", ["<", "<p", "<!--", "</p></p>", "<table><td>", "<math>", "<li id=ref1>a"])
def test_broken(html):
    assert all(r["n"] < r.get("last", r["n"] + 1) for r in page_events.scanned(html))


def test_elements_are_dealt_by_page_without_texts_at_ends(spark, monkeypatch):
    """What a task sorts is a page's share of a shuffle; an element's end carries no texts into the windows."""
    dealt = []
    deal = page_events.spread
    monkeypatch.setattr(page_events, "spread", lambda df, *keys: dealt.append((df, keys)) or deal(df, *keys))
    pages = spark.createDataFrame([("a", "<article><p>" + "word " * 20 + "</p><p>" + "more " * 20 + "</p></article>")], "doc string, html string")
    found = page_events.elements(page_events.page_rows(pages))
    (events, keys), = dealt
    assert keys == ("doc",) and not {"id", "boxed", "owners"} & set(events.columns)
    assert events.where("step = -1 and (text is not null or names is not null or src is not null)").count() == 0
    assert sorted(r.text.split()[0] for r in found.where("tag = 'p'").collect()) == ["more", "word"]
