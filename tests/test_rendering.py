"""Markdown of documents against a serial writer, and single blocks."""

import re
from random import Random

from pyspark.sql import functions as F

from quire.operators import pointer_tree, rendering, span_tree

SCHEMA = "doc string, page int, pos int, kind string, role string, level int, continues boolean, runs array<struct<kind: string, text: string, styles: array<string>, url: string>>"


def run(text, kind="text", styles=(), url=None):
    return (kind, text, list(styles), url)


def serial(blocks):
    """One pass: footnotes wait until their page is over, or the paragraph that goes on is."""
    out, page, open_, waiting = "", None, False, []
    for b in blocks:
        text = "".join(r[1] for r in b[7])
        if b[3] == "paragraph" and b[4] == "footnote":
            waiting.append(f"\n\n*Footnote (page {b[1]}):* {text}")
            continue
        text = {"heading": "#" * (b[5] or 1) + " " + text, "paragraph": ("> " if b[4] == "aside" else "") + text, "equation": f"$$\n{text}\n$$"}.get(b[3], "")
        if not text:
            continue
        joins = b[3] == "paragraph" and b[6] and open_
        anchor = "" if b[1] == page else f"<!-- source: pdf page {b[1]} -->\n"
        if anchor and not joins:
            out, waiting = out + "".join(waiting), []
        page = b[1]
        out += ("\n" if joins else "\n\n") + anchor + text
        if joins:
            out, waiting = out + "".join(waiting), []
        open_ = b[3] == "paragraph" and b[4] != "aside"
    return (out + "".join(waiting)).rstrip("\n") + "\n"


def test_random_documents(spark):
    random, rows, want = Random(5), [], {}
    for d in range(150):
        page, blocks = 1, []
        for pos in range(random.randint(1, 14)):
            page += random.random() < 0.4
            kind = random.choice(["paragraph"] * 5 + ["heading", "furniture", "equation"])
            role = random.choice(["body", "body", "footnote", "footnote", "aside"]) if kind == "paragraph" else None
            blocks.append((str(d), page, pos, kind, role, random.randint(1, 3), random.random() < 0.5, [run(random.choice(["a", "b c", "d", ""]))] if random.random() < 0.95 else []))
        rows += blocks
        if (text := serial(blocks)) != "\n":
            want[str(d)] = text
    random.shuffle(rows)
    got = {r.doc: r.markdown for r in rendering.document_markdown(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_inline(spark):
    runs = [run("E", "math", ["bold"]), run(" two words ", styles=["bold", "italic"]), run("x()", "code"), run("here", "link", ["superscript"], "u"), run("no", "link"), run("  ", styles=["bold"]), run("a\x01b\tc", styles=["odd"]), run("2", styles=["subscript"])]
    frame = spark.createDataFrame([("d", 1, 1, "paragraph", "body", None, False, runs)], SCHEMA)
    assert frame.select(rendering.inline(F.col("runs")).alias("m")).first().m == "$E$ ***two words*** `x()`<sup>[here](u)</sup>no  a�b\tc<sub>2</sub>"


def test_native_documents(spark):
    """Blocks of both native forms render, front matter first."""
    spans = '{"pages":[{"page_idx":0,"blocks":[{"type":"doc_title","content":"T"},{"type":"text","content":"begins"},{"type":"page_footnote","content":"n"},{"type":"image","content":[{"type":"image_caption","content":"Fig. 1 A"},{"type":"image_footnote","content":"note"}]}]},{"page_idx":1,"blocks":[{"type":"table","content":[{"type":"table_caption","content":"Table 2 (continued)"},{"type":"table_body","content":"<table><tr><td colspan=2>a|b</td></tr><tr><td>1</td><td>2</td></tr></table>"}]},{"type":"list","content":[{"type":"text","content":"x"}]},{"type":"odd"}]}]}'
    native = spark.createDataFrame([("d", spans), ("e", "{}")], "doc string, json string")
    front = spark.createDataFrame([("d", "---\na: 1\n---\n"), ("e", "---\n---\n")], "doc string, front string")
    got = {r.doc: r.markdown for r in rendering.document_markdown(span_tree.span_blocks(native).drop("panels"), front=front).collect()}
    assert got == {"e": "---\n---\n", "d": """---
a: 1
---


<!-- source: pdf page 1 -->
# T

begins

**Figure 1**

*(no image asset available)*

**Published caption:** Fig. 1 A

*Figure note:* note

*Footnote (page 1):* n

<!-- source: pdf page 2 -->
**Table 2** *(continued)*

**Published caption:** Table 2 (continued)

| a\\|b |  |
| --- | --- |
| 1 | 2 |

*Merged cells are shown once, at their first row and column; the HTML and cells files keep the exact structure.*

- x

<!-- retained backend block 'odd'; see document.json -->
"""}
    pointers = '{"formulas":true,"runs":[{"document":{"body":{"children":[{"$ref":"#/texts/0"},{"$ref":"#/pictures/0"}]},"texts":[{"label":"formula","text":"x=1"}],"pictures":[{}]}}]}'
    text = rendering.document_markdown(pointer_tree.pointer_blocks(spark.createDataFrame([("d", pointers)], "doc string, json string"))).first().markdown
    assert re.sub(r"\n+", "\n", text) == "\n<!-- source: pdf page 1 -->\n$$\nx=1\n$$\n**Figure (unlabelled)**\n*(no image asset available)*\n**Published caption:** *(none associated)*\n"
