"""Links to supplements inside runs."""

import re
from random import Random

from quire.operators import rendering, scanners
from quire.operators import supplement_links as L

RUNS = "array<struct<kind: string, text: string, styles: array<string>, url: string>>"


def test_anchors_and_targets(spark):
    rows = [
        ("a", 1, "h1", "heading", None, False, [("text", "Supplementary Note 2: Noise", [], None)]), ("a", 2, "f1", "figure", "S1", False, []), ("a", 3, "f2", "figure", "1", False, []), ("a", 4, "t1", "table", "S2b", True, []), ("a", 5, "t2", "table", "S2B", False, []), ("a", 6, "e1", "equation", "x", False, []), ("a", 7, "h2", "heading", None, False, [("text", "Methods", [], None)]),
        ("b", 1, "g1", "figure", "S1", False, []), ("b", 2, "g2", "figure", "9", None, []),
    ]
    found = L.anchors(spark.createDataFrame(rows, f"doc string, pos int, id string, kind string, label string, continues boolean, runs {RUNS}"))
    assert sorted((r.doc, r.id, r.anchor) for r in found.collect()) == [("a", "f1", "figure-s1"), ("a", "h1", "section-s2"), ("a", "t2", "table-s2b"), ("b", "g1", "figure-s1"), ("b", "g2", "figure-s9")]
    supplements = spark.createDataFrame([("p", 1, "s/b.md", "b"), ("p", 0, "s/a.md", "a"), ("q", 0, "s/c.md", "c")], "paper string, ordinal int, path string, doc string")
    got = {(r.paper, r.kind, r.number): r.target for r in L.targets(supplements, found).collect()}
    assert got == {("p", "figure", "1"): "s/a.md#figure-s1", ("p", "figure", "9"): "s/b.md#figure-s9", ("p", "table", "2b"): "s/a.md#table-s2b", ("p", "section", "2"): "s/a.md#section-s2", ("p", "document", ""): "s/a.md", ("q", "document", ""): "s/c.md"}


def plain(runs, targets):
    out = ""
    for kind, text, _, url in runs:
        if kind == "math":
            out += f"${text}$"
        elif kind == "link":
            found = scanners.supplement_references(text.strip())
            to = targets.get((found[0]["kind"], found[0]["number"])) if len(found) == 1 and (found[0]["start"], found[0]["end"]) == (0, len(text.strip())) else None
            out += f"[{text}]({to}) ([original link]({url}))" if to else f"[{text}]({url})"
        else:
            out += scanners.linked(text, targets)
    return out


def test_linked_runs(spark):
    """As a serial writer links them, over random runs."""
    random, rows = Random(9), []
    pieces = ["See Fig. S1", " and Supplementary Table 2", "; Eqs. (S3), ", "é Note S4.", " the Supporting Information ", "Figure 7", "Fig. S9", "plain"]
    for i in range(200):
        runs = [(random.choice(["text", "text", "math", "link"]), "".join(random.choice(pieces) for _ in range(random.randint(1, 3))), [], None) for _ in range(random.randint(0, 4))]
        rows.append((random.choice("pq"), i, [(k, t.strip() if k == "link" else t, s, "u" if k == "link" else None) for k, t, s, _ in runs], f"x{i}"))
    known = [("p", "figure", "1", "a#f1"), ("p", "table", "2", "a#t2"), ("p", "document", "", "a"), ("q", "equation", "3", "b#e3"), ("q", "section", "4", "b#s4"), ("q", "figure", "9", "b#f9")]
    blocks = spark.createDataFrame(rows, f"paper string, pos int, runs {RUNS}, id string")
    got = L.linked_runs(blocks, spark.createDataFrame(known, "paper string, kind string, number string, target string"))
    assert got.columns == blocks.columns
    shown = {r.id: r.m for r in got.select("id", rendering.inline(got.runs).alias("m")).collect()}
    want = {i: plain(runs, {(k, n): t for p, k, n, t in known if p == paper}) for paper, _, runs, i in rows}
    assert shown == want and sum("](a" in m or "](b" in m for m in want.values()) > 40


def test_styles_stay(spark):
    blocks = spark.createDataFrame([("p", 1, [("text", "in Fig. S1 x", ["bold"], None), ("text", "none", [], None)]), ("p", 2, None), ("p", 3, [])], f"paper string, pos int, runs {RUNS}")
    got = {r.pos: r.runs and [tuple(x) for x in r.runs] for r in L.linked_runs(blocks, spark.createDataFrame([("p", "figure", "1", "a")], "paper string, kind string, number string, target string")).collect()}
    assert got == {1: [("text", "in ", ["bold"], None), ("link", "Fig. S1", ["bold"], "a"), ("text", " x", ["bold"], None), ("text", "none", [], None)], 2: None, 3: []}
    assert re.match(L.LABEL.replace("(?i)", ""), "S12a")
