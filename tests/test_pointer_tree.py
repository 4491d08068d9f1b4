"""Documents of JSON pointers against a plain walk, and their blocks' parts on a fixture."""

import json
import re
from random import Random

from quire.operators import normalize, pointer_tree


def ref(kind, i):
    return {"$ref": f"#/{kind}/{i}"}


def made(random):
    """A document of random references: nested and shared groups, cycles, lists, references to nothing, furniture."""
    texts = [{"label": random.choice(["text", "text", "list_item", "list_item", "section_header", "formula", "odd"]), "text": random.choice([f"t{i}", "References", "Methods"]), "self_ref": f"#/texts/{i}", "marker": random.choice(["", f"[{i}]"])} for i in range(12)]
    for t in random.sample(texts, 2):
        t |= {"content_layer": "furniture", "label": random.choice(["page_header", "page_footer", "other"])}
    for t in texts:
        t["prov"] = [{"page_no": random.choice([1, 1, 2])}]
    anything = lambda: random.choice([ref("texts", random.randint(0, 13)), ref("groups", random.randint(0, 6)), ref("tables", random.randint(0, 2)), ref("pictures", 0), {"$ref": "texts/1"}, {"$ref": "#/texts/x"}])
    groups = [{"label": random.choice(["list", "ordered_list", "section"]), "children": [anything() for _ in range(random.randint(0, 3))]} for _ in range(6)]
    if random.random() < 0.5:
        groups[0]["content_layer"] = "furniture"
    return {"schema_name": "D", "body": {"children": [anything() for _ in range(5)]}, "texts": texts, "groups": groups, "tables": [{"self_ref": "#/tables/0"}, {"self_ref": "#/tables/1"}], "pictures": [{"self_ref": "#/pictures/0", "captions": [ref("texts", random.randint(0, 15))]}]}


def plain(document):
    """(page, kind, text) of blocks: a walk that enters no group within itself."""
    out, heading = [], ""

    def item(pointer):
        m = re.fullmatch(r"#/(\w+)/(\d+)", pointer)
        found = document.get(m[1], []) if m else []
        return found[int(m[2])] if m and int(m[2]) < len(found) else None

    def page(x):
        return (x.get("prov") or [{}])[0].get("page_no") or 1

    def listed(members):
        if members and re.match(pointer_tree.REFERENCES, heading):
            out.extend((page(m), 0, "paragraph", (m["marker"] + " " if m["marker"] else "") + m["text"]) for m in members)
        elif members:
            out.append((page(members[0]), 0, "list", "|".join(m["text"] for m in members)))

    def walk(pointer, inside):
        nonlocal heading
        x = item(pointer)
        if x is None or x.get("content_layer") == "furniture" or pointer in inside:
            return
        kind, label, text = pointer.split("/")[1], x.get("label", ""), x.get("text", "")
        if kind == "groups":
            below = [(c.get("$ref", ""), item(c.get("$ref", ""))) for c in x["children"]]
            is_list = label in ("list", "ordered_list")
            if is_list:
                listed([c for _, c in below if c is not None and c.get("label") == "list_item"])
            for p, c in below:
                if c is not None and not (is_list and c.get("label") == "list_item"):
                    walk(p, inside | {pointer})
        elif kind in ("tables", "pictures"):
            caption = next((c["text"] for r in x.get("captions", []) if (c := item(r["$ref"])) is not None), None)
            out.append((page(x), 0, kind.replace("tables", "table").replace("pictures", "figure"), caption or ""))
        elif label == "list_item":
            listed([x])
        else:
            if label == "section_header":
                heading = text
            out.append((page(x), 0, {"formula": "equation", "section_header": "heading", "text": "paragraph"}.get(label, "unknown"), text))

    for child in document["body"]["children"]:
        walk(child["$ref"], frozenset())
    for x in document["texts"]:
        if x.get("content_layer") == "furniture":
            role = pointer_tree.FURNITURE.get(x["label"])
            out.append((page(x), {"header": -1, "footer": 1}.get(role, 0), "furniture" if role else "unknown", x["text"]))
    return [(p, k, t) for p, _, k, t in sorted(out, key=lambda b: b[:2])]


def test_random_documents(spark):
    random = Random(11)
    documents = [made(random) for _ in range(60)]
    native = spark.createDataFrame([(i, json.dumps({"formulas": True, "runs": [{"document": d}]})) for i, d in enumerate(documents)] + [(99, "no json"), (98, None), (97, '{"runs": 3}')], "doc int, json string")
    got = {}
    text = lambda r: "".join(x["text"] for x in r)
    for b in sorted(pointer_tree.pointer_blocks(native).collect(), key=lambda b: b.pos):
        shown = "|".join(text(i) for i in b["items"]) if b["items"] is not None else b.caption or "" if b.kind in ("table", "figure") else json.loads(b.raw)["text"] if b.raw else text(b.runs)
        got.setdefault(b.doc, []).append((b.page, b.kind, shown))
    for i, d in enumerate(documents):
        assert got.get(i, []) == plain(d), (i, d)
    assert not {97, 98, 99} & set(got)


def test_deep_groups(spark):
    """Twenty levels need five joins; a chain that ends in a circle has no place."""
    groups = [{"label": "section", "children": [ref("groups", i + 1)]} for i in range(19)] + [{"label": "section", "children": [ref("texts", 0)]}, {"label": "x", "children": [ref("groups", 21)]}, {"label": "x", "children": [ref("groups", 20), ref("texts", 0)]}]
    native = spark.createDataFrame([(1, json.dumps({"runs": [{"document": {"body": {"children": [ref("groups", 0)]}, "groups": groups, "texts": [{"label": "text", "text": "deep"}]}}]}))], "doc int, json string")
    assert [(b.kind, b.runs[0].text) for b in pointer_tree.pointer_blocks(native).collect()] == [("paragraph", "deep")]
    places = pointer_tree.group_places(pointer_tree.nodes(native)).collect()
    assert sorted(len(p.path) for p in places) == list(range(21))


def test_parts_of_blocks(spark):
    cell = lambda r, c, text, down=1, across=1, head=False: {"start_row_offset_idx": r, "start_col_offset_idx": c, "row_span": down, "col_span": across, "text": text, "column_header": head}
    box = lambda l, t, r, b, origin: {"page_no": 1, "bbox": {"l": l, "t": t, "r": r, "b": b, "coord_origin": origin}}  # noqa: E731, E741
    document = {
        "pages": {"1": {"size": {"width": 300.0, "height": 200.0}}, "x": {"size": {"width": 1, "height": 1}}},
        "body": {"children": [ref("texts", 0), ref("tables", 0), ref("pictures", 0), ref("texts", 3), ref("texts", 4), ref("tables", 1), ref("texts", 7), ref("texts", 8)]},
        "texts": [
            {"label": "section_header", "level": 2, "text": "Methods", "self_ref": "#/texts/0", "prov": [box(10, 190, 290, 180, "BOTTOMLEFT")]}, {"label": "caption", "text": "Table IV. Sums (continued)"}, {"label": "footnote", "text": "a Estimated."},
            {"label": "text", "text": "A link", "hyperlink": "https://a.b", "formatting": {"bold": True, "italic": False, "script": "super"}}, {"label": "formula", "text": "E = m", "orig": "E = m (S3)"}, {"label": "caption", "text": "Fig. 2b Wave", "prov": [box(0, 5, 50, 1, "TOPLEFT")]}, {"label": "text", "text": "second"},
            {"label": "caption", "text": "alone"}, {"label": "text", "text": "S .0137 e .0138"},
        ],
        "tables": [{"self_ref": "#/tables/0", "captions": [ref("texts", 1), ref("texts", 6), ref("texts", 99)], "footnotes": [ref("texts", 2)], "data": {"num_rows": 2, "num_cols": 3, "table_cells": [cell(0, 0, "A", 2), cell(0, 1, "µJ", 1, 2, True), cell(0, 1, "µJ", 1, 2, True), cell(1, 0, "over"), cell(1, 1, "<1.8")]}}, {"captions": [ref("texts", 1)]}],
        "pictures": [{"self_ref": "#/pictures/0", "captions": [ref("texts", 5)], "prov": [box(20, 40, 60, 30, "TOPLEFT")]}],
    }
    native = spark.createDataFrame([("s", json.dumps({"formulas": False, "runs": [{"document": document, "images": {"#/tables/0": "images/t.png"}, "errors": ["x"]}]}))], "doc string, json string")
    found = pointer_tree.pointer_blocks(native).cache()
    heading, table, figure, link, formula, empty, alone, codes = sorted(found.collect(), key=lambda b: b.pos)
    assert (heading.level, tuple(heading.box), tuple(heading.fraction)) == (3, (10.0, 10.0, 290.0, 20.0), (0.033333, 0.05, 0.966667, 0.1))
    assert (table.label, table.caption, table.footnotes, table.asset, table.continues) == ("IV", "Table IV. Sums (continued)", ["second", "a Estimated."], "native/images/t.png", True)
    assert table.html == '<table><tr><td rowspan="2">A</td><th colspan="2">µJ</th></tr><tr><td>&lt;1.8</td><td></td></tr></table>' and len(table.problems) == 1
    assert (figure.label, tuple(figure.context), figure.footnotes) == ("2b", (0.0, 1.0, 60.0, 40.0), [])
    assert [tuple(r) for r in link.runs] == [("link", "A link", ["bold", "superscript"], "https://a.b")]
    assert (formula.label, formula.runs[0].text, empty.html) == ("S3", "", None)
    assert alone.role == "aside" and codes.role == "body"
    assert len({b.id for b in found.collect()}) == 8 and heading.id.startswith("hd_") and figure.id.startswith("fig_")
    assert sorted((r.id, r.code) for r in pointer_tree.pointer_findings(found).collect()) == sorted([(table.id, "TABLE_STRUCTURE_UNRESOLVED"), (formula.id, "EQUATION_NOT_TRANSCRIBED"), (empty.id, "TABLE_BODY_MISSING"), (alone.id, "CAPTION_UNATTACHED"), (codes.id, "GLYPH_CODES")])
    sizes = spark.createDataFrame([("s", 1, 310.0, 200.0), ("s", 2, 1.0, 1.0)], "doc string, page int, width double, height double")
    assert sorted((r.page, r.code) for r in pointer_tree.run_findings(native, sizes).collect() if r.page) == [(1, "PAGE_SIZE_MISMATCH")]
    assert pointer_tree.run_findings(native, sizes.limit(0)).count() == 1


def test_written_grid():
    """Spans cost what they cover of the grid; a grid of too many places is reported."""
    cell = lambda r, c, down=1, across=1: {"row": r, "column": c, "row_span": down, "column_span": across, "header": False, "text": "x"}
    assert normalize.written_grid([cell(0, 0, 1_000_000_000)], 2, 2)["html"] == '<table><tr><td rowspan="1000000000">x</td><td></td></tr><tr><td></td></tr></table>'
    assert normalize.written_grid([cell(0, 0, 1_000_000_000)]) == {"html": "", "problems": ["a grid of 1000000000 by 1 places is not written"]}
    assert normalize.written_grid([]) == {"html": "<table></table>", "problems": []}


def test_malformed_pages(spark):
    native = spark.createDataFrame([("d", '{"children":[{"id":"/page/3/Page/1","children":[{"block_type":"Text","html":"a"}]},{"id":"/page/x","children":[{"block_type":"Text","html":"b"}]},{"children":[]}]}')], "doc string, json string")
    assert [(b.page, b.html) for b in normalize.tree_blocks(native).collect()] == [(4, "a")]
    assert [r.code for r in normalize.malformed_pages(native).collect()] == ["PAGE_MALFORMED"] * 2


def test_stored_items_are_dealt_over_all_cores(spark, monkeypatch):
    """A narrow table of one small file is dealt out before its rows grow into documents."""
    from quire.plans import registry

    dealt = {}
    stored = pointer_tree.materialize
    monkeypatch.setattr(pointer_tree, "materialize", lambda df, label: dealt.setdefault(label, df.rdd.getNumPartitions()) and stored(df, label))
    registry.QUERIES["pointer_blocks"](spark, "/root/testdata/sf0.001")
    assert dealt["nodes"] >= spark.sparkContext.defaultParallelism
