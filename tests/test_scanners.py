"""Scanners and the Markdown renderer on small fixtures."""

from pyspark.sql import functions as F

from quire.operators import export, scanners


def test_latex():
    assert scanners.latex_problems(r"\frac{a}{b} \left( x \right) \{ \\\\ \leftarrow") == []
    assert scanners.latex_problems(r"}{ \{ \left( \begin{a}\end{b}") == ["a brace closes that was not opened", "open braces at the end: 1", "left delimiters: 1, right ones: 0", "environment b ends where a is open"]
    assert scanners.latex_problems(r"\begin{x}") == ["environment x does not end"]


def test_json():
    assert scanners.first_object('<think>{"a": 1}</think> so {bad} {"b": "}"} {"c": 2}') == '{"b": "}"}'
    assert scanners.first_object("none {") is None


def test_references():
    text = "See Supplementary Figure 2, Table S3b and the Supporting Information."
    assert [(r["kind"], r["number"]) for r in scanners.supplement_references(text)] == [("figure", "2"), ("table", "3b"), ("document", "")]
    text_2 = "Suppl. Fig. 3, fig. s2 and Fig. (S1), but not Fig. 4; supplementary note (7)."
    assert [(r["kind"], r["number"]) for r in scanners.supplement_references(text_2)] == [("figure", "3"), ("figure", "2"), ("figure", "1"), ("section", "7")]
    assert scanners.linked(text, {("table", "3b"): "si.md#t3"}) == "See Supplementary Figure 2, [Table S3b](si.md#t3) and the Supporting Information."


def test_columns(spark):
    rows = spark.createDataFrame([(1, 'x {"a": 1}'), (2, None)], "i int, x string")
    got = rows.select("i", scanners.json_object("x").alias("j"), F.size(scanners.references("x")).alias("n"), F.size(scanners.latex_balance("x")).alias("p")).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, '{"a": 1}', 0, 0), (2, None, 0, 0)]


def test_markdown(spark):
    rows = [("d", 1, 1, "heading", 2, "T", False), ("d", 1, 2, "footnote", None, "note", False), ("d", 1, 3, "paragraph", None, "begins", False), ("d", 2, 4, "furniture", None, "head", False), ("d", 2, 5, "paragraph", None, "goes on", True), ("d", 2, 6, "paragraph", None, "new", False)]
    blocks = spark.createDataFrame(rows, "doc string, page int, pos int, kind string, level int, text string, continues boolean")
    assert export.document_markdown(blocks, "doc").first().markdown == '<a id="page-1"></a>\n## T\n\nbegins goes on\n\n> note\n\n<a id="page-2"></a>\nnew\n'
