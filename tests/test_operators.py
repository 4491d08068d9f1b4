"""Operators' own rules on small fixtures."""

import pytest
from pyspark.sql import functions as F

from quire.functions import ids, text
from quire.operators import compare, dedup, export, html, identity, layout, search


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, x string" + (", y string" if isinstance(values[0], tuple) else ""))
    return [r.r for r in rows.select("i", expression.alias("r")).orderBy("i").collect()]


def test_title_key(spark):
    cases = {"The": "the", "The Étude: ﬁne—Straße": "etude fine strasse", "Ｆｕｌｌ ½": "full 1 2", "Việt Nam ά": "viet nam α", "İ ǅ": "i dz", "A  b": "b", "An": "an", "": "", "x2 Ångström": "x2 angstrom"}
    assert column(spark, list(cases), text.title_key(F.col("x"))) == list(cases.values())


def test_ascii_fold(spark):
    assert column(spark, ["Łódź", "Sørensen", "Æon ß", "日本 é"], text.ascii_fold(F.col("x"))) == ["Lodz", "Sorensen", "AEon ss", " e"]


def test_identifiers(spark):
    assert column(spark, ["https://doi.org/10.1000/AbC).", "doi: 10.1/x", "DOI:10.1234/a;"], ids.normalize_doi(F.col("x"))) == ["10.1000/abc", None, "10.1234/a"]
    assert column(spark, ["10.1000/a, 10.1000/A; 10.12345/b."], ids.doi_candidates(F.col("x"))) == [["10.1000/a", "10.12345/b"]]
    assert column(spark, ["see 10.1000/AbC; again 10.1000/abc"], ids.doi_candidates(F.col("x"))) == [["10.1000/AbC"]]
    assert column(spark, ["arXiv:2206.01062v2", "hep-th/9901001"], ids.arxiv_base(F.col("x"))) == ["2206.01062", "hep-th/9901001"]


@pytest.mark.parametrize(
    ("name", "doi"),
    [
        ("PhysRevLett.88.123456-1.pdf", "10.1103/physrevlett.88.123456"), ("ol-30-2-77.pdf", "10.1364/ol.30.000077"), ("s12345-020-98765-x.pdf", "10.1038/s12345-020-98765-x"), ("rsta.2011.0099.pdf", "10.1098/rsta.2011.0099"),
        ("ja123456b.pdf", "10.1021/ja123456b"), ("ab2001123456.pdf", "10.1039/ab2001123456"), ("andp.190512345678.pdf", "10.1002/andp.190512345678"), ("bf12345678.pdf", "10.1007/bf12345678"),
        ("x-S0123456785123456-y.pdf", "10.1016/0123-4567(85)12345-6"), ("1905.12345v3.pdf", "10.48550/arxiv.1905.12345"), ("978-0-12-345678-9_2.pdf", "10.1007/978-0-12-345678-9"), ("oe-9-1-1234567.pdf", "10.1364/oe.9.1234567"),
    ],
)
def test_filename_dois(spark, name, doi):
    assert column(spark, [name], ids.filename_dois(F.col("x"))) == [[doi]]


def test_labels_and_names(spark):
    assert column(spark, ["Figure S2: x", "Fig. 3b", "Table 1"], ids.figure_label(F.col("x"))) == ["S2", "3b", None]
    captions = ["Table values of x", "Table XL: y", "Table 3A", "Figure 3abc", "Supplementary Table 2", "Supplementary\u00a0Fig. 3", "Tab. 3", "FIG. S1a|", "FIGURE 2", "table 2", "Fig 4", "Fig. 3\u00b5", "TABLE SIV."]
    assert column(spark, captions, ids.figure_label(F.col("x"))) == [None] * 5 + ["3", None, "S1a", None, None, "4", None, None]
    assert column(spark, captions, ids.table_label(F.col("x"))) == [None, "XL", "3A", None, "2", None, "3"] + [None] * 5 + ["SIV"]
    assert column(spark, ["/a/simple.pdf", "/a/x-SI.pdf", "supplementary2.pdf", "a_esm.pdf"], ids.supplement_name(F.col("x"))) == [False, True, True, True]
    assert column(spark, ["1-3,15", "2", "3,1-2", "x"], ids.pages(F.col("x"))) == [[1, 2, 3, 15], [2], [1, 2, 3], None]
    assert [None if r is None else tuple(r) for r in column(spark, ["A. B. Smith", "Smith"], ids.split_name(F.col("x")))] == [("A. B.", "Smith"), None]


def test_stable_shard(spark):
    import hashlib

    keys = ["a", "paper-17", "é"]
    assert column(spark, keys, ids.stable_shard(F.col("x"), 7)) == [int(hashlib.sha256(k.encode()).hexdigest(), 16) % 7 for k in keys]


def test_title_agreement(spark):
    pairs = [
        ("The Light Field", "light-field", "same"), ("Superconductivity of thin films - a review", "Superconductivity of thin films", "near"), ("A study of β phase in metals now", "Study of phase in metals now", "near"),
        ("measurement of the oxygen level 10 in water", "measurement of the 0xygen level 10 in water", "near"), ("one thing", "another thing", "different"),
    ]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    assert [r.agreement for r in identity.title_agreement(rows, "a", "b").orderBy("i").collect()] == [g for *_, g in pairs]


def test_pair_supplements(spark):
    rows = [("smith2020optics.pdf", ["10.1/a"]), ("smith2020optics_si.pdf", []), ("b_supp.pdf", ["10.1/a"]), ("z.pdf", ["10.1/c"]), ("short_si.pdf", []), ("short.pdf", [])]
    got = {r.name: r.paper for r in dedup.pair_supplements(spark.createDataFrame(rows, "name string, dois array<string>")).collect()}
    assert got == {"smith2020optics_si.pdf": "smith2020optics.pdf", "b_supp.pdf": "smith2020optics.pdf", "short_si.pdf": None}


def test_pair_supplements_that_begin_alike(spark):
    """Many names with one beginning make no pairs; a paper listed twice is one paper, two at the same distance are none."""
    paper = lambda i: f"/in/library/{i:05d}paper"
    rows = [(f"{paper(i)}{end}", []) for i in range(3000) for end in (".pdf", "_si.pdf")] + [(f"{paper(7)}.pdf", [])]
    rows += [("/in/library/x1_si.pdf", []), ("/in/library/x1.pdf", []), ("/in/library/x2_si.pdf", ["10.1/b"]), ("/in/library/X2a.pdf", ["10.1/b"]), ("/in/library/x2b.pdf", []), ("/in/library/x2c_si.pdf", []), ("/in/library/y_si.pdf", ["10.1/b", "10.1/d"]), ("z.pdf", ["10.1/d"])]
    found = dedup.pair_supplements(spark.createDataFrame(rows, "name string, dois array<string>"))
    got = {r.name: (r.paper, r.reason) for r in found.collect()}
    assert all(got[f"{paper(i)}_si.pdf"] == (f"{paper(i)}.pdf", "file name") for i in range(3000))
    assert got["/in/library/x1_si.pdf"] == ("/in/library/x1.pdf", "file name")
    assert got["/in/library/x2_si.pdf"] == ("/in/library/X2a.pdf", "shared DOI")
    assert got["/in/library/x2c_si.pdf"] == (None, "unpaired")
    assert got["/in/library/y_si.pdf"] == (None, "unpaired")


def test_similar_titles_by_prefixes_of_both_sides(spark):
    """All pairs of random titles as by brute force, between two tables and within one; titles of frequent words and one rare word make no candidates."""
    from random import Random

    random = Random(4)
    titles = [" ".join(random.choices("abcdefghijklmnopqrst"[: random.choice([3, 6, 20])], k=random.randint(1, 24))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(titles)), "id long, k string")
    words = [set(t.split()) for t in titles]
    want = {(i, j): len(x & y) / len(x | y) for i, x in enumerate(words) for j, y in enumerate(words) if 5 * len(x & y) >= 4 * len(x | y)}
    both = {(r.a, r.b): r.overlap for r in search._similar(rows, rows, 0.8, between=True).collect()}
    assert both == want
    assert {(r.a, r.b): r.overlap for r in search.similar_titles(rows, "id", "k").collect()} == {p: v for p, v in want.items() if p[0] < p[1]}
    many = spark.range(100_000).selectExpr("id", "concat('large ring ', id div 2, ' in small') as k")
    assert search._similar(many, many, 0.8, between=True).count() == 200_000


def test_tables(spark):
    grid = html.table_grid("<table><tr><td rowspan=2>a<td colspan=2>b</tr><tr><td>c<td>d &amp; e</tr></table>")
    assert [(c["row"], c["column"], c["text"]) for c in grid["cells"]] == [(0, 0, "a"), (0, 1, "b"), (1, 1, "c"), (1, 2, "d & e")]
    assert (grid["rows"], grid["columns"], grid["problems"]) == (2, 3, [])
    assert html.table_grid("<table><tr><td>a<td>b</tr><tr><td colspan=x>c</tr></table>")["problems"] == ["colspan 'x' is no span; 1 is taken", "row 2 has 1 of 2 columns"]
    long = html.table_grid("<table><tr><td rowspan=3>a</td><td>b</td></tr><tr><td>c</td></tr></table>")
    assert (long["rows"], long["cells"][0]["row_span"], long["problems"]) == (3, 3, ["spans go down to row 3 of 2"])
    wide = html.table_grid("<table><tr><td colspan=1000000000>a</td></tr><tr><td rowspan=2>x<table><tr><td>in</td></tr></table></td></tr><tr><td>c</td></tr></table><table><tr><td>no</td></tr></table>")
    assert [(c["row"], c["column"], c["text"]) for c in wide["cells"]] == [(0, 0, "a"), (1, 0, "xin"), (2, 1, "c")]
    assert wide["problems"] == ["row 2 has 1 of 1000000000 columns", "row 3 has 2 of 1000000000 columns"]


def test_clean_title(spark):
    cases = {"On <i>N</i><sub>2</sub> &amp; H_{2}[?]*": "On N2 & H2", "Decay of [alpha] and \\Beta-rays &#233;&#x3b1;": "Decay of α and Β-rays éα", "  Plain † ": "Plain", "a &unknown; b": "a &unknown; b"}
    assert column(spark, list(cases), text.clean_title(F.col("x"))) == list(cases.values())
    assert column(spark, [r"\mathrm{CO}_{2} \varphi"], text.math_as_text(F.col("x"))) == ["CO2φ"]


def test_text_digest(spark):
    import hashlib
    import unicodedata

    once = "Étude  de\u00a0la\tlumière"
    want = hashlib.sha256(" ".join(unicodedata.normalize("NFC", once).split()).encode()).hexdigest()
    assert column(spark, [once, unicodedata.normalize("NFD", once)], text.text_digest(F.col("x"))) == [want, want]


def test_furniture(spark):
    rows = [("d", p, p, "running head", 0.1, 0.05) for p in range(1, 5)] + [("d", 5, 9, "other", 0.1, 0.9)]
    blocks = spark.createDataFrame(rows, "doc string, page int, pos int, key string, x0 double, y0 double")
    got = layout.repeated_furniture(blocks.where("page = 1 or pos = 9"), blocks).collect()
    assert [(r.pos, r.role, r.pages) for r in got] == [(1, "header", 3)]


def test_outcomes(spark):
    got = column(spark, [("2", "2.0"), ("2", "2"), ("2", " 2\r\n"), ("2", None)], compare.outcome(F.lit(True), F.col("y"), F.lit(True), F.col("x"), F.lit("equation")))
    assert got == ["mismatch", "exact", "normalized", "missing"]


def test_versions(spark):
    got = column(spark, ["Author's Accepted Manuscript", "a post-print", "under  review", "nothing"], identity.version(F.col("x")))
    assert got == ["accepted_manuscript", "accepted_manuscript", "submitted_manuscript", "unknown"]


def test_search_parse():
    assert search.parse('"Été light" re-use') == [["ete", "light"], ["re", "use"]]
    assert search.parse("...") == []


def test_citation_key(spark):
    assert column(spark, ["The Étude of light"], export.citation_key(F.lit("Müller"), F.lit(2019), F.col("x"))) == ["muller2019etude"]
    assert export.dump({"b": 1, "a": [None]}) == '{\n  "a": [\n    null\n  ],\n  "b": 1\n}\n'
