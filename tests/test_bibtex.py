"""BibTeX entries."""

from pyspark.sql import functions as F

from quire.operators import bibtex

WORK = "article_type string, authors array<struct<given: string, family: string, literal: string>>, editors array<struct<given: string, family: string, literal: string>>, title string, journal string, year int, volume string, issue string, pages string, article_number string, publisher string, url string, asserted boolean, doi string"


def test_escaping_and_capitals(spark):
    texts = ["50% of R&D_x #1 $y {z} ~a ^b", "back\\slash", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", bibtex.escaped(F.col("t")).alias("e"))
    assert [r.e for r in rows.orderBy("i").collect()] == [r"50\% of R\&D\_x \#1 \$y \{z\} \textasciitilde{}a \textasciicircum{}b", r"back\textbackslash\{\}slash", "", None]
    titles = ["On the DNA of iPhones in NaCl", "Élan ÉLAN A aB 3D x-Ray", "plain", " two  blanks ", "(NMR)"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string").select("i", bibtex.protected(F.col("t")).alias("p"))
    assert [r.p for r in rows.orderBy("i").collect()] == ["On the {DNA} of {iPhones} in {NaCl}", "Élan {ÉLAN} A {aB} 3D {x-Ray}", "plain", " two  blanks ", "{(NMR)}"]


def test_entries(spark):
    works = [
        ("journal-article", [("Ada", "Müller", None), (None, None, "The R&D Group"), (None, "", "")], None, "By light: GaAs", "J. of X", 2019, "3", "1", "5-7", None, "Pub", "u", False, "10.1/a_b"),
        ("bibtex:phdthesis", None, [("B", "Ed", None)], "Thesis", "Uni", None, None, None, "1--2-3", "e7", "Uni", "https://x", True, None),
        ("posted-content", None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(works)], f"i int, w struct<{WORK.replace(' string', ': string').replace(' array', ': array').replace(' int', ': int').replace(' boolean', ': boolean').replace(':: ', ': ')}>")
    first, second, third = (r.e for r in rows.select("i", bibtex.entry(F.col("w")).alias("e")).orderBy("i").collect())
    assert first == "@article{muller2019light,\n  author = {Müller, Ada and {The R\\&D Group}},\n  title = {By light: {GaAs}},\n  journal = {J. of X},\n  year = {2019},\n  volume = {3},\n  number = {1},\n  pages = {5--7},\n  doi = {10.1/a_b},\n  url = {https://doi.org/10.1/a_b}\n}\n"
    assert second == "@phdthesis{ednodatethesis,\n  editor = {Ed, B},\n  title = {Thesis},\n  school = {Uni},\n  pages = {1--2-3},\n  eid = {e7},\n  url = {https://x}\n}\n"
    assert third == "@misc{anonymousnodateuntitled,\n\n}\n".replace(",\n\n}", ",\n  note = {Preprint}\n}")
