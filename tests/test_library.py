"""Intake decisions, tables read twice, and figures against their pages, on small fixtures."""

from pyspark.sql import functions as F

from quire.operators import export, figures, intake, table_check
from quire.plans import text_queries


def rows(frame, *order):
    return [tuple(r) for r in frame.orderBy(*order).collect()]


def test_pair_captures(spark):
    papers = spark.createDataFrame([("a", ["10.1/X", "10.1/x"]), ("b", ["10.1/y"]), ("c", ["10.1/y"]), ("d", [])], "paper string, dois array<string>")
    pages = spark.createDataFrame([("1", "10.1/x"), ("2", "10.1/Y"), ("3", None), ("4", "10.1/z")], "path string, doi string")
    assert rows(intake.pair_captures(papers, pages), "path") == [("1", "a", "shared DOI"), ("2", None, "several papers print it"), ("3", None, "no DOI declared"), ("4", None, "no paper prints it")]
    assert intake.pair_captures(papers.limit(0), pages.limit(0)).count() == 0


def test_settled_searches(spark):
    hits = spark.createDataFrame([("p", 0, "x"), ("p", 0, "y"), ("p", 1, "z"), ("p", 1, "z"), ("p", 2, "x"), ("q", 0, "x"), ("q", 0, "y")], "paper string, ordinal int, hit string")
    assert rows(intake.settled_searches(hits, "paper", "ordinal", "hit"), "paper") == [("p", 1, "z")]


def test_choose_reading(spark):
    cases = [("a .012 1,5", "1,5 .012", True), ("1 1 2", "1 2", True), ("1", "1", False), ("1", None, True), (None, "", True)]
    found = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n string, o string, g boolean").select("i", table_check.choose_reading(F.col("n"), F.col("o"), F.col("g")).alias("r")).select("i", "r.outcome", "r.body", "r.alternative")
    assert rows(found, "i") == [(0, "replaced", "1,5 .012", "a .012 1,5"), (1, "differs", "1 1 2", None), (2, "kept", "1", None), (3, "unread", "1", None), (4, "replaced", "", None)]


def test_citing_sentence(spark):
    blocks = spark.createDataFrame([("d", 2, "See Figure 3."), ("d", 1, "One. Two, as in Fig.3, is. Three."), ("d", 0, "Fig. 31 is not it.")], "doc string, pos int, body string")
    asked = spark.createDataFrame([("d", "3"), ("d", "4"), ("d", None)], "doc string, label string")
    assert rows(figures.citing_sentence(blocks, asked, "doc", "pos", "body"), "label") == [("d", None, None), ("d", "3", "Two, as in Fig.3, is."), ("d", "4", None)]


def test_printed_family(spark):
    cases = [("mao", "s.s. mao1, f. quere2", True), ("mao", "Maori", False), ("h usler", "H. Häusler and K. Kerl", True), ("", "x", False), (None, "x", False), ("mao", None, False)]
    found = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, f string, p string").select("i", figures.printed_family(F.col("f"), F.col("p")).alias("r"))
    assert [r[1] for r in rows(found, "i")] == [c[2] for c in cases]


def test_cites(spark):
    cases = [("12", "34-40", None, True), ("12", None, "E7", True), ("12", "35", None, False), (None, "34", None, False), ("12", None, None, False)]
    tokens = F.array(F.lit("12"), F.lit("34"), F.lit("e7"))
    found = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, v string, p string, a string").select("i", figures.cites(F.col("v"), F.col("p"), F.col("a"), tokens).alias("r"))
    assert [r[1] for r in rows(found, "i")] == [c[3] for c in cases]


def test_check_printed():
    region = "Wave length of the pulse − 5 nm, energy-level caption"
    assert figures.check_printed(["-5 nm", "energylevel", "caption", ""], region, "Caption", False) == {"applicable": True, "claimed": 4, "confirmed": 3, "informative": 3, "found": 2, "unconfirmed": ["caption"]}
    assert not figures.check_printed(["x"], region, "", True)["applicable"] and not figures.check_printed(["x"], "short", "", False)["applicable"]


def test_directory_name(spark):
    cases = [(True, "Müller-Lüdenscheidt", 2019, "On the “Æther” of a x light, via 3 waves", False, "MullerLudenscheidt_2019_AEtherLightWaves"), (True, None, None, None, True, "Anonymous_nodate_Untitled_abcdef"), (False, "A", 1, "b", False, "Unverified_abcdefabcdef"), (None, "A", 1, "b", None, "Unverified_abcdefabcdef")]
    found = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, n boolean, f string, y int, t string, k boolean")
    found = found.select("i", export.directory_name(F.col("n"), F.col("f"), F.col("y"), F.col("t"), F.lit("abcdef" * 4), F.col("k")).alias("r"))
    assert [r[1] for r in rows(found, "i")] == [c[5] for c in cases]


def test_identifiers_of_large_keys(spark, tmp_path):
    """Queries over made texts keep rows of every key, and the texts stay well formed."""
    spark.sql("select id as p_partkey, 'Red Nut' as p_name, 7 as p_size from values (99999L), (100000L), (1234567L), (2000000001L) t(id)").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("select id as o_orderkey, 1234567L as o_custkey from range(4)").write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(text_queries.doi_candidates(spark, str(tmp_path)), "p_partkey") == [
        (99999, "10.100999/red.nut.7 10.1000/99999", "2101.99999v2", "2101.99999"),
        (100000, "10.101000/red.nut.7 10.1000/100000", "2101.00000v2", "2101.00000"),
        (1234567, "10.1235567/red.nut.7 10.1000/1234567", "2101.34567v2", "2101.34567"),
        (2000000001, "10.1001/red.nut.7 10.1000/2000000001", "2101.00001v2", "2101.00001"),
    ]
    assert rows(text_queries.filename_dois(spark, str(tmp_path)), "o_orderkey") == [(0, "10.1103/physreva.0.1234567"), (1, "10.1364/ao.1.234567"), (2, "10.48550/arxiv.2101.34567"), (3, "")]
