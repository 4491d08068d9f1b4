import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet").cache()


#: Every operator meets these: nulls in any column, empty and wordless texts, repeated rows, one very long text.
EDGE = [
    (1, "one two three four five six seven", "en", "a", 33, 0),
    (1, "one two three four five six seven", "en", "a", 33, 0),
    (2, None, None, None, None, 0),
    (None, "one two three four five six seven", "en", None, None, 0),
    (3, "", "de", "b", 0, 0),
    (4, " \t\n ", "de", "b", 4, 0),
    (5, "wort " * 60_000, "de", "b", None, 0),
    (6, "a@b.co, +49 (30) 1234567, 10.0.0.1, 4111 1111 1111 1111, été \U0001f600", "fr", "a", None, 0),
    (-7, "UPPER lower\nUPPER lower\nUPPER lower", "xx", "c", None, 0),
]


@pytest.fixture(scope="session")
def edge(spark):
    rows = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long, x int")
    for name in ("node", "size", "part", "rank", "key", "t", "d", "host", "score", "words", "lines", "ids", "label", "v", "row", "own", "_own", "dropped", "bad", "before", "good", "host_key", "nth", "of_full", "of_taken", "take", "_host", "_bad", "_lines", "_doc_id", "_full", "_take", "class", "order"):
        rows = rows.withColumn(name, rows.x + len(name))
    return rows.cache()


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")
