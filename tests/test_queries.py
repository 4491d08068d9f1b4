"""Every query against its DuckDB equivalent, and the entry point."""


import duckdb
import pandas as pd
import pytest

import __spark_entry__
from quire.operators import html
from quire.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda v: None if pd.isna(v) else f"{float(v):.6g}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted((tuple(show(v.item() if hasattr(v, "item") else v) for v in row) for row in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "held_by", "text_sha256"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["crossref_records", "datacite_records", "registry_lookup", "corroborated_hits"])
def test_narrow_tables_are_dealt_over_all_cores(spark, name):
    """A small file's rows are dealt out before they grow into responses and are parsed."""
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_parsed_response_stands_once_in_the_plan(spark):
    """However many fields are read of it, a response is parsed by one expression."""
    plan = registry.QUERIES["crossref_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_pages_go_through_python_a_few_at_a_time(spark):
    """A worker holds the results of a few pages, however many a batch has, and the session hands it few."""
    sizes = [len(out) for out in html.parse_article.func(iter([pd.Series(["<p>x</p>"] * 600), pd.Series([None])]))]
    assert max(sizes) <= html.ROWS_OUT and sum(sizes) == 601
    registry.QUERIES["page_text_coverage"](spark, DATA)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
