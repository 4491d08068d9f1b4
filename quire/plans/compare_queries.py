"""Comparison of readings, multisets, labels, benchmark outcomes, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import bags, compare, export, html
from quire.plans import sql
from quire.plans.registry import query
from quire.sources.shared import parts_of, small_batches
from quire.sources.tables import load

@query(
    "shingle_coverage",
    f"""
    WITH dw AS MATERIALIZED (SELECT doc_id, {sql.words('text')} AS w FROM documents), ds AS MATERIALIZED (SELECT doc_id, {sql.shingles('w')} AS s FROM dw WHERE len(w) >= 12),
    d AS (SELECT doc_id, unnest(s) AS s FROM ds), bw AS MATERIALIZED (SELECT item_id, {sql.words('text')} AS w FROM benchmark), bs AS MATERIALIZED (SELECT item_id, unnest({sql.shingles('w')}) AS s FROM bw)
    SELECT doc_id, item_id, hits, len(ds.s) AS total FROM (SELECT doc_id, item_id, count(*) AS hits FROM d JOIN bs ON d.s = bs.s GROUP BY 1, 2) JOIN ds USING (doc_id)
    """,
)
def shingle_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-word runs that documents share with benchmark passages."""
    return compare.coverage(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), "doc_id", "item_id").select("doc_id", "item_id", "hits", "total")


@query(
    "uncovered_paragraphs",
    f"""
    WITH a AS (SELECT md5(text) AS key, {sql.words('text')} AS w FROM (SELECT DISTINCT text FROM conversations)),
    x AS (SELECT key, unnest({sql.shingles('w')}) AS s FROM a WHERE len(w) >= 12), t AS (SELECT DISTINCT unnest({sql.shingles('w')}) AS s FROM (SELECT {sql.words('text')} AS w FROM documents))
    SELECT key, round(avg(CASE WHEN t.s IS NULL THEN 0 ELSE 1 END), 6) AS share FROM x LEFT JOIN t USING (s) GROUP BY key HAVING avg(CASE WHEN t.s IS NULL THEN 0 ELSE 1 END) < 0.5
    """,
)
def uncovered_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct turns of which the documents hold less than half."""
    turns = load(spark, sf_dir, "conversations").select("text").distinct().withColumn("key", F.md5("text"))
    return compare.uncovered(turns, load(spark, sf_dir, "documents"), "key").select("key", F.round("share", 6).alias("share"))


_NUM = "'\\d+(?:[.,]\\d+)*'"
_LINES = "SELECT l_orderkey AS k, l_extendedprice::VARCHAR || ' ' || l_suppkey || ' ' || l_linenumber AS t FROM lineitem"


@query("number_multiset", f"SELECT k, value, count(*) AS n FROM (SELECT k, unnest(regexp_extract_all(t, {_NUM})) AS value FROM (SELECT l_orderkey AS k, l_suppkey || '; ' || l_linenumber || ',5 at ' || l_partkey || '.' AS t FROM lineitem)) GROUP BY 1, 2")
def number_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as printed in rows made from ``lineitem``, by order."""
    lines = load(spark, sf_dir, "lineitem")
    rows = lines.selectExpr("l_orderkey as k", "concat(l_suppkey, '; ', l_linenumber, ',5 at ', l_partkey, '.') as t")
    return bags.numbers(rows.repartition(parts_of(lines, 3), "k"), "k", "t")


@query(
    "multiset_diff",
    """
    WITH l AS (SELECT l_orderkey AS k, l_linenumber::VARCHAR AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT l_orderkey AS k, (l_suppkey % 5)::VARCHAR AS v, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT k, sum(least(coalesce(l.n, 0), coalesce(r.n, 0)))::BIGINT AS shared, sum(greatest(coalesce(l.n, 0) - coalesce(r.n, 0), 0))::BIGINT AS only_left, sum(greatest(coalesce(r.n, 0) - coalesce(l.n, 0), 0))::BIGINT AS only_right FROM l FULL JOIN r USING (k, v) GROUP BY k
    """,
)
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of an order's numbers compared as multisets."""
    rows = load(spark, sf_dir, "lineitem")
    left, right = (bags.printed(rows.selectExpr("l_orderkey as k", f"cast({c} as string) as t"), "k", "t") for c in ("l_linenumber", "l_suppkey % 5"))
    return bags.compare(left, right, "k", parts_of(rows, 2))


@query("table_agreement", "WITH d AS (SELECT l_orderkey AS k, list_sort(list(l_linenumber % 3)) AS a, list_sort(list(l_suppkey % 3)) AS b FROM lineitem GROUP BY 1) SELECT k, CASE WHEN a = b THEN 'agreed' ELSE 'disagreed' END AS status FROM d")
def table_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two readings hold the same numbers, as often, in any order."""
    rows = load(spark, sf_dir, "lineitem")
    left, right = (bags.printed(rows.selectExpr("l_orderkey as k", f"cast({c} % 3 as string) as t"), "k", "t") for c in ("l_linenumber", "l_suppkey"))
    return bags.compare(left, right, "k", parts_of(rows, 2)).select("k", F.when(F.col("only_left") + F.col("only_right") == 0, "agreed").otherwise("disagreed").alias("status"))


@query(
    "label_full_outer",
    """
    WITH l AS (SELECT s_nationkey AS label, arg_min(s_suppkey % 4, s_suppkey) AS v FROM supplier WHERE s_nationkey % 5 > 0 GROUP BY 1), r AS (SELECT c_nationkey AS label, arg_min(c_custkey % 4, c_custkey) AS v FROM customer WHERE c_nationkey % 4 > 0 GROUP BY 1)
    SELECT coalesce(l.label, r.label) AS label, CASE WHEN r.label IS NULL THEN 'only_reference' WHEN l.label IS NULL THEN 'only_other' WHEN l.v = r.v THEN 'agrees' ELSE 'differs' END AS status FROM l FULL JOIN r ON l.label = r.label
    """,
)
def label_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects matched by label, the nations of suppliers and customers in labels' place."""
    left = load(spark, sf_dir, "supplier").where("s_nationkey % 5 > 0").selectExpr("s_nationkey as label", "s_suppkey % 4 as v", "s_suppkey as pos")
    right = load(spark, sf_dir, "customer").where("c_nationkey % 4 > 0").selectExpr("c_nationkey as label", "c_custkey % 4 as v", "c_custkey as pos")
    return compare.labels(left, right, "label", "v", "pos")


@query("caption_ratio")
def caption_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching-blocks ratio of each turn with the one before it; has no SQL form."""
    rows = load(spark, sf_dir, "conversations")
    before = rows.selectExpr("conv_id", "turn + 1 as turn", "text as earlier")
    return rows.join(before, ["conv_id", "turn"]).select("conv_id", "turn", compare.word_ratio("earlier", "text").alias("ratio"))


@query(
    "benchmark_outcome",
    """
    SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'scope_mismatch' WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'header_mismatch' WHEN quality = toxic THEN 'exact' WHEN doc_id % 3 = 0 THEN 'normalized' ELSE 'mismatch' END AS outcome FROM labels
    """,
)
def benchmark_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of observations made from ``labels``: numbers as strings, formulas with blanks around."""
    observed = F.expr("case when doc_id % 7 = 0 then null when quality = toxic then cast(quality as string) when doc_id % 3 = 0 then concat(' ', quality, '\r\n') else concat(toxic, '.0') end")
    return load(spark, sf_dir, "labels").select("doc_id", compare.outcome(F.col("doc_id") % 11 > 0, observed, F.col("doc_id") % 5 > 0, F.col("quality").cast("string"), F.when(F.col("doc_id") % 3 == 0, "equation").otherwise("cell")).alias("outcome"))


@query("top_samples", "WITH r AS (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS r FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)) SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY c_mktsegment) AS samples FROM r WHERE r <= 3 GROUP BY 1")
def top_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three segments of each nation: a report's samples."""
    return bags.samples(load(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", 3)


@query("block_histogram", "SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS user, count(*) FILTER (WHERE role = 'assistant') AS assistant, count(*) FILTER (WHERE role = 'system') AS system, sum(length(text))::BIGINT AS characters FROM conversations GROUP BY 1")
def block_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of blocks of a document, conversations in documents' place."""
    return compare.histogram(load(spark, sf_dir, "conversations"), "conv_id", "role", ["user", "assistant", "system"], F.length("text"))


@query("validation_counts", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'click') AS warnings, count(*) FILTER (WHERE event_type NOT IN ('error', 'click')) AS infos, CASE WHEN bool_or(event_type = 'error') THEN 'fail' WHEN bool_or(event_type = 'click') THEN 'review' ELSE 'pass' END AS status FROM events GROUP BY 1")
def validation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by severity, events in findings' place."""
    severity = F.expr("case event_type when 'error' then 'error' when 'click' then 'warning' else 'info' end")
    return export.validation_counts(load(spark, sf_dir, "events").withColumn("severity", severity), "user_id")


@query("page_article")
def page_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, headings and paragraphs of pages; HTML has no SQL form."""
    small_batches(spark)
    a = load(spark, sf_dir, "pages").select("page_id", html.parse_article("html").alias("a"))
    return a.select("page_id", "a.title", F.size("a.headings").alias("headings"), F.size("a.paragraphs").alias("paragraphs"), F.aggregate("a.paragraphs", F.lit(0), lambda x, p: x + F.length(p)).alias("characters"), "a.links")


@query("page_text_coverage")
def page_text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each page's paragraphs the documents hold."""
    small_batches(spark)
    a = load(spark, sf_dir, "pages").select("page_id", html.parse_article("html").alias("a"))
    p = a.select(F.col("page_id"), F.posexplode("a.paragraphs").alias("n", "text")).withColumn("key", F.concat_ws(":", "page_id", "n"))
    left = compare.uncovered(p, load(spark, sf_dir, "documents"), "key").select("key", F.round("share", 6).alias("share"))
    return p.select("key", "page_id").join(left, "key", "left").groupBy("page_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.count("share").alias("uncovered"))


@query("table_grids", "SELECT n_nationkey, 2 AS rows, 3 AS columns, 4 AS cells, '0:0,0:1,1:1,1:2' AS places FROM nation")
def table_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of tables with spans made from ``nation``."""
    markup = F.format_string("<table><tr><td rowspan=2>%s</td><td colspan='2'>b</td></tr><tr><td>c</td><td>%d</td></tr></table>", "n_name", "n_nationkey")
    g = load(spark, sf_dir, "nation").select("n_nationkey", html.parse_table(markup).alias("g"))
    places = F.array_join(F.transform("g.cells", lambda c: F.concat_ws(":", c["row"], c["column"])), ",")
    return g.select("n_nationkey", "g.rows", "g.columns", F.size("g.cells").alias("cells"), places.alias("places"))
