"""Batch runs' results and manifests' bundles, made from the tables' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import merged_runs
from quire.plans.registry import query
from quire.sources.tables import load


@query(
    "merged_runs",
    """WITH r AS (SELECT l_suppkey::VARCHAR AS run, l_partkey::VARCHAR AS sha256, CASE WHEN l_quantity > 12 THEN 'published' ELSE 'failed' END AS status, CASE WHEN l_quantity > 12 THEN 'd' || (l_suppkey % 2) || '/' || l_partkey END AS directory, l_orderkey * 10 + l_linenumber AS finished FROM lineitem WHERE l_partkey % 3 > 0 OR l_linenumber = 1),
    g AS (SELECT sha256, arg_max({'status': status, 'run': run}, {'finished': finished, 'run': run}) AS x, count(DISTINCT run) AS runs, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'published') AS done, count(DISTINCT directory) AS dirs, max(finished) AS finished FROM r GROUP BY sha256)
    SELECT sha256, x.status AS status, runs, CASE WHEN dirs > 1 THEN 'conflict' WHEN runs = 1 THEN 'single' WHEN done > 0 AND failed = 0 THEN 'repeat' ELSE 'retried' END AS state, finished FROM g""",
)
def merged_runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest results of sources over sharded runs made from ``lineitem``: suppliers as runs, parts as sources."""
    done = F.col("l_quantity") > 12
    rows = load(spark, sf_dir, "lineitem").where("l_partkey % 3 > 0 or l_linenumber = 1").select(
        F.col("l_suppkey").cast("string").alias("run"), F.col("l_partkey").cast("string").alias("sha256"), F.when(done, "published").otherwise("failed").alias("status"), F.lit("export").alias("stage"),
        F.when(done, F.concat(F.lit("d"), (F.col("l_suppkey") % 2).cast("string"), F.lit("/"), F.col("l_partkey").cast("string"))).alias("directory"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("finished"),
    )
    return merged_runs.merged(rows).select("sha256", "status", "runs", "state", "finished")


@query(
    "bundle_clashes",
    """WITH f AS (SELECT o_orderkey, 'e' || o_orderkey AS id, sha256((o_custkey % 700)::VARCHAR) AS paper, sha256('s' || o_orderkey // 4) AS supplement, o_orderkey % 6 > 0 AS taken FROM orders),
    m AS (SELECT id, 'p' || o_orderkey AS path, paper AS sha256 FROM f WHERE taken UNION ALL SELECT id, 's' || o_orderkey, supplement FROM f),
    g AS (SELECT sha256, min(id) AS first FROM m GROUP BY sha256)
    SELECT m.sha256, first, id, path FROM m JOIN g USING (sha256) WHERE id <> first""",
)
def bundle_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a manifest made from ``orders`` whose bytes another entry has too; some papers weren't taken."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("e"), "o_orderkey").alias("id"), F.concat(F.lit("p"), "o_orderkey").alias("paper"), F.concat(F.lit("s"), "o_orderkey").alias("supplement"), "o_custkey")
    entries = rows.select("id", "paper", F.array("supplement").alias("supplements"), F.array().cast("array<string>").alias("html"))
    papers = rows.where("o_orderkey % 6 > 0").select(F.col("paper").alias("path"), F.sha2((F.col("o_custkey") % 700).cast("string"), 256).alias("sha256"))
    others = rows.select(F.col("supplement").alias("path"), F.sha2(F.concat(F.lit("s"), F.expr("cast(o_orderkey div 4 as string)")), 256).alias("sha256"))
    return merged_runs.clashes(merged_runs.bundles(entries, papers.unionByName(others)))
