"""Order-dependent rewrites, geometry, display order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import catalog, layout
from quire.plans.registry import query
from quire.sources.tables import load

_LINES = """
    l AS (SELECT doc_id AS doc, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
    k AS (SELECT doc, pos, pos // 10 AS page, lower(trim(regexp_replace(line, '[\\s\\p{Z}]+', ' ', 'g'))) AS key, (pos % 10) / 10.0::DOUBLE AS y0 FROM l)
"""


@query(
    "repeated_furniture",
    f"""
    WITH {_LINES}, f AS (SELECT * FROM k WHERE length(key) < 80)
    SELECT b.doc, b.page, b.pos, CASE WHEN b.y0 < 0.5 THEN 'header' ELSE 'footer' END AS role, count(DISTINCT f.page) AS pages FROM k b JOIN f ON b.doc = f.doc AND b.key = f.key AND b.page <> f.page
    WHERE b.key <> '' AND abs(b.y0 - f.y0) <= 0.31 GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT f.page) >= 2
    """,
)
def repeated_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that repeat at like places on other pages of ten lines; places stretched as lines have no boxes."""
    lines = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    rows = lines.select("doc", (F.col("p") + 1).alias("pos"), F.expr("(p + 1) div 10").alias("page"), text.squash_key(F.col("line")).alias("key"), F.lit(0.0).alias("x0"), F.expr("((p + 1) % 10) / 10.0D / 31.0D").alias("y0"))
    found = layout.repeated_furniture(rows, rows.where(F.length("key") < 80))
    return found.select("doc", "page", "pos", F.expr("if((pos % 10) / 10.0D < 0.5D, 'header', 'footer')").alias("role"), "pages")


@query(
    "reference_runs",
    """
    WITH b AS (SELECT conv_id, turn, role = 'user' AS ref, lag(role = 'user', 1, false) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
    r AS (SELECT *, CASE WHEN ref THEN sum(CASE WHEN ref AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) END AS run FROM b),
    m AS (SELECT *, max(run) OVER (PARTITION BY conv_id) AS runs FROM r), t AS (SELECT *, min(CASE WHEN run = runs THEN turn END) OVER (PARTITION BY conv_id) AS goal FROM m),
    g AS (SELECT *, coalesce(ref AND runs >= 2 AND run < runs, false) AS moved FROM t)
    SELECT conv_id, turn, moved, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN moved THEN goal ELSE turn END, CASE WHEN moved THEN 0 ELSE 1 END, turn) AS new_pos FROM g
    """,
)
def reference_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier runs moved to the last run, users' turns in references' place."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("ref"))
    return layout.reference_order(rows, ["conv_id"], "turn", "ref").select("conv_id", "turn", "moved", "new_pos")


@query("leading_blocks", "SELECT conv_id, turn, role FROM (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn // 2) AS r FROM conversations) WHERE r <= 2")
def leading_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the first two pages, two turns a page."""
    rows = load(spark, sf_dir, "conversations").withColumn("page", F.expr("turn div 2"))
    return layout.leading_pages(rows, "conv_id", "page").select("conv_id", "turn", "role")


@query("author_hint", "WITH h AS (SELECT conv_id, min(turn) AS h FROM conversations WHERE role = 'user' GROUP BY 1) SELECT c.conv_id, arg_min(length(text), turn) AS characters, min(turn) AS turn FROM conversations c JOIN h USING (conv_id) WHERE turn > h AND role <> 'user' GROUP BY 1")
def author_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first other block after the first heading, users' turns in headings' place."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("heading"), F.length("text").alias("characters"))
    return layout.author_line(rows, "conv_id", "turn", "heading", "characters").select("conv_id", "characters", "turn")


@query(
    "visual_runs",
    """
    WITH e AS (SELECT user_id, event_id, event_type = 'purchase' AS done, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run FROM events)
    SELECT user_id, run, count(*) AS size, bool_or(done) AS closed FROM e GROUP BY 1, 2
    """,
)
def visual_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive blocks up to the one with a caption, purchases in captions' place."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("done"))
    return layout.terminated_runs(rows, "user_id", "event_id", "done")


@query("page_ranges", "SELECT o_custkey, min(p) AS first, max(p) AS last FROM (SELECT o_custkey, p, p - row_number() OVER (PARTITION BY o_custkey ORDER BY p) AS i FROM (SELECT DISTINCT o_custkey, o_orderkey // 1000 AS p FROM orders)) GROUP BY o_custkey, i")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of pages, thousands of order keys in pages' place."""
    return layout.page_ranges(load(spark, sf_dir, "orders").withColumn("p", F.expr("o_orderkey div 1000")), "o_custkey", "p")


_BOX = "l_linenumber / 10.0::DOUBLE AS x0, l_suppkey % 7 / 10.0::DOUBLE AS y0, l_linenumber / 10.0::DOUBLE + 0.3 + l_quantity / 200.0 AS x1, l_suppkey % 7 / 10.0::DOUBLE + 0.4 AS y1"


@query(
    "iou_match",
    f"""
    WITH b AS (SELECT l_orderkey AS page, l_linenumber::BIGINT AS id, l_linenumber::BIGINT AS pos, l_partkey % 5 AS label, {_BOX} FROM lineitem),
    t AS (SELECT * FROM b WHERE id % 2 = 1), c AS (SELECT * FROM b WHERE id % 2 = 0),
    o AS (SELECT t.page, t.id, c.id AS m, c.pos, CASE WHEN least(t.x1, c.x1) - greatest(t.x0, c.x0) <= 0 OR least(t.y1, c.y1) - greatest(t.y0, c.y0) <= 0 THEN 0.0 ELSE
        (least(t.x1, c.x1) - greatest(t.x0, c.x0)) * (least(t.y1, c.y1) - greatest(t.y0, c.y0)) / ((t.x1 - t.x0) * (t.y1 - t.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) - (least(t.x1, c.x1) - greatest(t.x0, c.x0)) * (least(t.y1, c.y1) - greatest(t.y0, c.y0))) END AS v FROM t JOIN c USING (page)),
    best AS (SELECT page, id, m, v FROM (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY v DESC, pos DESC) AS r FROM o WHERE v >= 0.5) WHERE r = 1),
    alone AS (SELECT page, label, min(id) AS m FROM c GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT t.page, t.id, coalesce(best.m, alone.m) AS match, round(best.v, 6) AS overlap FROM t LEFT JOIN best ON t.page = best.page AND t.id = best.id LEFT JOIN alone ON t.page = alone.page AND t.label = alone.label
    """,
)
def iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables matched by overlap and else by label, boxes made from ``lineitem``."""
    found = layout.match_tables(*_tables(spark, sf_dir))
    return found.select("page", "id", "match", F.round("overlap", 6).alias("overlap"))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    box = ["l_linenumber / 10.0D as x0", "l_suppkey % 7 / 10.0D as y0", "l_linenumber / 10.0D + 0.3D + l_quantity / 200.0D as x1", "l_suppkey % 7 / 10.0D + 0.4D as y1"]
    rows = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey as page", "cast(l_linenumber as bigint) as id", "cast(l_linenumber as bigint) as pos", "l_partkey % 5 as label", *box)
    return rows.where("id % 2 = 1"), rows.where("id % 2 = 0")


@query("greedy_match")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tables matched one to one in order, which has no SQL form."""
    return layout.greedy_tables(*_tables(spark, sf_dir))


@query("catalog_order", "SELECT row_number() OVER (ORDER BY coalesce(nullif(c_mktsegment, 'BUILDING'), '~'), (1990 + c_nationkey)::VARCHAR, c_custkey) AS place, c_custkey FROM customer")
def catalog_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a catalog by family, year and key: ranks within sorted ranges, added to the ranges' starts."""
    rows = load(spark, sf_dir, "customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("family"), (F.col("c_nationkey") + 1990).alias("year"), "c_custkey")
    return catalog.display_order(rows, "family", "year", "c_custkey").select("place", "c_custkey")


@query("box_unions", f"SELECT l_orderkey AS page, round(min(x0), 6) AS x0, round(min(y0), 6) AS y0, round(max(x1), 6) AS x1, round(max(y1), 6) AS y1 FROM (SELECT l_orderkey, {_BOX} FROM lineitem) GROUP BY 1")
def box_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around each page's tables."""
    from quire.functions.geometry import box_union

    a, b = _tables(spark, sf_dir)
    out = a.unionByName(b).groupBy("page").agg(*box_union("x0", "y0", "x1", "y1"))
    return out.select("page", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))
