"""Intake decisions, tables read twice, and figures against their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import export, figures, intake, table_check
from quire.plans.registry import query
from quire.sources.shared import parts_of
from quire.sources.tables import load


@query(
    "capture_pairs",
    """
    WITH p AS (SELECT 10000 + p_partkey % 150 AS doi, min(p_partkey) AS paper, count(*) AS n FROM part GROUP BY 1),
    c AS (SELECT s_suppkey AS path, CASE WHEN s_suppkey % 5 <> 0 THEN 10000 + s_suppkey * 7 % 170 END AS doi FROM supplier)
    SELECT path, CASE WHEN n = 1 THEN paper END AS paper,
        CASE WHEN c.doi IS NULL THEN 'no DOI declared' WHEN n IS NULL THEN 'no paper prints it' WHEN n > 1 THEN 'several papers print it' ELSE 'shared DOI' END AS reason
    FROM c LEFT JOIN p ON c.doi = p.doi
    """,
)
def capture_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved pages made from ``supplier`` and papers made from ``part``, paired by DOI."""
    papers = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("paper"), F.expr("array(concat('10.1000/AB', 10000 + p_partkey % 150))").alias("dois"))
    captures = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), F.expr("if(s_suppkey % 5 <> 0, concat('10.1000/ab', 10000 + s_suppkey * 7 % 170), null)").alias("doi"))
    return intake.pair_captures(papers, captures)


@query(
    "to_extract",
    """SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 40)
        AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 7)""",
)
def to_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in groups' place: not known (finished), not held, no supplements (by their lines)."""
    lines = load(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    groups = load(spark, sf_dir, "orders").select("o_orderkey", F.expr("if(o_orderstatus = 'F', 'library', null)").alias("known_as"))
    return intake.to_extract(groups, lines.where("l_returnflag = 'R' and l_quantity > 40"), lines.where("l_linenumber = 7"), "o_orderkey").select("o_orderkey")


@query(
    "settled_searches",
    """
    WITH e AS (SELECT l_orderkey, l_linenumber % 3 AS ordinal, min(l_suppkey) AS hit FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) = 1)
    SELECT l_orderkey, ordinal, hit FROM e QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY ordinal) = 1
    """,
)
def settled_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' suppliers in searches' place: the first third of lines that names one supplier."""
    lines = load(spark, sf_dir, "lineitem")
    hits = lines.select("l_orderkey", (F.col("l_linenumber") % 3).alias("ordinal"), F.col("l_suppkey").alias("hit"))
    return intake.settled_searches(hits.repartition(parts_of(lines), "l_orderkey"), "l_orderkey", "ordinal", "hit")


@query(
    "description_counts",
    "SELECT user_id, count(*) FILTER (WHERE event_type NOT IN ('error', 'click')) AS described, count(*) FILTER (WHERE event_type = 'click') AS skipped, count(*) FILTER (WHERE event_type = 'error') AS failed, round(coalesce(sum(value), 0), 4) AS usd FROM events GROUP BY user_id",
)
def description_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions by state and cost, events in their place."""
    state = F.expr("case event_type when 'error' then 'failed' when 'click' then 'skipped' else 'described' end")
    found = intake.description_counts(load(spark, sf_dir, "events").withColumn("state", state), "user_id", "state", "value")
    return found.withColumn("usd", F.round("usd", 4))


@query(
    "table_readings",
    """
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_size || ' nm, 12.5 and x' ELSE 'x, 12.5 and ' || p_size END AS body,
        CASE WHEN p_partkey % 4 = 0 THEN 'x, 12.5 and ' || p_size END AS alternative,
        CASE WHEN p_partkey % 2 = 1 THEN 'kept' WHEN p_partkey % 4 = 0 THEN 'replaced' WHEN p_partkey % 8 = 2 THEN 'unread' ELSE 'differs' END AS outcome FROM part
    """,
)
def table_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of tables made from ``part``: every fourth has a second one with the same numbers."""
    native = F.expr("concat('x, 12.5 and ', p_size)")
    ocr = F.expr("case when p_partkey % 4 = 0 then concat(p_size, ' nm, 12.5 and x') when p_partkey % 8 = 6 then concat(p_size, ' nm, 1.25') end")
    return load(spark, sf_dir, "part").select("p_partkey", table_check.choose_reading(native, ocr, F.col("p_partkey") % 2 == 0).alias("r")).select("p_partkey", "r.*")


@query(
    "table_cross_check",
    """
    WITH t AS (SELECT o_orderkey AS table_id FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT o_orderkey AS reference_id, o_orderkey % 5 = 0 AS other FROM orders WHERE o_orderkey % 4 <> 0)
    SELECT table_id, reference_id, CASE WHEN table_id IS NULL THEN 'EXTRA' WHEN reference_id IS NULL THEN 'UNMATCHED' WHEN other THEN 'DISAGREED' ELSE 'AGREED' END AS outcome
    FROM t FULL JOIN r ON table_id = reference_id
    """,
)
def table_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables made from ``orders`` and independent readings of them, paired by key."""
    orders = load(spark, sf_dir, "orders")
    tables = orders.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey as table_id", "concat('7 and ', o_custkey, ' and 2.50') as body")
    reference = orders.where("o_orderkey % 4 <> 0").selectExpr("o_orderkey as reference_id", "concat(o_custkey, if(o_orderkey % 5 = 0, ' 2.5 ', ' 2.50 '), 7) as body")
    pairs = orders.where("o_orderkey % 12 in (1, 2, 5, 7, 10, 11)").selectExpr("o_orderkey as table_id", "o_orderkey as reference_id")
    return table_check.cross_check(tables, reference, pairs)


@query("citing_sentences", "SELECT doc_id, 'S' || doc_id % 7 AS label, CASE WHEN doc_id % 3 > 0 THEN 'As Fig. S' || doc_id % 7 || ' shows, it holds.' END AS sentence FROM documents")
def citing_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made sentences, three blocks of them for each of ``documents``, that cite a figure; no text of the documents is read."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.expr("concat('S', doc_id % 7)").alias("label"))
    made = "array(concat('Fig. S', doc_id % 7, '1 differs. It does.'), if(doc_id % 3 > 0, concat('Before it. As Fig. ', label, ' shows, it holds. After it.'), 'None. Here.'), concat('Also Figure ', doc_id % 7, '.'))"
    blocks = docs.select("doc_id", F.posexplode(F.expr(made)).alias("pos", "body"))
    return figures.citing_sentence(blocks, docs, "doc_id", "pos", "body")


@query("printed_families", "SELECT c_custkey, c_custkey % 3 < 2 AS printed, c_custkey % 2 = 0 AS cited FROM customer")
def printed_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and locations on pages made from ``customer``: printed with a digit, with a lost letter, or inside a word."""
    page = F.expr("concat('By A. ', case c_custkey % 3 when 0 then concat(c_mktsegment, c_nationkey) when 1 then concat('H\\u00e4', c_mktsegment) else concat('x', c_mktsegment) end, ', vol. ', c_custkey, ', p. ', if(c_custkey % 2 = 0, 'e17', 'e18'))")
    family = F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("h "), F.lower("c_mktsegment"))).otherwise(F.lower("c_mktsegment"))
    cited = figures.cites(F.col("c_custkey").cast("string"), F.lit("E17-22"), F.lit(None).cast("string"), text.words(page))
    return load(spark, sf_dir, "customer").select("c_custkey", figures.printed_family(family, page).alias("printed"), cited.alias("cited"))


@query(
    "printed_checks",
    """SELECT p_partkey, p_partkey % 5 > 0 AS applicable, 3 AS claimed, CASE WHEN p_partkey % 5 > 0 THEN 2 ELSE 0 END AS confirmed, CASE WHEN p_partkey % 5 > 0 THEN 2 ELSE 0 END AS informative,
        CASE WHEN p_partkey % 5 > 0 THEN 1 ELSE 0 END AS found, CASE WHEN p_partkey % 5 > 0 THEN 'only in caption' ELSE '' END AS unconfirmed FROM part""",
)
def printed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on figures made from ``part``: a value with a minus, a short string, and one that the caption alone prints."""
    claimed = F.expr("array(concat('\\u2212', p_partkey, ' nm'), 'nm', 'only in caption')")
    region = F.expr("concat('Axis of wave lengths in vacuum -', p_partkey, ' nm only in caption')")
    check = figures.printed_check(claimed, region, F.lit("Only in caption"), F.col("p_partkey") % 5 == 0)
    return load(spark, sf_dir, "part").select("p_partkey", check.alias("c")).select("p_partkey", "c.*").withColumn("unconfirmed", F.array_join("unconfirmed", "|"))


@query(
    "directory_names",
    """SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 'Unverified_' || left(sha256(c_name), 12) ELSE upper(left(c_mktsegment, 1)) || substr(c_mktsegment, 2) || '_' || CASE WHEN c_nationkey % 2 = 0 THEN (1990 + c_nationkey)::VARCHAR ELSE 'nodate' END
        || '_LightWavesCustomer' || CASE WHEN c_custkey % 10 = 0 THEN '_' || left(sha256(c_name), 6) ELSE '' END END AS directory FROM customer""",
)
def directory_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of papers made from ``customer``; every tenth name is taken."""
    year = F.expr("if(c_nationkey % 2 = 0, 1990 + c_nationkey, null)")
    name = export.directory_name(F.col("c_acctbal") > 0, F.col("c_mktsegment"), year, F.concat(F.lit("The light of x waves: "), F.lit("customer "), F.col("c_name")), F.sha2("c_name", 256), F.col("c_custkey") % 10 == 0)
    return load(spark, sf_dir, "customer").select("c_custkey", name.alias("directory"))
