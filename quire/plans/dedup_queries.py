"""Duplicates, known sources, supplements, relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import dedup, identity
from quire.plans import sql
from quire.plans.registry import query
from quire.sources.tables import load

_KEYED = f"SELECT doc_id, CASE WHEN length({sql.squash('text')}) >= 200 THEN sha256({sql.squash('text')}) END AS text_sha256 FROM documents"


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", dedup.content_key(F.col("text")).alias("text_sha256"))


@query("content_equivalents", f"WITH k AS ({_KEYED}), f AS (SELECT text_sha256, min(doc_id) AS first FROM k WHERE text_sha256 IS NOT NULL GROUP BY 1) SELECT doc_id, first::VARCHAR AS held_by, text_sha256 FROM k JOIN f USING (text_sha256) WHERE doc_id <> first")
def content_equivalents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of 200 normalised characters or more whose text an earlier document holds."""
    return dedup.content_equivalents(_keyed(spark, sf_dir), "doc_id")


@query("identical_groups", "SELECT sha256(text) AS sha256, min(doc_id) AS \"primary\", array_to_string(list_sort(list(doc_id))[2:], ',') AS aliases FROM documents GROUP BY 1")
def identical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of identical bytes."""
    rows = load(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("path"))
    return dedup.identical_groups(rows).select("sha256", "primary", F.array_join("aliases", ",").alias("aliases"))


@query("known_sources", "SELECT c.conv_id, c.turn, k.known_as FROM conversations c LEFT JOIN (SELECT sha256(text) AS h, min(conv_id) AS known_as FROM conversations WHERE turn = 0 GROUP BY 1) k ON sha256(c.text) = k.h")
def known_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose bytes the library of first turns holds."""
    rows = load(spark, sf_dir, "conversations").withColumn("sha256", F.sha2("text", 256))
    return dedup.known_sources(rows.select("conv_id", "turn", "sha256"), rows.where("turn = 0").select("sha256", F.col("conv_id").alias("directory"))).select("conv_id", "turn", "known_as")


@query("unknown_sources", "SELECT conv_id, turn FROM conversations WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents)")
def unknown_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose bytes no document has."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("sha256"))
    return dedup.unknown_sources(rows, load(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"))).select("conv_id", "turn")


@query(
    "dedup_summary",
    f"""
    WITH k AS ({_KEYED}), g AS (SELECT sha256(text) AS h, min(doc_id) AS doc_id, bool_or(text IN (SELECT text FROM benchmark)) AS known, min(source) AS source FROM documents GROUP BY 1),
    r AS (SELECT g.*, k.text_sha256 FROM g JOIN k USING (doc_id)), f AS (SELECT text_sha256, min(doc_id) AS first FROM r WHERE NOT known GROUP BY 1),
    s AS (SELECT r.*, coalesce(NOT known AND f.first <> r.doc_id AND r.text_sha256 IS NOT NULL, false) AS held, source IN ('src1', 'src2') AS sup FROM r LEFT JOIN f ON r.text_sha256 = f.text_sha256)
    SELECT count(*) AS groups, count(*) FILTER (WHERE known) AS known, count(*) FILTER (WHERE NOT known AND held) AS held, count(*) FILTER (WHERE NOT known AND NOT held AND sup) AS supplements, count(*) FILTER (WHERE NOT known AND NOT held AND NOT sup) AS to_extract FROM s
    """,
)
def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An intake plan's counts: known to ``benchmark``, held as equal text, supplements (two sources stand in), left to extract."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"), dedup.content_key(F.col("text")).alias("text_sha256"))
    groups = docs.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.min("source").alias("source"), F.first("text_sha256").alias("text_sha256"))
    groups = dedup.known_sources(groups, load(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("sha256"), F.col("item_id").alias("directory")))
    held = dedup.content_equivalents(groups.where("known_as is null"), "doc_id").select("doc_id", "held_by")
    return dedup.dedup_summary(groups.join(held, "doc_id", "left").withColumn("is_supplement", F.col("source").isin("src1", "src2")))


_ID = "regexp_extract(text, '[0-9][0-9-]{6,}[0-9]', 0)"


@query("shared_first_candidate", f"SELECT candidate, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, nullif({_ID}, '') AS candidate FROM documents) WHERE candidate IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def shared_first_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First number-like identifiers that documents share, in DOIs' place."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.nullif(F.regexp_extract("text", "[0-9][0-9-]{6,}[0-9]", 0), F.lit("")).alias("candidate"))
    return dedup.shared_first(rows, "candidate", "doc_id")


@query("supplement_pairs", "SELECT '/in/' || lower(replace(s_name, '#', '')) || 'paper_si.pdf' AS name, CASE WHEN s_suppkey % 2 = 0 THEN '/in/z' || s_suppkey || '.pdf' ELSE '/in/' || lower(replace(s_name, '#', '')) || 'paper.pdf' END AS paper, CASE WHEN s_suppkey % 2 = 0 THEN 'shared DOI' ELSE 'file name' END AS reason FROM supplier")
def supplement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplements paired by DOI or by file name, files made from ``supplier``."""
    s = load(spark, sf_dir, "supplier")
    stem = "concat('/in/', lower(replace(s_name, '#', '')), 'paper')"
    doi = "if(s_suppkey % 2 = 0, array(concat('10.1000/', s_suppkey)), cast(array() as array<string>))"
    files = s.selectExpr(f"concat({stem}, '_si.pdf') as name", f"{doi} as dois").unionByName(s.selectExpr(f"concat({stem}, '.pdf') as name", "cast(array() as array<string>) as dois")).unionByName(s.where("s_suppkey % 2 = 0").selectExpr("concat('/in/z', s_suppkey, '.pdf') as name", f"{doi} as dois"))
    return dedup.pair_supplements(files)


_PAPERS = f"SELECT doc_id AS id, doc_id AS directory, CASE WHEN doc_id % 3 = 0 THEN '10.1/' || md5(text) END AS doi, {sql.title_key(sql.FIRST_LINE)} AS title_key, source AS family, CASE WHEN doc_id % 7 > 0 THEN 2000 + doc_id % 2 END AS year FROM documents"


@query(
    "library_relations",
    f"""
    WITH p AS ({_PAPERS}), work AS (SELECT a.id, min(b.directory) AS directory FROM p a JOIN p b ON a.doi = b.doi AND a.directory <> b.directory GROUP BY 1),
    twin AS (SELECT a.id, min(b.directory) AS directory FROM p a JOIN p b ON a.title_key = b.title_key AND a.family = b.family AND a.year = b.year AND coalesce(a.doi, a.directory::VARCHAR) <> coalesce(b.doi, b.directory::VARCHAR) WHERE a.title_key <> '' GROUP BY 1)
    SELECT id, directory, 'same_work' AS relation FROM work UNION ALL SELECT id, directory, 'possible_duplicate' FROM twin
    """,
)
def library_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations among documents as papers: the text's digest in DOIs' place, source as family."""
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("directory"), F.expr("if(doc_id % 3 = 0, concat('10.1/', md5(text)), null)").alias("doi"), text.title_key(text.first_line(F.col("text"))).alias("title_key"), F.col("source").alias("family"), F.expr("if(doc_id % 7 > 0, 2000 + doc_id % 2, null)").alias("year"))
    return identity.library_relations(rows, rows)


@query("relation_findings", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND NOT (o_orderstatus <> 'unknown' AND o_orderstatus = 'F') THEN 'OTHER_VERSION_IN_LIBRARY' ELSE 'DUPLICATE_CANDIDATE' END AS code FROM orders")
def relation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of relations made from ``orders``."""
    relation = F.expr("if(o_orderkey % 2 = 0, 'same_work', 'possible_duplicate')")
    return load(spark, sf_dir, "orders").select("o_orderkey", identity.relation_finding(relation, F.col("o_orderstatus"), F.lit("F")).alias("code"))


@query("intake_title_matches", f"WITH t AS (SELECT doc_id, {sql.title_key(sql.FIRST_LINE)} AS k FROM documents), b AS (SELECT DISTINCT {sql.title_key(sql.FIRST_LINE)} AS k FROM benchmark) SELECT k AS title_key, count(*) AS batch, bool_or(b.k IS NOT NULL) AS in_library FROM t LEFT JOIN b USING (k) WHERE k <> '' GROUP BY 1 HAVING count(*) > 1 OR bool_or(b.k IS NOT NULL)")
def intake_title_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title keys that a batch of documents shares with itself or with ``benchmark``."""
    key = text.title_key(text.first_line(F.col("text"))).alias("title_key")
    return dedup.intake_titles(load(spark, sf_dir, "documents").select(key), load(spark, sf_dir, "benchmark").select(key))
