"""Full-text search and lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import search
from quire.plans import sql
from quire.plans.registry import query
from quire.sources.shared import materialize, new_path, spread
from quire.sources.tables import load

_W = search.WEIGHTS


def _bm25_sql(phrases: list[list[str]], k: int) -> str:
    """BM25 of documents by title (first line) and body, as DuckDB SQL."""
    hits = lambda c, p: f"len(list_filter(range(1, len({c}) + 1), lambda i: " + " AND ".join(f"coalesce({c}[i + {j}], '') = '{w}'" for j, w in enumerate(p)) + "))"
    tf = ", ".join(f"{_W['title']} * {hits('t', p)} + {_W['body']} * {hits('b', p)} AS tf{j}" for j, p in enumerate(phrases))
    df = ", ".join(f"count(*) FILTER (WHERE tf{j} > 0) AS df{j}" for j in range(len(phrases)))
    part = " + ".join(f"greatest(ln((n - df{j} + 0.5) / (df{j} + 0.5)), 1e-6) * tf{j} * 2.2 / (tf{j} + 1.2 * (0.25 + 0.75 * d / avgdl))" for j in range(len(phrases)))
    return f"""
    WITH w AS (SELECT doc_id, {sql.words(sql.FIRST_LINE)} AS t, {sql.words('text')} AS b FROM documents), c AS (SELECT doc_id, len(t) + len(b) AS d, {tf} FROM w),
    s AS (SELECT count(*) AS n, avg(d) AS avgdl, {df} FROM c), r AS (SELECT doc_id, -({part})::DOUBLE AS score FROM c, s WHERE {" AND ".join(f"tf{j} > 0" for j in range(len(phrases)))})
    SELECT doc_id, round(score, 6) AS score FROM r ORDER BY r.score, doc_id LIMIT {k}
    """


def _searched(spark: SparkSession, sf_dir: str, text_query: str, k: int) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", text.first_line(F.col("text")).alias("title"), F.col("text").alias("body"))
    return search.bm25(rows, "doc_id", ["title", "body"], text_query, k).select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_search", _bm25_sql([["license"], ["version"]], 20))
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for two words."""
    return _searched(spark, sf_dir, "license version", 20)


@query("bm25_phrase", _bm25_sql([["apache", "license"], ["the"]], 20))
def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for a phrase and a word."""
    return _searched(spark, sf_dir, '"Apache License" the', 20)


@query("search_snippets")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of the best documents; only hits are joined back to their texts."""
    hits = _searched(spark, sf_dir, "license version", 20)
    return load(spark, sf_dir, "documents").join(hits, "doc_id").select("doc_id", "score", search.snippet("text", "license version").alias("snippet"))


@query("postings", f"SELECT item_id, pos - 1 AS pos, term FROM (SELECT item_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS term FROM (SELECT item_id, {sql.words('text')} AS w FROM benchmark))")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the benchmark passages with its place."""
    return search.postings(load(spark, sf_dir, "benchmark"), "item_id", ["text"]).select("item_id", "pos", "term")


_KEYED = f"sha256(text) AS h, sha256({sql.squash('text')}) AS norm, nullif({sql.title_key(sql.FIRST_LINE)}, '') AS key"
_STEP = "SELECT q.query, c.directory, {rank} AS rank, c.held, '{status}' AS status, '{reason}' AS reason FROM q JOIN (SELECT {column} AS v, min(doc_id) AS directory, count(DISTINCT doc_id) AS held FROM d GROUP BY 1) c ON q.{column} = c.v"
_STEPS = " UNION ALL ".join(
    _STEP.format(rank=i, status=status, reason=reason, column=column)
    for i, (status, reason, column) in enumerate((("present", "identical bytes", "h"), ("present", "identical text", "norm"), ("candidate", "equal titles; titles alone never prove identity", "key")))
)


@query(
    "lookup_cascade",
    f"""
    WITH d AS MATERIALIZED (SELECT doc_id, {_KEYED} FROM documents), q AS (SELECT 1000000000 + item_id AS query, {_KEYED} FROM benchmark UNION ALL SELECT doc_id AS query, h, norm, key FROM d),
    e AS ({_STEPS}), b AS (SELECT query, directory, held, status, reason FROM (SELECT *, row_number() OVER (PARTITION BY query, directory ORDER BY rank) AS r FROM e) WHERE r = 1)
    SELECT * FROM b UNION ALL SELECT query, NULL, 0, 'absent', '' FROM q WHERE query NOT IN (SELECT query FROM b)
    """,
)
def lookup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage and every document looked up among the documents by bytes, text and title, a class of copies at a time."""
    columns = lambda name: [name.alias("query"), F.sha2("text", 256).alias("sha256"), text.text_digest(F.col("text")).alias("text_sha256"), F.nullif(text.title_key(text.first_line(F.col("text"))), F.lit("")).alias("title_key")]
    # keyed once and stored: documents are both asked and searched by each of the keys
    docs = materialize(load(spark, sf_dir, "documents").select(*columns(F.col("doc_id"))), "keyed")
    queries = load(spark, sf_dir, "benchmark").select(*columns(F.col("item_id") + 1000000000)).unionByName(docs)
    table = lambda c: docs.select(F.col(c).alias("value"), F.col("query").alias("directory"))
    steps = [
        ("present", "identical bytes", table("sha256"), "sha256"),
        ("present", "identical text", table("text_sha256"), "text_sha256"),
        ("candidate", "equal titles; titles alone never prove identity", table("title_key"), "title_key"),
    ]
    return search.lookup(queries, steps)


_PAPERS = "SELECT p_partkey AS directory, '10.1000/p' || p_partkey AS doi, p_name || ' ' || p_partkey // 2 || ' in ' || p_type AS title, p_brand AS family, 1990 + p_size % 30 AS year FROM part"


@query(
    "library_lookup",
    f"""
    WITH p AS MATERIALIZED ({_PAPERS}), k AS MATERIALIZED (SELECT directory, year, lower(replace(family, '#', ' ')) AS f, list_distinct(list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS w FROM p),
    q AS (SELECT 100000000 + directory AS query, directory AS own, w, f, year FROM k),
    t AS (SELECT q.query, k.directory FROM q JOIN k ON k.f LIKE '%' || q.f || '%' AND abs(k.year - q.year) <= 1 WHERE len(list_intersect(q.w, k.w))::DOUBLE / (len(q.w) + len(k.w) - len(list_intersect(q.w, k.w))) >= 0.8),
    d AS (SELECT query, own AS directory, 'present' AS status, 'validated DOI' AS reason FROM q WHERE own % 2 = 0)
    SELECT query, directory, 1 AS held, status, reason FROM d
    UNION ALL SELECT query, directory, 1, 'candidate', 'similar titles; titles alone never prove identity' FROM t WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.query = t.query AND d.directory = t.directory)
    """,
)
def library_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made from ``part`` looked up in a library made from it: half of them with a DOI, all with title, author and year."""
    made = "concat(p_name, ' ', p_partkey div 2, ' in ', p_type)"
    parts = spread(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size"), "p_partkey").select(F.col("p_partkey").cast("long").alias("directory"), F.expr("concat('10.1000/P', p_partkey)").alias("doi"), F.expr(made).alias("title"), F.array("p_brand").alias("families"), F.expr("1990 + p_size % 30").alias("year"))
    papers = parts.select("directory", F.lower("doi").alias("doi"), text.title_key(F.col("title")).alias("title_key"), F.lit(None).cast("string").alias("title_key_observed"), "families", "year")
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    asked = parts.select((F.col("directory") + 100000000).alias("query"), none.alias("sha256"), none.alias("text_sha256"), none.alias("arxiv"), empty.alias("arxiv_candidates"), F.expr("if(directory % 2 = 0, doi, null)").alias("doi"), empty.alias("doi_candidates"), "title", F.get("families", F.lit(0)).alias("author"), "year", none.alias("first_page"))
    blank = lambda column: papers.where("false").select("directory", none.alias(column))
    index = {"sources": blank("sha256"), "texts": blank("text_sha256"), "arxiv": blank("identifier"), "candidates": blank("doi"), "papers": papers}
    return search.lookup_library(asked, index)


@query("indexed_search", _bm25_sql([["apache", "license"], ["the"]], 20))
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrase query answered from a stored index of the documents: folders of the query's terms alone are read."""
    rows = load(spark, sf_dir, "documents").select("doc_id", text.first_line(F.col("text")).alias("title"), F.col("text").alias("body"))
    path = new_path(spark, "index")
    search.index_terms(rows, "doc_id", ["title", "body"], path)
    return search.bm25_index(spark, "doc_id", path, '"Apache License" the', 20).select("doc_id", F.round("score", 6).alias("score"))


_TITLES = f"SELECT min(doc_id) AS id, k FROM (SELECT doc_id, {sql.title_key(sql.FIRST_LINE)} AS k FROM documents) WHERE k <> '' GROUP BY k"


@query(
    "jaccard_titles",
    f"""
    WITH t AS (SELECT id, list_distinct(string_split(k, ' ')) AS w FROM ({_TITLES})), p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w))::DOUBLE AS n, len(a.w) + len(b.w) AS m FROM t a JOIN t b ON a.id < b.id AND len(a.w) * 0.8 <= len(b.w) AND len(b.w) * 0.8 <= len(a.w))
    SELECT a, b, round(n / (m - n), 6) AS overlap FROM p WHERE n / (m - n) >= 0.8
    """,
)
def jaccard_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct first lines whose words overlap by 0.8."""
    titles = load(spark, sf_dir, "documents").select("doc_id", text.title_key(text.first_line(F.col("text"))).alias("k")).where("k <> ''").groupBy("k").agg(F.min("doc_id").alias("id"))
    return search.similar_titles(titles, "id", "k").select("a", "b", F.round("overlap", 6).alias("overlap"))


@query(
    "printed_titles",
    f"""
    WITH t AS (SELECT item_id AS title_id, array_to_string(string_split({sql.title_key('text')}, ' ')[1:6], ' ') AS key FROM benchmark), p AS (SELECT doc_id AS page_id, ' ' || {sql.title_key('text')} || ' ' AS page FROM documents)
    SELECT DISTINCT title_id, page_id FROM t JOIN p ON contains(p.page, ' ' || t.key) WHERE len(string_split(key, ' ')) >= 4
    """,
)
def printed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that print the first six words of a passage, the words in titles' place."""
    titles = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("title_id"), F.array_join(F.slice(F.split(text.title_key(F.col("text")), " "), 1, 6), " ").alias("key"))
    pages = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), text.title_key(F.col("text")).alias("page_key"))
    return search.printed_titles(titles, pages)
