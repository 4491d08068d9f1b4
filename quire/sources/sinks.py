"""Writing catalogs, index tables and derived catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import markdown_cell
from quire.operators.search import postings


def write_catalog(rows: DataFrame, path: str) -> None:
    """A JSONL catalog in order of directory; Spark's committer makes it appear whole."""
    rows.orderBy("directory").write.mode("overwrite").json(path)


def build_index(catalog: DataFrame, path: str) -> None:
    """Index tables of a catalog (directory, doi, arxiv, title, title_key, authors, abstract, body, year, sources, candidates).

    papers, sources (the first is main, others supplements), candidates, arxiv and postings, as Parquet.
    """
    catalog.select("directory", F.lower("doi").alias("doi"), "title", "title_key", "authors", "year").write.mode("overwrite").parquet(f"{path}/papers")
    sources = catalog.select("directory", F.posexplode("sources").alias("position", "sha256"))
    sources.withColumn("role", F.when(F.col("position") == 0, "main").otherwise("supplement")).write.mode("overwrite").parquet(f"{path}/sources")
    catalog.select("directory", F.explode("candidates").alias("doi")).write.mode("overwrite").parquet(f"{path}/candidates")
    catalog.where("arxiv is not null").select("directory", F.col("arxiv").alias("identifier")).write.mode("overwrite").parquet(f"{path}/arxiv")
    postings(catalog, "directory", ["title", "abstract", "body"]).write.mode("overwrite").partitionBy("field").parquet(f"{path}/postings")


def index_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def catalog_markdown(rows: DataFrame) -> DataFrame:
    """(place, line): a Markdown table's lines by family (none last), year and directory."""
    cells = F.array(*(markdown_cell(F.col(c).cast("string")) for c in ("directory", "title", "year")))
    return rows.select(F.coalesce("family", F.lit("~")).alias("family"), F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"), "directory", F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")).alias("line")).orderBy("family", "year", "directory")
