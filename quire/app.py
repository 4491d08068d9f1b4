"""The library's commands: ``python -m quire.app COMMAND``. Each prints its rows as JSON and ends with the result's code."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import ids
from quire.operators import catalog, dedup, library_files, merged_runs, search, validate
from quire.sources import files, library, sinks

#: Rows that a command prints; what it computes is not limited, and ``--out`` writes all.
SHOWN = 1000
COMMANDS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], DataFrame], Callable[[argparse.ArgumentParser], None]]] = {}


def command(name: str, arguments: Callable[[argparse.ArgumentParser], None]):
    """Register a command: a function that makes its rows, and one that adds its arguments."""

    def add(function):
        COMMANDS[name] = (function, arguments)
        return function

    return add


def _paths(*names: str) -> Callable[[argparse.ArgumentParser], None]:
    def add(parser: argparse.ArgumentParser) -> None:
        for name in names:
            parser.add_argument(name)

    return add


def _catalog(spark: SparkSession, path: str) -> DataFrame:
    return catalog.catalog_rows(library.papers(spark, path))


def _shard(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("directory")
    parser.add_argument("library")
    parser.add_argument("--shard", default="1/1", help="K/N: only the sources of shard K of N, by the digest of their digest")


@command("batch", _shard)
def batch(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """What an intake of a folder's files has to extract: one row a digest, with what the library knows of it."""
    k, n = (int(x) for x in given.shard.split("/"))
    found = files.pdf_files(spark, given.directory).where("sha256 is not null")
    groups = dedup.identical_groups(found).where(ids.stable_shard(F.col("sha256"), n) == k - 1)
    held = _catalog(spark, given.library).select("directory", F.explode("source_sha256").alias("sha256"))
    planned = dedup.known_sources(groups, held).withColumn("is_supplement", ids.supplement_name(F.col("primary")))
    state = F.when(F.col("known_as").isNotNull(), "skipped").when(F.col("is_supplement"), "supplement").otherwise("to_extract")
    return planned.select("primary", "sha256", F.size("aliases").alias("aliases"), "known_as", state.alias("status"))


@command("bundles", _paths("manifest", "directory"))
def bundles(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """A manifest's entries over a folder's files, by file name: digests of each entry's paper and supplements, its pages, and other entries' names that its bytes stand under."""
    name = F.substring_index("path", "/", -1)
    found = files.pdf_files(spark, given.directory).where("sha256 is not null").select(name.alias("path"), "sha256")
    bare = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda p: F.substring_index(p, "/", -1))
    entries = files.manifest(spark, given.manifest).where("size(problems) = 0").select("id", F.substring_index("paper", "/", -1).alias("paper"), bare(F.col("supplements")).alias("supplements"), bare(F.col("html")).alias("html"))
    members = merged_runs.bundles(entries, found)
    others = merged_runs.clashes(members).groupBy("id").agg(F.array_sort(F.collect_set("first")).alias("same_bytes_as"))
    return merged_runs.pairing(members).join(others, "id", "left")


@command("merge", _paths("results"))
def merge(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """The latest result of each source over sharded runs' results (JSON lines: run, sha256, status, stage, directory, finished)."""
    rows = spark.read.schema("run string, sha256 string, status string, stage string, directory string, finished string").json(given.results)
    return merged_runs.merged(rows).withColumnRenamed("status", "result")


@command("dedup", _paths("directory"))
def dedup_report(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """Groups of files of equal bytes, and the supplements among them with their papers."""
    found = files.pdf_files(spark, given.directory).where("sha256 is not null")
    groups = dedup.identical_groups(found)
    pairs = dedup.pair_supplements(groups.select(F.col("primary").alias("name"), F.array().cast("array<string>").alias("dois")))
    return groups.join(pairs, groups["primary"] == pairs["name"], "left").select("sha256", "primary", F.array_join("aliases", " ").alias("aliases"), "paper", "reason")


@command("publish", _paths("library"))
def publish(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """Write the library's catalog anew from its papers."""
    rows = _catalog(spark, given.library)
    sinks.write_catalog(rows, f"{given.library.rstrip('/')}/.catalog")
    return rows.select("directory", F.lit("published").alias("status"))


def _layout(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("library")
    parser.add_argument("--layout", choices=("flat", "by-year", "by-initial"), default="flat")


@command("organize", _layout)
def organize(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """The moves that a layout needs; those whose goal is taken are conflicts. Nothing is moved."""
    rows = _catalog(spark, given.library)
    moves = catalog.organize_plan(rows, given.layout)
    bad = catalog.name_conflicts(moves, rows).select("old", F.lit("conflict").alias("status"))
    return moves.join(bad, "old", "left").select("old", "new", F.coalesce("status", F.lit("complete")).alias("status"))


@command("migrate", _paths("library", "versions"))
def migrate(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """Each paper's state by its records' versions, against a JSON list of schema, oldest and current version."""
    versions = spark.read.schema("schema string, oldest int, current int").json(given.versions)
    papers = library.papers(spark, given.library)
    texts = F.explode(F.array_compact(F.array(*(c for c in library.RECORDS if c != "bibtex")))).alias("json")
    records = papers.select("directory", texts).select("directory", F.from_json("json", "schema string, schema_version int").alias("r")).select("directory", "r.*")
    return catalog.paper_states(validate.record_state(records, versions), papers.select("directory").where("false"))


@command("compare", _paths("reference", "other"))
def compare_texts(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """Of paragraphs (JSON lines: doc, pos, text) of one reading: how many were compared, how many another one mostly lacks, and their share."""
    read = lambda path: spark.read.schema("doc string, pos long, text string").json(path)
    from quire.operators import report

    return report.coverage(read(given.reference), read(given.other)).withColumn("share", F.round(F.col("absent") / F.col("compared"), 4))


@command("attach", _paths("library", "files"))
def attach(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """What attaching files (JSON lines: directory, sha256, name) to papers comes to."""
    offered = spark.read.schema("directory string, sha256 string, name string").json(given.files)
    kept = _catalog(spark, given.library).select("directory", F.explode("source_sha256").alias("sha256"))
    found = library_files.attach(offered, kept)
    return found.select("directory", "name", "outcome", F.when(F.col("outcome") == "attached", "complete").otherwise("skipped").alias("status"))


@command("index", _paths("library", "index"))
def index(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """Build the search index of a library's catalog."""
    rows = _catalog(spark, given.library).select("directory", "title", F.array_join("authors", " ").alias("authors"), "abstract")
    search.index_terms(rows, "directory", ["title", "authors", "abstract"], given.index)
    return spark.read.parquet(f"{given.index}/lengths").agg(F.count(F.lit(1)).alias("papers")).withColumn("status", F.lit("complete"))


def _search(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("query")
    parser.add_argument("index", nargs="+")
    parser.add_argument("--limit", type=int, default=10)


@command("search", _search)
def search_index(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """The best papers of each index for a query, in one order."""
    results = [search.bm25_index(spark, "directory", path, given.query, given.limit).select(F.lit(path).alias("library"), "directory", "score") for path in given.index]
    return search.merged(results, "directory")


@command("lookup", _paths("bibtex", "library"))
def lookup(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """Whether a library holds the works of a BibTeX file, by DOI and by title, author and year."""
    entries = spark.read.text(given.bibtex, wholetext=True).select(F.posexplode(files.read_bibtex("value")).alias("n", "e"))
    field = lambda name: F.try_element_at("e.fields", F.lit(name))
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    lead = F.get(ids.bibtex_authors(field("author")), F.lit(0))["family"]
    asked = entries.select(F.col("e.key").alias("query"), none.alias("sha256"), none.alias("text_sha256"), none.alias("arxiv"), empty.alias("arxiv_candidates"), ids.normalize_doi(field("doi")).alias("doi"), empty.alias("doi_candidates"), field("title").alias("title"), lead.alias("author"), field("year").try_cast("int").alias("year"), none.alias("first_page"))
    rows = _catalog(spark, given.library)
    papers = rows.select("directory", F.lower("doi").alias("doi"), "title_key", "title_key_observed", F.array_compact(F.concat(F.array("first_author_family"), "authors_observed")).alias("families"), "year")
    tables = {
        "papers": papers,
        "sources": rows.select("directory", F.explode("source_sha256").alias("sha256")),
        "texts": rows.select("directory", "text_sha256"),
        "arxiv": rows.select("directory", F.col("arxiv").alias("identifier")),
        "candidates": rows.select("directory", F.explode("doi_candidates").alias("doi")),
    }
    return search.lookup_library(asked, tables)


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; returns its code: that of its rows' statuses, 0 where they have none."""
    parser = argparse.ArgumentParser(prog="quire", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (function, add) in COMMANDS.items():
        own = commands.add_parser(name, help=function.__doc__)
        add(own)
        own.add_argument("--out", help="write all rows there, as JSON lines")
        own.add_argument("--strict", action="store_true")
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("quire").getOrCreate()
    rows = COMMANDS[given.command][0](spark, given)
    if given.out:
        rows.write.mode("overwrite").json(given.out)
        rows = spark.read.schema(rows.schema).json(given.out)
    for r in rows.limit(SHOWN).toJSON().collect():
        print(json.dumps(json.loads(r), sort_keys=True, ensure_ascii=False))
    if "status" not in rows.columns or given.command == "lookup":
        return catalog.OK
    items = rows.select(F.lit(given.command).alias("command"), "status", F.lit(0).alias("warnings"))
    settled = F.when(F.col("status").isin("to_extract", "supplement"), "complete").otherwise(F.col("status"))
    result = catalog.command_result(items.withColumn("status", settled), "command", given.strict).first()
    return catalog.OK if result is None else result.exit_code


if __name__ == "__main__":
    sys.exit(main())
