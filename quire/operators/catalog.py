"""A library's catalog: one row a paper from its five JSON records, states, and the result of a command."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import ids, text
from quire.operators import resolution

# The members of a paper's records that the catalog shows.
METADATA = (
    "work_id string, document_version string, arxiv string, bibliographic_status string, "
    "fields struct<title struct<value string>, authors struct<value array<struct<given string, family string, literal string>>>, year struct<value int>, journal struct<value string>>, "
    "identity struct<doi string, registry_record struct<abstract string>>, observations struct<title string, entries array<struct<field string, value string>>>"
)
EXTRACTION = "run_id string, published_utc string, sources array<struct<sha256 string, fingerprint struct<text_sha256 string, doi_candidates array<string>>>>, supplements array<struct<markdown string>>"
DOCUMENT = "backend string, backend_version string, pages array<struct<number int>>"
VALIDATION = "processing_status string, counts map<string, int>"
ROW_SCHEMA, ROW_VERSION = "catalog_row", 1
#: What an item's status means for a command: done, or else a problem; and the codes that a command ends with.
DONE = ["complete", "published", "unchanged", "skipped"]
OK, CONFLICT, PARTIAL, FAILURE = 0, 3, 4, 5


def author_names(authors: Column) -> Column:
    """``Given Family`` of each author, or the literal name; those without any are left out."""
    each = lambda a: F.coalesce(F.nullif(F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit(""))), F.lit("")), a["literal"])
    return F.filter(F.transform(F.coalesce(authors, F.array().cast("array<struct<given string, family string, literal string>>")), each), lambda n: n.isNotNull() & (n != ""))


def catalog_rows(papers: DataFrame, library_id: str | None = None) -> DataFrame:
    """The catalog's 33 columns for papers (directory, manifest, metadata, validation, extraction, document, bibtex).

    All but directory are the files' texts. What identifies a paper is null unless it was validated; what was observed
    stands apart. Null or broken records give nulls and empty lists.
    """
    read = papers.select(
        "directory",
        F.from_json("manifest", "generation string").alias("m"),
        F.from_json("metadata", METADATA).alias("d"),
        F.from_json("validation", VALIDATION).alias("v"),
        F.from_json("extraction", EXTRACTION).alias("e"),
        F.from_json("document", DOCUMENT).alias("doc"),
        "bibtex",
    )
    observed = lambda field: F.transform(F.filter(F.coalesce("d.observations.entries", F.array().cast("array<struct<field string, value string>>")), lambda x: x["field"] == field), lambda x: x["value"])
    lead = F.get("d.fields.authors.value", F.lit(0))
    sources = F.coalesce("e.sources", F.array().cast("array<struct<sha256 string, fingerprint struct<text_sha256 string, doi_candidates array<string>>>>"))
    others = F.slice(sources, 2, F.greatest(F.size(sources) - 1, F.lit(0)))
    pairs = F.filter(F.zip_with(others, F.coalesce("e.supplements", F.array().cast("array<struct<markdown string>>")), lambda s, t: F.struct(s["sha256"].alias("sha256"), s["fingerprint"]["text_sha256"].alias("text_sha256"), t["markdown"].alias("markdown"))), lambda x: x["sha256"].isNotNull() & x["markdown"].isNotNull())
    main = F.get(sources, F.lit(0))["fingerprint"]
    title, seen = F.col("d.fields.title.value"), F.col("d.observations.title")
    return read.select(
        F.lit(ROW_SCHEMA).alias("schema"),
        F.lit(ROW_VERSION).alias("schema_version"),
        F.lit(library_id).alias("library_id"),
        "directory",
        F.col("m.generation").alias("generation"),
        F.col("d.work_id").alias("work_id"),
        F.coalesce("d.document_version", F.lit("unknown")).alias("document_version"),
        F.col("d.identity.doi").alias("doi"),
        F.col("d.arxiv").alias("arxiv"),
        title.alias("title"),
        text.title_key(title).alias("title_key"),
        author_names(F.col("d.fields.authors.value")).alias("authors"),
        F.coalesce(lead["family"], lead["literal"]).alias("first_author_family"),
        F.col("d.fields.year.value").alias("year"),
        F.col("d.fields.journal.value").alias("venue"),
        F.col("d.identity.registry_record.abstract").alias("abstract"),
        F.nullif(F.trim(F.regexp_extract(F.substring_index(F.coalesce("bibtex", F.lit("")), "\n", 1), r"\{([^,]*)", 1)), F.lit("")).alias("citation_key"),
        seen.alias("title_observed"),
        text.title_key(seen).alias("title_key_observed"),
        observed("author").alias("authors_observed"),
        observed("identifier").alias("identifiers_observed"),
        F.coalesce(main["doi_candidates"], F.array().cast("array<string>")).alias("doi_candidates"),
        F.transform(sources, lambda s: s["sha256"]).alias("source_sha256"),
        pairs.alias("supplements"),
        main["text_sha256"].alias("text_sha256"),
        F.size(F.coalesce("doc.pages", F.array().cast("array<struct<number int>>"))).alias("page_count"),
        F.col("v.counts").alias("counts"),
        F.col("v.processing_status").alias("processing_status"),
        F.col("d.bibliographic_status").alias("bibliographic_status"),
        F.col("doc.backend").alias("backend"),
        F.col("doc.backend_version").alias("backend_version"),
        F.col("e.run_id").alias("run_id"),
        F.col("e.published_utc").alias("published_utc"),
    )


def display_order(rows: DataFrame, family: str, year: str, last: str) -> DataFrame:
    """Adds ``place``, from 1: by family (none: last), year and ``last``. Only counts by family and year are summed over all."""
    from pyspark.sql.window import Window

    keyed = rows.withColumns({"_f": F.coalesce(F.col(family), F.lit("~")), "_y": F.coalesce(F.col(year).cast("string"), F.lit(""))})
    counts = keyed.groupBy("_f", "_y").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_f", "_y").orderBy(last))
    return keyed.withColumn("_r", inside).join(starts, ["_f", "_y"]).withColumn("place", F.col("_start") + F.col("_r")).drop("_f", "_y", "_start", "_r")


def paper_states(records: DataFrame, problems: DataFrame) -> DataFrame:
    """(directory, state) of papers by their ``records`` (directory, state) and integrity ``problems`` (directory).

    damaged where a file is, else unsupported where a record's version isn't read, else outdated where one is older,
    else current.
    """
    found = records.groupBy("directory").agg(F.bool_or(F.col("state") == "unsupported").alias("u"), F.bool_or(F.col("state").isin("older", "outdated")).alias("o"))
    bad = problems.select("directory").distinct().withColumn("d", F.lit(True))
    state = F.when(F.col("d"), "damaged").when(F.col("u"), "unsupported").when(F.col("o"), "outdated").otherwise("current")
    return found.join(bad, "directory", "full").select("directory", state.alias("state"))


def catalog_state(lines: DataFrame, current: int = ROW_VERSION, oldest: int = ROW_VERSION) -> DataFrame:
    """One row: a catalog's state by its lines (value): absent, unreadable, unsupported, older or current."""
    row = F.from_json("value", "schema_version string, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    rows = lines.where(F.trim("value") != "").select(row.alias("r"))
    version = F.col("r.schema_version").try_cast("int")
    kinds = rows.select(F.col("r._broken").isNotNull().alias("broken"), (F.coalesce(version, F.lit(-1)).between(oldest, current)).alias("read"), (version < current).alias("old"))
    one = kinds.agg(F.count(F.lit(1)).alias("n"), F.bool_or("broken").alias("broken"), F.bool_or(~F.col("read")).alias("unsupported"), F.bool_or("old").alias("older"))
    return one.select(F.when(F.col("n") == 0, "absent").when(F.col("broken"), "unreadable").when(F.col("unsupported"), "unsupported").when(F.col("older"), "older").otherwise("current").alias("state"))


def command_result(items: DataFrame, group: str, strict: bool = False) -> DataFrame:
    """(group, summary, exit_code) of each command's ``items`` (group, status, warnings).

    summary counts the statuses. The code: 0 where all are done, 4 for a mix of done ones and problems, or for warnings
    where ``strict``; else 3 where every problem is a conflict, and 5 otherwise.
    """
    each = items.groupBy(group, "status").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("warnings") > 0).alias("warned"))
    done = F.col("status").isin(DONE)
    one = each.groupBy(group).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("summary"),
        F.bool_and(done).alias("all_done"),
        F.bool_or(done).alias("some_done"),
        F.bool_and(done | (F.col("status") == "conflict")).alias("only_conflicts"),
        F.bool_or("warned").alias("warned"),
    )
    code = F.when(F.col("all_done"), F.when(F.lit(strict) & F.coalesce("warned", F.lit(False)), PARTIAL).otherwise(OK)).when(F.col("some_done"), PARTIAL).when(F.col("only_conflicts"), CONFLICT).otherwise(FAILURE)
    return one.select(group, "summary", code.cast("int").alias("exit_code"))


def organize_plan(catalog: DataFrame, layout: str) -> DataFrame:
    """(old, new): moves that put every paper of a ``catalog`` where a layout wants it; those in place have none."""
    shard = ids.library_shard(layout, resolution.named(F.col("bibliographic_status")), F.col("year"), F.col("first_author_family"))
    name = F.substring_index("directory", "/", -1)
    new = F.when(shard == "", name).otherwise(F.concat_ws("/", shard, name))
    return catalog.select(F.col("directory").alias("old"), new.alias("new")).where("old <> new")


def name_conflicts(moves: DataFrame, catalog: DataFrame) -> DataFrame:
    """(new, old): moves whose goal another move, or a paper that stays, has too; none of them may be made."""
    stays = catalog.select(F.col("directory").alias("new")).join(moves.select(F.col("old").alias("new")), "new", "left_anti")
    taken = moves.groupBy("new").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("new").union(stays.join(moves.select("new"), "new", "left_semi")).distinct()
    return moves.join(taken, "new", "left_semi").select("new", "old")


def stale(index: DataFrame, catalog: DataFrame, version: int) -> DataFrame:
    """One row (stale, reason): whether an index's meta (catalog_sha256, schema_version) fits a catalog (line).

    The digest is made of sums, so no line is gathered anywhere; see ``catalog_digest``.
    """
    now = catalog_digest(catalog)
    both = now.join(index.select("catalog_sha256", "schema_version"), F.lit(True), "left")
    reason = F.when(F.col("catalog_sha256").isNull(), "no index").when(F.col("schema_version") != version, "another schema version").when(F.col("catalog_sha256") != F.col("sha256"), "the catalog has changed")
    return both.select(reason.isNotNull().alias("stale"), reason.alias("reason"))


def catalog_digest(catalog: DataFrame) -> DataFrame:
    """One row (sha256, n): a digest of a catalog's lines (line) that doesn't hang on their order.

    It is made of sums over four parts of the lines' digests, so that tasks add up their own lines first.
    """
    digest = F.sha2("line", 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    one = catalog.agg(F.count(F.lit(1)).alias("n"), *parts)
    return one.select(F.sha2(F.concat_ws(":", "n", *(F.coalesce(f"p{i}", F.lit(0)) for i in range(4))), 256).alias("sha256"), "n")
