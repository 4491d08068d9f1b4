"""Registry records from stored responses: Crossref works, DataCite entries, lookups and searches without a network."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import ids, text

# The members that are read of a provider's JSON.
_PERSON = "struct<given string, family string, name string, ORCID string, sequence string>"
_DATE = "struct<`date-parts` array<array<int>>>"
WORK = (
    f"struct<DOI string, type string, title array<string>, subtitle array<string>, author array<{_PERSON}>, editor array<{_PERSON}>, `container-title` array<string>, publisher string, volume string, issue string, "
    f"page string, `article-number` string, issued {_DATE}, `published-print` {_DATE}, `published-online` {_DATE}, URL string, ISSN array<string>, license array<struct<URL string>>, abstract string, "
    "relation map<string, array<struct<id string, `id-type` string>>>>"
)
ENTRY = (
    "struct<doi string, titles array<struct<title string>>, creators array<struct<givenName string, familyName string, name string, nameIdentifiers array<struct<nameIdentifier string, nameIdentifierScheme string>>>>, "
    "publicationYear int, types struct<resourceTypeGeneral string>, container struct<title string, volume string, issue string>, publisher string, url string, "
    "descriptions array<struct<description string, descriptionType string>>, rightsList array<struct<rightsUri string>>>"
)
#: Hits of a search that are read, and the statuses that settle a lookup.
SEARCH_ROWS, FOUND, UNKNOWN = 10, 200, 404


def plain(value: Column) -> Column:
    """A provider's text without tags and entities, single-spaced; null where nothing is left. Formulas are words of their own."""
    apart = F.regexp_replace(F.regexp_replace(value, r"<(?:mml:)?math\b", " $0"), r"</(?:mml:)?math>", "$0 ")
    bare = text.squash(text.unescaped(F.regexp_replace(apart, r"<[^>]+>", "")))
    return text.once(bare, lambda b: F.nullif(b, F.lit("")))


def first(values: Column) -> Column:
    """An array's first element; null of an empty one."""
    return F.get(values, F.lit(0))


def strings(values: Column) -> Column:
    """An array's elements that hold something."""
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def author(given: Column, family: Column, literal: Column, orcid: Column, sequence: Column) -> Column:
    """A name of five parts. A whole name that was delivered as the family name is split, and kept as the literal one."""

    def named(p: Column) -> Column:
        parts = F.when(p["given"].isNull() & p["literal"].isNull(), ids.split_name(p["family"]))
        return text.once(
            parts,
            lambda s: F.struct(
                F.coalesce(s["given"], p["given"]).alias("given"),
                F.coalesce(s["family"], p["family"]).alias("family"),
                F.when(s.isNotNull(), p["family"]).otherwise(p["literal"]).alias("literal"),
                p["orcid"].alias("orcid"),
                p["sequence"].alias("sequence"),
            ),
        )

    return text.once(F.struct(given.alias("given"), family.alias("family"), literal.alias("literal"), orcid.alias("orcid"), sequence.alias("sequence")), named)


def _people(values: Column) -> Column:
    each = lambda p: author(plain(p["given"]), plain(p["family"]), plain(p["name"]), plain(p["ORCID"]), plain(p["sequence"]))
    return F.transform(F.coalesce(values, F.array().cast(f"array<{_PERSON}>")), each)


def _date(value: Column) -> Column:
    return F.coalesce(first(value["date-parts"]), F.array().cast("array<int>"))


def _relations(value: Column, doi: Callable[[Column], Column]) -> Column:
    each = lambda e: F.transform(F.filter(e["value"], lambda t: t["id-type"] == "doi"), lambda t: F.struct(e["key"].alias("kind"), doi(t["id"]).alias("doi")))
    return F.filter(F.flatten(F.transform(F.map_entries(F.coalesce(value, F.create_map().cast("map<string, array<struct<id string, `id-type` string>>>"))), each)), lambda r: r["doi"].isNotNull())


def work(w: Column, doi: Callable[[Column], Column] = ids.normalize_doi) -> Column:
    """The record of a Crossref work; its doi is null where the work has none."""
    return F.struct(
        F.lit("crossref").alias("provider"),
        doi(w["DOI"]).alias("doi"),
        F.coalesce(plain(w["type"]), F.lit("unknown")).alias("type"),
        plain(first(w["title"])).alias("title"),
        plain(first(w["subtitle"])).alias("subtitle"),
        _people(w["author"]).alias("authors"),
        _people(w["editor"]).alias("editors"),
        plain(first(w["container-title"])).alias("container_title"),
        plain(w["publisher"]).alias("publisher"),
        plain(w["volume"]).alias("volume"),
        plain(w["issue"]).alias("issue"),
        plain(w["page"]).alias("pages"),
        plain(w["article-number"]).alias("article_number"),
        _date(w["issued"]).alias("issued"),
        _date(w["published-print"]).alias("published_print"),
        _date(w["published-online"]).alias("published_online"),
        plain(w["URL"]).alias("url"),
        strings(w["ISSN"]).alias("issn"),
        strings(F.transform(F.coalesce(w["license"], F.array().cast("array<struct<URL string>>")), lambda x: plain(x["URL"]))).alias("license_urls"),
        plain(w["abstract"]).alias("abstract"),
        _relations(w["relation"], doi).alias("relations"),
    )


def entry(a: Column) -> Column:
    """The record of a DataCite entry's attributes, in the shape of ``work``."""
    none, no_one, no_date = F.lit(None).cast("string"), F.array().cast("array<struct<given string, family string, literal string, orcid string, sequence string>>"), F.array().cast("array<int>")
    orcid = lambda c: first(F.filter(c["nameIdentifiers"], lambda i: F.upper(i["nameIdentifierScheme"]) == "ORCID"))["nameIdentifier"]
    person = lambda c: author(plain(c["givenName"]), plain(c["familyName"]), plain(c["name"]), plain(orcid(c)), none)
    people = F.when(a["creators"].isNotNull(), F.transform(a["creators"], person)).otherwise(no_one)
    said = first(F.filter(a["descriptions"], lambda d: d["descriptionType"] == "Abstract"))["description"]
    return F.struct(
        F.lit("datacite").alias("provider"),
        ids.doi_once(a["doi"]).alias("doi"),
        F.coalesce(plain(a["types"]["resourceTypeGeneral"]), F.lit("unknown")).alias("type"),
        plain(first(a["titles"])["title"]).alias("title"),
        none.alias("subtitle"),
        people.alias("authors"),
        no_one.alias("editors"),
        plain(a["container"]["title"]).alias("container_title"),
        plain(a["publisher"]).alias("publisher"),
        plain(a["container"]["volume"]).alias("volume"),
        plain(a["container"]["issue"]).alias("issue"),
        none.alias("pages"),
        none.alias("article_number"),
        F.when(a["publicationYear"].isNotNull(), F.array(a["publicationYear"])).otherwise(no_date).alias("issued"),
        no_date.alias("published_print"),
        no_date.alias("published_online"),
        plain(a["url"]).alias("url"),
        F.array().cast("array<string>").alias("issn"),
        strings(F.transform(F.coalesce(a["rightsList"], F.array().cast("array<struct<rightsUri string>>")), lambda x: plain(x["rightsUri"]))).alias("license_urls"),
        plain(said).alias("abstract"),
        F.array().cast("array<struct<kind string, doi string>>").alias("relations"),
    )


def parse_crossref(body: Column) -> Column:
    """The record of a works response's JSON."""
    return text.once(F.from_json(body, f"message {WORK}")["message"], lambda w: work(w, ids.doi_once))


def parse_datacite(body: Column) -> Column:
    """The record of a DOI response's JSON."""
    return text.once(F.from_json(body, f"data struct<attributes {ENTRY}>")["data"]["attributes"], entry)


def lookup(wanted: DataFrame, responses: DataFrame) -> DataFrame:
    """(key, doi, outcome, record) for each row of ``wanted`` (key, doi).

    ``responses``: what was stored (provider, doi, status, body), one a provider and DOI. Crossref goes first; where it
    doesn't know the DOI or didn't answer, DataCite's answer counts. outcome: found, malformed (no DOI, or an answer
    that is no record), unavailable (no answer stored, or a failed one, and no record) or not_found (neither knows it).
    """
    known = responses.where(F.col("doi").isNotNull()).select("provider", F.lower("doi").alias("_doi"), "status", "body")
    side = lambda provider: known.where(F.col("provider") == provider).select("_doi", F.struct("status", "body").alias(f"_{provider}"))
    rows = wanted.select("key", F.col("doi").alias("_given"), ids.normalize_doi(F.col("doi")).alias("_doi")).join(side("crossref"), "_doi", "left").join(side("datacite"), "_doi", "left")
    status = lambda provider: F.coalesce(F.col(f"_{provider}.status"), F.lit(0))
    record = F.when(status("crossref") == FOUND, parse_crossref(F.col("_crossref.body"))).when(status("datacite") == FOUND, parse_datacite(F.col("_datacite.body")))
    rows = rows.withColumn("record", record)
    answered = (status("crossref") == FOUND) | (status("datacite") == FOUND)
    failed = ~status("crossref").isin(FOUND, UNKNOWN) | ~status("datacite").isin(FOUND, UNKNOWN)
    outcome = F.when(F.col("_doi").isNull() | (answered & F.col("record.doi").isNull()), "malformed").when(answered, "found").when(failed, "unavailable").otherwise("not_found")
    return rows.select("key", F.coalesce("_doi", "_given").alias("doi"), outcome.alias("outcome"), F.when(outcome == "found", F.col("record")).alias("record"))


def missing_responses(urls: DataFrame, responses: DataFrame) -> DataFrame:
    """The ``urls`` (url) that no stored response answers; each once. Offline, these are what can't be looked up."""
    return urls.select("url").distinct().join(responses.select("url"), "url", "left_anti")


def search_hits(queries: DataFrame, responses: DataFrame) -> DataFrame:
    """(doc, ordinal, place, record) of the stored answers (query, status, body) to ``queries`` (doc, ordinal, query).

    The first ten works of an answer count, in its order; works without a DOI are passed over. Answers are joined as they are
    stored and read behind the join: works are many times as large, and would be sorted for it.
    """
    items = F.slice(F.from_json("body", f"message struct<items array<{WORK}>>")["message"]["items"], 1, SEARCH_ROWS)
    hits = queries.join(responses.where(F.col("status") == FOUND).select("query", "body"), "query").select("doc", "ordinal", F.posexplode(items).alias("place", "_w"))
    return hits.select("doc", "ordinal", "place", work(F.col("_w")).alias("record")).where("record.doi is not null")


def flatten(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value, status): a record's fields as rows, REGISTRY or, for null ones, MISSING."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    rows = records.select(key, F.explode(pairs).alias("_f")).select(key, "_f.field", "_f.value")
    return rows.withColumn("status", F.when(F.col("value").isNull(), "MISSING").otherwise("REGISTRY"))
