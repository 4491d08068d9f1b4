"""Registry records, evidence, searches and decisions, made from the tables' columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import ids, text
from quire.operators import records, resolution
from quire.plans.registry import query
from quire.sources.shared import parts_of, spread
from quire.sources.tables import load


def _json(*members: tuple[str, str]) -> Column:
    """A JSON object of SQL expressions that give JSON."""
    return F.expr("concat('{', " + ", ',', ".join(f"'\"{name}\":', {value}" for name, value in members) + ", '}')")


def _work(key: str = "p_partkey") -> Column:
    """A works response made from ``part``: markup in the title, a whole name as a family name, a translation."""
    message = [
        ("DOI", f"concat('\"10.1000/P', {key}, '\"')"),
        ("title", "concat('[\"On <i>', p_name, '</i> &amp; more\"]')"),
        ("subtitle", "if(p_size % 2 = 0, '[\"Part two\"]', '[]')"),
        ("author", "concat('[{\"given\":\"Ada\",\"family\":\"', p_brand, '\"},{\"family\":\"D V Willetts\"},{\"name\":\"The Group\"}]')"),
        ("container-title", "concat('[\"', p_type, '\"]')"),
        ("volume", "concat('\"', p_size, '\"')"),
        ("page", f"concat('\"', {key}, '-', {key} + 9, '\"')"),
        ("issued", "concat('{\"date-parts\":[[', 1990 + p_size % 30, ',3]]}')"),
        ("ISSN", "'[\"\",\"1234-5678\"]'"),
        ("relation", f"concat('{{\"is-translation-of\":[{{\"id\":\"10.1000/Q', {key}, '\",\"id-type\":\"doi\"}},{{\"id\":\"x\",\"id-type\":\"uri\"}}]}}')"),
    ]
    return F.concat(F.lit('{"message":'), _json(*message), F.lit("}"))


@query(
    "crossref_records",
    """SELECT p_partkey, '10.1000/p' || p_partkey AS doi, 'On ' || p_name || ' & more' AS title, CASE WHEN p_size % 2 = 0 THEN 'Part two' END AS subtitle, 'Ada|' || p_brand || '|-;D V|Willetts|D V Willetts;-|-|The Group' AS authors,
        p_type AS container_title, p_size::VARCHAR AS volume, p_partkey || '-' || (p_partkey + 9) AS pages, 1990 + p_size % 30 AS year, '1234-5678' AS issn, 'is-translation-of 10.1000/q' || p_partkey AS relations FROM part""",
)
def crossref_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works made from ``part``, read into records."""
    rows = spread(load(spark, sf_dir, "part"), "p_partkey").select("p_partkey", records.parse_crossref(_work()).alias("r"))
    shown = lambda a: F.concat_ws("|", *(F.coalesce(a[c], F.lit("-")) for c in ("given", "family", "literal")))
    names = F.array_join(F.transform("r.authors", shown), ";")
    relations = F.array_join(F.transform("r.relations", lambda x: F.concat_ws(" ", x["kind"], x["doi"])), ";")
    return rows.select("p_partkey", "r.doi", "r.title", "r.subtitle", names.alias("authors"), "r.container_title", "r.volume", "r.pages", F.get("r.issued", F.lit(0)).alias("year"), F.array_join("r.issn", ";").alias("issn"), relations.alias("relations"))


def _entry(key: str) -> Column:
    attributes = [
        ("doi", f"concat('\"10.2000/C', {key}, '\"')"),
        ("titles", "concat('[{\"title\":\"', c_name, '\"}]')"),
        ("creators", "concat('[{\"givenName\":\"Bo\",\"familyName\":\"', c_mktsegment, '\",\"nameIdentifiers\":[{\"nameIdentifier\":\"0000-1\",\"nameIdentifierScheme\":\"orcid\"}]}]')"),
        ("publicationYear", "1990 + c_nationkey"),
        ("types", "'{\"resourceTypeGeneral\":\"Text\"}'"),
        ("descriptions", "concat('[{\"description\":\"x\",\"descriptionType\":\"Other\"},{\"description\":\"About ', c_name, '\",\"descriptionType\":\"Abstract\"}]')"),
    ]
    return F.concat(F.lit('{"data":{"attributes":'), _json(*attributes), F.lit("}}"))


@query("datacite_records", "SELECT c_custkey, '10.2000/c' || c_custkey AS doi, 'Text' AS type, c_name AS title, 'Bo ' || c_mktsegment || ' 0000-1' AS author, 1990 + c_nationkey AS year, 'About ' || c_name AS abstract FROM customer")
def datacite_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries made from ``customer``, read into records."""
    rows = spread(load(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", records.parse_datacite(_entry("c_custkey")).alias("r"))
    lead = F.get("r.authors", F.lit(0))
    return rows.select("c_custkey", "r.doi", "r.type", "r.title", F.concat_ws(" ", lead["given"], lead["family"], lead["orcid"]).alias("author"), F.get("r.issued", F.lit(0)).alias("year"), "r.abstract")


@query(
    "registry_lookup",
    """SELECT p_partkey AS key, CASE p_partkey % 6 WHEN 5 THEN 'no doi' ELSE '10.1000/p' || p_partkey END AS doi, CASE p_partkey % 6 WHEN 0 THEN 'found' WHEN 1 THEN 'found' WHEN 2 THEN 'not_found' WHEN 3 THEN 'unavailable' WHEN 4 THEN 'malformed' ELSE 'malformed' END AS outcome,
        CASE p_partkey % 6 WHEN 0 THEN 'crossref' WHEN 1 THEN 'datacite' END AS provider FROM part""",
)
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' DOIs looked up in stored responses: with Crossref, with DataCite behind it, with neither, with no answer, with a broken one, and no DOI."""
    part = spread(load(spark, sf_dir, "part"), "p_partkey")
    kind = F.col("p_partkey") % 6
    wanted = part.select(F.col("p_partkey").alias("key"), F.when(kind == 5, "no doi").otherwise(F.concat(F.lit("https://doi.org/10.1000/P"), "p_partkey")).alias("doi"))
    doi = F.concat(F.lit("10.1000/p"), "p_partkey")
    crossref = part.where(kind.isin(0, 1, 2, 4)).select(F.lit("crossref").alias("provider"), doi.alias("doi"), F.when(kind.isin(0, 4), 200).otherwise(404).alias("status"), F.when(kind == 0, _work()).when(kind == 4, F.lit('{"message":{}}')).alias("body"))
    entry = F.concat(F.lit('{"data":{"attributes":{"doi":"10.1000/p'), "p_partkey", F.lit('"}}}'))
    datacite = part.where(kind.isin(1, 2)).select(F.lit("datacite").alias("provider"), doi.alias("doi"), F.when(kind == 1, 200).otherwise(404).alias("status"), F.when(kind == 1, entry).alias("body"))
    return records.lookup(wanted, crossref.unionByName(datacite)).select("key", "doi", "outcome", F.col("record.provider").alias("provider"))


@query("missing_responses", "SELECT DISTINCT 'u' || o_custkey AS url FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def missing_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made from ``orders`` that no response, stored for customers of some nations, answers."""
    urls = load(spark, sf_dir, "orders").select(F.concat(F.lit("u"), "o_custkey").alias("url"))
    return records.missing_responses(urls, load(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.concat(F.lit("u"), "c_custkey").alias("url")))


@query("search_answers", "SELECT o_orderkey AS doc, i - 1 AS place, '10.1000/' || o_orderkey || '-' || i AS doi FROM (SELECT o_orderkey, unnest(range(1, least(10, 1 + o_orderkey % 13) + 1)) AS i FROM orders) WHERE i <> 3")
def search_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten works, one of them without a DOI, of answers made from ``orders``."""
    orders = load(spark, sf_dir, "orders")
    parts = parts_of(orders, 4)  # answers are wide
    orders = orders.select(F.col("o_orderkey").alias("doc"), F.lit(0).alias("ordinal"), F.concat(F.lit("q"), "o_orderkey").alias("query")).repartition(parts, "query")
    works = F.expr("to_json(transform(sequence(1, cast(1 + doc % 13 as int)), i -> named_struct('DOI', if(i = 3, 'none', concat('10.1000/', doc, '-', i)))))")
    answers = orders.select("query", F.lit(200).alias("status"), F.concat(F.lit('{"message":{"items":'), works, F.lit("}}")).alias("body"))
    return records.search_hits(orders, answers).select("doc", "place", F.col("record.doi").alias("doi"))


@query(
    "doi_evidence",
    """
    WITH e AS (SELECT p_partkey AS doc, '10.1000/a' || p_partkey AS doi, 'pdf_information,page_1_text' AS sources, true AS strong, 1 AS place FROM part WHERE p_partkey % 3 = 0
      UNION ALL SELECT p_partkey, '10.1016/1234-5678(81)12345-6', 'pdf_information_pii', false, 2 FROM part WHERE p_partkey % 2 = 0
      UNION ALL SELECT p_partkey, '10.1007/bf' || lpad((p_partkey % 100000000)::VARCHAR, 8, '0'), 'file_name', false, 3 FROM part
      UNION ALL SELECT p_partkey, '10.48550/arxiv.2101.' || lpad((p_partkey % 100000)::VARCHAR, 5, '0'), 'arxiv_identifier', false, 4 FROM part)
    SELECT doc, doi, sources, strong, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN strong THEN 0 ELSE 1 END, place) AS rank FROM e
    """,
)
def doi_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOI candidates of documents made from ``part``: information, file name, arXiv identifier and first page."""
    part = load(spark, sf_dir, "part").withColumnRenamed("p_partkey", "doc")
    row = lambda source, value: part.select("doc", F.lit(source).alias("source"), F.lit(1).alias("seq"), F.expr(value).alias("value")).where("value is not null")
    evidence = row("pdf_information", "nullif(concat(if(doc % 3 = 0, concat('doi:10.1000/A', doc, '. '), ''), if(doc % 2 = 0, 'PII: S1234-5678(81) 12345-6', '')), '')")
    evidence = evidence.unionByName(row("file_name", "concat('bf', lpad(cast(doc % 100000000 as string), 8, '0'), '-2.pdf')")).unionByName(row("arxiv_identifier", "concat('2101.', lpad(cast(doc % 100000 as string), 5, '0'), 'v2')"))
    evidence = evidence.unionByName(row("page_1_text", "if(doc % 3 = 0, concat('See https://doi.org/10.1000/a', doc, ', please.'), null)"))
    return resolution.collect_candidates(evidence).select("doc", "doi", F.array_join("sources", ",").alias("sources"), "strong", "rank")


@query(
    "resolved_candidates",
    """
    WITH c AS (SELECT o_orderkey AS doc, i AS rank, i = 3 AND o_orderkey % 2 = 0 OR i = 5 AS fits, i <> 2 AS known FROM orders, range(1, 6) r(i)),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN fits THEN 0 ELSE 1 END, rank) AS place FROM c)
    SELECT doc, '10.1000/' || doc || '-' || rank AS doi, place, CASE WHEN place = 1 THEN 'accepted' ELSE 'after_accepted' END AS outcome FROM o
    """,
)
def resolved_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six candidates a document made from ``orders``: the sixth is beyond the limit, the second isn't registered, the fifth, and of even ones the third, has the title."""
    orders = load(spark, sf_dir, "orders")
    docs = orders.select(F.col("o_orderkey").alias("doc")).repartition(parts_of(orders, 6), "doc")  # before they grow
    each = docs.select("doc", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rank")).withColumn("doi", F.concat_ws("-", F.concat(F.lit("10.1000/"), "doc"), "rank"))
    fits = F.expr("rank in (5, 6) or (rank = 3 and doc % 2 = 0)")
    registered = each.where("rank <> 2").select("doi", F.when(fits, F.concat(F.lit("The order of number "), "doc")).otherwise("Something else altogether").alias("title"))
    return resolution.resolve(each, registered, docs.select("doc", F.concat(F.lit("Order of Number "), "doc").alias("title")))


@query(
    "search_texts",
    """SELECT c_custkey AS doc, q.ordinal, q.query FROM customer, LATERAL (SELECT unnest([{'ordinal': 0, 'query': 'On ' || c_name}, {'ordinal': 1, 'query': 'Second title'}, {'ordinal': 2, 'query': 'On ' || c_name || ' by ' || c_mktsegment || ' light waves ' || c_custkey}]) AS q)""",
)
def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of documents made from ``customer``: two titles, and the first with its author line and a file name's words."""
    rows = load(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "doc")
    titles = rows.select("doc", F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.concat(F.lit("On <b>"), "c_name", F.lit("</b>*")).alias("title")), F.struct(F.lit(2).alias("rank"), F.lit("Second title").alias("title")))).alias("t")).select("doc", "t.*")
    name = resolution.file_hint(F.concat(F.lit("/in/light_waves_online_"), "doc", F.lit(".pdf")))
    hints = rows.select("doc", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.concat(F.lit("by "), "c_mktsegment").alias("hint")), F.struct(F.lit(2).alias("seq"), name.alias("hint")))).alias("h")).select("doc", "h.*")
    return resolution.search_queries(titles, hints)


@query(
    "corroborated_hits",
    "SELECT p_partkey AS doc, '10.1000/' || p_partkey AS doi, CASE WHEN p_partkey % 4 = 1 THEN 'fail' ELSE 'pass' END AS title_check, CASE WHEN p_partkey % 4 = 2 THEN 'fail' ELSE 'pass' END AS author_check, CASE WHEN p_partkey % 4 = 3 THEN 'fail' ELSE 'pass' END AS year_check, p_partkey % 4 = 0 AS accepted FROM part",
)
def corroborated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits made from ``part`` against their documents' titles and first pages; three in four fail one check."""
    part = spread(load(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("doc"), "p_name", (F.col("p_partkey") % 4).alias("k"))
    titles = part.select("doc", F.concat(F.lit("On the "), "p_name", F.lit(" of number "), "doc").alias("title"))
    hits = part.select("doc", F.concat(F.lit("10.1000/"), "doc").alias("doi"), F.when(F.col("k") == 1, "Unlike anything").otherwise(F.concat(F.lit("<i>On</i> the "), "p_name")).alias("title"), F.concat(F.lit("of number "), "doc").alias("subtitle"), F.lit("Müller").alias("family"), F.array(F.lit(1999), F.lit(2000)).alias("years"))
    pages = part.select("doc", F.concat(F.when(F.col("k") == 2, "S. Mullerson").otherwise("S. Muller1"), F.lit(", published "), F.when(F.col("k") == 3, 1998).otherwise(2000)).alias("page_text"))
    return resolution.corroborate(hits, titles, pages).select("doc", "doi", "title_check", "author_check", "year_check", "accepted")


@query(
    "chosen_hits",
    """
    WITH h AS (SELECT o_orderkey AS doc, i, o_orderkey % 4 AS k FROM orders, range(1, 5) r(i))
    SELECT doc, '10.1000/' || doc || '-' || i AS doi, CASE WHEN i = 1 THEN 'search_component' WHEN i = 2 THEN 'translation_original' WHEN k = 0 THEN CASE i WHEN 3 THEN 'accepted' ELSE 'search_not_cited' END
        WHEN k = 1 THEN CASE i WHEN 4 THEN 'accepted' ELSE 'search_not_cited' END ELSE 'search_ambiguous' END AS outcome FROM h
    """,
)
def chosen_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four accepted hits a document made from ``orders``: a component, an original and its translation, and one more; pages or file names cite one of the last two."""
    docs = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") % 4).alias("k"))
    doi = lambda n: F.concat(F.lit("10.1000/"), "doc", F.lit(f"-{n}"))
    relation = lambda *pairs: F.array(*(F.struct(F.lit(k).alias("kind"), d.alias("doi")) for k, d in pairs)) if pairs else F.array().cast("array<struct<kind string, doi string>>")
    hit = lambda n, kind, relations, page: docs.select("doc", doi(n).alias("doi"), F.lit(kind).alias("type"), relations.alias("relations"), F.lit("53").alias("volume"), F.lit(page).alias("pages"), F.lit(None).cast("string").alias("article_number"))
    hits = hit(1, "component", relation(), "1").unionByName(hit(2, "journal-article", relation(), "185-9")).unionByName(hit(3, "journal-article", relation(("is-translation-of", doi(2)), ("cites", doi(4))), "185-9")).unionByName(hit(4, "journal-article", relation(), "E7"))
    words = lambda value: F.split(value, " ")
    tokens = docs.select("doc", words(F.expr("case k when 0 then 'vol 53 185' when 1 then 'vol 53 185 e7' else 'vol 53' end")).alias("page_words"), words(F.expr("if(k = 1, '53 e7', '53')")).alias("file_words"))
    return resolution.choose(hits, tokens)


@query(
    "supplement_demotion",
    """SELECT c_custkey AS doc, CASE WHEN c_nationkey % 3 = 2 THEN 'UNVERIFIED' WHEN c_custkey % 4 IN (0, 1) THEN 'UNVERIFIED' ELSE 'VALIDATED' END AS status,
        CASE WHEN c_nationkey % 3 < 2 AND c_custkey % 4 IN (0, 1) THEN NULL ELSE '10.1000/' || c_custkey END AS doi, CASE WHEN c_nationkey % 3 < 2 AND c_custkey % 4 IN (0, 1) THEN '10.1000/' || c_custkey END AS supplement_of FROM customer""",
)
def supplement_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities made from ``customer``; a quarter has a supplement's title, a quarter a supplement's file name."""
    rows = load(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "doc")
    identities = rows.select("doc", F.expr("if(c_nationkey % 3 = 2, 'UNVERIFIED', 'VALIDATED')").alias("status"), F.concat(F.lit("10.1000/"), "doc").alias("doi"))
    titles = rows.select("doc", F.expr("if(doc % 4 = 0, 'Supplementary Materials for light', 'On supplementary materials')").alias("title"))
    return resolution.demote_supplements(identities, titles, rows.select("doc", F.expr("if(doc % 4 = 1, 'abb_sm.pdf', 'abb.pdf')").alias("name")))


@query(
    "asserted_identities",
    """SELECT c_custkey AS doc, CASE c_custkey % 4 WHEN 0 THEN 'VALIDATED' WHEN 1 THEN 'ASSERTED' WHEN 2 THEN 'ASSERTED' ELSE 'VALIDATED' END AS status, CASE c_custkey % 4 WHEN 1 THEN '10.1000/other' ELSE '10.1000/' || c_custkey END AS doi FROM customer""",
)
def asserted_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities made from ``customer`` with what users say: the same DOI, another one, an entry, or nothing."""
    rows = load(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "doc")
    identities = rows.select("doc", F.lit("VALIDATED").alias("status"), F.concat(F.lit("10.1000/"), "doc").alias("doi"))
    said = rows.where("doc % 4 < 3").select("doc", F.expr("case doc % 4 when 0 then concat('doi:10.1000/', doc) when 1 then '10.1000/OTHER' end").alias("asserted_doi"), F.expr("if(doc % 4 = 2, '@article{x, title={y}}', null)").alias("bibtex"))
    return resolution.asserted(identities, said)


@query("identity_states", "SELECT o_orderkey, o_orderkey % 4 < 2 AS validated, o_orderkey % 4 < 3 AS named, o_orderkey % 3 = 0 AS strong FROM orders")
def identity_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates of states and candidates made from ``orders``."""
    status = F.expr("case o_orderkey % 4 when 0 then 'VALIDATED' when 1 then 'VALIDATED_WITH_WARNINGS' when 2 then 'ASSERTED' end")
    sources = F.expr("array('file_name', if(o_orderkey % 3 = 0, 'page_1_furniture', 'page_1_text'))")
    return load(spark, sf_dir, "orders").select("o_orderkey", resolution.validated(status).alias("validated"), resolution.named(status).alias("named"), resolution.strong(sources).alias("strong"))


@query("bibtex_names", "SELECT s_suppkey, 'A. B. Smith; ' || 'Jo van ' || upper('d') || s_nationkey || '; -' || ' Group' || s_suppkey AS authors FROM supplier")
def bibtex_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author fields made from ``supplier``: family first, given first, and a single word."""
    field = F.concat(F.lit("Smith, A. B. and Jo van D"), "s_nationkey", F.lit(" and  Group"), "s_suppkey")
    shown = F.transform(ids.bibtex_authors(field), lambda p: F.concat_ws(" ", F.coalesce(p["given"], F.lit("-")), p["family"]))
    return load(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(shown, "; ").alias("authors"))


@query("utc_times", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T14:05Z' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 14:05:06' END AS given FROM orders")
def utc_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times made from ``orders``: a date, two times, and an impossible day, another offset and a word, which are none."""
    made = F.expr("concat(case when o_orderkey % 6 < 3 then date_format(o_orderdate, 'yyyy-MM-dd') when o_orderkey % 6 = 3 then '2021-02-30' when o_orderkey % 6 = 4 then '2021-02-03T10:00+02:00' else 'today' end, case o_orderkey % 6 when 1 then 'T14:05Z' when 2 then ' 14:05:06' else '' end)")
    return load(spark, sf_dir, "orders").select("o_orderkey", ids.utc_time(made).alias("given"))


@query("label_places", "SELECT label, row_number() OVER (ORDER BY length(label), label) AS place FROM (SELECT DISTINCT 'S' || p_size AS label FROM part UNION SELECT DISTINCT p_size::VARCHAR FROM part)")
def label_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels made from ``part``'s sizes in the order in which people sort them; there are as many as sizes."""
    from pyspark.sql.window import Window

    sizes = load(spark, sf_dir, "part").select("p_size").distinct()
    labels = sizes.select(F.concat(F.lit("S"), "p_size").alias("label")).union(sizes.select(F.col("p_size").cast("string"))).distinct()
    return labels.select("label", F.row_number().over(Window.orderBy(*ids.label_order(F.col("label")))).alias("place"))


@query("clean_titles", "SELECT p_partkey, p_name || ' of α-H2' || p_size || ' & ' || p_brand AS title, 'α' || p_size AS math FROM part")
def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with tags, entities, Greek names, TeX and footnote marks made from ``part``."""
    title = F.concat(F.lit("<b>"), "p_name", F.lit("</b>  of [alpha]-\\mathrm{H}_{2}"), "p_size", F.lit(" &#38; "), "p_brand", F.lit(" *†"))
    return load(spark, sf_dir, "part").select("p_partkey", text.clean_title(title).alias("title"), text.math_as_text(F.concat(F.lit("\\alpha _{"), "p_size", F.lit("}"))).alias("math"))
