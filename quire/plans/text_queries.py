"""Normalisation, identifiers, labels and validators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import ids, text
from quire.operators import bibtex, export, identity, records, validate
from quire.plans import sql
from quire.plans.registry import query
from quire.sources.tables import load


@query("text_digest", f"SELECT doc_id, length({sql.squash('text')}) AS characters, sha256({sql.squash('text')}) AS text_sha256 FROM documents")
def text_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's normalised length and digest."""
    norm = text.normalized(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.length(norm).alias("characters"), F.sha2(norm, 256).alias("text_sha256"))


@query("title_key", f"SELECT doc_id, {sql.title_key(sql.FIRST_LINE)} AS title_key FROM documents")
def title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title keys of first lines."""
    return load(spark, sf_dir, "documents").select("doc_id", text.title_key(text.first_line(F.col("text"))).alias("title_key"))


@query("title_key_groups", f"SELECT title_key, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, {sql.title_key(sql.FIRST_LINE)} AS title_key FROM documents) WHERE title_key <> '' GROUP BY title_key HAVING count(*) > 1")
def title_key_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title keys that several documents share."""
    return title_key(spark, sf_dir).where("title_key <> ''").groupBy("title_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("words_count", f"SELECT doc_id, len({sql.words('text')}) AS n, len(list_distinct({sql.words('text')})) AS n_distinct FROM documents")
def words_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded words of each document."""
    w = load(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("n_distinct"))


@query("ascii_fold_lines", f"SELECT doc_id, regexp_replace(strip_accents(replace({sql.FIRST_LINE}, 'ß', 'ss')), '[^\\x00-\\x7F]', '', 'g') AS folded FROM documents")
def ascii_fold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines in ASCII."""
    return load(spark, sf_dir, "documents").select("doc_id", text.ascii_fold(text.first_line(F.col("text"))).alias("folded"))


@query("stable_shards", "SELECT o_orderkey, list_reduce(list_prepend(0, list_transform(string_split(sha256(o_orderkey::VARCHAR), ''), lambda c: ('0x' || c)::INTEGER)), lambda a, d: (a * 16 + d) % 7) AS shard FROM orders")
def stable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders dealt to seven shards by digest."""
    return load(spark, sf_dir, "orders").select("o_orderkey", ids.stable_shard(F.col("o_orderkey").cast("string"), 7).alias("shard"))


_DOIS = "'See https://doi.org/10.' || (1000 + p_partkey % 100000000) || '/' || upper(replace(p_name, ' ', '.')) || '.' || p_size || '), also 10.1000/' || p_partkey || '; arXiv:2101.' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') || 'v2 and 10.1000/' || p_partkey || '.'"


@query(
    "doi_candidates",
    f"""
    WITH t AS (SELECT p_partkey, {_DOIS} AS text FROM part),
    d AS (SELECT p_partkey, text, list_transform(regexp_extract_all(text, '10\\.\\d{{4,9}}/[^\\s"<>]+'), lambda x: regexp_replace(x, '[.,;:)\\]}}''"]+$', '')) AS found FROM t)
    SELECT p_partkey, array_to_string(list_filter(found, lambda x, i: list_position(list_transform(found, lambda y: lower(y)), lower(x)) = i), ' ') AS dois, regexp_extract(text, '(?i)arXiv:\\s*(\\d{{4}}\\.\\d{{4,5}}(?:v\\d+)?)', 1) AS arxiv,
        lower(regexp_replace(regexp_extract(text, '(?i)arXiv:\\s*(\\d{{4}}\\.\\d{{4,5}}(?:v\\d+)?)', 1), 'v\\d+$', '')) AS base FROM d
    """,
)
def doi_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in sentences made from ``part``."""
    made = "concat('See https://doi.org/10.', 1000 + p_partkey % 100000000, '/', upper(replace(p_name, ' ', '.')), '.', p_size, '), also 10.1000/', p_partkey, '; arXiv:2101.', lpad(cast(p_partkey % 100000 as string), 5, '0'), 'v2 and 10.1000/', p_partkey, '.')"
    rows = load(spark, sf_dir, "part").select("p_partkey", F.expr(made).alias("text"))
    arxiv = F.get(ids.arxiv_candidates(F.col("text")), F.lit(0))
    return rows.select("p_partkey", F.array_join(ids.doi_candidates(F.col("text")), " ").alias("dois"), arxiv.alias("arxiv"), ids.arxiv_base(arxiv).alias("base"))


@query("normalized_dois", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE '10.' || (1000 + o_custkey % 100000000) || '/' || lower(replace(o_orderpriority, ' ', '_')) END AS doi FROM orders")
def normalized_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOIs with prefixes, capitals and stray punctuation made from ``orders``, normalised; a third are none."""
    body = "1000 + o_custkey % 100000000, '/', replace(o_orderpriority, ' ', '_')"
    made = F.expr(f"case o_orderkey % 3 when 0 then concat(' https://doi.org/10.', {body}, ').') when 1 then concat('DOI: 10.', {body}, ',') else concat('11.', o_custkey, '/x') end")
    return load(spark, sf_dir, "orders").select("o_orderkey", ids.normalize_doi(made).alias("doi"))


@query("plausible_titles", f"SELECT doc_id, length(regexp_replace({sql.FIRST_LINE}, '[^\\p{{L}}]', '', 'g')) >= 3 AND NOT regexp_matches({sql.FIRST_LINE}, '(?i)\\.(?:pdf|docx?|tex|dvi|indd|qxd)\\b|^microsoft word|^untitled|^doi:|^10\\.\\d{{4}}|^arxiv:') AS plausible FROM documents")
def plausible_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether first lines could be titles."""
    return load(spark, sf_dir, "documents").select("doc_id", text.plausible_title(text.first_line(F.col("text"))).alias("plausible"))


@query("supplement_names", "SELECT l_orderkey, l_linenumber, l_linenumber IN (1, 2) AS supplement FROM lineitem")
def supplement_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names made from ``lineitem``: supplements by token and by prefix, and words that only contain one."""
    name = F.expr("concat('/data/paper', l_orderkey, case l_linenumber when 1 then '_SI.pdf' when 2 then '-Supplementary-1.pdf' when 3 then '_simple.pdf' when 4 then '.pdf' else '_msm.x.pdf' end)")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ids.supplement_name(name).alias("supplement"))


@query("filename_dois", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '10.1103/physreva.' || (o_orderkey % 90) || '.' || o_custkey WHEN 1 THEN '10.1364/ao.' || (o_orderkey % 90) || '.' || lpad((o_custkey % 1000000)::VARCHAR, 6, '0') WHEN 2 THEN '10.48550/arxiv.2101.' || lpad((o_custkey % 100000)::VARCHAR, 5, '0') ELSE '' END AS dois FROM orders")
def filename_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOIs of publishers' file names made from ``orders``."""
    name = F.expr("case o_orderkey % 4 when 0 then concat('PhysRevA.', o_orderkey % 90, '.', o_custkey, '.pdf') when 1 then concat('ao-', o_orderkey % 90, '-3-', o_custkey % 1000000, '.PDF') when 2 then concat('2101.', lpad(cast(o_custkey % 100000 as string), 5, '0'), 'v3.pdf') else concat('scan ', o_custkey, '.pdf') end")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.array_join(ids.filename_dois(name), " ").alias("dois"))


@query(
    "object_labels",
    f"""SELECT l_orderkey, l_linenumber, {sql.label(sql.captions("l_suppkey"), ids.FIGURE_LABEL)} AS figure, {sql.label(sql.captions("l_suppkey"), ids.TABLE_LABEL)} AS "table",
        CASE WHEN l_linenumber > 1 THEN l_partkey::VARCHAR END AS equation FROM lineitem""",
)
def object_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed labels of captions and formulas made from ``lineitem``; captions take all forms of ``sql.CAPTIONS``."""
    caption = F.expr(sql.captions("l_suppkey"))
    latex = F.expr(r"concat('x = y \\tag{0} z', if(l_linenumber > 1, concat('\\tag*{ ', l_partkey, ' }'), '\\tag{ }'))")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ids.figure_label(caption).alias("figure"), ids.table_label(caption).alias("table"), ids.equation_label(latex).alias("equation"))


@query("latex_keys", "SELECT p_partkey, 'a_' || p_size || '+b(c)' AS latex_key FROM part")
def latex_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison keys of formulas made from ``part``."""
    latex = F.concat(F.lit(r"\mathrm{a}_{"), F.col("p_size"), F.lit(r"} \quad + \, \text{b} \left( c \right) \tag{"), F.col("p_partkey"), F.lit("}"))
    return load(spark, sf_dir, "part").select("p_partkey", text.latex_key(latex).alias("latex_key"))


@query("unmapped_glyphs", "SELECT doc_id, len(regexp_extract_all(text, '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{9F}]')) AS controls, text LIKE '%GNU%' AS gnu FROM documents")
def unmapped_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control characters other than tab and newline of each document."""
    return load(spark, sf_dir, "documents").select("doc_id", text.control_characters(F.col("text")).alias("controls"), F.contains("text", F.lit("GNU")).alias("gnu"))


@query("strict_props", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, CASE WHEN json_keys(props::JSON) = ['k'] AND json_type(props::JSON, '$.k') IN ('UBIGINT', 'BIGINT') AND (props::JSON ->> 'k')::BIGINT >= 1 THEN 'accepted' ELSE 'rejected' END AS state FROM events")
def strict_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties checked for exactly one key, an integer of 1 or more."""
    rows = load(spark, sf_dir, "events").select("event_id", validate.strict_integer(F.col("props"), "k").alias("r"))
    return rows.select("event_id", F.col("r.value").alias("k"), "r.state")


@query("page_selections", "SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(list_concat(range(l_linenumber, l_linenumber + 3), [l_suppkey % 20 + 1]))), ',') AS pages FROM lineitem")
def page_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page selections made from ``lineitem``."""
    made = F.expr("concat(l_linenumber, '-', l_linenumber + 2, ', ', l_suppkey % 20 + 1)")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(ids.pages(made), ",").alias("pages"))


@query("split_names", "SELECT s_suppkey, 'A. ' || chr((66 + s_nationkey)::INTEGER) || '.' AS given, 'Supplier' AS family FROM supplier")
def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors' names made from ``supplier``, split."""
    name = ids.split_name(F.expr("concat('A.  ', chr(66 + s_nationkey), '. Supplier')"))
    return load(spark, sf_dir, "supplier").select("s_suppkey", name["given"].alias("given"), name["family"].alias("family"))


@query("library_shards", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN upper(left(c_mktsegment, 1)) ELSE 'unverified' END AS by_initial, CASE WHEN c_acctbal > 0 THEN (1990 + c_nationkey)::VARCHAR ELSE 'unverified' END AS by_year FROM customer")
def library_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of papers made from ``customer``."""
    good, year, family = F.col("c_acctbal") > 0, F.col("c_nationkey") + 1990, F.col("c_mktsegment")
    return load(spark, sf_dir, "customer").select("c_custkey", ids.library_shard("by-initial", good, year, family).alias("by_initial"), ids.library_shard("by-year", good, year, family).alias("by_year"))


@query("content_ids", "SELECT p_partkey, 'block_' || left(sha256(p_name || '|' || p_brand || '|' || p_size), 12) AS block_id FROM part")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from contents."""
    return load(spark, sf_dir, "part").select("p_partkey", ids.content_id("block", F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")).alias("block_id"))


@query("printed_years", "SELECT o_orderkey, year(o_orderdate)::VARCHAR AS years FROM orders")
def printed_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years in sentences made from ``orders``."""
    made = F.expr("concat('Received ', date_format(o_orderdate, 'd MMMM yyyy'), '; vol. 21000, again ', year(o_orderdate))")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.array_join(ids.years(made), ",").alias("years"))


_KEY_SQL = "lower(c_mktsegment) || (1990 + c_nationkey) || lower(replace(c_name, '#', ''))"


@query("citation_keys", f"SELECT c_custkey, {_KEY_SQL} AS citation_key FROM customer")
def citation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BibTeX keys of papers made from ``customer``."""
    return load(spark, sf_dir, "customer").select("c_custkey", export.citation_key(F.col("c_mktsegment"), F.col("c_nationkey") + 1990, F.concat(F.lit("The of "), F.col("c_name"))).alias("citation_key"))


@query("csl_items", f"SELECT c_custkey, '{{\"id\":\"' || {_KEY_SQL} || '\",\"type\":\"article-journal\",\"title\":\"' || c_name || '\",\"author\":[{{\"family\":\"' || c_mktsegment || '\"}}]' || CASE WHEN c_nationkey % 2 = 0 THEN ',\"issued\":{{\"date-parts\":[[' || (1990 + c_nationkey) || ']]}}' ELSE '' END || '}}' AS item FROM customer")
def csl_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSL-JSON of papers made from ``customer``."""
    key = export.citation_key(F.col("c_mktsegment"), F.col("c_nationkey") + 1990, F.col("c_name"))
    year = F.expr("if(c_nationkey % 2 = 0, c_nationkey + 1990, null)")
    return load(spark, sf_dir, "customer").select("c_custkey", export.csl_item(key, F.col("c_name"), F.col("c_mktsegment"), year).alias("item"))


@query("markdown_rows", "SELECT n_nationkey, '| ' || n_name || ' | a\\|b |' AS line FROM nation")
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown table rows of ``nation``."""
    return load(spark, sf_dir, "nation").select("n_nationkey", export.table_markdown(F.array("n_name", F.lit("a|b"))).alias("line"))


@query("table_csv", "SELECT n_regionkey::BIGINT AS region, string_agg(n_nationkey || ',' || n_name, chr(10) ORDER BY n_nationkey) AS csv FROM nation GROUP BY 1")
def table_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's nations as CSV, from cells."""
    rows = load(spark, sf_dir, "nation").selectExpr("cast(n_regionkey as bigint) as region", "n_nationkey", "n_name", "cast(row_number() over (partition by n_regionkey order by n_nationkey) - 1 as int) as row")
    cells = rows.select("region", "row", F.expr("inline(array(struct(0 as column, cast(n_nationkey as string) as text), struct(1 as column, n_name as text)))")).withColumns({"row_span": F.lit(1), "column_span": F.lit(1)})
    return export.table_csv(cells, "region")


@query(
    "version_decision",
    f"""SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'accepted_manuscript' WHEN doc_id % 5 = 2 THEN 'submitted_manuscript' WHEN doc_id % 5 = 3 THEN 'preprint'
        WHEN doc_id % 5 = 4 AND doc_id % 2 = 0 THEN 'submitted_manuscript' WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN 'version_of_record' ELSE 'unknown' END AS version FROM documents""",
)
def version_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of documents with markers put before their texts, by id."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.expr("concat(case doc_id % 5 when 1 then 'Author''s Accepted  Manuscript. ' when 2 then 'Submitted to Nature. ' when 3 then 'A pre-print. ' else '' end, text)").alias("front"))
    return rows.select("doc_id", identity.version(F.col("front"), file_name=F.expr("if(doc_id % 10 = 4, 'x_submitted.pdf', 'x.pdf')"), printed=F.expr("doc_id % 10 = 0")).alias("version"))


@query(
    "identity_decision",
    """
    WITH c AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' WHEN 2 THEN 'fail' END AS t, CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 4 = 3 THEN 'pass' ELSE 'warn' END AS a,
        CASE WHEN o_custkey % 5 <= 1 THEN 'pass' ELSE 'warn' END AS y, o_orderkey % 2 = 0 AS strong FROM orders)
    SELECT o_orderkey, CASE WHEN t = 'fail' AND strong THEN 'CONFLICT' WHEN t = 'fail' OR (t IS NULL AND NOT strong) THEN 'UNVERIFIED' WHEN coalesce(t = 'warn', false) OR coalesce(a = 'warn', false) OR y = 'warn' THEN 'VALIDATED_WITH_WARNINGS' ELSE 'VALIDATED' END AS status FROM c
    """,
)
def identity_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on checks made from ``orders``."""
    title = F.expr("case o_orderkey % 4 when 0 then 'pass' when 1 then 'warn' when 2 then 'fail' end")
    author = identity.author_check(F.col("o_custkey") % 4, F.expr("if(o_custkey % 4 = 0, 0, 3)"))
    return load(spark, sf_dir, "orders").select("o_orderkey", identity.decision(F.coalesce(title, F.lit(None).cast("string")), author, identity.year_check(F.col("o_custkey") % 5), F.col("o_orderkey") % 2 == 0).alias("status"))


@query("title_agreement")
def title_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of documents' first lines with altered copies of them; the misread test has no SQL form."""
    line = text.first_line(F.col("text"))
    rows = load(spark, sf_dir, "documents").select("doc_id", line.alias("a"), F.expr("case doc_id % 4 when 0 then upper(split(text, '\n')[0]) when 1 then concat('The ', split(text, '\n')[0], ' - part 1') when 2 then replace(split(text, '\n')[0], 'o', '0') else reverse(split(text, '\n')[0]) end").alias("b"))
    return identity.title_agreement(rows, "a", "b").select("doc_id", "agreement")


@query(
    "registry_flatten",
    "SELECT c_custkey, f.field, f.value, CASE WHEN f.value IS NULL THEN 'MISSING' ELSE 'REGISTRY' END AS status FROM customer, LATERAL (SELECT unnest([{'field': 'title', 'value': c_name}, {'field': 'journal', 'value': nullif(c_mktsegment, 'BUILDING')}, {'field': 'year', 'value': c_nationkey::VARCHAR}]) AS f)",
)
def registry_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made from ``customer``, one row a field."""
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("title"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("journal"), F.col("c_nationkey").alias("year"))
    return records.flatten(rows, "c_custkey", ["title", "journal", "year"])


@query(
    "bibtex_entries",
    r"""SELECT c_custkey, '@' || CASE c_custkey % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'phdthesis' ELSE 'misc' END || '{' || lower(c_mktsegment) || (1990 + c_nationkey) || regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') || ',' || chr(10)
        || '  author = {' || c_mktsegment || ', A. and {Group \& Co}},' || chr(10) || '  title = {By ' || replace(c_name, '#', '\#') || ' {' || c_mktsegment || '\_X}},' || chr(10)
        || '  ' || CASE c_custkey % 3 WHEN 0 THEN 'journal' WHEN 1 THEN 'school' ELSE 'booktitle' END || ' = {J 100\%},' || chr(10) || '  year = {' || (1990 + c_nationkey) || '},' || chr(10) || '  pages = {' || c_nationkey || '--' || c_custkey || '},' || chr(10)
        || CASE WHEN c_custkey % 3 = 2 THEN '  publisher = {J 100\%},' || chr(10) ELSE '' END || '  doi = {10.1/' || c_custkey || '},' || chr(10) || '  url = {https://doi.org/10.1/' || c_custkey || '}' || chr(10) || '}' || chr(10) AS entry FROM customer""",
)
def bibtex_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BibTeX entries of works made from ``customer``: escaped characters, protected capitals, three types."""
    none = lambda kind: F.lit(None).cast(kind)
    person = "struct<given: string, family: string, literal: string>"
    authors = F.array(F.struct(F.lit("A.").alias("given"), F.col("c_mktsegment").alias("family"), none("string").alias("literal")), F.struct(none("string").alias("given"), none("string").alias("family"), F.lit("Group & Co").alias("literal")))
    work = F.struct(
        F.expr("case c_custkey % 3 when 0 then 'journal-article' when 1 then 'bibtex:phdthesis' else 'Dataset' end").alias("article_type"), authors.alias("authors"), none(f"array<{person}>").alias("editors"), F.concat(F.lit("By "), "c_name", F.lit(" "), "c_mktsegment", F.lit("_X")).alias("title"),
        F.lit("J 100%").alias("journal"), (1990 + F.col("c_nationkey")).cast("int").alias("year"), none("string").alias("volume"), none("string").alias("issue"), F.concat_ws("-", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")).alias("pages"), none("string").alias("article_number"),
        F.lit("J 100%").alias("publisher"), none("string").alias("url"), F.lit(False).alias("asserted"), F.concat(F.lit("10.1/"), "c_custkey").alias("doi"),
    )
    return load(spark, sf_dir, "customer").select("c_custkey", bibtex.entry(work).alias("entry"))
