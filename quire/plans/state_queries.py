"""Catalogs, library state, saved pages, comparison reports and native trees, made from the tables' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import ids, text
from quire.operators import catalog, compare, figures, library_files, normalize, report, saved_page
from quire.plans import sql
from quire.plans.registry import query
from quire.sources.shared import parts_of
from quire.sources.tables import load


@query(
    "catalog_rows",
    """SELECT 'p/' || c_custkey AS directory, 'work_' || c_custkey AS work_id, CASE WHEN c_acctbal > 0 THEN '10.1000/' || c_custkey END AS doi, CASE WHEN c_acctbal > 0 THEN c_name END AS title, CASE WHEN c_acctbal > 0 THEN replace(lower(c_name), '#', ' ') END AS title_key,
        CASE WHEN c_acctbal > 0 THEN 'Ada ' || c_mktsegment || '; The Group' ELSE '' END AS authors, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS first_author_family, CASE WHEN c_acctbal > 0 THEN 1990 + c_nationkey END AS year, 'key' || c_custkey AS citation_key,
        'Seen ' || c_name AS title_observed, 'One' AS authors_observed, 'h' || c_custkey || ',s' AS source_sha256, 's:t:si.md' AS supplements, 'd' || c_custkey AS text_sha256, 2 AS page_count, c_nationkey AS figures, CASE WHEN c_acctbal > 0 THEN 'VALIDATED' ELSE 'UNVERIFIED' END AS bibliographic_status FROM customer""",
)
def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows of papers whose five records are made from ``customer``."""
    good = "c_acctbal > 0"
    fields = f"if({good}, concat('{{\"title\":{{\"value\":\"', c_name, '\"}},\"authors\":{{\"value\":[{{\"given\":\"Ada\",\"family\":\"', c_mktsegment, '\"}},{{\"literal\":\"The Group\"}}]}},\"year\":{{\"value\":', 1990 + c_nationkey, '}}}}'), '{{}}')"
    metadata = f"concat('{{\"work_id\":\"work_', c_custkey, '\",\"bibliographic_status\":\"', if({good}, 'VALIDATED', 'UNVERIFIED'), '\",\"fields\":', {fields}, ',\"identity\":{{', if({good}, concat('\"doi\":\"10.1000/', c_custkey, '\"'), ''), '}},\"observations\":{{\"title\":\"Seen ', c_name, '\",\"entries\":[{{\"field\":\"author\",\"value\":\"One\"}},{{\"field\":\"subject\",\"value\":\"x\"}}]}}}}')"
    extraction = "concat('{\"run_id\":\"r1\",\"sources\":[{\"sha256\":\"h', c_custkey, '\",\"fingerprint\":{\"text_sha256\":\"d', c_custkey, '\",\"doi_candidates\":[\"10.1/x\"]}},{\"sha256\":\"s\",\"fingerprint\":{\"text_sha256\":\"t\"}}],\"supplements\":[{\"markdown\":\"si.md\"}]}')"
    papers = load(spark, sf_dir, "customer").select(
        F.concat(F.lit("p/"), "c_custkey").alias("directory"),
        F.lit('{"generation":"g1"}').alias("manifest"),
        F.expr(metadata).alias("metadata"),
        F.expr("concat('{\"processing_status\":\"complete\",\"counts\":{\"figures\":', c_nationkey, '}}')").alias("validation"),
        F.expr(extraction).alias("extraction"),
        F.lit('{"backend":"b","pages":[{"number":1},{"number":2}]}').alias("document"),
        F.concat(F.lit("@article{key"), "c_custkey", F.lit(",\n  title = {x}\n}")).alias("bibtex"),
    )
    rows = catalog.catalog_rows(papers, "lib")
    kept = F.array_join(F.transform("supplements", lambda s: F.concat_ws(":", s["sha256"], s["text_sha256"], s["markdown"])), ",")
    listed = [F.array_join("authors", "; ").alias("authors"), F.array_join("authors_observed", ",").alias("authors_observed"), F.array_join("source_sha256", ",").alias("source_sha256"), kept.alias("supplements"), F.try_element_at("counts", F.lit("figures")).alias("figures")]
    return rows.select("directory", "work_id", "doi", "title", "title_key", "first_author_family", "year", "citation_key", "title_observed", "text_sha256", "page_count", "bibliographic_status", *listed)


@query(
    "organize_moves",
    "WITH m AS (SELECT 'in/' || c_name AS old, CASE WHEN c_acctbal > 0 THEN (1990 + c_nationkey)::VARCHAR || '/' || c_name ELSE 'unverified/' || c_name END AS new FROM customer) SELECT * FROM m WHERE old <> new",
)
def organize_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of papers made from ``customer`` into folders by year."""
    rows = load(spark, sf_dir, "customer").select(F.concat(F.lit("in/"), "c_name").alias("directory"), F.expr("if(c_acctbal > 0, 'VALIDATED', 'UNVERIFIED')").alias("bibliographic_status"), (F.col("c_nationkey") + 1990).alias("year"), F.col("c_mktsegment").alias("first_author_family"))
    return catalog.organize_plan(rows, "by-year")


@query(
    "paper_states",
    """SELECT o_custkey AS directory, CASE WHEN bool_or(o_orderpriority LIKE '1%') AND o_custkey % 7 = 0 THEN 'damaged' WHEN bool_or(o_orderstatus = 'P') THEN 'unsupported' WHEN bool_or(o_orderstatus = 'O') THEN 'outdated' ELSE 'current' END AS state FROM orders GROUP BY 1""",
)
def paper_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of papers made from ``orders``: a customer's orders are its records, some urgent ones its integrity problems."""
    orders = load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "directory")
    recorded = orders.select("directory", F.expr("case o_orderstatus when 'P' then 'unsupported' when 'O' then 'older' else 'current' end").alias("state"))
    return catalog.paper_states(recorded, orders.where("o_orderpriority like '1%' and directory % 7 = 0").select("directory"))


@query(
    "command_results",
    """
    WITH s AS (SELECT o_custkey AS command, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'conflict' ELSE 'failed' END AS status FROM orders)
    SELECT command, count(*) FILTER (WHERE status = 'complete') AS complete, CASE WHEN bool_and(status = 'complete') THEN 0 WHEN bool_or(status = 'complete') THEN 4 WHEN bool_and(status = 'conflict') THEN 3 ELSE 5 END::INTEGER AS exit_code FROM s GROUP BY 1
    """,
)
def command_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of commands, a customer's orders in the place of a command's items."""
    items = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("command"), F.expr("case o_orderstatus when 'F' then 'complete' when 'O' then 'conflict' else 'failed' end").alias("status"), F.lit(0).alias("warnings"))
    return catalog.command_result(items, "command").select("command", F.coalesce(F.try_element_at("summary", F.lit("complete")), F.lit(0)).alias("complete"), "exit_code")


@query("catalog_states", "SELECT CASE WHEN count(*) = 0 THEN 'absent' ELSE 'unsupported' END AS state FROM customer")
def catalog_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a catalog with one line a customer; some are of a version to come."""
    lines = load(spark, sf_dir, "customer").select(F.concat(F.lit('{"schema_version":'), F.expr("if(c_custkey = 0, 9, 1)"), F.lit("}")).alias("value"))
    return catalog.catalog_state(lines)


@query("index_staleness", "SELECT true AS stale, 'the catalog has changed' AS reason")
def index_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an index of ``customer``'s lines fits the catalog when one line has changed."""
    lines = load(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct("*")).alias("line"))
    index = catalog.catalog_digest(lines).select(F.col("sha256").alias("catalog_sha256"), F.lit(1).alias("schema_version"))
    return catalog.stale(index, lines.select(F.when(F.col("c_custkey") == 0, F.lit("{}")).otherwise(F.col("line")).alias("line")), 1)


@query(
    "attached_files",
    """
    WITH f AS (SELECT o_custkey AS directory, o_orderpriority AS sha256, o_orderkey AS name FROM orders), k AS (SELECT DISTINCT o_custkey AS directory, o_orderpriority AS sha256 FROM orders WHERE o_orderstatus = 'P')
    SELECT f.directory, f.sha256, f.name, CASE WHEN k.directory IS NOT NULL THEN 'already_kept' WHEN row_number() OVER (PARTITION BY f.directory, f.sha256 ORDER BY f.name) = 1 THEN 'attached' ELSE 'repeated' END AS outcome FROM f LEFT JOIN k USING (directory, sha256)
    """,
)
def attached_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made from ``orders`` attached to customers' papers, priorities in the place of digests."""
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("directory"), F.col("o_orderpriority").alias("sha256"), F.col("o_orderkey").alias("name"), "o_orderstatus")
    return library_files.attach(rows.drop("o_orderstatus"), rows.where("o_orderstatus = 'P'")).select("directory", "sha256", "name", "outcome")


@query("undescribed_figures", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_orderkey = l.l_orderkey AND k.l_linenumber = l.l_linenumber AND k.l_returnflag = 'R')")
def undescribed_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures made from ``lineitem`` without a kept description; returned lines are described."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return library_files.undescribed(rows.drop("l_returnflag").distinct(), rows.where("l_returnflag = 'R'"), ["l_orderkey", "l_linenumber"])


@query("journal_recovery", "SELECT o_orderkey AS directory, CASE o_orderkey % 5 WHEN 0 THEN 'roll_back' WHEN 1 THEN 'roll_back' WHEN 2 THEN 'roll_forward' ELSE 'report' END AS action FROM orders WHERE o_orderkey % 5 <> 3")
def journal_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of replacements, made from ``orders``, that stopped at some step; those done need nothing."""
    step = F.expr("case o_orderkey % 5 when 0 then 'staged' when 1 then 'old_aside' when 2 then 'new_in_place' when 3 then 'done' else 'other' end")
    return library_files.recovery(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("directory"), step.alias("step")))


@query("missing_assets", "SELECT DISTINCT l_orderkey AS doc, l_linenumber AS block_id, 'f' || l_suppkey AS asset, 'ASSET_MISSING' AS code FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_orderkey = l.l_orderkey AND k.l_suppkey = l.l_suppkey AND k.l_quantity > 25)")
def missing_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets made from ``lineitem`` that no file, made from its larger lines, holds."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("block_id"), F.concat(F.lit("f"), "l_suppkey").alias("asset"), "l_quantity")
    return library_files.missing_assets(rows, rows.where("l_quantity > 25").withColumnRenamed("asset", "path")).distinct()


@query(
    "saved_page_findings",
    """
    WITH p AS (SELECT c_custkey AS doc, c_nationkey % 4 AS k, c_custkey % 3 AS r FROM customer)
    SELECT doc, 'HTML_VERSION_MISMATCH' AS code, 'error' AS severity, '10.1/other / 10.1/' || doc AS detail FROM p WHERE k = 1
    UNION ALL SELECT doc, 'HTML_IDENTITY_UNCONFIRMED', 'warning', CASE k WHEN 2 THEN 'same_title' ELSE 'unconfirmed' END FROM p WHERE k > 1
    UNION ALL SELECT doc, 'HTML_INCOMPLETE', 'warning', '100' FROM p WHERE k IN (0, 2) AND r = 0
    UNION ALL SELECT doc, 'HTML_HEADING_NOT_IN_PDF', 'warning', 'Results' FROM p WHERE k IN (0, 2) AND r = 1
    UNION ALL SELECT doc, 'HTML_TEXT_NOT_IN_PDF', 'warning', '1' FROM p WHERE k IN (0, 2) AND r = 2
    UNION ALL SELECT doc, 'HTML_FIGURE_NOT_IN_PDF', 'warning', '2' FROM p WHERE k IN (0, 2)
    UNION ALL SELECT doc, 'HTML_CAPTION_DIFFERS', 'warning', '1' FROM p WHERE k IN (0, 2) AND r = 1
    UNION ALL SELECT doc, CASE r WHEN 0 THEN 'HTML_TABLE_AGREED' WHEN 1 THEN 'HTML_TABLE_DISAGREED' ELSE 'HTML_TABLE_NOT_COMPARABLE' END, CASE r WHEN 1 THEN 'warning' ELSE 'info' END, '1' FROM p WHERE k IN (0, 2)
    UNION ALL SELECT doc, 'HTML_REFERENCES_DIFFER', 'warning', '2 / 1' FROM p WHERE k IN (0, 2) AND r = 0
    """,
)
def saved_page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved pages and papers made from ``customer``: the same work by DOI or by title, another one, or none that can be told."""
    p = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), (F.col("c_nationkey") % 4).alias("k"), (F.col("c_custkey") % 3).alias("r"), "c_name")
    pages = p.select(
        "doc",
        F.expr("case k when 0 then concat('10.1/', doc) when 1 then '10.1/other' end").alias("page_doi"),
        F.expr("if(k = 3, null, concat('10.1/', doc))").alias("paper_doi"),
        F.expr("if(k = 3, 'Unlike', c_name)").alias("page_title"),
        F.col("c_name").alias("paper_title"),
        F.expr("if(r = 0, 100, 5000)").alias("characters"),
    )
    row = lambda where, *values: p.where(where).select("doc", *(F.expr(v).alias(n) for n, v in values))
    long = "'one two three four five six seven eight nine ten eleven twelve thirteen'"
    parts = {
        "headings": (row("true", ("text", "'Methods'")).union(row("r = 1", ("text", "'Results'"))), row("true", ("text", "'METHODS.'"))),
        "paragraphs": (row("true", ("pos", "1"), ("text", long)), row("r < 2", ("pos", "7"), ("text", f"concat('zero ', {long})")).union(row("r = 2", ("pos", "7"), ("text", "'other words'")))),
        "figures": (row("true", ("label", "'1'"), ("caption", "if(r = 1, 'a quite different caption here', 'spectrum of the light wave in air')")).union(row("true", ("label", "'2'"), ("caption", "'x'"))), row("true", ("label", "'1'"), ("caption", "'Spectrum of the light wave in air'"))),
        "tables": (row("true", ("label", "'1'"), ("text", "if(r = 2, 'a b', '1.5 and 2')")), row("true", ("label", "'1'"), ("text", "if(r = 0, '2 then 1.5', '2 then 1.6')"))),
        "references": (row("true", ("pos", "1"), ("text", "'see 10.1000/A.'")).union(row("r = 0", ("pos", "2"), ("text", "'none'"))), row("true", ("pos", "1"), ("text", "'x'"))),
    }
    return saved_page.check(pages, parts, row("r = 2", ("label", "'1'"), ("cells", "4")))


@query(
    "page_references",
    "SELECT o_custkey AS doc, count(*) AS page, count(*) FILTER (WHERE o_orderstatus = 'F') AS paper, string_agg('10.1000/A' || o_orderkey, ',' ORDER BY o_orderkey) AS dois FROM orders GROUP BY 1",
)
def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference lists made from ``orders``: a customer's orders on the page, the finished ones in the paper."""
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("Ref. doi:10.1000/A"), "o_orderkey", F.lit("; also 10.1000/a"), "o_orderkey").alias("text"), "o_orderstatus")
    found = saved_page.reference_counts(rows, rows.where("o_orderstatus = 'F'"))
    return found.select("doc", "page", "paper", F.array_join("dois", ",").alias("dois"))


@query(
    "word_shares",
    f"""
    WITH w AS (SELECT doc_id, {sql.words(sql.FIRST_LINE)} AS a, {sql.words("concat_ws(' ', source, lang, split_part(text, chr(10), 2))")} AS b FROM documents),
    n AS (SELECT doc_id, a, list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS met FROM w)
    SELECT doc_id, round(CASE WHEN len(a) = 0 THEN 0 ELSE met::DOUBLE / len(a) END, 6) AS share FROM n
    """,
)
def word_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document's first line its second line has, as often."""
    other = text.words(F.concat_ws(" ", "source", "lang", F.split_part("text", F.lit("\n"), F.lit(2))))
    return load(spark, sf_dir, "documents").select("doc_id", F.round(compare.word_share(text.words(text.first_line(F.col("text"))), other), 6).alias("share"))


@query(
    "comparison_counts",
    """
    WITH d AS (SELECT c_custkey AS doc, c_custkey % 3 AS r FROM customer)
    SELECT doc, s.section, s.status, s.n FROM d, LATERAL (SELECT unnest([
        {'section': 'reference_text_in_other', 'status': 'compared', 'n': 1}, {'section': 'reference_text_in_other', 'status': 'absent', 'n': CASE WHEN r = 2 THEN 1 ELSE 0 END},
        {'section': 'other_text_in_reference', 'status': 'compared', 'n': 1}, {'section': 'other_text_in_reference', 'status': 'absent', 'n': CASE WHEN r = 2 THEN 1 ELSE 0 END},
        {'section': 'headings', 'status': 'only_reference', 'n': CASE WHEN r = 1 THEN 1 END}, {'section': 'figures', 'status': CASE WHEN r = 1 THEN 'differs' ELSE 'agrees' END, 'n': 1},
        {'section': 'figures', 'status': 'only_reference', 'n': 1}, {'section': 'tables', 'status': CASE WHEN r = 0 THEN 'agrees' ELSE 'differs' END, 'n': 1}, {'section': 'tables', 'status': 'only_other', 'n': 1},
        {'section': 'equations', 'status': CASE WHEN r = 0 THEN 'same' ELSE 'different' END, 'n': 1}]) AS s) WHERE s.n IS NOT NULL
    """,
)
def comparison_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison report, in counts, of two readings of documents made from ``customer``."""
    customer = load(spark, sf_dir, "customer")
    p = customer.repartition(parts_of(customer, 8), "c_custkey").select(F.col("c_custkey").alias("doc"), (F.col("c_custkey") % 3).alias("r"))
    row = lambda where, *values: p.where(where).select("doc", *(F.expr(v).alias(n) for n, v in values))
    long = "'one two three four five six seven eight nine ten eleven twelve thirteen'"
    reference = {
        "headings": row("true", ("text", "'Methods'")).union(row("r = 1", ("text", "'Results'"))),
        "paragraphs": row("true", ("pos", "1"), ("text", long)),
        "figures": row("true", ("label", "'1'"), ("caption", "if(r = 1, 'a quite different caption here', 'spectrum of the light wave in air')"), ("pos", "1")).union(row("true", ("label", "'2'"), ("caption", "'x'"), ("pos", "2"))),
        "tables": row("true", ("label", "'1'"), ("text", "'1.5 and 2'")),
        "equations": row("true", ("pos", "1"), ("label", "'4'"), ("latex", "'a + b \\\\quad (4)'")),
    }
    other = {
        "headings": row("true", ("text", "'METHODS'")),
        "paragraphs": row("true", ("pos", "3"), ("text", f"if(r = 2, 'quite other words stand here so that nothing of it is in the first one', {long})")),
        "figures": row("true", ("label", "'1'"), ("caption", "'Spectrum of the light wave in air'"), ("pos", "1")),
        "tables": row("true", ("label", "'1'"), ("text", "if(r = 0, '2 then 1.5', '2 then 1.6')")).union(row("true", ("label", "'9'"), ("text", "'1'"))),
        "equations": row("true", ("pos", "1"), ("label", "'4'"), ("latex", "if(r = 0, 'a+b', 'a-b')")),
    }
    return report.comparison(reference, other)


@query("cell_grids", "SELECT n_nationkey, '<table><tr><th colspan=\"2\">' || n_name || '</th><td>a &amp; b</td></tr><tr><td></td><td>' || n_regionkey || '</td><td></td></tr></table>' AS html, 1 AS problems FROM nation")
def cell_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of cells made from ``nation``, one of which lies over another."""
    values = [(0, 0, 1, 2, "true", "n_name"), (0, 2, 1, 1, "false", "'a & b'"), (1, 1, 1, 1, "false", "cast(n_regionkey as string)"), (0, 1, 1, 1, "false", "'over'")]
    cells = ", ".join(f"struct({r} as row, {c} as column, {d} as row_span, {w} as column_span, {h} as header, {t} as text)" for r, c, d, w, h, t in values)
    rows = load(spark, sf_dir, "nation").select("n_nationkey", F.expr(f"inline(array({cells}))"))
    return normalize.grid_html(rows, "n_nationkey").select("n_nationkey", "html", F.size("problems").alias("problems"))


@query("rich_runs", "SELECT p_partkey, 'text:Energy |math:E_' || p_size || '|text: of |text+bold:' || p_name || '|link@u' || p_partkey || ':see' AS runs FROM part")
def rich_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rich-text runs of blocks' HTML made from ``part``."""
    html = F.concat(F.lit("<p>Energy\n <math> E_"), "p_size", F.lit("</math> of <b>"), "p_name", F.lit('</b><a href="u'), "p_partkey", F.lit('">see</a><script>x</script> </p>'))
    shown = lambda r: F.concat(r["kind"], F.when(F.size(r["styles"]) > 0, F.concat(F.lit("+"), F.array_join(r["styles"], "+"))).otherwise(""), F.coalesce(F.concat(F.lit("@"), r["url"]), F.lit("")), F.lit(":"), r["text"])
    return load(spark, sf_dir, "part").select("p_partkey", normalize.html_runs(html).alias("r")).select("p_partkey", F.array_join(F.transform("r", shown), "|").alias("runs"))


@query(
    "block_trees",
    f"""WITH c AS (SELECT s_suppkey, s_nationkey, {sql.captions("s_suppkey")} AS c FROM supplier)
    SELECT s_suppkey AS doc, b.page, b.pos, b.kind, b.label, b.caption FROM c, LATERAL (SELECT unnest([{{'page': 1, 'pos': 1, 'kind': 'heading', 'label': NULL, 'caption': NULL}},
        {{'page': 1, 'pos': 2, 'kind': 'figure', 'label': {sql.label("c", ids.FIGURE_LABEL)}, 'caption': c}}, {{'page': 12, 'pos': 3, 'kind': 'equation', 'label': 'S' || s_nationkey, 'caption': NULL}},
        {{'page': 12, 'pos': 4, 'kind': 'table', 'label': {sql.label("c", ids.TABLE_LABEL)}, 'caption': c}}, {{'page': 12, 'pos': 5, 'kind': 'unknown', 'label': NULL, 'caption': NULL}}]) AS b)""",
)
def block_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of native trees made from ``supplier``: a heading, a figure group, an equation, a table group and an unknown type.

    Pages are numbered by their ids, the last one's holds no number; captions take all forms of ``sql.CAPTIONS``.
    """
    caption = F.expr(sql.captions("s_suppkey"))
    native = F.concat(
        F.lit('{"children":[{"id":"/page/0/Page/9","children":[{"block_type":"SectionHeader","html":"<h1>T</h1>"},{"block_type":"FigureGroup","children":[{"block_type":"Figure"},{"block_type":"Caption","html":"<p>'),
        caption,
        F.lit('</p>"}]}]},{"id":"/page/11/Page/2","children":[{"block_type":"Equation","html":"<math>E = m \\\\quad (S'),
        "s_nationkey",
        F.lit(')</math>"},{"block_type":"TableGroup","children":[{"block_type":"Table","html":"<table><tr><td>1</td></tr></table>"},{"block_type":"Caption","html":"'),
        caption,
        F.lit('"}]},{"block_type":"Odd","html":"?"}]},{"id":"/page/x","children":[{"block_type":"Text","html":"lost"}]}]}'),
    )
    return normalize.tree_blocks(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), native.alias("json"))).select("doc", "page", "pos", "kind", "label", "caption")


@query(
    "figure_claims",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'no JSON object' WHEN 2 THEN 'a list is not one of strings' WHEN 3 THEN 'panels are not a list of objects' END AS problem, CASE WHEN p_partkey % 4 = 0 THEN 'plot' END AS figure_type,
        CASE WHEN p_partkey % 4 = 0 THEN '1:' || p_size || ',n' ELSE '' END AS printed, CASE WHEN p_partkey % 4 = 0 THEN 1 END AS readings FROM part""",
)
def figure_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models' answers made from ``part``: whole claims, none, and two of a wrong form."""
    whole = "concat('<think>{\"a\":1}</think> Here: {\"figure_type\":\"plot\",\"uncertain\":[\"x\",\" \"],\"panels\":[{\"label\":\"a\",\"printed_text\":[\"', p_size, '\",\"n\",\"\"],\"approximate_readings\":[{\"what\":\"peak\",\"value\":\"3\"},{\"what\":\"\",\"value\":\"4\"}]}]} end')"
    answer = F.expr(f"case p_partkey % 4 when 0 then {whole} when 1 then 'none {{' when 2 then '{{\"uncertain\":\"x\"}}' else '{{\"panels\":[1]}}' end")
    rows = load(spark, sf_dir, "part").select("p_partkey", figures.parse_claims(answer).alias("r"))
    panels = F.col("r.claims.panels")
    printed = F.concat(F.size(panels).cast("string"), F.lit(":"), F.array_join(F.get(panels, F.lit(0))["printed_text"], ","))
    return rows.select("p_partkey", "r.problem", F.col("r.claims.figure_type").alias("figure_type"), F.coalesce(printed, F.lit("")).alias("printed"), F.size(F.get(panels, F.lit(0))["approximate_readings"]).alias("readings"))
