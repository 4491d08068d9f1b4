"""Documents of JSON pointers made from the tables' columns, articles of pages, strict records, rendered documents and budgeted calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import ids
from quire.operators import admission, page_events, pointer_tree, rendering, reprocess, saved_page, schemas, span_tree
from quire.operators import supplement_links as supplement_links_
from quire.plans import sql
from quire.plans.registry import query
from quire.sources.shared import parts_of, spread
from quire.sources.tables import load

K, S = "p_partkey", "p_size"


def _joined(*parts: str) -> str:
    """SQL of both engines: strings and numbers in one string; parts in quotes are text."""
    return " || ".join(p if p.startswith("'") else f"CAST({p} AS STRING)" for p in parts)


def _ref(kind: str, number: str) -> str:
    return _joined(f"""'{{"$ref":"#/{kind}/'""", number, "'\"}'")


def _text(i: int) -> str:
    label = f"CASE ({K} + {i}) % 5 WHEN 0 THEN 'list_item' WHEN 1 THEN 'section_header' WHEN 2 THEN 'formula' WHEN 3 THEN 'caption' ELSE 'text' END"
    body = f"CASE WHEN ({K} + {i}) % 5 = 1 AND ({S} + {i}) % 3 = 0 THEN 'References' WHEN ({K} + {i}) % 5 = 3 THEN {sql.captions(f'({K} + {i})')} ELSE 'text {i} ' || p_name END"
    layer = f"""CASE WHEN ({K} * 7 + {i}) % 11 = 0 THEN '"content_layer":"furniture",' ELSE '' END"""
    return f"""'{{"label":"' || {label} || '",' || {layer} || '"orig":"a ({i}b)","marker":"[{i}]","self_ref":"#/texts/{i}","prov":[{{"page_no":{1 + i % 2}}}],"text":"' || {body} || '"}}'"""


def _group(i: int) -> str:
    label = f"CASE WHEN ({K} + {i}) % 4 = 0 THEN 'list' ELSE 'section' END"
    below = [_ref("texts", str(i)), _ref("groups", f"({2 * i + 1} + {K} % 3)"), _ref("texts", f"(({i} + {S}) % 18)"), _ref("groups", f"(({3 * i} + {K}) % 8)")]
    return f"""'{{"label":"' || {label} || '","children":[' || {" || ',' || ".join(below)} || ']}}'"""


_list = lambda parts: " || ',' || ".join(parts)
_body = [_ref("groups", "0"), _ref("tables", "0"), _ref("texts", f"({K} % 16)"), _ref("groups", f"({S} % 8)"), _ref("tables", "1")]
_tables = [f"""'{{"self_ref":"#/tables/{i}","captions":[' || {_ref("texts", f"({K} % {20 - i})")} || ']}}'""" for i in (0, 1)]
#: SQL of both engines: a document of 16 texts, 8 groups that nest, share members, name themselves and name nothing, and two tables.
DOCUMENT = f"""'{{"formulas":true,"runs":[{{"document":{{"body":{{"children":[' || {_list(_body)} || ']}},"texts":[' || {_list([_text(i) for i in range(16)])} || '],"groups":[' || {_list([_group(i) for i in range(8)])} || '],"tables":[' || {_list(_tables)} || ']}}}}]}}'"""


@query(
    "pointer_blocks",
    f"""WITH RECURSIVE d AS (SELECT {K} AS doc, ({DOCUMENT})::JSON AS j FROM part),
    x AS (SELECT doc, kind, i, '#/' || kind || '/' || i AS ref, json_extract(j, '$.runs[0].document.' || kind || '[' || i || ']') AS item FROM d, (VALUES ('texts'), ('groups'), ('tables')) AS c(kind), range(0, 16) AS r(i)),
    items AS (SELECT doc, kind, i, ref, item, coalesce(item ->> 'label', '') AS label, coalesce(item ->> 'text', '') AS text, coalesce(item ->> 'content_layer', '') = 'furniture' AS furniture, coalesce((item ->> '$.prov[0].page_no')::INT, 1) AS page FROM x WHERE item IS NOT NULL),
    uppers AS (SELECT doc, '#/body' AS upper, FALSE AS is_list, json_extract_string(j, '$.runs[0].document.body.children[*]."$ref"') AS refs FROM d
        UNION ALL SELECT doc, ref, label = 'list', json_extract_string(item, '$.children[*]."$ref"') FROM items WHERE kind = 'groups' AND NOT furniture),
    edges AS (SELECT doc, upper, is_list, e.ref AS ref, e.rank AS rank FROM (SELECT doc, upper, is_list, unnest(list_transform(refs, lambda r, i: {{'ref': r, 'rank': i - 1}})) AS e FROM uppers)),
    rec AS (SELECT doc, ref, is_list, rank, CAST([] AS BIGINT[]) AS base, [upper] AS seen FROM edges WHERE upper = '#/body'
        UNION ALL SELECT e.doc, e.ref, e.is_list, e.rank, list_append(r.base, r.rank), list_append(r.seen, r.ref) FROM rec r JOIN edges e ON e.doc = r.doc AND e.upper = r.ref WHERE NOT list_contains(r.seen, r.ref)),
    occ AS (SELECT i.*, is_list AND label = 'list_item' AS member, CASE WHEN is_list AND label = 'list_item' THEN list_append(base, -1) ELSE list_append(base, rank) END AS path, rank FROM rec JOIN items i USING (doc, ref) WHERE kind <> 'groups' AND ((is_list AND label = 'list_item') OR NOT furniture)),
    h AS (SELECT *, last_value(CASE WHEN label = 'section_header' THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM occ),
    e AS (SELECT *, label = 'list_item' AND coalesce(heading, '') = 'References' AS entry FROM h),
    flat AS (SELECT doc, path, CASE WHEN member THEN rank ELSE 0 END AS member, page, 0 AS edge, 0 AS last, CASE WHEN kind = 'tables' THEN 'table' WHEN entry THEN 'paragraph' WHEN label = 'formula' THEN 'equation' WHEN label = 'section_header' THEN 'heading' ELSE 'paragraph' END AS kind,
            CASE WHEN kind = 'tables' THEN NULL WHEN entry THEN 'reference' WHEN label = 'caption' THEN 'aside' WHEN label = 'text' THEN 'body' END AS role, CASE WHEN kind = 'tables' THEN '' WHEN entry THEN (item ->> 'marker') || ' ' || text ELSE text END AS shown, kind = 'tables' AS is_table, item FROM e WHERE label <> 'list_item' OR entry
        UNION ALL SELECT doc, path, 0, arg_min(page, rank), 0, 0, 'list', NULL, string_agg(text, '|' ORDER BY rank), FALSE, arg_min(item, rank) FROM e WHERE label = 'list_item' AND NOT entry GROUP BY doc, path
        UNION ALL SELECT doc, [i], 0, page, 0, 1, 'unknown', NULL, '', FALSE, item FROM items WHERE kind = 'texts' AND furniture),
    c AS (SELECT f.*, t.text AS caption FROM flat f LEFT JOIN items t ON f.is_table AND t.doc = f.doc AND t.ref = (f.item ->> '$.captions[0]."$ref"'))
    SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page, edge, last, path, member)::INT AS pos, page, kind, role, shown, caption,
        CASE WHEN kind = 'equation' THEN regexp_extract(item ->> 'orig', '[0-9]+b') WHEN is_table THEN {sql.label("caption", ids.TABLE_LABEL)} END AS label FROM c""",
)
def pointer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pointer documents made from ``part``: groups below groups, shared, circular and without a target, lists, references, captions, furniture."""
    found = pointer_tree.pointer_blocks(spread(load(spark, sf_dir, "part"), K).select(F.col(K).alias("doc"), F.expr(DOCUMENT).alias("json")))
    text = lambda runs: F.array_join(F.transform(runs, lambda r: r["text"]), "")
    shown = F.when(F.col("kind") == "list", F.array_join(F.transform("items", text), "|")).otherwise(text(F.col("runs")))
    return found.select("doc", "pos", "page", "kind", "role", F.when(F.col("kind") == "unknown", "").otherwise(shown).alias("shown"), "caption", "label")


#: SQL of both engines: what each page gets in front of its article's end: two figures, a table below a heading, hidden and publishers' parts, references.
PARTS = (
    """'<h2>Results ' || CAST(page_id % 7 AS STRING) || '</h2><div class="advert"><p>Never read this advertisement, however long it is.</p></div><figure><img src="1.png"><figcaption><b>Fig. 1</b> Wave of ' || url || '</figcaption></figure><div class="fig"><p>Figure 2: Field ' || CAST(page_id % 5 AS STRING) || ' <span hidden>no</span></p></div>"""
    """<div><h4>Table ' || CASE WHEN page_id % 2 = 0 THEN 'II' ELSE '2' END || ' Sums</h4><div><table><tr><th>n</th><td>' || CAST(page_id AS STRING) || '.5</td></tr><tr><td colspan=2>7</td></tr></table></div></div>"""
    """<section id="references"><ol><li>Ada. Waves. 10.1000/' || CAST(page_id AS STRING) || ' <span class="links">link</span></li>' || CASE WHEN page_id % 3 = 0 THEN '<li>Another <i>one</i></li>' ELSE '' END || '</ol></section></article>'"""
)
HEAD = """'<meta name="citation_doi" content="10.1000/' || CASE WHEN page_id % 4 = 1 THEN 'x' ELSE '' END || CAST(page_id AS STRING) || '"><meta name="citation_title" content="Page"></head>'"""
HTML = f"replace(replace(html, '</article>', {PARTS}), '</head>', {HEAD})"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc"), F.expr(HTML).alias("html"))


@query(
    "page_parts",
    """WITH a AS (SELECT page_id::VARCHAR AS doc, page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS body FROM pages),
    p AS (SELECT doc, trim(regexp_replace(regexp_replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&middot;', '·', 'g'), '[ \n\t]+', ' ', 'g')) AS text FROM (SELECT doc, unnest(string_split(body, '<p>')[2:]) AS x FROM a))
    SELECT doc, 'paragraphs' AS part, NULL AS label, text FROM (SELECT doc, html_unescape(text) AS text FROM p) WHERE length(text) >= 40
    UNION ALL SELECT doc, 'headings', NULL, x FROM (SELECT doc, unnest(['Results ' || page_id % 7, 'Table ' || CASE WHEN page_id % 2 = 0 THEN 'II' ELSE '2' END || ' Sums']) AS x FROM a)
    UNION ALL SELECT doc, 'figures', '1', 'Fig. 1 Wave of ' || url FROM a
    UNION ALL SELECT doc, 'figures', '2', 'Figure 2: Field ' || page_id % 5 FROM a
    UNION ALL SELECT doc, 'tables', CASE WHEN page_id % 2 = 0 THEN 'II' ELSE '2' END, 'n ' || page_id || '.5 7' FROM a
    UNION ALL SELECT doc, 'references', '10.1000/' || page_id, 'Ada. Waves. 10.1000/' || page_id FROM a
    UNION ALL SELECT doc, 'references', '', 'Another one' FROM a WHERE page_id % 3 = 0""".replace("html_unescape(text)", "replace(replace(replace(replace(text, '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"),
)
def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs, headings, figures, tables and references of ``pages``, each with a few parts put in."""
    parts = page_events.article(_pages(spark, sf_dir))
    none, cells = F.lit(None).cast("string"), F.array_join(F.transform("grid.cells", lambda c: c["text"]), " ")
    columns = {"paragraphs": (none, F.col("text")), "headings": (none, F.col("text")), "figures": (F.col("label"), F.col("caption")), "tables": (F.col("label"), cells), "references": (F.array_join("dois", " "), F.col("text"))}
    out = [parts[k].select("doc", F.lit(k).alias("part"), label.alias("label"), value.alias("text")) for k, (label, value) in columns.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


@query(
    "page_findings",
    """WITH p AS (SELECT page_id, page_id::VARCHAR AS doc, CASE WHEN page_id % 2 = 0 THEN 'II' ELSE '2' END AS label FROM pages WHERE page_id % 4 <> 1)
    SELECT page_id::VARCHAR AS doc, 'HTML_VERSION_MISMATCH' AS code, 'error' AS severity, '10.1000/x' || page_id || ' / 10.1000/' || page_id AS detail FROM pages WHERE page_id % 4 = 1
    UNION ALL SELECT doc, 'HTML_HEADING_NOT_IN_PDF', 'warning', 'Results ' || page_id % 7 FROM p
    UNION ALL SELECT doc, 'HTML_FIGURE_NOT_IN_PDF', 'warning', '2' FROM p
    UNION ALL SELECT doc, 'HTML_CAPTION_DIFFERS', 'warning', '1' FROM p WHERE page_id % 5 = 0
    UNION ALL SELECT doc, CASE WHEN page_id % 3 = 1 THEN 'HTML_TABLE_DISAGREED' ELSE 'HTML_TABLE_AGREED' END, CASE WHEN page_id % 3 = 1 THEN 'warning' ELSE 'info' END, label FROM p
    UNION ALL SELECT doc, 'HTML_REFERENCES_DIFFER', 'warning', '2 / 1' FROM p WHERE page_id % 3 = 0""",
)
def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of real ``pages`` against papers that hold the same text but lack or change some parts; findings on the text's length aside."""
    parts = page_events.article(_pages(spark, sf_dir))
    rows = load(spark, sf_dir, "pages").select("page_id", "url", F.col("page_id").cast("string").alias("doc"))
    papers = rows.select("doc", F.concat(F.lit("10.1000/"), "doc").alias("doi"), F.lit("Page").alias("title"))
    pages, own = page_events.checkable(parts, papers)
    made = lambda **values: rows.select("doc", *(F.expr(v).alias(k) for k, v in values.items()))
    label = "if(page_id % 2 = 0, 'II', '2')"
    paper = {
        "headings": made(text=f"concat('TABLE ', {label}, ': sums')"),
        "paragraphs": own["paragraphs"],
        "figures": made(label="'1'", caption="if(page_id % 5 = 0, 'Quite another caption', concat('Fig. 1 Wave of ', url))"),
        "tables": made(label=label, text="concat('7 n ', page_id + int(page_id % 3 = 1), '.5')"),
        "references": made(pos="1", text="'Ada'"),
    }
    return saved_page.check(pages, {k: (own[k], paper[k]) for k in paper}).where("code <> 'HTML_INCOMPLETE'")


#: SQL of both engines: coverage records of orders, most of them with a fault or two.
COVERAGE = """'{"requested":[' || CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '1,true,3' ELSE '1,2,' || CAST(3 + o_orderkey % 4 AS STRING) END || '],"returned":' || CASE o_orderkey % 7 WHEN 0 THEN '"all"' WHEN 1 THEN '[2,1]' WHEN 2 THEN '[1,0,"2",1.5]' ELSE '[1,2]' END
    || CASE o_orderkey % 3 WHEN 0 THEN '' ELSE ',"empty":[' || CAST(o_custkey % 4 AS STRING) || ']' END || CASE WHEN o_custkey % 4 = 0 THEN ',"' || lower(o_orderstatus) || '":null}' ELSE '}' END"""


@query(
    "record_problems",
    f"""WITH d AS (SELECT o_orderkey, ({COVERAGE})::JSON AS j FROM orders), f AS (SELECT o_orderkey, j, unnest(['requested', 'returned', 'empty']) AS name FROM d),
    v AS (SELECT o_orderkey, name, j -> name AS v FROM f WHERE list_contains(json_keys(j), name)),
    each AS (SELECT o_orderkey, name, i, v -> ('$[' || i || ']') AS x FROM (SELECT o_orderkey, name, v, unnest(range(0, json_array_length(v)::BIGINT)) AS i FROM v WHERE json_type(v) = 'ARRAY')),
    bad AS (SELECT o_orderkey, '$.' || name AS path, 'missing field' AS problem FROM f WHERE NOT list_contains(json_keys(j), name)
        UNION ALL SELECT o_orderkey, '$.' || k, 'unknown field' FROM (SELECT o_orderkey, unnest(json_keys(j)) AS k FROM d) WHERE k NOT IN ('requested', 'returned', 'empty')
        UNION ALL SELECT o_orderkey, '$.' || name, 'no list' FROM v WHERE json_type(v) <> 'ARRAY'
        UNION ALL SELECT o_orderkey, '$.' || name || '[' || i || ']', 'no integer of 1 or more' FROM each WHERE json_type(x) NOT IN ('UBIGINT', 'BIGINT') OR TRY_CAST(x AS BIGINT) < 1),
    good AS (SELECT o_orderkey, (j -> 'requested')::BIGINT[] AS r, (j -> 'returned')::BIGINT[] AS t, (j -> 'empty')::BIGINT[] AS e FROM d WHERE o_orderkey NOT IN (SELECT o_orderkey FROM bad))
    SELECT * FROM bad
    UNION ALL SELECT o_orderkey, '$', 'no page requested' FROM good WHERE len(r) = 0
    UNION ALL SELECT o_orderkey, '$', 'returned pages don''t rise' FROM good WHERE list_sort(list_distinct(t)) <> t
    UNION ALL SELECT o_orderkey, '$', 'empty pages that were not returned' FROM good WHERE NOT list_has_all(t, e)""",
)
def record_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All problems of coverage records made from ``orders``: booleans and fractions as pages, texts for lists, fields too many or too few, pages that don't rise."""
    found = schemas.checked(load(spark, sf_dir, "orders").select("o_orderkey", F.expr(COVERAGE).alias("json")), schemas.COVERAGE)
    return found.select("o_orderkey", F.inline("problems"))


_O = "CAST(o_orderkey AS STRING)"
_caption = lambda shift: sql.captions(f"(o_orderkey + {shift})")
_part = lambda part, text: f"""'{{"type":"{part}","content":"' || {text} || '"}}'"""
#: SQL of both engines: a document of two pages: visual blocks that a text may part, runs with links and formulas, a table, lists in lists, a formula.
SPANS = f"""'{{"pages":[{{"page_idx":0,"blocks":[{{"type":"doc_title","content":"Order ' || {_O} || '"}},{{"type":"image","content":[' || {_part("image_caption", "'(a)'")} || ']}},' || CASE WHEN o_orderkey % 4 = 0 THEN '{{"type":"text","content":"between"}},7,' ELSE '' END
    || '{{"type":"chart","content":[' || {_part("chart_caption", _caption(0))} || ',' || {_part("chart_footnote", "'note'")} || ',' || {_part("chart_caption", _caption(5))} || ']}},{{"type":"image","content":[]}},{{"type":"text","content":[{{"type":"text","content":"cost "}},{{"type":"equation_inline","content":"c_' || CAST(o_custkey AS STRING) || '"}},{{"type":"hyperlink","url":"u","content":[{{"type":"text","content":" see"}},{{"type":"text","content":" there"}}]}},{{"type":"text","content":[]}}]}}]}},'
    || '{{"page_idx":1,"blocks":[{{"type":"table","content":[' || CASE WHEN o_orderkey % 3 = 0 THEN {_part("table_caption", _caption(1))} || ',' ELSE '' END || {_part("table_footnote", _caption(2))} || ',' || {_part("table_footnote", "'* by hand'")} || ',{{"type":"table_body","content":"<table><tr><td>1</td></tr></table>"}}]}},{{"type":"list","content":[{{"type":"text","content":"one"}},{{"type":"list","content":[' || CASE WHEN o_custkey % 2 = 0 THEN '{{"type":"list","content":[{{"type":"text","content":"deep"}}]}},' ELSE '' END || '{{"type":"text","content":"two"}}]}},{{"type":"text","content":"three"}}]}},'
    || '{{"type":"equation","content":"x ' || CASE WHEN o_orderkey % 2 = 0 THEN chr(92) || chr(92) || 'tag{{' || {_O} || '}}' ELSE '' END || '"}}]}}]}}'"""


@query(
    "span_blocks",
    f"""WITH d AS (SELECT o_orderkey AS doc, ({SPANS})::JSON AS j FROM orders),
    b AS (SELECT doc, page, nth, j -> ('$.pages[' || (page - 1) || '].blocks[' || nth || ']') AS b FROM (SELECT doc, page, j, unnest(range(0, json_array_length(j, '$.pages[' || (page - 1) || '].blocks')::BIGINT)) AS nth FROM (SELECT doc, j, unnest([1, 2]) AS page FROM d))),
    t AS (SELECT doc, page, nth, b, b ->> 'type' AS type, CASE WHEN json_type(b -> 'content') = 'ARRAY' THEN json_array_length(b, '$.content')::BIGINT ELSE 0 END AS n FROM b WHERE json_type(b) = 'OBJECT'),
    kids AS (SELECT doc, page, nth, type, i, b -> ('$.content[' || i || ']') AS k FROM (SELECT *, unnest(range(0, n)) AS i FROM t)),
    told AS (SELECT doc, page, nth, string_agg(CASE WHEN k ->> 'type' = 'hyperlink' THEN array_to_string(json_extract_string(k, '$.content[*].content'), '') WHEN json_type(k -> 'content') = 'VARCHAR' THEN k ->> 'content' ELSE '' END, '' ORDER BY i) AS text FROM kids WHERE type = 'text' GROUP BY doc, page, nth),
    c AS (SELECT doc, page, nth, type, i, k ->> 'type' AS part, k ->> 'content' AS text FROM kids WHERE type IN ('image', 'chart', 'table')),
    chosen AS (SELECT doc, page, nth, arg_min(text, i) AS caption, min(i) AS i FROM c WHERE suffix(part, '_caption') AND type <> 'table' AND {sql.label("text", ids.FIGURE_LABEL)} IS NOT NULL GROUP BY doc, page, nth),
    v AS (SELECT t.*, caption, chosen.i AS ci, coalesce(sum(CASE WHEN type NOT IN ('image', 'chart') OR caption IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM t LEFT JOIN chosen USING (doc, page, nth)),
    notes AS (SELECT v.doc, v.page, v.g, string_agg(c.text, '|' ORDER BY c.nth, c.i) AS notes FROM v JOIN c ON c.doc = v.doc AND c.page = v.page AND c.nth = v.nth WHERE v.type IN ('image', 'chart') AND c.text <> '(a)' AND c.i IS DISTINCT FROM v.ci GROUP BY v.doc, v.page, v.g),
    figs AS (SELECT doc, page, min(nth) AS nth, 'figure' AS kind, max(caption) AS caption, count(*) AS panels, g FROM v WHERE type IN ('image', 'chart') GROUP BY doc, page, g),
    tabs AS (SELECT doc, page, nth, list(text ORDER BY i) FILTER (WHERE part = 'table_caption') AS caps, list(text ORDER BY i) FILTER (WHERE part = 'table_footnote') AS foots FROM c WHERE type = 'table' GROUP BY doc, page, nth),
    tcap AS (SELECT *, caps[1] AS own, {sql.label("caps[1]", ids.TABLE_LABEL)} AS l1, {sql.label("foots[1]", ids.TABLE_LABEL)} AS l2 FROM tabs),
    flat AS (SELECT doc, page, nth, 'heading' AS kind, NULL AS label, NULL AS caption, b ->> 'content' AS shown FROM t WHERE type = 'doc_title'
        UNION ALL SELECT t.doc, t.page, t.nth, 'paragraph', NULL, NULL, coalesce(text, b ->> 'content') FROM t LEFT JOIN told USING (doc, page, nth) WHERE type = 'text'
        UNION ALL SELECT doc, page, nth, 'equation', nullif(regexp_extract(b ->> 'content', 'tag.([0-9]+)', 1), ''), NULL, b ->> 'content' FROM t WHERE type = 'equation'
        UNION ALL SELECT doc, page, nth, 'list', NULL, NULL, array_to_string(list_transform(regexp_extract_all(b::VARCHAR, '"text","content":"[a-z]+'), lambda x: split_part(x, '"', 6)), '|') FROM t WHERE type = 'list'
        UNION ALL SELECT doc, page, nth, 'table', coalesce(l1, l2), CASE WHEN own IS NULL AND l2 IS NOT NULL THEN foots[1] ELSE own END, CASE WHEN own IS NULL AND l2 IS NOT NULL THEN foots[2] ELSE array_to_string(foots, '|') END FROM tcap
        UNION ALL SELECT f.doc, f.page, f.nth, 'figure', {sql.label("f.caption", ids.FIGURE_LABEL)}, f.caption, CASE WHEN f.caption IS NULL THEN 'unresolved' WHEN panels = 1 THEN 'single' ELSE 'caption_run' END || ':' || panels || ':' || coalesce(notes, '') FROM figs f LEFT JOIN notes n ON n.doc = f.doc AND n.page = f.page AND n.g = f.g)
    SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page, nth)::INT AS pos, kind, label, caption, shown FROM flat""",
)
def span_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of nested documents made from ``orders``: figures of several panels, runs, lists in lists, table captions among the footnotes."""
    found = span_tree.span_blocks(spread(load(spark, sf_dir, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("doc"), F.expr(SPANS).alias("json")))
    text = lambda runs: F.array_join(F.transform(runs, lambda r: r["text"]), "")
    shown = F.when(F.col("kind") == "figure", F.concat_ws(":", "grouping", F.size("panels").cast("string"), F.array_join("footnotes", "|"))).when(F.col("kind") == "list", F.array_join(F.transform("items", text), "|")).when(F.col("kind") == "table", F.array_join("footnotes", "|")).otherwise(text(F.col("runs")))
    return found.select("doc", "page", "pos", "kind", "label", "caption", shown.alias("shown"))


@query(
    "rendered_documents",
    """WITH b AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS pos, 1 + l_linenumber // 3 AS page, (l_suppkey + l_linenumber) % 7 AS k, l_partkey, l_suppkey % 2 = 0 AS continues FROM lineitem),
    r AS (SELECT *, k IN (1, 2) AS note, CASE WHEN k = 0 THEN '## Part ' || l_partkey WHEN k = 3 THEN '> ' ELSE '' END || CASE WHEN k > 0 THEN 'text ' || l_partkey || ' **$x$** [see](u)' ELSE '' END AS text FROM b WHERE k <> 6),
    s AS (SELECT *, coalesce(lag(k IN (4, 5)) OVER w, FALSE) AS open, page IS DISTINCT FROM lag(page) OVER w AS turned FROM r WINDOW w AS (PARTITION BY doc, note ORDER BY pos)),
    j AS (SELECT *, NOT note AND k IN (3, 4, 5) AND continues AND open AS joins, NOT note AND turned AS turns FROM s),
    d AS (SELECT *, CASE WHEN joins THEN 2 * pos + 1 WHEN turns THEN 2 * pos - 1 END AS due FROM j),
    f AS (SELECT *, CASE WHEN note THEN coalesce((SELECT min_by(e.due, e.pos) FROM d e WHERE e.doc = d.doc AND e.pos >= d.pos AND e.due IS NOT NULL), 1000000) ELSE 2 * pos END AS key FROM d),
    t AS (SELECT doc, string_agg(CASE WHEN joins THEN chr(10) ELSE chr(10) || chr(10) END || CASE WHEN turns THEN '<!-- source: pdf page ' || page || ' -->' || chr(10) ELSE '' END || CASE WHEN note THEN '*Footnote (page ' || page || '):* ' ELSE '' END || text, '' ORDER BY key, pos) AS m FROM f GROUP BY doc)
    SELECT doc, m || chr(10) AS markdown FROM t""".replace("**$x$**", "$x$"),
)
def rendered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of documents made from ``lineitem``: headings, paragraphs that go on, asides, footnotes and furniture."""
    rows = load(spark, sf_dir, "lineitem").withColumn("k", (F.col("l_suppkey") + F.col("l_linenumber")) % 7)
    run = lambda kind, text, url="null": f"struct('{kind}' as kind, {text} as text, array() as styles, {url} as url)"
    runs = F.expr(f"if(k = 0, array({run('text', 'concat(\'Part \', l_partkey)', 'cast(null as string)')}), array({run('text', 'concat(\'text \', l_partkey, \' \')', 'cast(null as string)')}, {run('math', '\'x\'', 'cast(null as string)')}, {run('text', '\' \'', 'cast(null as string)')}, {run('link', '\'see\'', '\'u\'')}))")
    kind, role = F.expr("case k when 0 then 'heading' when 6 then 'furniture' else 'paragraph' end"), F.expr("case when k in (1, 2) then 'footnote' when k = 3 then 'aside' else 'body' end")
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    blocks = rows.select(F.col("l_orderkey").alias("doc"), F.expr("cast(1 + l_linenumber div 3 as int)").alias("page"), F.row_number().over(line).alias("pos"), kind.alias("kind"), role.alias("role"), F.lit(2).alias("level"), (F.col("l_suppkey") % 2 == 0).alias("continues"), runs.alias("runs"))
    return rendering.document_markdown(blocks)


@query(
    "admitted_calls",
    """WITH RECURSIVE c AS (SELECT c_custkey AS call, CASE WHEN c_custkey % 50 > 0 THEN 1000 + (c_custkey * 7919) % 40000 END AS cost, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS n FROM customer),
    cap AS (SELECT sum(cost) // 3 AS cap FROM c),
    run AS (SELECT 0::BIGINT AS n, 70000::HUGEINT AS spent, NULL::BIGINT AS call, FALSE AS admitted
        UNION ALL SELECT c.n, run.spent + CASE WHEN run.spent + c.cost <= cap.cap THEN c.cost ELSE 0 END, c.call, coalesce(run.spent + c.cost <= cap.cap, FALSE) FROM run JOIN c ON c.n = run.n + 1, cap)
    SELECT call, admitted FROM run WHERE n > 0""",
)
def admitted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls made from ``customer``, in order of nation and customer, under a third of what all could cost, part of which is spent."""
    calls = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("call"), "c_nationkey", F.expr("if(c_custkey % 50 > 0, 1000 + (cast(c_custkey as bigint) * 7919) % 40000, null)").alias("cost"))
    cap = calls.agg(F.expr("sum(cost) div 3")).first()[0]
    return admission.admitted(calls, ["c_nationkey", "call"], cap, 70_000).select("call", "admitted")


@query(
    "supplement_links",
    """WITH p AS (SELECT p_partkey, p_size % 4 AS f, p_size % 5 AS t, p_partkey % 3 AS n FROM part),
    x AS (SELECT *, CASE WHEN f < 2 AND n > 0 THEN '[Fig. S' || f || '](si/' || p_partkey || 'a.md#figure-s' || f || ')' ELSE 'Fig. S' || f END AS a,
        CASE WHEN n = 2 AND t < 3 THEN '[Supplementary Table ' || t || '](si/' || p_partkey || 'b.md#table-s' || t || ')' ELSE 'Supplementary Table ' || t END AS b, CASE WHEN n > 0 THEN '[Supporting Information](si/' || p_partkey || 'a.md)' ELSE 'Supporting Information' END AS c FROM p)
    SELECT p_partkey, 'See ' || a || ', $Fig. S1$ and ' || b || '; the ' || c || '.' || CASE WHEN f < 2 AND n > 0 THEN '[Figure S' || f || '](si/' || p_partkey || 'a.md#figure-s' || f || ') ([original link](u))' ELSE '[Figure S' || f || '](u)' END AS markdown FROM x""",
)
def supplement_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers made from ``part`` with links to the figures of their first supplement and the tables of their second one, where they have those."""
    part = load(spark, sf_dir, "part")
    rows = part.selectExpr("cast(p_partkey as string) as paper", "p_partkey", "p_size % 4 as f", "p_size % 5 as t", "p_partkey % 3 as n").repartition(parts_of(part, 6), "paper")  # six objects each
    run = lambda kind, text, url="cast(null as string)": f"struct('{kind}' as kind, {text} as text, array() as styles, {url} as url)"
    said = [run("text", "concat('See Fig. S', f, ', ')"), run("math", "'Fig. S1'"), run("text", "concat(' and Supplementary Table ', t, '; the Supporting Information.')"), run("link", "concat('Figure S', f)", "'u'")]
    blocks = rows.select("paper", "p_partkey", F.lit(1).alias("pos"), F.expr(f"array({', '.join(said)})").alias("runs"))
    supplements = rows.select("paper", F.expr("inline(slice(array(struct(0 as ordinal, concat('si/', paper, 'a.md') as path, concat(paper, 'a') as doc), struct(1 as ordinal, concat('si/', paper, 'b.md') as path, concat(paper, 'b') as doc)), 1, cast(n as int)))"))
    objects = [("a", 0, "figure", "S0"), ("a", 1, "figure", "S1"), ("b", 0, "table", "0"), ("b", 1, "table", "s1"), ("b", 2, "table", "S2"), ("b", 3, "table", "S2")]
    made = rows.select("paper", F.inline(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("s", "pos", "kind", "label"), o, strict=True))) for o in objects))))
    anchored = supplement_links_.anchors(made.select(F.concat("paper", "s").alias("doc"), "pos", F.col("pos").cast("string").alias("id"), "kind", "label", F.lit(False).alias("continues"), F.array().cast("array<struct<text: string>>").alias("runs")))
    linked = supplement_links_.linked_runs(blocks, supplement_links_.targets(supplements, anchored))
    return linked.select("p_partkey", rendering.inline(F.col("runs")).alias("markdown"))


@query(
    "stale_stages",
    r"""WITH d AS (SELECT doc_id, doc_id::VARCHAR AS paper, sha256(text) AS t, sha256(lang || source) AS m FROM documents),
    now AS (SELECT *, sha256('normalise' || chr(10) || '2' || chr(10) || 'native=' || t) AS n FROM d WHERE doc_id % 7 > 0),
    wanted AS (SELECT doc_id, paper, 'normalise' AS stage, n AS digest FROM now
        UNION ALL SELECT doc_id, paper, 'identity', sha256('identity' || chr(10) || '1' || chr(10) || 'metadata=' || CASE WHEN doc_id % 4 = 1 THEN '-' ELSE m END || chr(10) || 'normalise<' || n) FROM now),
    old AS (SELECT *, sha256('normalise' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '2' ELSE '1' END || chr(10) || 'native=' || CASE WHEN doc_id % 3 = 0 THEN sha256('other') ELSE t END) AS n FROM d WHERE doc_id % 5 > 0),
    held AS (SELECT paper, 'normalise' AS stage, n AS was FROM old UNION ALL SELECT paper, 'identity', sha256('identity' || chr(10) || '1' || chr(10) || 'metadata=' || CASE WHEN doc_id % 4 = 1 THEN '-' ELSE m END || chr(10) || 'normalise<' || n) FROM old)
    SELECT paper, stage, CASE WHEN digest IS NULL THEN 'gone' WHEN was IS NULL THEN 'new' WHEN was <> digest THEN 'changed' ELSE 'current' END AS state FROM wanted FULL JOIN held USING (paper, stage)""",
)
def stale_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of ``documents`` against what was published of them: other texts, other rules, papers that are new or gone, a part that some lack."""
    docs = load(spark, sf_dir, "documents").withColumn("paper", F.col("doc_id").cast("string"))
    stages = lambda version: [reprocess.Stage("normalise", version, ("native",)), reprocess.Stage("identity", "1", ("metadata",), ("normalise",))]

    def parts(rows: DataFrame, text: str) -> DataFrame:
        native = rows.selectExpr("paper", "'native' as part", f"sha2({text}, 256) as sha256")
        return native.unionByName(rows.where("doc_id % 4 <> 1").selectExpr("paper", "'metadata' as part", "sha2(concat(lang, source), 256) as sha256"))

    wanted = reprocess.digests(parts(docs.where("doc_id % 7 > 0"), "text"), stages("2"))
    before = [reprocess.digests(parts(docs.where(f"doc_id % 5 > 0 and doc_id % 2 = {k}"), "if(doc_id % 3 = 0, 'other', text)"), stages(v)) for k, v in ((0, "2"), (1, "1"))]
    published = before[0].unionByName(before[1]).withColumns({"turn": F.lit(1).cast("long"), "path": F.lit("")})
    return reprocess.states(wanted, published).select("paper", "stage", "state")
