"""A saved web page against the extraction of the same paper: identity first, then five comparisons and their findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import bags, compare
from quire.sources.shared import materialize

#: Characters of body text that a whole article has at least.
LEAST_CHARACTERS = 3000
TABLE_CODES = {"only_in_page": ("HTML_TABLE_NOT_IN_PDF", "warning"), "not_comparable": ("HTML_TABLE_NOT_COMPARABLE", "info"), "agrees": ("HTML_TABLE_AGREED", "info"), "differs": ("HTML_TABLE_DISAGREED", "warning")}


def identity(page_doi: Column, paper_doi: Column, page_title: Column, paper_title: Column) -> Column:
    """same_doi, mismatch (two different DOIs), same_title (where a side has no DOI) or unconfirmed."""
    page, paper = (F.nullif(F.lower(x), F.lit("")) for x in (page_doi, paper_doi))
    bare = lambda t: F.nullif(F.array_join(text.words(F.coalesce(t, F.lit(""))), ""), F.lit(""))
    same = F.coalesce(bare(page_title) == bare(paper_title), F.lit(False))
    return F.when(page.isNotNull() & paper.isNotNull(), F.when(page == paper, "same_doi").otherwise("mismatch")).when(same, "same_title").otherwise("unconfirmed")


def compared(status: Column) -> Column:
    """Whether a page of that identity is compared at all."""
    return status.isin("same_doi", "same_title")


def _finding(rows: DataFrame, code: str, severity: str, detail: Column | None = None) -> DataFrame:
    return rows.select("doc", F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(None).cast("string") if detail is None else detail.cast("string")).alias("detail"))


def _by_status(rows: DataFrame, codes: dict[str, tuple[str, str]]) -> DataFrame:
    """Findings of labelled objects, code and severity by their status."""
    of = lambda k: F.try_element_at(F.create_map(*(F.lit(x) for status, found in codes.items() for x in (status, found[k]))), F.col("status"))
    return rows.select("doc", of(0).alias("code"), of(1).alias("severity"), F.col("label").alias("detail")).where("code is not null")


def heading_differences(page: DataFrame, paper: DataFrame) -> DataFrame:
    """(doc, side, text): headings (doc, text) that only the page, or only the paper, has, by their words."""
    key = F.array_join(text.words(F.col("text")), "")
    keyed = lambda rows: rows.withColumn("key", key).where("key <> ''").groupBy("doc", "key").agg(F.first("text").alias("text"))
    a, b = keyed(page), keyed(paper)
    only = lambda x, y, side: x.join(y.select("doc", "key"), ["doc", "key"], "left_anti").select("doc", F.lit(side).alias("side"), "text")
    return only(a, b, "page").unionByName(only(b, a, "paper"))


def caption_status(page: DataFrame, paper: DataFrame) -> DataFrame:
    """(doc, label, status, ratio) of the page's figures (doc, label, caption): only_in_page, agrees or differs."""
    first = paper.where("label is not null and caption is not null").groupBy("doc", "label").agg(F.first("caption").alias("_other"), F.lit(True).alias("_there"))
    rows = page.join(first, ["doc", "label"], "left").withColumn("ratio", compare.word_ratio(F.col("caption"), F.col("_other")))
    status = F.when(F.col("_there").isNull(), "only_in_page").when(F.col("ratio") >= compare.CAPTION_RATIO, "agrees").otherwise("differs")
    return rows.select("doc", "label", status.alias("status"), "ratio")


def table_status(page: DataFrame, paper: DataFrame, math: DataFrame | None = None) -> DataFrame:
    """(doc, label, status, shared, only_page, only_paper, word_share) of the page's labelled tables (doc, label, text).

    Tables agree where they hold the same numbers as often. ``math`` (doc, label, cells) counts cells that the page shows
    as pictures: a table with such cells and no number can't be compared.
    """
    key = F.concat_ws("\u0001", "doc", "label")
    labelled = lambda rows: rows.where("label is not null").groupBy("doc", "label").agg(F.first("text").alias("text")).withColumn("_k", key)
    a, b = labelled(page), labelled(paper)
    counts = bags.compare(bags.numbers(a, "_k", "text"), bags.numbers(b.join(a.select("_k"), "_k", "left_semi"), "_k", "text"), "_k")
    rows = a.select("doc", "label", "_k", F.col("text").alias("_own")).join(b.select("_k", F.col("text").alias("_other"), F.lit(True).alias("_there")), "_k", "left").join(counts, "_k", "left")
    rows = rows.join(math, ["doc", "label"], "left") if math is not None else rows.withColumn("cells", F.lit(0))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = F.when(F.col("_there").isNull(), "only_in_page").when((n("shared") + n("only_left") == 0) & (n("cells") > 0), "not_comparable").when(n("only_left") + n("only_right") == 0, "agrees").otherwise("differs")
    share = F.when(F.col("_there"), F.round(compare.word_share(text.words(F.col("_own")), text.words(F.col("_other"))), 3))
    return rows.select("doc", "label", status.alias("status"), n("shared").alias("shared"), n("only_left").alias("only_page"), n("only_right").alias("only_paper"), share.alias("word_share"))


def reference_counts(page: DataFrame, paper: DataFrame) -> DataFrame:
    """(doc, page, paper, dois): references of either side (doc, pos, text), and the DOIs that the page's print, in order."""
    from quire.functions import ids

    of_page = page.groupBy("doc").agg(F.count(F.lit(1)).alias("page"), ids.first_seen(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", ids.doi_candidates(F.col("text")).alias("d")))), lambda x: x["d"]))).alias("dois"))
    of_paper = paper.groupBy("doc").agg(F.count(F.lit(1)).alias("paper"))
    return of_page.join(of_paper, "doc", "full").select("doc", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("paper", F.lit(0)).alias("paper"), F.coalesce("dois", F.array().cast("array<string>")).alias("dois"))


def check(pages: DataFrame, parts: dict[str, tuple[DataFrame, DataFrame]], math: DataFrame | None = None) -> DataFrame:
    """(doc, code, severity, detail): the findings of saved pages (doc, page_doi, paper_doi, page_title, paper_title, characters).

    ``parts``: of headings, paragraphs, figures, tables and references, the page's rows and the paper's, as the functions
    here take them (paragraphs: doc, pos, text). A page of another work, or of none that can be told, has one finding, and
    nothing of it is compared.
    """
    rows = pages.withColumn("status", identity(*(F.col(c) for c in ("page_doi", "paper_doi", "page_title", "paper_title"))))
    rows = materialize(rows, "saved_pages")
    good = rows.where(compared(F.col("status"))).select("doc", "characters")
    here = lambda name: tuple(side.join(good.select("doc"), "doc", "left_semi") for side in parts[name])
    found = [
        _finding(rows.where("status = 'mismatch'"), "HTML_VERSION_MISMATCH", "error", F.concat_ws(" / ", "page_doi", "paper_doi")),
        _finding(rows.where("status in ('same_title', 'unconfirmed')"), "HTML_IDENTITY_UNCONFIRMED", "warning", F.col("status")),
        _finding(good.where(F.col("characters") < LEAST_CHARACTERS), "HTML_INCOMPLETE", "warning", F.col("characters")),
    ]
    if "headings" in parts:
        found.append(_finding(heading_differences(*here("headings")).where("side = 'page'"), "HTML_HEADING_NOT_IN_PDF", "warning", F.col("text")))
    if "paragraphs" in parts:
        own, other = here("paragraphs")
        absent = uncovered_of_own(own, other)
        found.append(_finding(absent.groupBy("doc").agg(F.count(F.lit(1)).alias("n")), "HTML_TEXT_NOT_IN_PDF", "warning", F.col("n")))
    if "figures" in parts:
        found.append(_by_status(caption_status(*here("figures")), {"only_in_page": ("HTML_FIGURE_NOT_IN_PDF", "warning"), "differs": ("HTML_CAPTION_DIFFERS", "warning")}))
    if "tables" in parts:
        found.append(_by_status(table_status(*here("tables"), math), TABLE_CODES))
    if "references" in parts:
        counts = reference_counts(*here("references")).where("page > 0 and page <> paper")
        found.append(_finding(counts, "HTML_REFERENCES_DIFFER", "warning", F.concat_ws(" / ", "page", "paper")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def uncovered_of_own(page: DataFrame, paper: DataFrame) -> DataFrame:
    """(doc, pos, share): paragraphs (doc, pos, text) of pages of which the same document's paper has less than half.

    Paragraphs under twelve words are left out; the join is on document and hashes of six-word runs.
    """
    return compare.uncovered_within(page, paper, ["doc", "pos"], ["doc"])
