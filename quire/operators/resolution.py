"""From evidence to identity: DOI candidates, their records, searches and what a user asserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import ids, text
from quire.operators import figures
from quire.operators.identity import NEAR_WORDS, forms_agreement, title_agreement, title_forms

# Sources of evidence in the order in which they are read, and those that identify the article itself.
SOURCES = ["pdf_information", "pdf_information_pii", "page_1_furniture", "file_name", "fingerprint", "arxiv_identifier", "page_1_text"]
STRONG = ["pdf_information", "page_1_furniture"]
#: Candidates that are looked up, titles that are searched, characters of a query and of a hint.
MOST_CANDIDATES, SEARCH_TITLES, QUERY_CHARACTERS, HINT_CHARACTERS = 5, 3, 300, 160
FILE_NOISE = ["online", "main", "sm", "si", "pdf", "supplementary"]
SUPPLEMENT_TITLE = r"(?i)^\s*(?:electronic\s+)?(?:supplementary|supplemental|supporting)\s+(?:information|materials?|data)\b"
ACCEPTED = ["VALIDATED", "VALIDATED_WITH_WARNINGS"]


def validated(status: Column) -> Column:
    """Whether a registry record confirmed the identity."""
    return F.coalesce(status.isin(ACCEPTED), F.lit(False))


def named(status: Column) -> Column:
    """Whether the identity may name directories and citations: validated, or asserted by the user."""
    return validated(status) | F.coalesce(status == "ASSERTED", F.lit(False))


def strong(sources: Column) -> Column:
    """Whether one of a candidate's sources is the article's own metadata."""
    return F.arrays_overlap(sources, F.array(*map(F.lit, STRONG)))


def collect_candidates(evidence: DataFrame) -> DataFrame:
    """(doc, doi, sources, strong, rank): distinct DOIs of ``evidence`` (doc, source, seq, value), strong ones first.

    ``source`` is one of ``SOURCES``; ``seq`` orders a source's values. Texts give the DOIs they print, file names those
    they encode, arXiv identifiers their registered DOI, and item identifiers of the information dictionary a weak DOI.
    Otherwise the order is that in which the sources are read.
    """
    at = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    arxiv = F.array(F.concat(F.lit("10.48550/arXiv."), ids.arxiv_base(F.col("value"))))
    found = F.when(F.col("source") == "file_name", ids.filename_dois(F.col("value"))).when(F.col("source") == "arxiv_identifier", arxiv).when(F.col("source") == "fingerprint", F.array("value")).otherwise(ids.doi_candidates(F.col("value")))
    weak = evidence.where("source = 'pdf_information'").select("doc", F.lit("pdf_information_pii").alias("source"), F.lit(2).alias("at"), "seq", F.posexplode(ids.weak_dois(F.col("value"))).alias("nth", "raw"))
    rows = evidence.select("doc", "source", at.alias("at"), "seq", F.posexplode(found).alias("nth", "raw")).unionByName(weak)
    rows = rows.select("doc", "source", F.struct("at", "seq", "nth").alias("place"), ids.normalize_doi(F.col("raw")).alias("doi")).where("doi is not null")
    per_source = rows.groupBy("doc", "doi", "source").agg(F.min("place").alias("place"))
    each = per_source.groupBy("doc", "doi").agg(F.min("place").alias("place"), F.transform(F.array_sort(F.collect_list(F.struct("place", "source"))), lambda s: s["source"]).alias("sources"))
    order = Window.partitionBy("doc").orderBy(F.col("strong").desc(), "place")
    return each.withColumn("strong", strong(F.col("sources"))).withColumn("rank", F.row_number().over(order)).select("doc", "doi", "sources", "strong", "rank")


def title_candidates(blocks: DataFrame, most: int = 4) -> DataFrame:
    """(doc, title, rank): a document's plausible titles: those of ``blocks`` (doc, priority, pos, value), each once.

    ``priority`` tells the kinds of places apart, lowest first: the main heading, the information dictionary, other
    headings. Titles that are the same key count once; at most ``most`` stay.
    """
    rows = blocks.select("doc", "priority", "pos", text.clean_title(F.col("value")).alias("title")).where(text.plausible_title(F.col("title")))
    rows = rows.withColumn("key", text.title_key(F.col("title"))).where("key <> ''")
    each = rows.groupBy("doc", "key").agg(F.min(F.struct("priority", "pos", "title")).alias("first"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy("first")))
    return ranked.where(F.col("rank") <= most).select("doc", "first.title", "rank")


def resolve(candidates: DataFrame, records: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc, doi, place, outcome): the first five candidates in the order in which they are tried.

    ``records`` (doi, title) are the registry's, ``titles`` (doc, title) the main ones. Candidates whose record has the
    main title go first. outcome: accepted for the first whose record's title isn't different, after_accepted for those
    behind it, rejected, or not_registered.
    """
    few = candidates.where(F.col("rank") <= MOST_CANDIDATES).select("doc", "doi", "rank")
    rows = few.join(records.select("doi", F.col("title").alias("registered"), F.lit(True).alias("known")), "doi", "left")
    # a document's title is read once, not once a candidate
    rows = title_forms(rows, "registered", "registered").join(title_forms(titles.select("doc", "title"), "title", "observed", NEAR_WORDS), "doc", "left")
    rows = forms_agreement(rows, "observed", "registered")
    fits = F.coalesce(F.col("known"), F.lit(False)) & F.col("observed").isNotNull() & F.col("registered").isNotNull() & (F.col("agreement") != "different")
    order = Window.partitionBy("doc").orderBy(F.col("fits").desc(), "rank")
    rows = rows.withColumn("fits", fits).withColumn("place", F.row_number().over(order))
    won = F.min(F.when(F.col("fits"), F.col("place"))).over(Window.partitionBy("doc"))
    outcome = F.when(F.col("place") == F.col("won"), "accepted").when(F.col("place") > F.col("won"), "after_accepted").when(F.col("known").isNull(), "not_registered").otherwise("rejected")
    return rows.withColumn("won", won).select("doc", "doi", "place", outcome.alias("outcome"))


def file_hint(name: Column) -> Column:
    """A descriptive file name as words to search; empty without two words of three letters."""
    stem = F.regexp_replace(F.regexp_replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), r"^.*/", ""), r"(?i)\.pdf$", "")
    telling = F.filter(F.split(stem, r"[\s_]+"), lambda w: ~F.lower(w).isin(FILE_NOISE))
    long = F.filter(telling, lambda w: F.length(F.regexp_replace(w, "[^A-Za-z]", "")) >= 3)
    return F.when(F.size(long) >= 2, F.array_join(telling, " ")).otherwise("")


def search_queries(titles: DataFrame, hints: DataFrame) -> DataFrame:
    """(doc, ordinal, query): the first three titles (doc, title, rank), then the first one with the ``hints`` (doc, seq, hint).

    Each query comes once, the last one cut at 300 characters; a hint of over 160 characters is cut.
    """
    cleaned = titles.where(F.col("rank") <= SEARCH_TITLES).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.clean_title(F.col("title")).alias("t")))), lambda x: x["t"]).alias("cleaned"))
    extra = hints.where("hint <> ''").groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.left("hint", F.lit(HINT_CHARACTERS)).alias("h")))), lambda x: x["h"]).alias("extra"))
    rows = cleaned.join(extra, "doc", "left")
    rich = F.left(F.array_join(F.concat(F.slice("cleaned", 1, 1), F.coalesce("extra", F.array().cast("array<string>"))), " "), F.lit(QUERY_CHARACTERS))
    return rows.select("doc", F.posexplode(F.array_distinct(F.concat("cleaned", F.array(rich)))).alias("ordinal", "query"))


def corroborate(hits: DataFrame, titles: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds title, author and year (pass or fail) and accepted to ``hits`` (doc, doi, title, subtitle, family, years).

    A title passes if one of the document's titles (doc, title) is the same as the hit's, with or without its subtitle,
    or near it; the first author's family name and one of the years must be printed on the first pages (doc, page_text).
    """
    forms = F.array_compact(F.array("title", F.when(F.col("subtitle").isNotNull(), F.concat_ws(" ", "title", "subtitle"))))
    pairs = hits.select("doc", "doi", F.explode(forms).alias("registered")).join(titles.select("doc", F.col("title").alias("observed")), "doc")
    graded = title_agreement(pairs, "observed", "registered").groupBy("doc", "doi").agg(F.bool_or(F.col("agreement") != "different").alias("same"))
    rows = hits.join(graded, ["doc", "doi"], "left").join(pages.select("doc", "page_text"), "doc", "left")
    check = lambda good: F.when(F.coalesce(good, F.lit(False)), "pass").otherwise("fail")
    printed = figures.printed_family(text.title_key(F.coalesce("family", F.lit(""))), F.coalesce("page_text", F.lit("")))
    years = F.arrays_overlap(F.transform("years", lambda y: y.cast("string")), ids.years(F.coalesce("page_text", F.lit(""))))
    out = rows.withColumns({"title_check": check(F.col("same")), "author_check": check(printed), "year_check": check(years)})
    return out.withColumn("accepted", F.expr("title_check = 'pass' and author_check = 'pass' and year_check = 'pass'")).drop("same", "page_text")


def choose(hits: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc, doi, outcome) for accepted ``hits`` (doc, doi, type, relations, volume, pages, article_number).

    Components are set aside, and originals whose translation is among the hits. Of several left, those whose volume and
    first page the document cites (``tokens``: doc, page_words, file_words) stay, where there are any: first by the words of
    pages and file names, then by those of the file names. One left is accepted; several are ambiguous.
    """
    rows = hits.join(tokens, "doc", "left")
    originals = hits.where("type <> 'component'").select("doc", F.explode("relations").alias("r")).where("r.kind = 'is-translation-of'").select("doc", F.col("r.doi").alias("doi"), F.lit(True).alias("original")).distinct()
    rows = rows.join(originals, ["doc", "doi"], "left")
    aside = F.when(F.col("type") == "component", "search_component").when(F.col("original"), "translation_original")
    rows = rows.withColumn("outcome", aside)
    own = Window.partitionBy("doc")
    for words, reason in (("page_words", "search_not_cited"), ("file_words", "search_not_cited")):
        left = F.col("outcome").isNull()
        cited = left & figures.cites(F.col("volume"), F.col("pages"), F.col("article_number"), F.coalesce(words, F.array().cast("array<string>")))
        rows = rows.withColumn("_cited", cited).withColumns({"_some": F.max("_cited").over(own), "_n": F.sum(left.cast("int")).over(own)})
        rows = rows.withColumn("outcome", F.when(left & F.col("_some") & (F.col("_n") > 1) & ~F.col("_cited"), reason).otherwise(F.col("outcome"))).drop("_cited", "_some", "_n")
    n = F.sum(F.col("outcome").isNull().cast("int")).over(own)
    return rows.withColumn("_n", n).select("doc", "doi", F.coalesce("outcome", F.when(F.col("_n") == 1, "accepted").otherwise("search_ambiguous")).alias("outcome"))


def demote_supplements(identities: DataFrame, titles: DataFrame, names: DataFrame) -> DataFrame:
    """``identities`` (doc, status, doi) with supplement_of: what reads like a supplement isn't the article itself.

    A title (doc, title) that says so, or a file name (doc, name) of a supplement, makes an accepted identity UNVERIFIED and
    its DOI that of the article to which the supplement belongs.
    """
    by_title = titles.where(F.col("title").rlike(SUPPLEMENT_TITLE)).select("doc")
    by_name = names.where(ids.supplement_name(F.col("name"))).select("doc")
    rows = identities.join(by_title.union(by_name).distinct().withColumn("_supplement", F.lit(True)), "doc", "left")
    down = F.coalesce(F.col("_supplement"), F.lit(False)) & named(F.col("status"))
    return rows.select("doc", F.when(down, "UNVERIFIED").otherwise(F.col("status")).alias("status"), F.when(~down, F.col("doi")).alias("doi"), F.when(down, F.col("doi")).alias("supplement_of"))


def asserted(identities: DataFrame, assertions: DataFrame) -> DataFrame:
    """``identities`` (doc, status, doi) with what the user says of them: ``assertions`` (doc, asserted_doi, bibtex).

    A DOI that a lookup had validated stays validated; any other, and a BibTeX entry, makes the identity ASSERTED.
    """
    rows = identities.join(assertions, "doc", "left")
    said = F.col("asserted_doi").isNotNull() | F.col("bibtex").isNotNull()
    same = validated(F.col("status")) & F.coalesce(F.col("doi") == ids.normalize_doi(F.col("asserted_doi")), F.lit(False))
    return rows.select("doc", F.when(said & ~same, "ASSERTED").otherwise(F.col("status")).alias("status"), F.coalesce(ids.normalize_doi(F.col("asserted_doi")), "doi").alias("doi"))
