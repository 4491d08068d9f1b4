"""BibTeX entries of identified works, written by expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.operators.export import citation_key

# Characters with a meaning of their own, in the order in which they are replaced; types of entries, and where a work's container goes.
ESCAPES = [("\\", "\\textbackslash{}"), ("&", "\\&"), ("%", "\\%"), ("#", "\\#"), ("$", "\\$"), ("_", "\\_"), ("{", "\\{"), ("}", "\\}"), ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}")]
TYPES = {"journal-article": "article", "proceedings-article": "inproceedings", "book-chapter": "incollection", "book": "book", "edited-book": "book", "monograph": "book", "reference-book": "book"}
CONTAINERS = {"article": "journal", "book": "series", "techreport": "institution", "report": "institution", "phdthesis": "school", "mastersthesis": "school", "thesis": "school"}
GIVEN_TYPE = "bibtex:"


def escaped(text: Column) -> Column:
    """A text with BibTeX's special characters escaped, one after the other."""
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), ESCAPES, text)


def protected(title: Column) -> Column:
    """A title whose words with a capital behind their first letter stand in braces, so that styles keep their case."""
    inner = lambda w: F.regexp_replace(w, r"\P{L}", "").rlike(r"^.+\p{IsUppercase}")
    return F.array_join(F.transform(F.split(title, " ", -1), lambda w: F.when(inner(w), F.concat(F.lit("{"), w, F.lit("}"))).otherwise(w)), " ")


def people(names: Column) -> Column:
    """Authors (given, family, literal) as "family, given" or "{literal}", joined by "and"; those without a name are left out."""
    has = lambda x: F.coalesce(x, F.lit("")) != ""
    given = lambda p: F.when(has(p["given"]), F.concat(F.lit(", "), escaped(p["given"]))).otherwise("")
    one = lambda p: F.when(has(p["family"]), F.concat(escaped(p["family"]), given(p))).when(has(p["literal"]), F.concat(F.lit("{"), escaped(p["literal"]), F.lit("}")))
    return F.array_join(F.array_compact(F.transform(names, one)), " and ")


def entry(work: Column) -> Column:
    """The entry of a work: a struct of article_type, authors, editors, title, journal, year, volume, issue, pages, article_number, publisher, url, asserted, doi.

    Null members are left out. A type ``bibtex:x`` is x; an unknown one is misc. The key is that of the first author's, or else editor's, family, the year and the title.
    """
    f = lambda name: work[name]
    typed = lambda table, key: F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)
    article = F.coalesce(f("article_type"), F.lit(""))
    kind = F.when(article.startswith(GIVEN_TYPE), F.substr(article, F.lit(len(GIVEN_TYPE) + 1))).otherwise(F.coalesce(typed(TYPES, article), F.lit("misc")))
    container = F.coalesce(typed(CONTAINERS, kind), F.lit("booktitle"))
    some = lambda names: F.coalesce(F.size(names), F.lit(0)) > 0
    repeated = container.isin("institution", "school") & f("publisher").eqNullSafe(f("journal"))
    pages = F.regexp_replace(F.replace(f("pages"), F.lit("--"), F.lit("-")), "^([^-]*)-", "$1--")
    fields = [
        (F.lit("author"), F.when(some(f("authors")), people(f("authors")))), (F.lit("editor"), F.when(some(f("editors")), people(f("editors")))), (F.lit("title"), protected(escaped(f("title")))), (container, escaped(f("journal"))), (F.lit("year"), f("year").cast("string")),
        (F.lit("volume"), escaped(f("volume"))), (F.lit("number"), escaped(f("issue"))), (F.lit("pages"), escaped(pages)), (F.lit("eid"), escaped(f("article_number"))), (F.lit("publisher"), F.when((kind != "article") & ~repeated, escaped(f("publisher")))),
        (F.lit("url"), F.when(F.coalesce(f("asserted"), F.lit(False)), f("url"))), (F.lit("doi"), f("doi")), (F.lit("url"), F.concat(F.lit("https://doi.org/"), f("doi"))), (F.lit("note"), F.when(article == "posted-content", F.lit("Preprint"))),
    ]
    lines = F.array_compact(F.array(*(F.concat(F.lit("  "), name, F.lit(" = {"), value, F.lit("}")) for name, value in fields)))
    lead = F.get(F.when(some(f("authors")), f("authors")).otherwise(f("editors")), F.lit(0))
    key = citation_key(F.coalesce(F.nullif(lead["family"], F.lit("")), lead["literal"], F.lit("anonymous")), f("year"), F.coalesce(f("title"), F.lit("")))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}\n"))
