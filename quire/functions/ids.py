"""Identifiers, labels, names and dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import ascii_fold, once

# The shapes of identifiers, labels and file names.
DOI = r"10\.\d{4,9}/[^\s\"<>]+"
ARXIV = r"(?i)arXiv:\s*((?:\d{4}\.\d{4,5}|[a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?)"
TRAILING = r"[.,;:)\]}'\"]+$"
DOI_PREFIXES = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)"
FIGURE_LABEL = r"(?U)^\s*(?:Supplementary\s+)?(?:Fig\.?|Figure|FIG\.?)\s*(S?\d+[A-Za-z]?)\b"
INITIALS_NAME = r"^((?:[A-Z]\.?(?:-[A-Z]\.?)?[\s.]*){1,4}?)\s*([A-Z][a-z][A-Za-z'\u2019-]*)$"
ITEM_IDENTIFIER = r"(?i)\bPII:?\s*S?(\d{4}-\d{3}[\dX]\s*\(\d{2}\)\s*\d{5}-[\dX])"
TABLE_LABEL = r"(?U)^\s*(?:Supplementary\s+)?(?:Table|TABLE|Tab\.)\s*(S?(?:\d+|[IVXLC]+)[A-Za-z]?)\b"
SUPPLEMENT_TOKENS = ["supp", "suppl", "si", "sm", "esm", "supporting"]
#: How publishers name files: of the whole stem, or of the stem without a copy's number, and the DOI by the pattern's groups.
WHOLE, CUT = "stem", "base"
PUBLISHER_FILES = [
    (WHOLE, r"(?i)\b(PhysRev(?:Lett|Applied|Fluids|Materials|Research|[A-EX])?|RevModPhys)\.(\d+)\.(\d+)\b", "10.1103/$1.$2.$3"),
    (WHOLE, r"(?i)\b(josa|josaa|josab|ao|ol|oe|optica|ome|boe|prj)-(\d+)-(\d+)-(\d+)\b", "10.1364/$1.$2.000000$4"),
    (WHOLE, r"(?i)\b(s\d{5}-\d{3}-\d{5}-[\dxyz])\b", "10.1038/$1"),
    (WHOLE, r"\b((?:rspa|rspb|rsta|rstb|rsif|rsos)\.\d{4}\.\d{4})\b", "10.1098/$1"),
    (CUT, r"(?i)^([a-z]{2}\d{6,7}[a-z]?)$", "10.1021/$1"),
    (CUT, r"(?i)^([a-z]{2}\d{10})$", "10.1039/$1"),
    (CUT, r"(?i)^([a-z]{2,8}\.\d{8,13})$", "10.1002/$1"),
    (CUT, r"(?i)^(bf\d{8})$", "10.1007/$1"),
    (WHOLE, r"\bS(\d{4})(\d{3}[\dX])([6-9]\d)(\d{5})([\dX])\b", "10.1016/$1-$2($3)$4-$5"),
    (CUT, r"^(\d{4}\.\d{4,5})(?:v\d+)?$", "10.48550/arXiv.$1"),
    (WHOLE, r"^(97[89]-\d{1,5}-\d{1,7}-\d{1,7}-[\dX])$", "10.1007/$1"),
    (CUT, r"^(97[89]-\d{1,5}-\d{1,7}-\d{1,7}-[\dX])$", "10.1007/$1"),
]


def normalize_doi(text: Column) -> Column:
    """A DOI without prefix and trailing punctuation, lower case; null where the rest is none."""
    return _checked_doi(_bare_doi(text))


def doi_once(text: Column) -> Column:
    """``normalize_doi`` for one field of many: its steps stand in the plan once, but are not compiled."""
    return once(_bare_doi(text), _checked_doi)


def _bare_doi(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text), DOI_PREFIXES, ""), TRAILING, "")


def _checked_doi(bare: Column) -> Column:
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), F.lower(bare))


def first_seen(values: Column) -> Column:
    """An array's values as first printed, those left out that an earlier one equals but for case."""

    def kept(found: Column) -> Column:
        low = F.transform(found, F.lower)
        return F.filter(found, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)

    return F.element_at(F.transform(F.array(values), kept), 1)


def doi_candidates(text: Column) -> Column:
    """DOIs in a text without trailing punctuation, as printed, first seen first, each once whatever its case."""
    return first_seen(F.transform(F.regexp_extract_all(text, F.lit(DOI), F.lit(0)), lambda x: F.regexp_replace(x, TRAILING, "")))


def arxiv_candidates(text: Column) -> Column:
    """arXiv identifiers in a text, first seen first, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ARXIV), F.lit(1)))


def arxiv_base(identifier: Column) -> Column:
    """An arXiv identifier without prefix and version."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(identifier), r"(?i)^arxiv:", ""), r"v\d+$", ""))


def figure_label(caption: Column) -> Column:
    """The figure's number that a caption begins with (``2``, ``S1``, ``3b``); null where it begins with none."""
    return F.nullif(F.regexp_extract(caption, FIGURE_LABEL, 1), F.lit(""))


def table_label(caption: Column) -> Column:
    """The table's number that a caption begins with, Arabic or Roman (``1``, ``III``, ``S2``); null where it begins with none."""
    return F.nullif(F.regexp_extract(caption, TABLE_LABEL, 1), F.lit(""))


def equation_label(latex: Column) -> Column:
    """The last ``\\tag``, trimmed; null where there is none or it is blank."""
    return F.nullif(F.trim(F.try_element_at(F.regexp_extract_all(latex, F.lit(r"\\tag\*?\{([^{}]*)\}"), F.lit(1)), F.lit(-1))), F.lit(""))


def supplement_name(name: Column) -> Column:
    """Whether a file name's tokens say that it is a supplement."""
    stem = F.regexp_replace(F.regexp_replace(F.lower(name), r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return F.exists(F.split(stem, "[^a-z0-9]+"), lambda t: t.isin(SUPPLEMENT_TOKENS) | t.startswith("supplement"))


def filename_dois(name: Column) -> Column:
    """DOIs that a file name encodes by its publisher's custom, normalised, each once."""
    stem = F.regexp_replace(F.regexp_replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), r"^.*/", ""), r"(?i)\.pdf$", "")
    part = {WHOLE: stem, CUT: F.regexp_replace(stem, r"[-_ ]\d$", "")}

    def made(of: str, pattern: str, doi: str) -> Column:
        return F.transform(F.regexp_extract_all(part[of], F.lit(pattern), F.lit(0)), lambda x: F.regexp_replace(x, pattern, doi))

    found = F.concat(*(made(*row) for row in PUBLISHER_FILES))
    padded = F.transform(found, lambda x: F.when(x.startswith("10.1364/"), F.regexp_replace(x, r"(?<=\.)0+(\d{6,})$", "$1")).otherwise(x))
    return F.array_distinct(F.filter(F.transform(padded, normalize_doi), lambda x: x.isNotNull()))


def split_name(name: Column) -> Column:
    """Initials and surname as (given, family), where a name is one to four initials and one capitalised surname; else null."""

    def parts(words: Column) -> Column:
        given = F.trim(F.regexp_extract(words, INITIALS_NAME, 1))
        return F.when(words.rlike(INITIALS_NAME) & (given != ""), F.struct(given.alias("given"), F.regexp_extract(words, INITIALS_NAME, 2).alias("family")))

    return once(F.trim(F.regexp_replace(name, r"\s+", " ")), parts)


def bibtex_authors(names: Column) -> Column:
    """The names of a BibTeX author field as (given, family, sequence): ``Family, Given`` or ``Given Family``."""

    def person(name: Column, i: Column) -> Column:
        comma = F.split(name, ",", 2)
        words = F.split(F.trim(name), r"\s+")
        family = F.when(name.contains(","), F.trim(F.get(comma, F.lit(0)))).otherwise(F.element_at(words, -1))
        given = F.when(name.contains(","), F.trim(F.get(comma, F.lit(1)))).otherwise(F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "))
        return F.struct(F.nullif(given, F.lit("")).alias("given"), family.alias("family"), F.when(i == 0, "first").otherwise("additional").alias("sequence"))

    return F.transform(F.split(F.trim(names), r"\s+and\s+"), person)


def weak_dois(value: Column) -> Column:
    """DOIs that printed item identifiers (``PII: S0022-4073(81)90057-1``) suggest, in order."""
    return F.transform(F.regexp_extract_all(value, F.lit(ITEM_IDENTIFIER), F.lit(1)), lambda x: F.concat(F.lit("10.1016/"), F.replace(x, F.lit(" "), F.lit(""))))


def utc_time(given: Column) -> Column:
    """A date or time of ISO 8601 as given, where it is one and in UTC; a time without an offset is. Else null."""
    bare = F.regexp_replace(F.regexp_replace(given, r"(Z|[+-]00:?00(:?00)?)$", ""), "T", " ")
    day = given.rlike(r"^\d{4}-\d{2}-\d{2}$")
    time = given.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?(Z|[+-]00:?00(:?00)?)?$")
    full = F.when(bare.rlike(r" \d{2}$"), F.concat(bare, F.lit(":00:00"))).when(bare.rlike(r" \d{2}:\d{2}$"), F.concat(bare, F.lit(":00"))).otherwise(F.replace(bare, F.lit(","), F.lit(".")))
    return F.when((day & given.try_cast("date").isNotNull()) | (time & full.try_cast("timestamp_ntz").isNotNull()), given)


def label_order(label: Column) -> list[Column]:
    """Keys that sort printed labels as people do: by length, then by text."""
    return [F.length(label), label]


def stable_shard(key: Column, shards: int) -> Column:
    """The key's SHA-256 as one number, modulo ``shards``."""
    digits = F.transform(F.filter(F.split(F.sha2(key, 256), ""), lambda c: c != ""), lambda c: F.conv(c, 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda a, d: (a * 16 + d) % shards)


def content_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` and twelve hex digits of the parts' SHA-256."""
    return F.concat(F.lit(f"{prefix}_"), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(12)))


def library_shard(layout: str, validated: Column, year: Column, family: Column) -> Column:
    """A paper's folder in a layout: flat, by-year or by-initial."""
    if layout == "flat":
        return F.lit("")
    if layout == "by-year":
        return F.when(validated & year.isNotNull(), year.cast("string")).otherwise("unverified")
    initial = F.upper(F.left(F.regexp_replace(ascii_fold(family), "[^A-Za-z]", ""), F.lit(1)))
    return F.when(validated & (initial != ""), initial).otherwise("unverified")


def pages(selection: Column) -> Column:
    """The pages of ``1-3,15``, in order, each once; null for what is no selection."""
    part = lambda p: F.sequence(F.regexp_extract(p, r"^(\d+)", 1).cast("int"), F.regexp_extract(p, r"(\d+)$", 1).cast("int"))
    good = selection.rlike(r"^\s*\d+(-\d+)?(\s*,\s*\d+(-\d+)?)*\s*$")
    return F.when(good, F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(F.regexp_replace(selection, r"\s", ""), ","), part)))))


def years(text: Column) -> Column:
    """Years 1500 to 2099 printed in a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(1[5-9]\d\d|20\d\d)\b"), F.lit(1)))
