"""Column expressions over whole texts, built from Spark SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The separators between words: \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"


def quoted(name: str) -> str:
    """A column's name as SQL takes it, whatever characters are in it."""
    return "`" + name.replace("`", "``") + "`"


def every(rows: DataFrame) -> list[Column]:
    """All columns of ``rows``, dots and quotes in their names or not."""
    return [F.col(quoted(c)) for c in rows.columns]


def fresh(rows: DataFrame, name: str) -> str:
    """A column name that ``rows`` doesn't have, without regard to case."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES, -1))


def n_words(text: Column) -> Column:
    """The number of words of a text (long); 0 for null."""
    return F.size(words(text)).cast("long")


def n_of(text: Column, chars: str) -> Column:
    """How many characters of a text the regex class ``chars`` matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{chars}+", ""))).cast("long")
