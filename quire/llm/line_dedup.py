"""Line dedup by site-relative frequency, by Spark SQL functions alone.

For each host: the pages that contain a line, over the host's pages. Lines over a ratio are boilerplate.
A host has at most (mean distinct lines of a page) / ratio of them, so a host's boilerplate is one short
array of hashes whatever its size; pages join it by host and drop lines in place. No text is shuffled
where the hosts' arrays are small enough to be sent to all executors; a hot host is split by adaptive
execution where they are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import native
from quire.sources.shared import materialize

#: A line is boilerplate on over this share of its host's pages, if on as many pages at least: on a host of fewer
#: than 1 / RATIO pages any line of a single page would exceed the share.
RATIO, LEAST_PAGES = 0.02, 5


def line_key(line: Column) -> Column:
    """A line's hash, blanks at its ends aside."""
    return F.xxhash64(F.btrim(line, F.lit(native.SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(native.SPACE)) != ""


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, n_pages, bad): each host's pages and the hashes of its boilerplate lines, from (host, text)."""
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _has_word), line_key))
    each = pages.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    often = each.join(total.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h"))).where(F.col("n") > ratio * F.col("n_pages"))
    bad = often.groupBy("host").agg(F.collect_list("line").alias("bad"))
    return total.join(bad.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h")), "left").select("host", "n_pages", F.coalesce("bad", F.array().cast("array<bigint>")).alias("bad"))


def _stripped(docs: DataFrame, host: str, ratio: float, least_pages: int) -> tuple[DataFrame, str, str]:
    """``docs`` with boilerplate taken out of ``text``, two more columns, and their names: lines with a word, and those dropped."""
    text = F.col("text").cast("string")
    own, bad, before, good, lines, dropped = (native.fresh(docs, n) for n in ("host_key", "bad", "before", "good", "lines", "dropped"))
    found = materialize(boilerplate(docs.select(F.col(host).cast("string").alias("host"), text.alias("text")), ratio, least_pages).select(F.col("host").alias(own), F.col("bad").alias(bad)), "boilerplate")
    rows = docs.join(found, F.col(host).cast("string").eqNullSafe(F.col(own)), "left").withColumn(before, _lines(text))
    left = F.filter(F.col(before), lambda x: ~(_has_word(x) & F.array_contains(F.col(bad), line_key(x))))
    rows = rows.withColumn(good, F.when(F.size(bad) > 0, left).otherwise(F.col(before)))
    kept = F.when(text.isNotNull(), F.array_join(good, "\n"))
    columns = [kept.alias("text") if c == "text" else F.col(native.quoted(c)) for c in docs.columns]
    return rows.select(*columns, F.size(F.filter(F.col(before), _has_word)).cast("long").alias(lines), (F.size(before) - F.size(good)).cast("long").alias(dropped)), lines, dropped


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; ``lines`` and ``dropped`` are added.

    All rows stay, with all their columns; lines and dropped (long) count lines with a word. Lines compare
    without blanks at their ends, and count once a page. A null host is a host of its own. Null texts
    stay null; blank lines are never dropped; other lines keep their order. Repeated rows each count as a
    page. An empty table gives an empty result. Columns named lines or dropped are replaced.
    """
    out, lines, dropped = _stripped(docs, host, ratio, least_pages)
    columns = [F.col(native.quoted(c)) for c in docs.columns if c.lower() not in ("lines", "dropped")]
    return out.select(*columns, F.col(lines).alias("lines"), F.col(dropped).alias("dropped"))


def cleaned(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows and columns of ``docs``, in order, with boilerplate lines dropped and n_chars counted anew.

    Nulls, blank lines, repeated rows and empty tables fare as in ``drop_boilerplate``; extra columns of any
    name keep their values.
    """
    out = _stripped(docs, host, RATIO, LEAST_PAGES)[0]
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*native.every(docs))
