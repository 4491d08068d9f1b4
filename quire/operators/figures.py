"""Figures against their pages: sentences that cite them, printed strings, names and locations."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text
from quire.operators.scanners import json_object

#: Characters of a region that can confirm anything, of a string that says something, of a context.
LEAST_REGION, LEAST_STRING, LONGEST_CONTEXT = 20, 3, 600
#: Hyphens that join words, and characters that no printed string is compared by.
_WORD_HYPHEN, _NOT_PRINTED = re.compile(r"-(?!\d)"), re.compile(r"[^\w.+\-]")


def citing_sentence(blocks: DataFrame, figures: DataFrame, doc: str, pos: str, body: str) -> DataFrame:
    """(doc, label, sentence) for each figure of ``figures`` (doc, label): the first sentence that cites it.

    Blocks and figures meet by document; a figure that no block cites, or without a label, has no sentence.
    """
    label = F.regexp_replace("label", r"([^A-Za-z0-9])", r"\\$1")
    pattern = F.concat(F.lit(r"\b(?:Fig\.?|Figure|FIG\.?)\s*"), label, F.lit(r"\b"))
    rows = figures.select(doc, "label", pattern.alias("_p")).join(blocks.select(doc, pos, F.col(body).alias("_t")), doc).where(F.expr("_t rlike _p"))
    first = rows.groupBy(doc, "label").agg(F.min_by(F.struct("_t", "_p"), pos).alias("_b")).select(doc, "label", "_b.*")
    first = first.withColumns({"_head": F.expr("split(_t, _p, 2)[0]"), "_rest": F.expr("split(_t, _p, 2)[1]"), "_cite": F.expr("regexp_extract(_t, _p, 0)")})
    tail = F.when(F.col("_rest").contains(". "), F.concat(F.substring_index("_rest", ". ", 1), F.lit("."))).otherwise(F.col("_rest"))
    sentence = F.left(F.concat(F.substring_index("_head", ". ", -1), "_cite", tail), F.lit(LONGEST_CONTEXT))
    return figures.select(doc, "label").distinct().join(first.select(doc, "label", sentence.alias("sentence")), [doc, "label"], "left")


def printed_family(family: Column, page: Column) -> Column:
    """Whether a family name's title key is printed as words, affiliation digits aside.

    A blank inside the key may stand for a letter that the record lost.
    """
    pattern = F.concat(F.lit("(?:^| )"), F.replace(family, F.lit(" "), F.lit(r"\s?[\p{L}\p{N}]?\s?")), F.lit(r"\d*(?: |$)"))
    return F.coalesce((family != "") & F.regexp_like(text.title_key(page), pattern), F.lit(False))


def cites(volume: Column, pages: Column, article: Column, tokens: Column) -> Column:
    """Whether both a volume and a first page (or article number) are among a page's lower-case ``tokens``."""
    first = F.coalesce(F.nullif(F.trim(F.split_part(pages, F.lit("-"), F.lit(1))), F.lit("")), article)
    has = lambda x: (x != "") & F.array_contains(tokens, F.lower(x))
    return F.coalesce(has(volume) & has(first), F.lit(False))


def printed_form(value: str) -> str:
    """A string as printed strings compare: compatibility forms, case, blanks and word hyphens folded."""
    plain = unicodedata.normalize("NFKC", value).casefold().translate({0x2212: "-", 0x2013: "-"})
    return _NOT_PRINTED.sub("", _WORD_HYPHEN.sub("", plain))


def check_printed(claimed: list[str], region: str, caption: str, ocr_layer: bool) -> dict:
    """Counts of claimed strings that the region prints, its caption's words taken out once each.

    Not applicable where the text layer is itself a machine reading, or too short to confirm anything.
    """
    spare, seen, left = Counter(printed_form(w) for w in caption.split()), Counter(), []
    for word in region.split():
        form = printed_form(word)
        seen[form] += 1
        if seen[form] > spare[form]:
            left.append(word)
    shown = printed_form("".join(left))
    if ocr_layer or len(shown) < LEAST_REGION:
        return {"applicable": False, "claimed": len(claimed), "confirmed": 0, "informative": 0, "found": 0, "unconfirmed": []}
    forms = [printed_form(c) for c in claimed]
    missing = [c for c, f in zip(claimed, forms, strict=True) if f and f not in shown]
    telling = [f for f in forms if len(f) >= LEAST_STRING]
    return {"applicable": True, "claimed": len(claimed), "confirmed": len(claimed) - len(missing), "informative": len(telling), "found": sum(f in shown for f in telling), "unconfirmed": missing}


@F.pandas_udf(T.StructType([T.StructField("applicable", T.BooleanType()), *(T.StructField(n, T.IntegerType()) for n in ("claimed", "confirmed", "informative", "found")), T.StructField("unconfirmed", T.ArrayType(T.StringType()))]))
def printed_check(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """``check_printed`` of columns: claimed, region, caption, ocr_layer; nulls are empty."""
    names = ["applicable", "claimed", "confirmed", "informative", "found", "unconfirmed"]
    for claimed, region, caption, ocr in parts:
        rows = [check_printed([x for x in (c if c is not None else []) if x], r or "", p or "", o is not None and bool(o)) for c, r, p, o in zip(claimed, region, caption, ocr, strict=True)]
        yield pd.DataFrame(rows, columns=names)


def call_cost(input_tokens: Column, output_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars of a model call, from prices of a million tokens."""
    return (input_tokens * price_in + output_tokens * price_out) / F.lit(1e6)


# The members of a description that claim something of a figure, and of each of its panels.
_LISTS = ["legend", "printed_text", "printed_numbers", "trends", "features", "uncertain"]
CLAIMS = (
    "figure_type string, summary string, uncertain array<string>, relationships array<string>, panels array<struct<label string, kind string, "
    + ", ".join(f"{c} array<string>" for c in _LISTS)
    + ", approximate_readings array<struct<what string, value string>>>>"
)


def parse_claims(answer: Column) -> Column:
    """(problem, claims) of a model's answer: its first JSON object read as claims; null claims where a problem is told.

    The object may have no panels. Lists must be lists of strings or numbers, panels a list of objects; blank strings and
    readings without both parts are dropped.
    """
    body = json_object(answer)
    v = F.try_parse_json(body)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))
    text_like = lambda path: kind(path).isin("VOID", "STRING")
    scalars = lambda path: kind(path).rlike("^(VOID|ARRAY<(VOID|STRING|BIGINT|DOUBLE|DECIMAL.*)>|ARRAY<VARIANT>)$")
    panels_like = kind("$.panels").rlike("^(VOID|ARRAY<(VOID|OBJECT.*)>)$")
    problem = (
        F.when(body.isNull(), "no JSON object")
        .when(~text_like("$.figure_type") | ~text_like("$.summary"), "a text is not a string")
        .when(~scalars("$.uncertain") | ~scalars("$.relationships"), "a list is not one of strings")
        .when(~panels_like, "panels are not a list of objects")
    )
    c = F.from_json(body, CLAIMS)
    kept = lambda values: F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    panel = lambda p: F.struct(
        F.nullif(F.trim(p["label"]), F.lit("")).alias("label"),
        F.nullif(F.trim(p["kind"]), F.lit("")).alias("kind"),
        *(kept(p[n]).alias(n) for n in _LISTS),
        F.filter(F.coalesce(p["approximate_readings"], F.array().cast("array<struct<what string, value string>>")), lambda r: F.coalesce(F.trim(r["what"]) != "", F.lit(False)) & F.coalesce(F.trim(r["value"]) != "", F.lit(False))).alias("approximate_readings"),
    )
    claims = F.struct(
        F.nullif(F.trim(c["figure_type"]), F.lit("")).alias("figure_type"),
        F.nullif(F.trim(c["summary"]), F.lit("")).alias("summary"),
        kept(c["uncertain"]).alias("uncertain"),
        kept(c["relationships"]).alias("relationships"),
        F.when(c["panels"].isNotNull(), F.transform(c["panels"], panel)).alias("panels"),
    )
    return F.struct(problem.alias("problem"), F.when(problem.isNull(), claims).alias("claims"))
