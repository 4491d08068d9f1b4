"""Scans that need a stack or the places of matches, which no built-in expression gives: batches in Python."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The words for kinds of objects, and how texts name a supplement as a whole.
KINDS = {
    "figure": r"Figures?\.?|Figs?\.?",
    "table": r"Tables?|Tab\.?",
    "equation": r"Equations?|Eqs?\.?",
    "section": r"Sections?|Sect?\.|Notes?",
}
DOCUMENT = r"\b(?:Supplementary\s+(?:Information|Materials?|Data|Text)|Supporting\s+Information|Supplemental\s+Materials?|Supplement\s+\d+)\b"
#: One scan finds both: a number needs its S where nothing before it says supplementary, and may stand in parentheses.
REFERENCE = re.compile(
    r"(?i:\b(?P<said>(?:Supplementary|Suppl\.)\s+)?(?:" + "|".join(f"(?P<{k}>{v})" for k, v in KINDS.items()) + r")\s*(?P<paren>\(\s*)?(?P<number>(?(said)S?|S)\d+[a-z]?)(?(paren)\s*\)|\b))|" + DOCUMENT
)
TOKEN = re.compile(r"\\begin\{(?P<begin>[^{}]*)\}|\\end\{(?P<end>[^{}]*)\}|\\(?P<side>left|right)(?![A-Za-z])|\\.|(?P<brace>[{}])", re.DOTALL)


def latex_problems(latex: str) -> list[str]:
    """What is unbalanced in a formula: braces, left and right delimiters, environments. One pass over its tokens."""
    level, stray, sides, environments, wrong = 0, 0, Counter(), [], []
    for token in TOKEN.finditer(latex):
        kind = token.lastgroup
        if kind == "brace":
            level += 1 if token["brace"] == "{" else -1
            stray, level = stray + (level < 0), max(level, 0)
        elif kind == "side":
            sides[token["side"]] += 1
        elif kind == "begin":
            environments.append(token["begin"])
        elif kind == "end":
            inner = environments.pop() if environments else None
            if inner != token["end"]:
                wrong.append(f"environment {token['end']} ends where {inner or 'none'} is open")
    found = ["a brace closes that was not opened"] * stray
    found += [f"open braces at the end: {level}"] if level else []
    found += [f"left delimiters: {sides['left']}, right ones: {sides['right']}"] if sides["left"] != sides["right"] else []
    return found + wrong + [f"environment {name} does not end" for name in environments]


def first_object(text: str) -> str | None:
    """The first whole JSON object in a text, after any closing think tag; strings and escapes are respected."""
    text = text.rsplit("</think>", 1)[-1]
    reader = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            value, end = reader.raw_decode(text, m.start())
        except ValueError:
            continue
        if isinstance(value, dict):
            return text[m.start() : end]
    return None


def supplement_references(text: str) -> list[dict]:
    """Non-overlapping references to supplements, the earliest start first: start, end, kind, number.

    The number is in lower case and without its S; a supplement as a whole has kind document and no number.
    """

    def read(m: re.Match) -> dict:
        kind = next((k for k in KINDS if m[k]), "document")
        return {"start": m.start(), "end": m.end(), "kind": kind, "number": (m["number"] or "").lower().lstrip("s")}

    return [read(m) for m in REFERENCE.finditer(text)]


def linked(text: str, targets: dict[tuple[str, str], str]) -> str:
    """Markdown with references that have a target made links."""
    out, at = [], 0
    for r in supplement_references(text):
        if (to := targets.get((r["kind"], r["number"]))) is not None:
            out += [text[at : r["start"]], f"[{text[r['start'] : r['end']]}]({to})"]
            at = r["end"]
    return "".join([*out, text[at:]])


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("number", T.StringType())])


@F.pandas_udf(T.ArrayType(T.StringType()))
def latex_balance(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``latex_problems`` of each formula; null gives none."""
    for values in parts:
        yield pd.Series([latex_problems(v or "") for v in values])


@F.pandas_udf(T.StringType())
def json_object(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``first_object`` of each text; null gives null."""
    for values in parts:
        yield pd.Series([None if v is None else first_object(v) for v in values], dtype=object)


@F.pandas_udf(T.ArrayType(SPAN))
def references(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``supplement_references`` of each text; null gives none."""
    for values in parts:
        yield pd.Series([supplement_references(v or "") for v in values])
