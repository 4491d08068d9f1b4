"""Strict records against a plain reading of the same descriptions, and rules that join fields."""

import copy
import json
import re
from random import Random

import pytest

from quire.operators import schemas as S

RUN = {"kind": "text", "text": "a", "styles": ["bold"], "url": None}
SPAN = {"page": 1, "bbox_pt": [0, 1.5, 2, 3e0], "bbox_fraction": None, "backend_type": "t", "backend_index": 0}
CELL = {"row": 0, "column": 0, "row_span": 1, "column_span": 2, "html": "", "text": "x"}
BLOCKS = [
    {"kind": "heading", "id": "h", "level": 1, "runs": [RUN], "span": SPAN}, {"kind": "paragraph", "id": "p", "role": "body", "runs": [RUN, RUN], "span": SPAN, "continues_previous": False}, {"kind": "list", "id": "l", "items": [[RUN], []], "span": SPAN, "continues_previous": True},
    {"kind": "equation", "id": "e", "latex": "", "label": None, "asset": "a", "span": SPAN}, {"kind": "figure", "id": "f", "label": "1", "caption": [RUN], "caption_span": SPAN, "footnotes": [[RUN]], "panels": [{"id": "q", "asset": None, "label": "a", "span": SPAN}], "context_bbox_pt": [1, 2, 3, 4], "grouping": "single", "page": 2},
    {"kind": "table", "id": "t", "label": None, "caption": None, "footnotes": [], "html": "", "cells": [CELL], "rows": 1, "columns": None, "asset": None, "span": SPAN, "continues_previous": False, "body_source": "ocr", "alternatives": [{"source": "docling", "html": "", "cells": None, "rows": None, "columns": 3}]},
    {"kind": "table", "id": "t", "label": None, "caption": None, "footnotes": [], "html": "", "cells": None, "rows": None, "columns": None, "asset": None, "span": SPAN, "continues_previous": False}, {"kind": "page_furniture", "id": "r", "role": "footer", "runs": [], "span": SPAN}, {"kind": "unclassified", "id": "u", "backend_type": "odd", "raw": "", "span": SPAN},
]
DOCUMENT = {"schema": "d", "schema_version": "0.3", "source_sha256": "s", "backend": "b", "backend_version": "1", "native_schema": "n", "native_schema_version": "2", "pages": [{"number": 1, "width_pt": 1.5, "height_pt": None, "status": "empty"}], "blocks": BLOCKS, "metadata": [{"field": "f", "value": "v", "source": "s"}], "findings": [{"code": "C", "severity": "info", "message": "m", "block_ids": ["h"], "page": None}]}
RESULT = {"schema": "r", "protocol_version": 1, "request_id": "a.b-1", "backend": "marker", "backend_version": "2", "status": "completed", "source_sha256": "0" * 64, "page_count": 3, "coverage": {"requested": [1, 2, 3], "returned": [1, 3], "empty": [3]}, "files": [{"path": "native/a.json", "sha256": "f" * 64, "size_bytes": 0}], "configuration": {}, "environment": {"x": [1]}, "timing": {"parse": 1.5, "save": 2}, "resources": {}, "diagnostics": [{"code": "c", "severity": "error", "message": "m"}], "failure": None}
D, R = S.document("d", "0.1 0.2 0.3"), S.result("r", S.integer(1))


def plain(spec, v, path="$"):
    """Problems of a decoded value, rules that join fields left out."""
    words = " ".join(spec.values)
    leaf = {
        "string": (lambda: isinstance(v, str) and v.strip(), "no string with content"), "text": (lambda: isinstance(v, str), "no string"), "choice": (lambda: isinstance(v, str) and v in spec.values, f"none of: {words}"), "shaped": (lambda: isinstance(v, str) and re.fullmatch(spec.pattern, v), f"not of the form {spec.pattern}"),
        "boolean": (lambda: type(v) is bool, "no boolean"), "integer": (lambda: type(v) is int and v >= spec.least, f"no integer of {spec.least} or more"), "number": (lambda: type(v) in (int, float) and abs(v) < float("inf"), "no finite number"), "mapping": (lambda: isinstance(v, dict), "no object"),
    }
    if spec.type in leaf:
        good, problem = leaf[spec.type]
        return [] if good() else [(path, problem)]
    if spec.type == "maybe":
        return [] if v is None else plain(spec.inner, v, path)
    if spec.type == "items":
        return [p for i, x in enumerate(v) for p in plain(spec.inner, x, f"{path}[{i}]")] if isinstance(v, list) else [(path, "no list")]
    if not isinstance(v, dict):
        return [(path, "no object")]
    if spec.type == "values":
        return [p for k, x in v.items() for p in plain(spec.inner, x, f"{path}.{k}")]
    if spec.type == "kinds":
        kinds = dict(spec.kinds)
        kind = v.get(spec.pattern)
        return plain(kinds[kind], v, path) if isinstance(kind, str) and kind in kinds else [(f"{path}.{spec.pattern}", "none of: " + " ".join(kinds))]
    fields = dict(spec.fields)
    out = [(f"{path}.{k}", "missing field") for k in fields if k not in v and k not in spec.optional] + [(f"{path}.{k}", "unknown field") for k in v if k not in fields]
    return out + [p for k, s in fields.items() if k in v for p in plain(s, v[k], f"{path}.{k}")]


def places(v, path=()):
    yield path
    for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
        yield from places(x, (*path, k))


def broken(random, whole):
    """A copy with one to three faults: a value of another type, a field too many or too few."""
    v = copy.deepcopy(whole)
    for _ in range(random.randint(1, 3)):
        path = random.choice([p for p in places(v) if p])
        holder = v
        for k in path[:-1]:
            holder = holder[k]
        fault = random.random()
        if fault < 0.2 and isinstance(holder, dict):
            del holder[path[-1]]
        elif fault < 0.4 and isinstance(holder, dict):
            holder["more"] = 1
        else:
            holder[path[-1]] = random.choice([True, None, "", " \t ", "x", 0, -1, 1.0, 2.5, 10**30, [], [1], {}, {"kind": "heading"}, "completed", "heading"])
    return v


@pytest.mark.parametrize("whole, spec, n", [(DOCUMENT, D, 250), (RESULT, R, 250)])
def test_broken_records(spark, whole, spec, n):
    random = Random(4)
    records = [whole, *(broken(random, whole) for _ in range(n))]
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, json string")
    ruled = {name for s in (S.COVERAGE, R, dict(S.BLOCK.kinds)["table"]) for name, _ in s.rules} | {"not four numbers"}
    for r in S.checked(frame, spec).collect():
        got = sorted((p.path, p.problem) for p in r.problems if p.problem not in ruled)
        assert got == sorted(plain(spec, records[r.i])), (r.i, json.dumps(records[r.i]))
        assert r.i or not r.problems


def test_rules(spark):
    cases = [
        ({"coverage": {"requested": [], "returned": [], "empty": []}}, ["no page requested"]), ({"coverage": {"requested": [1, 1], "returned": [2, 1], "empty": [1]}}, ["requested pages don't rise", "returned pages don't rise"]), ({"coverage": {"requested": [1], "returned": [1], "empty": [2]}}, ["empty pages that were not returned"]),
        ({"coverage": None}, ["completed without coverage or page count"]), ({"failure": {"kind": "k", "message": "", "traceback": ""}}, ["completed with a failure"]), ({"status": "failed"}, ["failed without a failure"]), ({"files": RESULT["files"] * 2}, ["files of one path"]),
        *(({"files": [RESULT["files"][0] | {"path": p}]}, [f"not of the form {S.SAFE_PATH.pattern}"]) for p in ("", ".", "/a", "a/../b", "..", "a//b", "a/", "./a", "a\\b")), *(({"files": [RESULT["files"][0] | {"path": p}]}, []) for p in ("a", "a/.b", "...", "a/..b", "a b/c")), ({"protocol_version": 0}, ["no integer of 1 or more"]),
    ]
    frame = spark.createDataFrame([(i, json.dumps(RESULT | change)) for i, (change, _) in enumerate(cases)], "i int, json string")
    for r in S.checked(frame, R).collect():
        assert [p.problem for p in r.problems] == cases[r.i][1], cases[r.i]
    table = {k: v for k, v in BLOCKS[5].items() if k != "alternatives"}
    frame = spark.createDataFrame([(0, json.dumps(DOCUMENT | {"blocks": [table, BLOCKS[0] | {"span": SPAN | {"bbox_pt": [1, 2, 3]}}]})), (1, "{"), (2, None), (3, "[]")], "i int, json string")
    got = {r.i: [tuple(p) for p in r.problems] for r in S.checked(frame, D).collect()}
    assert got == {0: [("$.blocks[0]", "body_source and alternatives go together"), ("$.blocks[1].span.bbox_pt", "not four numbers")], 1: [("$", "no JSON")], 2: [("$", "no JSON")], 3: [("$", "no object")]}


def test_corpus(spark):
    good = {"schema": "c", "schema_version": 1, "library_id": "0123456789abcdef", "layout": "flat", "created_utc": "2026-01-02T03:04:05Z"}
    frame = spark.createDataFrame([(0, json.dumps(good)), (1, json.dumps(good | {"layout": "by-year", "created_utc": "today"}))], "i int, json string")
    assert {r.i: [p.path for p in r.problems] for r in S.checked(frame, S.corpus("c")).collect()} == {0: [], 1: ["$.created_utc"]}
