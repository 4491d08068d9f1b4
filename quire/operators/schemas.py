"""Whole records checked strictly: all problems with their places, from a description of the record.

A description is data: exact keys, types and choices, lists, alternatives by a ``kind``. ``problems`` compiles one into a single
expression over a variant, so records of any size are checked in place, without a shuffle and without Python. JSON's booleans are no
integers here, blank strings hold nothing, and a field that isn't known is as wrong as one that is missing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBLEM = "array<struct<path: string, problem: string>>"
Rule = tuple[str, Callable[[Column], Column]]


@dataclass(frozen=True)
class Spec:
    """A description: ``type``, and what it needs of the rest."""

    type: str
    least: int = 0
    values: tuple[str, ...] = ()
    pattern: str = ""
    inner: Spec | None = None
    fields: tuple[tuple[str, Spec], ...] = ()
    optional: tuple[str, ...] = ()
    kinds: tuple[tuple[str, Spec], ...] = ()
    rules: tuple[Rule, ...] = field(default=(), compare=False)


STRING, TEXT, NUMBER, BOOLEAN, MAPPING = (Spec(t) for t in ("string", "text", "number", "boolean", "mapping"))


def integer(least: int) -> Spec:
    return Spec("integer", least=least)


def choice(values: str) -> Spec:
    return Spec("choice", values=tuple(values.split()))


def shaped(pattern: str) -> Spec:
    """A string that a pattern matches as a whole."""
    return Spec("shaped", pattern=pattern)


def items(inner: Spec, *rules: Rule) -> Spec:
    return Spec("items", inner=inner, rules=rules)


def values(inner: Spec) -> Spec:
    """An object of any keys, whose values are all alike."""
    return Spec("values", inner=inner)


def maybe(inner: Spec) -> Spec:
    return Spec("maybe", inner=inner)


def record(fields: dict[str, Spec], optional: str = "", rules: tuple[Rule, ...] = ()) -> Spec:
    return Spec("record", fields=tuple(fields.items()), optional=tuple(optional.split()), rules=rules)


def by_kind(kinds: dict[str, Spec], key: str = "kind") -> Spec:
    """One of several records, told by the string under ``key``."""
    return Spec("kinds", pattern=key, kinds=tuple(kinds.items()))


_NONE = lambda: F.array().cast(PROBLEM)


def _one(path: Column, problem: Column | str) -> Column:
    return F.array(F.struct(path.alias("path"), (F.lit(problem) if isinstance(problem, str) else problem).alias("problem")))


def _unless(good: Column, path: Column, problem: str) -> Column:
    return F.when(F.coalesce(good, F.lit(False)), _NONE()).otherwise(_one(path, problem))


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _scalar(v: Column) -> Column:
    """The type of a value that is no object or list; a list or object counts as none."""
    return F.when(_object(v).isNull() & _array(v).isNull(), F.schema_of_variant(v)).otherwise("")


def _string(v: Column) -> Column:
    return F.when(_scalar(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _leaf(spec: Spec, v: Column, path: Column) -> Column:
    text = _string(v)
    if spec.type == "string":
        return _unless(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) != "", path, "no string with content")
    if spec.type == "text":
        return _unless(text.isNotNull(), path, "no string")
    if spec.type == "choice":
        return _unless(text.isin(*spec.values), path, "none of: " + " ".join(spec.values))
    if spec.type == "shaped":
        return _unless(text.rlike(f"^(?:{spec.pattern})\\z"), path, "not of the form " + spec.pattern)
    if spec.type == "boolean":
        return _unless(_scalar(v) == "BOOLEAN", path, "no boolean")
    if spec.type == "integer":
        large = _scalar(v).rlike(r"^DECIMAL\((19|[23]\d),0\)$") & F.try_variant_get(v, "$", "string").rlike("^\\d+$")  # beyond 64 bits; 1.0 has fewer digits
        return _unless(((_scalar(v) == "BIGINT") & (F.try_variant_get(v, "$", "bigint") >= spec.least)) | large, path, f"no integer of {spec.least} or more")
    if spec.type == "number":
        value = F.try_variant_get(v, "$", "double")
        return _unless(_scalar(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & ~F.isnan(value) & (F.abs(value) < float("inf")), path, "no finite number")
    return _unless(_object(v).isNotNull(), path, "no object")


def _all(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else _NONE()


def _keys(found: Column, allowed: Column, needed: Column, path: Column) -> Column:
    """Keys too many and keys missing; ``found``, ``allowed`` and ``needed`` are arrays of names."""
    more = F.transform(F.array_sort(F.array_except(found, allowed)), lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("unknown field").alias("problem")))
    less = F.transform(F.array_sort(F.array_except(needed, found)), lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("missing field").alias("problem")))
    return F.concat(less, more).cast(PROBLEM)


def _names(names: list[str]) -> Column:
    return F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")


def _fields(v: Column, keys: Column, path: Column, groups: dict[tuple[str, Spec], Column | None]) -> list[Column]:
    """The problems of fields that are there, each where its condition (None: always) holds."""
    out = []
    for (name, spec), test in groups.items():
        there = F.array_contains(keys, F.lit(name)) if test is None else test & F.array_contains(keys, F.lit(name))
        found = _bound(spec, v, name, path)
        out.append(F.when(there, found).otherwise(_NONE()))
    return out


def _bound(spec: Spec, v: Column, name: str, path: Column) -> Column:
    own = F.concat(path, F.lit(f".{name}"))
    return _once(_member(v, name), lambda x: problems(spec, x, own))


def problems(spec: Spec, v: Column, path: Column) -> Column:
    """All problems of a variant against a description: an array of (path, problem), empty where there are none."""
    if spec.type == "maybe":
        return F.when(F.is_variant_null(v), _NONE()).otherwise(problems(spec.inner, v, path))
    if spec.type in ("items", "values"):
        if spec.type == "items":
            found = lambda a: F.flatten(F.transform(a, lambda x, i: problems(spec.inner, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
            whole, absent = _array(v), "no list"
        else:
            found = lambda m: F.flatten(F.transform(F.map_entries(m), lambda e: problems(spec.inner, e["value"], F.concat(path, F.lit("."), e["key"]))))
            whole, absent = _object(v), "no object"
        checked = [F.when(F.coalesce(ok(v), F.lit(False)), _NONE()).otherwise(_one(path, name)) for name, ok in spec.rules]
        ruled = lambda a: F.concat(found(a), *(F.when(F.size(found(a)) == 0, c).otherwise(_NONE()) for c in checked)) if checked else found(a)
        return F.when(whole.isNull(), _one(path, absent)).otherwise(_once(whole, ruled))
    if spec.type == "record":
        names = [n for n, _ in spec.fields]
        needed = _names([n for n in names if n not in spec.optional])

        def checked(keys: Column) -> Column:
            every = F.concat(_keys(keys, _names(names), needed, path), *_fields(v, keys, path, {f: None for f in spec.fields}))
            rules = [F.when(F.coalesce(ok(v), F.lit(False)), _NONE()).otherwise(_one(path, name)) for name, ok in spec.rules]
            return _once(every, lambda e: F.when(F.size(e) == 0, F.concat(*rules)).otherwise(e)) if rules else every

        return F.when(_object(v).isNull(), _one(path, "no object")).otherwise(_once(F.map_keys(_object(v)), checked))
    if spec.type == "kinds":
        return F.when(_object(v).isNull(), _one(path, "no object")).otherwise(_once(_string(_member(v, spec.pattern)), lambda kind: _dispatched(spec, v, path, kind)))
    return _leaf(spec, v, path)


def _dispatched(spec: Spec, v: Column, path: Column, kind: Column) -> Column:
    """The problems of a record of several kinds; fields that kinds share are checked by one expression."""
    table = dict(spec.kinds)
    own = lambda pick: F.try_element_at(F.create_map(*(x for k, s in table.items() for x in (F.lit(k), _names(pick(s))))), kind)
    allowed, needed = own(lambda s: [n for n, _ in s.fields]), own(lambda s: [n for n, _ in s.fields if n not in s.optional])
    groups: dict[tuple[str, Spec], list[str]] = {}
    for k, s in table.items():
        for f in s.fields:
            groups.setdefault(f, []).append(k)
    tests = {f: None if len(k) == len(table) else kind.isin(*k) for f, k in groups.items()}
    rules = [F.when((kind != k) | F.coalesce(ok(v), F.lit(False)), _NONE()).otherwise(_one(path, name)) for k, s in table.items() for name, ok in s.rules]

    def known(keys: Column) -> Column:
        every = F.concat(_keys(keys, allowed, needed, path), *_fields(v, keys, path, tests))
        return _once(every, lambda e: F.when(F.size(e) == 0, F.concat(*rules)).otherwise(e)) if rules else every

    wrong = _one(F.concat(path, F.lit(f".{spec.pattern}")), "none of: " + " ".join(table))
    return F.when(F.coalesce(kind.isin(*table), F.lit(False)), _once(F.map_keys(_object(v)), known)).otherwise(wrong)


def checked(records: DataFrame, spec: Spec, json: str = "json") -> DataFrame:
    """``records`` with ``problems``: of their JSON against a description; a text that is no JSON, and a null, has one at ``$``."""
    found = _once(F.try_parse_json(F.col(json)), lambda v: F.when(v.isNull(), _one(F.lit("$"), "no JSON")).otherwise(problems(spec, v, F.lit("$"))))
    return records.withColumn("problems", found)


def _numbers(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "array<bigint>")


def _rising(name: str) -> Rule:
    return f"{name} pages don't rise", lambda v: F.array_sort(F.array_distinct(_numbers(v, name))) == _numbers(v, name)


def _is_null(v: Column, name: str) -> Column:
    return F.is_variant_null(_member(v, name))


def _completed(v: Column) -> Column:
    return F.try_variant_get(v, "$.status", "string") == "completed"


# The fields of stored records.
SHA256, REQUEST_ID = shaped("[0-9a-f]{64}"), shaped("[A-Za-z0-9][A-Za-z0-9._-]{0,63}")
SAFE_PATH = shaped(r"(?!/)(?!.*(?:^|/)\.{0,2}(?:/|$))[^\\\x00]+")
BACKENDS, SEVERITIES = "mineru docling marker", "info warning error"
_four: Rule = ("not four numbers", lambda v: F.size(_array(v)) == 4)
BOX = maybe(items(NUMBER, _four))
SPAN = record({"page": integer(1), "bbox_pt": BOX, "bbox_fraction": BOX, "backend_type": STRING, "backend_index": maybe(integer(0))})
RUN = record({"kind": choice("text math code link"), "text": TEXT, "styles": items(STRING), "url": maybe(STRING)})
RUNS = items(RUN)
PANEL = record({"id": STRING, "asset": maybe(STRING), "label": maybe(STRING), "span": SPAN})
CELL = record({"row": integer(0), "column": integer(0), "row_span": integer(1), "column_span": integer(1), "html": TEXT, "text": TEXT})
_GRID = {"html": TEXT, "cells": maybe(items(CELL)), "rows": maybe(integer(1)), "columns": maybe(integer(1))}
_TABLE = {"kind": STRING, "id": STRING, "label": maybe(STRING), "caption": maybe(RUNS), "footnotes": items(RUNS), **_GRID, "asset": maybe(STRING), "span": SPAN, "continues_previous": BOOLEAN, "body_source": choice("native ocr"), "alternatives": items(record({"source": choice("native ocr docling"), **_GRID}))}
_together: Rule = ("body_source and alternatives go together", lambda v: _member(v, "body_source").isNull() == _member(v, "alternatives").isNull())
BLOCK = by_kind(
    {
        "heading": record({"kind": STRING, "id": STRING, "level": integer(1), "runs": RUNS, "span": SPAN}),
        "paragraph": record({"kind": STRING, "id": STRING, "role": choice("body reference footnote aside"), "runs": RUNS, "span": SPAN, "continues_previous": BOOLEAN}),
        "list": record({"kind": STRING, "id": STRING, "items": items(RUNS), "span": SPAN, "continues_previous": BOOLEAN}),
        "equation": record({"kind": STRING, "id": STRING, "latex": TEXT, "label": maybe(STRING), "asset": maybe(STRING), "span": SPAN}),
        "figure": record({"kind": STRING, "id": STRING, "label": maybe(STRING), "caption": maybe(RUNS), "caption_span": maybe(SPAN), "footnotes": items(RUNS), "panels": items(PANEL), "context_bbox_pt": BOX, "grouping": choice("single caption_run unresolved"), "page": integer(1)}),
        "table": record(_TABLE, "body_source alternatives", (_together,)),
        "page_furniture": record({"kind": STRING, "id": STRING, "role": choice("header footer page_number"), "runs": RUNS, "span": SPAN}),
        "unclassified": record({"kind": STRING, "id": STRING, "backend_type": STRING, "raw": TEXT, "span": SPAN}),
    }
)
PAGE = record({"number": integer(1), "width_pt": maybe(NUMBER), "height_pt": maybe(NUMBER), "status": choice("processed empty missing")})
FINDING = record({"code": STRING, "severity": choice(SEVERITIES), "message": STRING, "block_ids": items(STRING), "page": maybe(integer(1))})
OBSERVATION = record({"field": STRING, "value": STRING, "source": STRING})
COVERAGE = record({"requested": items(integer(1)), "returned": items(integer(1)), "empty": items(integer(1))}, rules=(("no page requested", lambda v: F.size(_numbers(v, "requested")) > 0), _rising("requested"), _rising("returned"), _rising("empty"), ("empty pages that were not returned", lambda v: F.size(F.array_except(_numbers(v, "empty"), _numbers(v, "returned"))) == 0)))
FILE = record({"path": SAFE_PATH, "sha256": SHA256, "size_bytes": integer(0)})


def document(schema: str, versions: str) -> Spec:
    """Document records of a schema's name and of the versions that are read, in one string."""
    return record({"schema": choice(schema), "schema_version": choice(versions), "source_sha256": STRING, "backend": STRING, "backend_version": STRING, "native_schema": STRING, "native_schema_version": STRING, "pages": items(PAGE), "blocks": items(BLOCK), "metadata": items(OBSERVATION), "findings": items(FINDING)})


def result(schema: str, version: Spec) -> Spec:
    """A worker's result records; ``version`` describes the protocol's."""
    paths = lambda v: F.transform(F.try_variant_get(v, "$.files", "array<variant>"), lambda f: F.try_variant_get(f, "$.path", "string"))
    rules = (
        ("files of one path", lambda v: F.size(F.array_distinct(paths(v))) == F.size(paths(v))),
        ("completed without coverage or page count", lambda v: ~_completed(v) | (~_is_null(v, "coverage") & ~_is_null(v, "page_count"))),
        ("completed with a failure", lambda v: ~_completed(v) | _is_null(v, "failure")),
        ("failed without a failure", lambda v: _completed(v) | ~_is_null(v, "failure")),
    )
    fields = {"schema": choice(schema), "protocol_version": version, "request_id": REQUEST_ID, "backend": choice(BACKENDS), "backend_version": STRING, "status": choice("completed failed"), "source_sha256": SHA256, "page_count": maybe(integer(1)), "coverage": maybe(COVERAGE), "files": items(FILE)}
    fields |= {"configuration": MAPPING, "environment": MAPPING, "timing": values(NUMBER), "resources": MAPPING, "diagnostics": items(record({"code": STRING, "severity": choice(SEVERITIES), "message": STRING})), "failure": maybe(record({"kind": STRING, "message": TEXT, "traceback": TEXT}))}
    return record(fields, rules=rules)


def corpus(schema: str) -> Spec:
    """A library's own record."""
    return record({"schema": choice(schema), "schema_version": integer(1), "library_id": shaped("[0-9a-f]{16}"), "layout": choice("flat by-year by-initial"), "created_utc": shaped(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|\+00:00)")})
