"""Files as frames: PDFs' bytes, JSONL catalogs and manifests, saved pages, BibTeX."""

from __future__ import annotations

import email
import email.policy
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: The manifest's header and its fields.
MANIFEST_SCHEMA, MANIFEST_VERSION = "batch_manifest", 1
MANIFEST_FIELDS = ["id", "paper", "supplements", "html", "document_version"]
PDF_SIGNATURE = "255044462D"


def pdf_files(spark: SparkSession, directory: str) -> DataFrame:
    """(path, size, modified, sha256, reason) of the directory's ``*.pdf``, not below it, in order of path.

    ``reason`` is null for what has the signature. Bytes are hashed where they are read.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", "*.[pP][dD][fF]").load(directory)
    good = F.hex(F.substring("content", 1, 5)) == PDF_SIGNATURE
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.when(good, F.sha2("content", 256)).alias("sha256"), F.when(~good, "no PDF signature").alias("reason")).orderBy("path")


def catalog(spark: SparkSession, path: str, schema: str, versions: tuple[int, ...]) -> DataFrame:
    """A JSONL catalog of a fixed schema; a row of another schema_version stops the read."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    known = F.col("schema_version").isin(*versions)
    checked = F.when(known, F.col("schema_version")).otherwise(F.raise_error(F.concat(F.lit("unsupported schema_version "), F.col("schema_version").cast("string"))).cast("int"))
    return rows.withColumn("schema_version", checked)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(line, id, paper, supplements, html, document_version, problems) of a batch manifest.

    All problems of a line are given, not just the first. Line 1 is the header and must name the schema;
    comments and blank lines are passed over. A manifest is small: its lines are numbered in one task.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "value")).select((F.col("n") + 1).alias("line"), F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")
    v = F.try_parse_json(F.col("value"))
    shape = "struct<id string, paper string, supplements array<string>, html array<string>, document_version string, schema string, schema_version int>"
    rows = lines.select("line", F.from_json("value", shape.replace("struct<", "").rstrip(">")).alias("r"), F.json_object_keys("value").alias("keys"), v.isNull().alias("broken"))
    head = F.min("line").over(Window.partitionBy())
    rows = rows.withColumn("head", F.col("line") == head)
    repeats = F.count(F.lit(1)).over(Window.partitionBy("r.id"))
    unknown = F.array_except("keys", F.array(*map(F.lit, MANIFEST_FIELDS)))
    problems = F.array_compact(
        F.array(
            F.when(F.col("broken"), "not JSON"),
            F.when(~F.col("broken") & F.col("head") & ((F.col("r.schema") != MANIFEST_SCHEMA) | (F.col("r.schema_version") != MANIFEST_VERSION) | F.col("r.schema").isNull()), "not a manifest header"),
            F.when(~F.col("broken") & ~F.col("head") & (F.size(unknown) > 0), F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", "))),
            F.when(~F.col("broken") & ~F.col("head") & (F.trim(F.coalesce("r.id", F.lit(""))) == ""), "no id"),
            F.when(~F.col("broken") & ~F.col("head") & (F.trim(F.coalesce("r.paper", F.lit(""))) == ""), "no paper"),
            F.when(~F.col("head") & F.col("r.id").isNotNull() & (repeats > 1), "repeated id"),
        )
    )
    return rows.withColumn("problems", problems).where("not head or size(problems) > 0").select("line", "r.id", "r.paper", "r.supplements", "r.html", "r.document_version", "problems")


def _main_part(data: bytes) -> tuple[str, str | None, str]:
    """Kind, address and HTML of a saved page."""
    start = data[:4096]
    if re.search(rb"(?im)^MIME-Version:", start) and re.search(rb"(?i)multipart/related|text/html", start):
        message = email.message_from_bytes(data, policy=email.policy.default)
        part = next((p for p in message.walk() if p.get_content_type() == "text/html"), None)
        html = "" if part is None else _decoded(part.get_payload(decode=True) or b"", part.get_content_charset())
        return "mhtml", message.get("Snapshot-Content-Location"), html
    html = _decoded(data, None)
    saved = re.search(r"<!-- saved from url=\(\d+\)(\S+) -->", html[:4096])
    return "html", None if saved is None else saved[1], html


def _decoded(data: bytes, charset: str | None) -> str:
    declared = re.search(rb"(?i)charset=[\"']?([\w-]+)", data[:2048])
    for name in (charset, None if declared is None else declared[1].decode("ascii", "replace"), "utf-8", "cp1252"):
        try:
            if name:
                return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("utf-8", "replace")


@F.pandas_udf(T.StructType([T.StructField("kind", T.StringType()), T.StructField("address", T.StringType()), T.StructField("html", T.StringType())]))
def captured(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Kind, address and HTML of saved pages' bytes; null bytes give an empty page."""
    for contents in parts:
        yield pd.DataFrame([_main_part(bytes(c) if c is not None else b"") for c in contents], columns=["kind", "address", "html"])


def bibtex_entries(source: str) -> list[tuple[str, str, dict[str, str]]]:
    """(type, key, fields) of each entry; values may nest braces; a broken entry is passed over."""
    found = []
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s{}]+)\s*,", source):
        fields, at, depth = {}, m.end(), 1
        begin = at
        while at < len(source) and depth:
            depth += {"{": 1, "}": -1}.get(source[at], 0)
            at += 1
        if depth:
            continue
        body, pos = source[begin : at - 1], 0
        while f := re.compile(r"\s*,?\s*([\w-]+)\s*=\s*").match(body, pos):
            pos = f.end()
            if pos < len(body) and body[pos] in '{"':
                close, level, end = "}" if body[pos] == "{" else '"', 0, pos + 1
                while end < len(body) and (body[end] != close or level):
                    level += {"{": 1, "}": -1}.get(body[end], 0)
                    end += 1
                value, pos = body[pos + 1 : end], end + 1
            else:
                bare = re.compile(r"[^,\s]*").match(body, pos)
                value, pos = bare.group(), bare.end()
            fields.setdefault(f[1].lower(), " ".join(value.split()))
        found.append((m[1].lower(), m[2], fields))
    return found


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("key", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])))
def read_bibtex(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The entries of BibTeX texts."""
    for texts in parts:
        yield pd.Series([[{"type": a, "key": b, "fields": c} for a, b, c in bibtex_entries(t or "")] for t in texts])
