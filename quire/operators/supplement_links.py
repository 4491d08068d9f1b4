"""References of papers to their supplements' objects, made links inside the runs they stand in.

A supplement's numbered figures, tables, equations and sections are its anchors. References are found in the runs that hold text,
meet the anchors of their paper's supplements by a join on paper, kind and number, and are cut out of their runs at their places.
Every side grows with the papers, and Spark's estimates miss how rows grow here, so joins are told to sort, which can spill, and
not to hold a side whole in each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.scanners import references

# What begins a numbered section, and what a label is.
SECTION = r"(?i)^\s*(?:Supplementary\s+(?:Note|Section)\s+)?S?(\d+)(?:[.:]|\s)"
LABEL = r"(?i)^S?(\d+[A-Za-z]?)$"
WHOLE = ("document", "")
RUN = "struct<kind: string, text: string, styles: array<string>, url: string>"


def _text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def anchors(blocks: DataFrame) -> DataFrame:
    """(doc, kind, number, pos, id, anchor) of blocks (doc, pos, id, kind, label, continues, runs): the first object of each kind and number.

    Figures, equations and tables that don't continue another count by their label, headings by the number they begin with.
    """
    number = F.lower(F.nullif(F.regexp_extract(F.trim("label"), LABEL, 1), F.lit("")))
    section = F.nullif(F.regexp_extract(_text(F.col("runs")), SECTION, 1), F.lit(""))
    labelled = F.col("kind").isin("figure", "equation") | ((F.col("kind") == "table") & ~F.coalesce("continues", F.lit(False)))
    keyed = blocks.select("doc", "pos", "id", F.when(F.col("kind") == "heading", "section").otherwise(F.col("kind")).alias("kind"), F.when(labelled, number).when(F.col("kind") == "heading", section).alias("number")).where("number is not null")
    first = keyed.groupBy("doc", "kind", "number").agg(F.min_by(F.struct("pos", "id"), "pos").alias("x"))
    return first.select("doc", "kind", "number", "x.pos", "x.id", F.concat("kind", F.lit("-s"), "number").alias("anchor"))


def targets(supplements: DataFrame, anchored: DataFrame) -> DataFrame:
    """(paper, kind, number, target) of supplements (paper, ordinal, path, doc) and their ``anchors``: the first supplement's that has it; the first one as a whole."""
    each = supplements.join(anchored.hint("merge"), "doc").groupBy("paper", "kind", "number").agg(F.min_by(F.concat("path", F.lit("#"), "anchor"), F.struct("ordinal", "pos")).alias("target"))
    whole = supplements.groupBy("paper").agg(F.min_by("path", "ordinal").alias("target"))
    return each.unionByName(whole.select("paper", F.lit(WHOLE[0]).alias("kind"), F.lit(WHOLE[1]).alias("number"), "target"))


def found_references(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """(paper, pos, run, start, end, kind, number, whole, text, target) of references in the runs of blocks (paper, pos, runs); formulas and code hold none.

    ``whole``: the reference is all that its run says. ``target`` is null where the paper's supplements have no such object.
    """
    prose = F.filter(F.transform("runs", lambda r, i: F.struct(i.alias("run"), r["kind"].alias("of"), r["text"].alias("text"))), lambda r: ~r["of"].isin("math", "code"))
    rows = blocks.select("paper", "pos", F.explode(prose).alias("r")).select("paper", "pos", "r.*").where(F.col("text").rlike(r"\d|Suppl|Support"))
    hits = rows.select("*", F.explode(references("text")).alias("h")).select("paper", "pos", "run", "text", "h.*")
    said = F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))
    hits = hits.select("paper", "pos", "run", "start", "end", "kind", "number", (F.trim("text") == said).alias("whole"), said.alias("text"))
    return hits.join(known.hint("merge"), ["paper", "kind", "number"], "left").select("paper", "pos", "run", "start", "end", "kind", "number", "whole", "text", "target")


def linked_runs(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """``blocks`` (paper, pos, runs and others) whose runs link to the targets ``known`` (paper, kind, number, target).

    A reference in a text becomes a link with the text's styles, what stands around it stays text. A link that is all reference leads to the
    target, and its own address follows as "(original link)". Formulas, code, other links and references without a target stay as they are.
    """
    hits = found_references(blocks, known).where("target is not null")
    each = hits.groupBy("paper", "pos").agg(F.array_sort(F.collect_list(F.struct("run", "start", "end", "whole", "target"))).alias("_hits"))
    text = lambda r, value: F.struct(F.lit("text").alias("kind"), value.alias("text"), r["styles"].alias("styles"), F.lit(None).cast("string").alias("url"))
    link = lambda r, value, url: F.struct(F.lit("link").alias("kind"), value.alias("text"), r["styles"].alias("styles"), url.alias("url"))
    part = lambda r, a, b: F.substr(r["text"], a + 1, b - a)

    def cut(r: Column, own: Column) -> Column:
        before = lambda k: F.when(k == 0, 0).otherwise(F.get(own, k - 1)["end"])
        pieces = F.flatten(F.transform(own, lambda h, k: F.array(text(r, part(r, before(k), h["start"])), link(r, part(r, h["start"], h["end"]), h["target"]))))
        rest = F.array(text(r, part(r, F.get(own, F.size(own) - 1)["end"], F.length(r["text"]))))
        return F.filter(F.concat(pieces, rest), lambda x: x["text"] != "").cast(f"array<{RUN}>")

    def one(r: Column, own: Column) -> Column:
        alone = F.array(r).cast(f"array<{RUN}>")
        is_link = (r["kind"] == "link") & r["url"].isNotNull()
        led = F.array(link(r, r["text"], F.get(own, F.lit(0))["target"]), text(r, F.lit(" (")), link(r, F.lit("original link"), r["url"]), text(r, F.lit(")"))).cast(f"array<{RUN}>")
        return F.when(F.size(own) == 0, alone).when(is_link, F.when((F.size(own) == 1) & F.get(own, F.lit(0))["whole"], led).otherwise(alone)).otherwise(cut(r, own))

    own = lambda i: F.filter(F.coalesce("_hits", F.array().cast("array<struct<run: int, start: int, end: int, whole: boolean, target: string>>")), lambda h: h["run"] == i)
    spliced = F.flatten(F.transform("runs", lambda r, i: one(r, own(i))))
    rows = blocks.join(each.hint("merge"), ["paper", "pos"], "left").withColumn("runs", F.when(F.col("_hits").isNull(), F.col("runs").cast(f"array<{RUN}>")).otherwise(spliced))
    return rows.select(*blocks.columns)
