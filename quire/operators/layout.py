"""Rewrites that depend on the order and place of a document's blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.functions.geometry import iou

#: How near two boxes' corners are on pages that repeat a line, and on how many other pages.
NEAR_X, NEAR_Y, OTHER_PAGES = 0.02, 0.01, 2
#: The least overlap that matches two tables.
LEAST_IOU = 0.5


def repeated_furniture(blocks: DataFrame, furniture: DataFrame) -> DataFrame:
    """Blocks that repeat furniture of two other pages or more at the same place, with role and pages.

    Both: doc, page, key, x0, y0; blocks also pos. The join is on document and folded text; places are the
    residual condition.
    """
    b, f = blocks.alias("b"), furniture.alias("f")
    same = (F.col("b.doc") == F.col("f.doc")) & (F.col("b.key") == F.col("f.key")) & (F.col("b.page") != F.col("f.page"))
    near = (F.abs(F.col("b.x0") - F.col("f.x0")) <= NEAR_X) & (F.abs(F.col("b.y0") - F.col("f.y0")) <= NEAR_Y)
    found = b.join(f, same & near).where("b.key <> ''").groupBy("b.doc", "b.page", "b.pos", "b.y0").agg(F.countDistinct("f.page").alias("pages"))
    return found.where(F.col("pages") >= OTHER_PAGES).select("doc", "page", "pos", F.when(F.col("y0") < 0.5, "header").otherwise("footer").alias("role"), "pages")


def islands(rows: DataFrame, group: list[str], order: str, flag: str) -> DataFrame:
    """Adds ``run``: the number, from 1, of the run of flagged rows that a row belongs to; null elsewhere."""
    w = Window.partitionBy(*group).orderBy(order)
    start = F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
    return rows.withColumn("_start", start.cast("int")).withColumn("run", F.when(F.col(flag), F.sum("_start").over(w))).drop("_start")


def reference_order(blocks: DataFrame, group: list[str], pos: str, reference: str) -> DataFrame:
    """Adds ``new_pos``: earlier runs of references move, in order, to just before the last run."""
    rows = islands(blocks, group, pos, reference)
    whole = Window.partitionBy(*group)
    rows = rows.withColumn("_runs", F.max("run").over(whole)).withColumn("_to", F.min(F.when(F.col("run") == F.col("_runs"), F.col(pos))).over(whole))
    moved = F.col(reference) & (F.col("_runs") >= 2) & (F.col("run") < F.col("_runs"))
    order = Window.partitionBy(*group).orderBy(F.when(moved, F.col("_to")).otherwise(F.col(pos)), F.when(moved, 0).otherwise(1), pos)
    return rows.withColumn("moved", F.coalesce(moved, F.lit(False))).withColumn("new_pos", F.row_number().over(order)).drop("_runs", "_to", "run")


def terminated_runs(rows: DataFrame, group: str, order: str, end: str) -> DataFrame:
    """(group, run, size, closed): consecutive rows up to and with the one flagged ``end``; leftovers are not closed."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum(F.col(end).cast("int")).over(before), F.lit(0))
    return rows.withColumn("run", run).groupBy(group, "run").agg(F.count(F.lit(1)).alias("size"), F.max(end).alias("closed"))


def page_ranges(pages: DataFrame, group: str, page: str) -> DataFrame:
    """(group, first, last): runs of consecutive distinct pages."""
    island = F.col(page) - F.row_number().over(Window.partitionBy(group).orderBy(page))
    return pages.select(group, page).distinct().withColumn("_i", island).groupBy(group, "_i").agg(F.min(page).alias("first"), F.max(page).alias("last")).drop("_i")


def leading_pages(blocks: DataFrame, doc: str, page: str, most: int = 2) -> DataFrame:
    """The blocks of each document's first ``most`` pages that have any."""
    rank = F.dense_rank().over(Window.partitionBy(doc).orderBy(page))
    return blocks.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def author_line(blocks: DataFrame, doc: str, pos: str, heading: str, body: str) -> DataFrame:
    """(doc, pos, body): each document's first block behind its first one flagged ``heading`` that isn't one itself."""
    before = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumn("_seen", F.max(F.col(heading).cast("int")).over(before)).where(F.col("_seen") == 1).where(~F.col(heading))
    return rows.groupBy(doc).agg(F.min(pos).alias(pos), F.min_by(body, pos).alias(body))


def match_tables(tables: DataFrame, candidates: DataFrame) -> DataFrame:
    """(page, id, match, overlap): each table's candidate of greatest overlap on its page, the later on ties.

    Both: page, id, pos, label, x0, y0, x1, y1. Without one of half overlap, the only candidate of the same
    label is taken, with no overlap.
    """
    box = lambda a: tuple(F.col(f"{a}.{c}") for c in ("x0", "y0", "x1", "y1"))
    pairs = tables.alias("t").join(candidates.alias("c"), F.col("t.page") == F.col("c.page")).select("t.page", "t.id", F.col("c.id").alias("match"), "c.pos", iou(box("t"), box("c")).alias("overlap")).where(F.col("overlap") >= LEAST_IOU)
    best = pairs.groupBy("page", "id").agg(F.max_by(F.struct("match", "overlap"), F.struct("overlap", "pos")).alias("b")).select("page", "id", "b.match", "b.overlap")
    alone = candidates.where("label is not null").groupBy("page", "label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("by_label")).where("n = 1").select("page", "label", "by_label")
    out = tables.select("page", "id", "label").join(best, ["page", "id"], "left").join(alone, ["page", "label"], "left")
    return out.select("page", "id", F.coalesce("match", "by_label").alias("match"), "overlap")


def greedy_tables(tables: DataFrame, candidates: DataFrame) -> DataFrame:
    """As ``match_tables``, but each candidate is used once, tables choosing in order of ``pos``.

    The order of choice is the result, so each page is matched in one task; a page's tables are few.
    """
    fields = ["id", "pos", "label", "x0", "y0", "x1", "y1"]
    each = lambda rows, name: rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", *(f for f in fields if f != "pos")))).alias(name))
    pages = each(tables, "left").join(each(candidates, "right"), "page", "left")
    return pages.select("page", F.explode(_greedy("left", "right")).alias("m")).select("page", "m.id", "m.match")


def _greedy_page(left: list[dict], right: list[dict]) -> list[dict]:
    free, rows = list(right), []
    for t in left:
        best, most = None, LEAST_IOU
        for c in free:
            w, h = min(t["x1"], c["x1"]) - max(t["x0"], c["x0"]), min(t["y1"], c["y1"]) - max(t["y0"], c["y0"])
            both = w * h if w > 0 and h > 0 else 0.0
            share = both / ((t["x1"] - t["x0"]) * (t["y1"] - t["y0"]) + (c["x1"] - c["x0"]) * (c["y1"] - c["y0"]) - both) if both else 0.0
            if share >= most:
                best, most = c, share
        if best is None and t["label"] is not None:
            same = [c for c in free if c["label"] == t["label"]]
            best = same[0] if len(same) == 1 else None
        if best is not None:
            free.remove(best)
        rows.append({"id": t["id"], "match": None if best is None else best["id"]})
    return rows


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("match", T.LongType())])))
def _greedy(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in parts:
        yield pd.Series([_greedy_page(list(a), [] if b is None else list(b)) for a, b in zip(left, right, strict=True)])
