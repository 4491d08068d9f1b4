"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

A source's documents, shuffled by a hash, form a line of tokens, run through twice at most and cut into
equal blocks. Slot i of the mix goes to the source at golden-ratio point frac(i / phi) of the cumulative
target weights; the slots of a source are ranked, and slot rank r takes block r of its source's line.
Nothing is gathered but one row a source: positions and ranks are prefix sums in two levels, over
hash buckets (or slot ranges) and inside each, so a hot source is spread over many tasks of ``BUCKET`` rows or so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import native
from quire.sources.shared import materialize

#: Slots of the schedule: a source's share is met to about 20 / SLOTS of the mix. Blocks grow with the mix.
SLOTS = 1 << 20
#: Documents of a hash bucket, slots of a range, and cells of the cumulative weights' index.
BUCKET, RANGE, CELLS = 8192, 4096, 4096
GOLDEN = 0.6180339887498949
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2


def fill_targets(sizes: list[int], share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> list[float]:
    """Targets of sources in order: by weight, none above ``repeats`` times its size, the excess reshared."""
    targets, left, open_ = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        give = {i: left * weights[i % len(weights)] / total for i in open_}
        over = {i for i in open_ if give[i] > repeats * sizes[i]}
        for i in over or open_:
            targets[i] = float(repeats * sizes[i]) if over else give[i]
        left -= sum(repeats * sizes[i] for i in over)
        open_ = [i for i in open_ if i not in over] if over else []
    return targets


def _running(rows: DataFrame, group: str, part: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over earlier rows of the group, by ``part`` and then ``order``."""
    rows = rows.withColumn("_part", part)
    sums = rows.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(sums, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p"))).withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_g", "_p", "_base")


def schedule(spark: SparkSession, targets: list[float], slots: int = SLOTS) -> tuple[DataFrame, int]:
    """(source_ix, block) of each slot, blocks ranked from 0 within a source, and a block's tokens."""
    total = sum(targets)
    block = max(1, -(-int(total) // slots))
    edges, at = [], 0.0
    for i, t in enumerate(targets):
        lo, at = at, at + t
        if t > 0:
            edges.append((i, lo / total, at / total if any(x > 0 for x in targets[i + 1 :]) else 2.0))
    bounds = spark.createDataFrame(edges, "source_ix int, lo double, hi double") if edges else spark.createDataFrame([], "source_ix int, lo double, hi double")
    cells = bounds.select("source_ix", "lo", "hi", F.explode(F.expr(f"sequence(cast(floor(lo * {CELLS}) as int), cast(floor(least(hi, 1.0D) * {CELLS}) as int))")).alias("cell"))
    points = spark.range(-(-int(total) // block)).select(F.col("id").alias("slot"), F.expr(f"(id + 0.5D) * {GOLDEN}D - floor((id + 0.5D) * {GOLDEN}D)").alias("point"))
    dealt = points.withColumn("cell", F.expr(f"cast(floor(point * {CELLS}) as int)")).join(cells, "cell").where("point >= lo and point < hi").select("slot", "source_ix", F.lit(1).cast("long").alias("one"))
    return _running(dealt, "source_ix", F.expr(f"slot div {RANGE}"), ["slot"], "one", "block").select("source_ix", "block"), block


def mix(docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, slots: int = SLOTS) -> DataFrame:
    """How many words the mix takes of each row of ``docs`` (doc_id, text, source).

    Returns a row per row: doc_id, source, size (words; null and wordless texts: 0), source_size, target
    and taken (0 to twice the size, repeats counted). Sources stand by code point, null last, as a source
    of its own. Reruns agree; rows alike in doc_id and size may change places among themselves. An empty
    table, or one without words, takes nothing.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), native.n_words(F.col("text").cast("string")).alias("size"))
    sized = materialize(sized.withColumn("key", F.xxhash64(F.lit(10), "doc_id", "size")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).collect()
    totals.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    targets = fill_targets([r.source_size for r in totals], share, weights)
    params = spark.createDataFrame([(i, r.source, r.source_size, t) for i, (r, t) in enumerate(zip(totals, targets, strict=True))], "source_ix int, p_source string, source_size long, target double")
    rows = sized.join(params, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    buckets = max(1, -(-sum(r.n for r in totals) // BUCKET))
    some = _running(rows.where("size > 0"), "source_ix", F.expr(f"pmod(key, {buckets}L)"), ["key", "doc_id", "size"], "size", "start")
    some = materialize(some, "lines")
    slots_of, block = schedule(spark, targets, slots)
    passes = some.select("source_ix", "start", "size", F.explode(F.expr(f"transform(sequence(0, {REPEATS - 1}), p -> start + p * source_size)")).alias("at"))
    blocks = passes.select("source_ix", "start", "at", "size", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))
    took = blocks.join(slots_of, ["source_ix", "block"]).groupBy("source_ix", "start").agg(F.sum(F.expr(f"least(at + size, (block + 1) * {block}) - greatest(at, block * {block})")).alias("taken"))
    out = some.join(took, ["source_ix", "start"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    none = rows.where("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return out.unionByName(none)


def mixed_documents(docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, as often as the mix takes them.

    A row taken in part comes with its first words, joined by a space, and its n_chars, if it has that
    column, counted anew. Rows of which nothing is taken are left out, so null and wordless texts are. Rows that
    repeat a doc_id, or have none, are matched by source, size and the order of their texts. Extra columns of any
    name keep their values; an empty table gives an empty result.
    """
    taken = materialize(mix(docs, share, weights).select("doc_id", "source", "size", "taken"), "taken")
    keys, rows = {"doc_id": F.col("doc_id").cast("long")}, docs
    if not taken.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        # rows alike in id, source and size are numbered on both sides; ids repeat seldom, and so do all three
        size, nth = native.fresh(docs, "size"), native.fresh(docs, "nth")
        taken = taken.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("taken")))
        same = Window.partitionBy("doc_id", "source", size).orderBy(F.xxhash64(F.col("text")))
        rows = docs.withColumn(size, native.n_words(F.col("text").cast("string"))).withColumn(nth, F.row_number().over(same))
        keys |= {"source": F.col("source").cast("string"), "size": F.col(size), "nth": F.col(nth)}
    names = {k: native.fresh(rows, f"of_{k}") for k in ("doc_id", "source", "size", "nth", "full", "taken", "take")}
    taken = taken.where("taken > 0").select(*(F.col(k).alias(names[k]) for k in keys), F.col("size").alias(names["full"]), F.col("taken").alias(names["taken"]))
    match = reduce(lambda a, b: a & b, (value.eqNullSafe(F.col(names[k])) for k, value in keys.items()))
    full, took, take = (F.col(names[k]) for k in ("full", "taken", "take"))
    # as many rows as documents: a shuffle at every size
    rows = rows.join(taken.hint("merge"), match).withColumn(names["take"], F.explode(F.filter(F.array(F.least(took, full), took - full), lambda x: x > 0)))
    part = F.array_join(F.slice(native.words(F.col("text")), 1, take.cast("int")), " ")
    out = rows.withColumn("text", F.when(take == full, F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*native.every(docs))
