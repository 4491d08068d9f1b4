"""Calls admitted to a budget in their order, as a serial loop would, by running sums over ranges.

Costs are whole numbers (millionths of a dollar), so sums are exact. A round adds up the calls still open, range by range; those whose
running sum fits are admitted, the first that doesn't is refused with all later ones that are dearer than what is left, and the rest
goes on with that. Calls of like cost take a few rounds; each round reads the open ones only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.sources.shared import materialize

#: Millionths of a dollar.
UNIT = 1_000_000


def worst_case(input_tokens: Column, most_output: Column, price_in: Column, price_out: Column) -> Column:
    """The most that a call can cost, in millionths of a dollar, rounded up: its counted input and the full length of an answer, at prices of a million tokens."""
    return F.ceil(input_tokens * price_in + most_output * price_out).cast("long")


def spent(ledger: DataFrame, dollars: str = "usd") -> int:
    """What a ledger's rows add up to, in millionths of a dollar, each rounded up."""
    return int(ledger.agg(F.coalesce(F.sum(F.ceil(F.col(dollars) * UNIT).cast("long")), F.lit(0))).first()[0])


def _running(rows: DataFrame) -> DataFrame:
    """``rows`` (part, nth, cost) with ``upto``: the costs of all rows up to each, by two levels of sums."""
    parts = rows.groupBy("part").agg(F.sum("cost").alias("whole"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = parts.select("part", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(F.broadcast(offsets), "part").withColumn("upto", F.col("offset") + F.sum("cost").over(inside)).drop("offset")


def admitted(calls: DataFrame, order: list[str], cap: int, already: int = 0, ranges: int | None = None) -> DataFrame:
    """``calls`` with ``admitted``, in order of the columns ``order``: whether the call's cost fits under ``cap`` with what came before.

    ``cost`` (long, 0 or more) and ``cap`` are in the same unit; ``already`` is spent. A refused call costs nothing, so a later, cheaper one may
    still fit. A null cost is refused. ``order`` must tell calls apart for reruns to agree: of calls alike either may come first.
    """
    spark = calls.sparkSession
    n = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = calls.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    stored = materialize(dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*order))), "calls")
    open_ = materialize(stored.where("cost is not null").select(F.col("_part").alias("part"), F.col("_nth").alias("nth"), "cost"), "open")
    left, taken = cap - already, []
    while True:
        open_ = open_.where(F.col("cost") <= left)
        sums = materialize(_running(open_), "sums")
        fits = sums.where(F.col("upto") <= left)
        found = fits.agg(F.max("upto").alias("used")).first().used
        last = sums.where(F.col("upto") > left).agg(F.min(F.struct("part", "nth")).alias("x")).first().x
        taken.append(fits.select(F.col("part").alias("_part"), F.col("nth").alias("_nth")))
        if last is None:
            break
        left -= found or 0
        behind = (F.col("part") > last.part) | ((F.col("part") == last.part) & (F.col("nth") > last.nth))
        open_ = materialize(sums.where(behind).select("part", "nth", "cost"), "open")
    chosen = taken[0]
    for more in taken[1:]:
        chosen = chosen.unionByName(more)
    flag = chosen.withColumn("admitted", F.lit(True))
    return stored.join(flag, ["_part", "_nth"], "left").withColumn("admitted", F.coalesce("admitted", F.lit(False))).drop("_part", "_nth")
