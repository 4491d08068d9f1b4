"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.shared import materialize, small_side

#: Maps of up to this many nodes are sent to all executors, and joined by a shuffle beyond.
BROADCAST_NODES = 1_000_000


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each end of ``links`` (a, b): component is the smallest node reachable.

    Each round sends every node to the least of itself and its neighbours, follows that twice (pointer jumping),
    and goes on with the links between the nodes that are left: two ends of a link never both stay, so the nodes
    with links halve at least. The rounds' maps are composed at the end. All tables are written to the shared
    folder; nothing but the test for links left reaches the driver. Repeated links and self links are harmless;
    without links the result is empty.
    """
    flip = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    edges = materialize(links.select("a", "b").union(flip).where("a <> b").distinct(), "edges")
    rounds = []
    while not rounds or not edges.isEmpty():
        low = materialize(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("low")), "low")
        small = low.count() <= BROADCAST_NODES
        send = lambda side: F.broadcast(side) if small else side
        step = lambda to: send(low.select(F.col("node").alias(to), F.col("low").alias(f"{to}_low")))
        far = low.join(step("low"), "low").select("node", F.col("low_low").alias("next")).join(step("next"), "next").select("node", F.col("next_low").alias("component"))
        rounds.append(materialize(far, "far"))
        side = lambda c: send(rounds[-1].select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")))
        edges = edges.join(side("a"), "a").join(side("b"), "b").where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()
        edges = materialize(edges, "edges")
    out = rounds.pop()
    while rounds:
        later = small_side(out.select(F.col("node").alias("component"), F.col("component").alias("last")), BROADCAST_NODES)
        out = materialize(rounds.pop().join(later, "component", "left").select("node", F.coalesce("last", "component").alias("component")), "labels")
    return out
