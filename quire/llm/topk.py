"""Exact top-k inner products by ball trees.

Vectors are dealt to clusters round centres that are learned from a bounded sample, and within a cluster to shards of
bounded size; each shard becomes a ball tree kept as one binary value. Queries go in blocks of one cluster. A block first
searches one shard of its own cluster: its kth score so far is what all its other searches start from, and clusters
whose ball can't reach it for any query of the block are never met. A search takes the node of greatest upper bound
q.c + |q| r first and ends when that is below the query's kth score so far. Clusters and their order decide the work,
never the result: every vector is in a shard, and only what a bound excludes is passed over.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.arrow import batches_of, bounded_batches
from quire.sources.shared import materialize

#: Numbers in a shard and in a block of queries (their rows: this over the dimension), and rows of a leaf.
SHARD_VALUES, BLOCK_VALUES, LEAF = 1 << 18, 1 << 14, 64
#: Clusters of a dimension, and about how many vectors their centres are learned from.
CLUSTERS, SAMPLE, STEPS = 64, 8192, 8
#: Shards that a cluster holds on average at least: smaller clusters would be pruned more often, but leave blocks and shards half empty.
SHARDS_EACH = 4
#: Vectors handed to Python at a time where only their clusters are told.
ORDER_ROWS = 4096
#: Rows of tree and queries handed to Python at a time.
PAIR_ROWS = 4
#: Above this, float64 sums may round; integers are then used.
EXACT = float(1 << 53)


def build(vectors: np.ndarray) -> dict[str, np.ndarray]:
    """A ball tree: row order, and for each node its rows, children (-1: leaf), centre and radius."""
    order = np.arange(len(vectors))
    spans, left, right, centers, radii, todo = [(0, len(vectors))], [-1], [-1], [None], [0.0], [0]
    points = vectors.astype(np.float64)
    while todo:
        node = todo.pop()
        s, e = spans[node]
        own = points[order[s:e]]
        centers[node] = own.mean(axis=0) if e > s else np.zeros(points.shape[1])
        away = np.sqrt(((own - centers[node]) ** 2).sum(axis=1))
        radii[node] = away.max() if e > s else 0.0
        if e - s <= LEAF:
            continue
        first = own[away.argmax()]
        second = own[((own - first) ** 2).sum(axis=1).argmax()]
        along = np.argsort(own @ (second - first), kind="stable")
        order[s:e] = order[s:e][along]
        middle = (s + e) // 2
        for part, child in (((s, middle), left), ((middle, e), right)):
            child[node] = len(spans)
            todo.append(len(spans))
            spans.append(part)
            left.append(-1)
            right.append(-1)
            centers.append(None)
            radii.append(0.0)
    return {"order": order, "spans": np.array(spans), "left": np.array(left), "right": np.array(right), "centers": np.array(centers), "radii": np.array(radii)}


def search(tree: dict[str, np.ndarray], vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, query: np.ndarray, own: int, k: int, least: int | None) -> list[tuple[int, int, int]]:
    """The best (score, id, row) of a shard for a query: at most k, none below ``least``, ties to smaller id.

    ``vectors``, ``ids`` and ``rows`` are in the tree's order. Row ``own`` takes no part.
    """
    q = query.astype(np.float64)
    length = float(np.sqrt(q @ q))
    bounds = tree["centers"] @ q + length * tree["radii"]
    bounds = bounds + 1e-9 * (np.abs(bounds) + length * tree["radii"] + 1) + 1e-6
    small = float(np.abs(query).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, len(query)) < EXACT
    left, right, spans = tree["left"], tree["right"], tree["spans"]
    best: list[tuple[int, int, int]] = []
    heap = [(-bounds[0], 0)]
    while heap:
        bound, node = heapq.heappop(heap)
        floor = best[-1][0] if len(best) == k else least
        if floor is not None and -bound < floor:
            break
        if left[node] >= 0:
            for child in (int(left[node]), int(right[node])):
                if floor is None or bounds[child] >= floor:
                    heapq.heappush(heap, (-bounds[child], child))
            continue
        s, e = spans[node]
        scores = (vectors[s:e].astype(np.float64) @ q).astype(np.int64) if small else (vectors[s:e] * query).sum(axis=1)
        near = np.flatnonzero(scores >= floor) if floor is not None else np.arange(len(scores))
        if len(near):
            best += [(int(scores[i]), int(ids[s + i]), int(rows[s + i])) for i in near if rows[s + i] != own]
            best.sort(key=lambda x: (-x[0], x[1], x[2]))
            del best[k:]
    return best


def centres(sample: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` centres of a sample: far points first, then means of what is nearest to each."""
    points = sample.astype(np.float64)
    found = [points[0]]
    away = ((points - found[0]) ** 2).sum(axis=1)
    while len(found) < k and away.max() > 0:
        found.append(points[away.argmax()])
        away = np.minimum(away, ((points - found[-1]) ** 2).sum(axis=1))
    table = np.array(found)
    for _ in range(STEPS):
        own = _nearest(points, table)
        table = np.array([points[own == c].mean(axis=0) if (own == c).any() else table[c] for c in range(len(table))])
    return table


def _nearest(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    return ((table * table).sum(axis=1) - 2 * (points @ table.T)).argmin(axis=1)


def _assigned(tables: dict[int, np.ndarray]):
    """Adds each vector's cluster, and its distance from the cluster's centre."""

    def run(batches):
        for batch in batches:
            dims = batch["dim"].to_numpy(zero_copy_only=False)
            cluster, away = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                if d in tables:
                    at = np.flatnonzero(dims == d)
                    points = np.array(batch["v"].take(pa.array(at)).to_pylist(), np.int64).astype(np.float64)
                    cluster[at] = _nearest(points, tables[d])
                    away[at] = np.sqrt(((points - tables[d][cluster[at]]) ** 2).sum(axis=1))
            yield batch.append_column("cluster", pa.array(cluster)).append_column("away", pa.array(away))

    return run


def _in_reach(balls: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """For each block of queries the clusters that may hold a score at or above a query's kth so far."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                dim, own, block = (batch[c][i].as_py() for c in ("dim", "cluster", "block"))
                q = dict(np.load(io.BytesIO(batch["queries"][i].as_py())))
                points = q["vectors"].astype(np.float64)
                clusters, table, radii = balls[dim]
                length = np.sqrt((points * points).sum(axis=1))[:, None]
                bounds = points @ table.T + length * radii
                bounds += 1e-9 * (np.abs(bounds) + length * radii + 1) + 1e-6
                near = (bounds >= np.where(q["known"], q["least"], np.iinfo(np.int64).min)[:, None]).any(axis=0)
                other = clusters[near]
                yield pa.record_batch({"dim": pa.array([dim] * len(other), pa.int32()), "cluster": pa.array([own] * len(other), pa.int32()), "block": pa.array([block] * len(other), pa.int64()), "other": pa.array(other, pa.int32())})

    return run


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.array(table["v"].to_pylist(), np.int64).reshape(table.num_rows, -1)
    return vectors, table["vec_id"].to_numpy(), table["row"].to_numpy()


def _tree(table: pa.Table) -> pa.Table:
    vectors, ids, rows = _columns(table)
    tree = build(vectors)
    order = tree.pop("order")
    blob = _pack(**tree, vectors=vectors[order], ids=ids[order], rows=rows[order])
    return pa.table({"dim": table["dim"][:1], "other": table["cluster"][:1], "shard": table["shard"][:1], "tree": pa.array([blob], pa.binary())})


def _block(k: int):
    def run(table: pa.Table) -> pa.Table:
        vectors, ids, rows = _columns(table)
        least = table["least"].to_pylist()
        blob = _pack(vectors=vectors, ids=ids, rows=rows, least=np.array([x or 0 for x in least], np.int64), known=np.array([x is not None for x in least], bool))
        return pa.table({"dim": table["dim"][:1], "cluster": table["cluster"][:1], "block": table["block"][:1], "queries": pa.array([blob], pa.binary())})

    return run


def _search(k: int):
    def run(batches):
        for batch in batches:
            for tree, queries in zip(batch["tree"], batch["queries"], strict=True):
                t, q = (dict(np.load(io.BytesIO(x.as_py()))) for x in (tree, queries))
                vectors, ids, rows = t["vectors"], t["ids"], t["rows"]
                out = [
                    (int(qid), int(row), *hit)
                    for vec, qid, row, least, known in zip(q["vectors"], q["ids"], q["rows"], q["least"], q["known"], strict=True)
                    for hit in search(t, vectors, ids, rows, vec, int(row), k, int(least) if known else None)
                ]
                names = ("query_id", "query_row", "score", "vec_id", "vec_row")
                yield pa.record_batch({n: pa.array([x[i] for x in out], pa.int64()) for i, n in enumerate(names)})

    return run


def top_k(vectors: DataFrame, k: int = 5, is_query: str = "vec_id % 50 = 0", scale: int = 256) -> DataFrame:
    """The k rows of greatest integer inner product for every query among ``vectors`` (vec_id, embedding).

    Components become floor(``scale`` * x). Queries are the rows for which the SQL condition ``is_query``
    holds; candidates are all rows but the query's own, a repeated vec_id's other rows included. Returns
    query_id, rank (from 1), vec_id, score; equal scores go to the smaller vec_id. Vectors that are null,
    or hold null or non-finite components, take no part, nor do rows without a vec_id; vectors only meet
    those of their own dimension, and an empty vector none. Scores have 64 bits and wrap beyond. An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    x = F.col("embedding").cast("array<double>")
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and size(x) > 0 and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    rows = materialize(sound.select("vec_id", F.monotonically_increasing_id().alias("row"), F.expr(f"transform(x, c -> cast(floor({scale} * c) as bigint))").alias("v"), F.expr("size(x)").alias("dim")), "vectors")
    per_shard = lambda dim: max(SHARD_VALUES // dim, 64)
    sizes = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a dimension
    tables = {}
    for dim, n in sizes.items():
        if (k_clusters := min(CLUSTERS, n // (SHARDS_EACH * per_shard(dim)))) > 1:
            some = rows.where(F.col("dim") == dim).where(F.expr(f"pmod(xxhash64(row, 3), {n}L) < {SAMPLE}L")).select("v").collect()
            if some:
                tables[dim] = centres(np.array([r.v for r in some], np.int64), k_clusters)
    with batches_of(spark, ORDER_ROWS):
        placed = materialize(rows.mapInArrow(_assigned(tables), "vec_id long, row long, v array<long>, dim int, cluster int, away double"), "placed")
    groups = materialize(placed.groupBy("dim", "cluster").agg(F.count(F.lit(1)).alias("n"), F.expr(f"count_if({is_query})").alias("m"), F.max("away").alias("radius")), "groups")
    balls = {}
    for r in sorted(groups.collect()):  # CLUSTERS rows a dimension at most
        balls.setdefault(r.dim, []).append((r.cluster, r.radius))
    balls = {d: (np.array([c for c, _ in x], np.int32), tables[d][[c for c, _ in x]] if d in tables else np.zeros((1, d)), np.array([r if d in tables else np.inf for _, r in x])) for d, x in balls.items()}
    numbers = groups.select("dim", "cluster", F.expr(f"ceil(n / greatest({SHARD_VALUES} div dim, 64))").alias("shards"), F.expr(f"greatest(1, ceil(m / greatest({BLOCK_VALUES} div dim, 8)))").alias("blocks"))
    dealt = placed.join(F.broadcast(numbers), ["dim", "cluster"]).select("*", F.expr("pmod(xxhash64(row, 1), shards)").alias("shard"))
    shape = ("dim", "cluster", "shard", "vec_id", "row", "v")
    trees = materialize(dealt.select(*shape).groupBy("dim", "cluster", "shard").applyInArrow(_tree, "dim int, other int, shard long, tree binary"), "trees")
    asked = dealt.where(is_query).select("dim", "cluster", F.expr("pmod(xxhash64(row, 2), blocks)").alias("block"), "vec_id", "row", "v")
    pack = lambda df: df.groupBy("dim", "cluster", "block").applyInArrow(_block(k), "dim int, cluster int, block long, queries binary")
    hits = "query_id long, query_row long, score long, vec_id long, vec_row long"
    own = numbers.select("dim", "cluster", "shards")
    with batches_of(spark, PAIR_ROWS):
        first = pack(asked.withColumn("least", F.lit(None).cast("long"))).join(F.broadcast(own), ["dim", "cluster"]).withColumn("other", F.col("cluster")).withColumn("shard", F.expr("block % shards"))
        seeds = materialize(first.join(trees, ["dim", "other", "shard"]).select("tree", "queries").mapInArrow(_search(k), hits), "seeds")
        kth = seeds.groupBy("query_row").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_row").alias("row"), "least")
        blocks = materialize(pack(asked.join(kth, "row", "left")), "blocks")
        met = materialize(blocks.mapInArrow(_in_reach(balls), "dim int, cluster int, block long, other int"), "met")
        met = met.join(F.broadcast(own.select("dim", F.col("cluster").alias("other"), "shards")), ["dim", "other"])
        rest = met.select("dim", "cluster", "block", "other", F.explode(F.expr("filter(sequence(0L, shards - 1), s -> other <> cluster or s <> block % shards)")).alias("shard"))
        others = materialize(rest.join(blocks, ["dim", "cluster", "block"]).join(trees, ["dim", "other", "shard"]).select("tree", "queries").mapInArrow(_search(k), hits), "hits")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    best = seeds.unionByName(others).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
