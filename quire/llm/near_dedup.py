"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents with equal shingle sets form one *node*. Each node stands in ``TREES`` sorted signature orders:
order t sorts by the hashes from ``DEPTH * t`` on, cyclically. Nodes that agree on an order's first ``DEPTH``
hashes form a region, and the sort goes ``TAIL`` hashes deeper where a region is crowded. Neighbours in an
order have the longest common prefixes: every node's two neighbours to either side in its region are its
candidates, at whatever depth they part. Orders are dealt to tasks by ranges and not by region, so a region of
any size is spread over tasks; each task hands on its border rows, which are paired by region.

Candidates are confirmed on full shingle sets in two rounds: each node's most similar candidate by estimate
first, then all others whose ends are still in different classes. A region of more than ``WHOLE`` nodes that
these leave in several classes is *open*, as pairs of it may not have been compared: all nodes of open regions
go through an exact join (prefix and position filters on full shingle sets, rare shingles first), which finds
every link between two of the classes so far. Components of all confirmed links are the classes.

A pair of similarity s shares a region with probability 1 - (1 - s**DEPTH)**TREES: 0.9999999 at 0.8. A pair that
shares one is lost only if its estimate is over five standard errors too low.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.arrow import batches_of, bounded_batches
from quire.llm.components import connected_components
from quire.llm.hashing import chunks, mix, shingle_sets
from quire.llm.native import every, fresh
from quire.sources.shared import materialize, small_side

TREES, DEPTH, TAIL, HASHES = 22, 3, 8, 96
#: Neighbours of a node to either side in an order; a region of up to WHOLE nodes has all its pairs among the candidates.
REACH = 2
WHOLE = REACH + 1
#: Rows of orders handed to Python at a time: they are short.
ORDER_ROWS = 16384
#: Counters of shingles, by which the exact join orders them; the order decides its work, not its result.
COUNTERS = 1 << 20
#: Candidates whose estimate is this far below the threshold (over five standard errors) are not confirmed.
MARGIN = 0.22
#: Nodes of candidates are sent to all executors up to this many, and joined by a shuffle beyond.
BROADCAST_NODES = 1_000_000
#: Nodes of more rows are joined to their rows apart from all others.
HOT_ROWS = 1000

_seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_multiply, _add = _seeds[:HASHES] | np.uint64(1), _seeds[HASHES:]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The MinHash signature, uint32."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 2048):
        low = np.minimum(low, ((shingles[at : at + 2048, None] * _multiply + _add) >> np.uint64(32)).min(axis=0))
    return low.astype(np.uint32)


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit id of a shingle set, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def _sketch(width: int):
    tree_seed = mix(np.arange(1, TREES + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            texts, ids = batch["text"].to_pylist(), batch["doc_id"]
            for a, b in chunks(texts):
                rows = shingle_sets(texts[a:b], width)
                sigs = [signature(s) for s in rows]
                heads = np.array(sigs).reshape(-1, HASHES)[:, : TREES * DEPTH].reshape(-1, TREES, DEPTH).astype(np.uint64)
                key = np.broadcast_to(tree_seed, heads.shape[:2])
                for d in range(DEPTH):
                    key = mix(key * np.uint64(31) + heads[:, :, d])
                yield pa.record_batch(
                    {
                        "doc_id": ids.slice(a, b - a),
                        "n_shingles": pa.array([len(s) for s in rows], pa.int64()),
                        "node": pa.array([node_of(s) for s in rows], pa.int64()),
                        "sig": pa.array([(s & 0xFF).astype(np.uint8).tobytes() for s in sigs], pa.binary()),
                        "heads": pa.array(list(key.astype(np.int64)), pa.list_(pa.int64())),
                    }
                )

    return run


def sketch(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, node, sig (a byte of each hash) and heads (each order's region) of each row."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sketch(width), "doc_id long, n_shingles long, node long, sig binary, heads array<long>")


def _neighbours(batches):
    """Rows sorted by part, tail and node in; pairs of nodes of one part at a distance of ``REACH`` or less out.

    The task's first and last rows come too, as rows without a second node: their parts may go on in other tasks.
    """
    held, heads = None, 0

    def border(rows):
        return pa.record_batch({"part": rows["part"], "tail": rows["tail"], "a": rows["node"], "b": pa.nulls(len(rows), pa.int64()), "step": pa.nulls(len(rows), pa.int32())})

    for batch in batches:
        if heads < REACH and len(batch):
            yield border(batch.slice(0, REACH - heads))
            heads += min(len(batch), REACH - heads)
        old = len(held) if held is not None else 0
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if len(batch) else held
        part, node = rows["part"].to_numpy(zero_copy_only=False), rows["node"].to_numpy(zero_copy_only=False)
        for step in range(1, REACH + 1):
            at = np.arange(max(0, old - step), len(part) - step)
            at = at[(part[at] == part[at + step]) & (node[at] != node[at + step])] if len(at) else at
            if len(at):
                yield pa.record_batch({"part": pa.array(part[at]), "tail": pa.nulls(len(at), pa.binary()), "a": pa.array(node[at]), "b": pa.array(node[at + step]), "step": pa.array(np.full(len(at), step, np.int32))})
        held = rows.slice(max(0, len(rows) - REACH))
    if held is not None:
        yield border(held)


def neighbours(nodes: DataFrame) -> DataFrame:
    """(part, a, b, step) for nodes (node, sig, heads): pairs in one region that stand ``step`` places apart in its order.

    A pair comes once for each order in which it is close. No region is gathered anywhere: a task sees a range of
    an order, and of each task four rows, its first and last, meet their region's rows of other tasks.
    """
    spark = nodes.sparkSession
    tail = F.expr(f"substring(concat(sig, sig), pmod(tree * {DEPTH} + {DEPTH}, {HASHES}) + 1, {TAIL})")
    rows = nodes.select("node", "sig", F.posexplode("heads").alias("tree", "part")).select("part", tail.alias("tail"), "node")
    ordered = rows.repartitionByRange("part", "tail", "node").sortWithinPartitions("part", "tail", "node")
    with batches_of(spark, ORDER_ROWS):
        found = materialize(ordered.mapInArrow(_neighbours, "part long, tail binary, a long, b long, step int"), "orders")
    order = Window.partitionBy("part").orderBy("tail", "a")
    border = found.where("b is null").select("part", "tail", "a").distinct()
    crossing = border.select("part", "a", F.array(*(F.struct(F.lead("a", k).over(order).alias("b"), F.lit(k).alias("step")) for k in range(1, REACH + 1))).alias("ahead"))
    crossing = crossing.select("part", "a", F.explode("ahead").alias("x")).select("part", "a", "x.b", "x.step").where("b is not null and a <> b")
    return found.where("b is not null").select("part", "a", "b", "step").unionByName(crossing)


def _estimates(least: float):
    def run(batches):
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            score = ((left == right).mean(axis=1) * 256 - 1) / 255
            near = score >= least
            yield pa.record_batch({"a": pa.array(batch["a"].to_numpy()[near]), "b": pa.array(batch["b"].to_numpy()[near]), "estimate": pa.array(score[near])})

    return run


def candidates(found: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b, estimate), a < b: the pairs of ``neighbours`` whose signatures' agreement is ``least`` or more; distinct."""
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_estimates(least), "a long, b long, estimate double")


def _best(pairs: DataFrame) -> DataFrame:
    """(a, b): each node's pair of greatest estimate; distinct."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.struct("estimate", "a", "b").alias("pair"))
    return ends.groupBy("node").agg(F.max("pair").alias("pair")).select("pair.a", "pair.b").distinct()


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose ends are in different classes; a node without a class is one of its own."""
    side = lambda c: small_side(classes.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), BROADCAST_NODES)
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def open_nodes(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of regions over ``WHOLE`` whose nodes are of several components; distinct."""
    crowded = found.where("step = 1").groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= WHOLE).select("part")
    crowded = small_side(materialize(crowded, "crowded"), BROADCAST_NODES)
    ends = found.where("step = 1").join(crowded, "part").select("part", F.explode(F.array("a", "b")).alias("node"))
    labels = small_side(classes.select("node", "component"), BROADCAST_NODES)
    members = ends.join(labels, "node", "left").select("part", "node", F.coalesce("component", "node").alias("component"))
    several = members.groupBy("part").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("part")
    several = small_side(materialize(several, "several"), BROADCAST_NODES)
    return members.join(several, "part", "left_semi").select("node", "component").distinct()


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(40)).astype(np.int64) % COUNTERS


def _count_shingles(width: int):
    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in chunks(texts):
                total += np.bincount(np.concatenate([_counter(s) for s in shingle_sets(texts[a:b], width)]), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.record_batch({"counter": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    return run


def _prefixes(width: int, percent: int, counts: np.ndarray):
    """Of each set, in the order of counts, the shingles that can be the first one shared with a similar set.

    ``rest`` counts the set's shingles from there on. One whose counter is 1 is in no other set.
    """

    def run(batches):
        for batch in batches:
            texts, nodes, components = batch["text"].to_pylist(), batch["node"].to_numpy(), batch["component"].to_numpy()
            for a, b in chunks(texts):
                found = []
                for i, s in enumerate(shingle_sets(texts[a:b], width), a):
                    n = counts[_counter(s)]
                    order, size = np.lexsort((s, n)), len(s)
                    rest = size - np.arange(size)
                    at = (100 * rest >= percent * size) & (n[order] > 1)
                    found.append((s[order][at].view(np.int64), rest[at], np.full(at.sum(), size), np.full(at.sum(), nodes[i]), np.full(at.sum(), components[i])))
                yield pa.record_batch({c: pa.array(np.concatenate(x), pa.int64()) for c, x in zip(("shingle", "rest", "size", "node", "component"), zip(*found, strict=True), strict=True)})

    return run


def _links_of(rest, size, node, component, percent: int, most: int = 1 << 21):
    """Pairs (a, b) of one shingle's sets, sorted by size, of different components that may reach ``percent``."""
    i = np.arange(len(size))
    ends = np.searchsorted(size, (100 + percent) * rest // percent - size, side="right")
    n = np.maximum(ends - i - 1, 0)
    i, n = i[n > 0], n[n > 0]
    upto = np.cumsum(n)
    start = 0
    while start < len(i):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, side="right")))
        k = n[start:stop]
        x = np.repeat(i[start:stop], k)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
        good = (component[x] != component[y]) & ((100 + percent) * rest[y] >= percent * (size[x] + size[y]))
        yield node[x[good]], node[y[good]]
        start = stop


def _shared_prefixes(percent: int):
    """Rows sorted by shingle and size in; pairs of sets (a, b), a < b, out. A shingle's rows may span batches."""

    def emit(columns):
        shingle, rest, size, node, component = columns
        cuts = np.flatnonzero(np.diff(shingle)) + 1
        for s, e in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(shingle)])).tolist(), strict=True):
            if e - s > 1 and (component[s:e] != component[s]).any():
                for x, y in _links_of(rest[s:e], size[s:e], node[s:e], component[s:e], percent):
                    if len(x):
                        yield pa.record_batch({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})

    def run(batches):
        held = []
        for batch in batches:
            now = [batch[c].to_numpy() for c in ("shingle", "rest", "size", "node", "component")]
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))
            if last or (held and held[0][0][0] != now[0][0]):
                yield from emit([np.concatenate(x) for x in zip(*held, [c[:last] for c in now], strict=True)])
                held = []
            held.append([c[last:] for c in now])
        if held:
            yield from emit([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def exact_candidates(texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Every pair (a, b), a < b, of ``texts`` (node, component, text) of different components that may reach ``percent``."""
    counts = np.zeros(COUNTERS, np.int64)
    for row in texts.select("text").mapInArrow(_count_shingles(width), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).where("n > 1").toLocalIterator():
        counts[row.counter] = row.n
    counts = np.minimum(np.maximum(counts, 1), 0xFFFFFFFF).astype(np.uint32)
    rows = texts.mapInArrow(_prefixes(width, percent, counts), "shingle long, rest long, size long, node long, component long")
    return rows.repartition("shingle").sortWithinPartitions("shingle", "size").mapInArrow(_shared_prefixes(percent), "a long, b long").distinct()


def _confirm(width: int, percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
            left, right = batch["text_a"].to_pylist(), batch["text_b"].to_pylist()
            keep = []
            for s, e in chunks([x + y for x, y in zip(left, right, strict=True)], 1 << 20):
                for i, (x, y) in enumerate(zip(shingle_sets(left[s:e], width), shingle_sets(right[s:e], width), strict=True), s):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        keep.append(i)
            yield pa.record_batch({"a": pa.array([a[i] for i in keep], pa.int64()), "b": pa.array([b[i] for i in keep], pa.int64())})

    return run


def classified(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """(doc_id, n_shingles, node, class, component_id) of each row of ``docs``: class is one of the class's nodes.

    Rows without words have class null and a component of their own.
    """
    seen = materialize(sketch(docs, width), "sketch")
    full = seen.where("n_shingles > 0")
    nodes = full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig"), F.first("heads").alias("heads"))
    nodes = materialize(nodes, "nodes")
    found = neighbours(nodes)
    pairs = materialize(candidates(found, nodes, percent / 100 - MARGIN), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = _texts(docs, nodes.select("node", "rep").join(ends, "node"), width)
    links = materialize(_confirmed(_best(pairs), texts, percent, width), "links")
    classes = connected_components(links)
    rest = materialize(_confirmed(_apart(pairs, classes), texts, percent, width), "links")
    if not rest.isEmpty():
        links = links.unionByName(rest)
        classes = connected_components(links)
    texts = _texts(docs, nodes.select("node", "rep").join(open_nodes(found, classes), "node"), width)
    if not texts.isEmpty():
        pairs = materialize(exact_candidates(texts, percent, width), "pairs")
        more = materialize(_confirmed(pairs, texts, percent, width), "links")
        if not more.isEmpty():
            classes = connected_components(links.unionByName(more))
    least = classes.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    named = classes.join(least, "component").select("node", "component", "least")
    whole = nodes.join(named, "node", "left").select("node", "n", F.coalesce("component", "node").alias("class"), F.coalesce("least", "rep").alias("component_id"))
    # a node that many rows share would gather them in one task: such nodes are few and go to the rows instead
    hot = small_side(materialize(whole.where(F.col("n") > HOT_ROWS).select("node", F.col("class").alias("hot_class"), F.col("component_id").alias("hot_id")), "hot"), BROADCAST_NODES)
    rows = full.select("doc_id", "n_shingles", "node").join(hot, "node", "left")
    columns = ("doc_id", "n_shingles", "node", "class", "component_id")
    out = rows.where("hot_class is null").join(whole.where(F.col("n") <= HOT_ROWS), "node").select(*columns)
    out = out.unionByName(rows.where("hot_class is not null").select("doc_id", "n_shingles", "node", F.col("hot_class").alias("class"), F.col("hot_id").alias("component_id")))
    none = seen.where("n_shingles = 0").select("doc_id", "n_shingles", "node", F.lit(None).cast("long").alias("class"), F.col("doc_id").alias("component_id"))
    return out.unionByName(none)


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """Classes of documents linked by 100 * intersection >= ``percent`` * union of their shingle sets.

    Takes ``doc_id`` and ``text``; other columns are ignored. Returns a row per input row: doc_id,
    n_shingles, component_id (smallest doc_id reachable, itself included) and kept (doc_id = component_id).
    Null, empty and wordless texts have no shingles and are linked with nothing. Rows that repeat a
    doc_id keep a row each, and each is linked by its own text. A null doc_id never names a class: a class of
    null ids only has a null component_id, and its rows are kept. An empty table gives an empty result.
    """
    out = classified(docs, percent, width).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _of_node(width: int):
    def run(batches):
        for batch in batches:
            texts, nodes = batch["text"].to_pylist(), batch["node"].to_pylist()
            keep = [i for s, e in chunks(texts) for i, x in enumerate(shingle_sets(texts[s:e], width), s) if node_of(x) == nodes[i]]
            yield batch.take(pa.array(keep, pa.int64()))

    return run


def _with_node(width: int):
    """Adds each row's node as the batch's last column; 0 for a text without words."""

    def run(batches):
        for batch in batches:
            texts = batch["text"].cast(pa.string()).to_pylist()
            nodes = [node_of(x) if len(x) else 0 for s, e in chunks(texts) for x in shingle_sets(texts[s:e], width)]
            yield batch.append_column("node", pa.array(nodes, pa.int64()))

    return run


def _texts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` (node, rep and other columns) without rep and with a text of each node, stored."""
    wanted = materialize(wanted, "wanted")
    named = small_side(wanted.where("rep is not null"), BROADCAST_NODES)
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    # rows that repeat a doc_id may hold different texts: the set's id tells which one is the node's
    found = materialize(rows.join(named, "rep").drop("rep"), "texts")
    found = found.mapInArrow(_of_node(width), found.schema)
    unnamed = wanted.where("rep is null").drop("rep")
    if not unnamed.isEmpty():
        own = rows.where("rep is null and text is not null").select("text").mapInArrow(_with_node(width), "text string, node long").groupBy("node").agg(F.first("text").alias("text"))
        found = found.unionByName(own.join(unnamed, "node").select(*found.columns))
    return materialize(found.dropDuplicates(["node"]), "texts")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The ``pairs`` (a, b) whose texts' shingle sets reach ``percent``."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(width, percent), "a long, b long")


def keep_one(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of ``docs`` (all columns) without near duplicates: one row of each class stays.

    Each row is judged by its own text. The row of the class's smallest doc_id stays (a null one only where the
    class has no other); of several such rows, the one whose other columns come first in order, and of rows
    equal in all columns one. Rows without words stay. An empty table gives an empty result.
    """
    found = materialize(classified(docs, percent, width), "classes")
    per_id = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("class is not null and not (doc_id <=> component_id)")).alias("drop"))
    per_id = materialize(per_id.where("n > 1 or doc_id is null or drop").select("doc_id", F.expr("n > 1 or doc_id is null").alias("again"), "drop"), "judged")
    key = fresh(docs, "key")
    side = lambda rows: small_side(rows.select(F.col("doc_id").alias(key)), BROADCAST_NODES)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key))
    out = docs.join(side(per_id), same, "left_anti")
    again = per_id.where("again")
    if again.isEmpty():
        return out
    # rows that repeat an id, or have none, are told apart by their text
    row = fresh(docs, "row")
    some = docs.join(side(again), same, "left_semi")
    bounded_batches(docs.sparkSession)
    text = materialize(some.withColumn(row, F.monotonically_increasing_id()), "again")
    own = text.select(row, F.col("text").cast("string").alias("text")).mapInArrow(_with_node(width), f"`{row}` long, text string, node long").select(row, "node")
    # nodes of the rows in question, each with its class
    classes = found.join(again.select(F.col("doc_id").alias(key)), found["doc_id"].eqNullSafe(F.col(key)), "left_semi").where("class is not null").groupBy("node").agg(F.first("class").alias("class"), F.first("component_id").alias("component_id"))
    placed = text.select(F.col(row), F.col("doc_id").cast("long").alias("id"), F.to_json(F.struct(*every(docs))).alias("order")).join(own, row).join(classes, "node", "left")
    placed = materialize(placed.select(F.col(row).alias("row"), "id", "order", "class", "component_id"), "placed")
    first = placed.where("class is not null and id <=> component_id").groupBy("class").agg(F.min(F.struct("order", "row")).alias("x")).select("x.row")
    stay = materialize(first.union(placed.where("class is null").select("row")), "stay").withColumnRenamed("row", row)
    return out.unionByName(text.join(stay, row, "left_semi").select(*every(docs)))
