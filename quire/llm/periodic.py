"""Maximal periodic runs of words, from the branching tandem repeats of suffix trees.

A worker puts the texts of a batch one after another, each text's words under numbers of its own and with a
number of its own at the end, so that no repeat crosses texts. Prefix doubling of the places that are not
yet alone sorts the suffixes; neighbours' common prefixes give the suffix tree's nodes, each a range of
sorted suffixes and a depth. For each node all leaf lists but the largest child's are walked (smaller half,
n log n leaves in all): leaf i of a node of depth q begins a branching tandem repeat if leaf i + q is in the node
too and the words q apart differ behind them. Rotating such a repeat to the left as far as words q apart
are equal gives the run that it ends; of repeats of one run, that of the smallest period stays.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import bounded_batches
from quire.llm.hashing import chunks

#: Leaves of nodes that are looked at together, and pairs of places few enough to be compared one by one.
HELD_LEAVES, FEW = 1 << 20, 64
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts as numbers, no two texts sharing any, with a number of its own before and behind each text; and where each begins."""
    fresh = count()
    parts, starts, at = [np.array([next(fresh)])], [], 1
    for words in texts:
        known = defaultdict(fresh.__next__)
        parts += [np.fromiter(map(known.__getitem__, words), np.int64, len(words)), np.array([next(fresh)])]
        starts.append(at)
        at += len(words) + 1
    return np.concatenate(parts), np.array(starts, np.int64)


def _run_starts(keys: np.ndarray) -> np.ndarray:
    """For each of sorted keys, the index of the first one equal to it."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def suffix_ranks(s: np.ndarray) -> np.ndarray:
    """Each suffix's place in order, by prefix doubling; only suffixes that share a prefix so far are sorted again."""
    n, times = len(s), np.bincount(s)
    rank = (np.cumsum(times) - times)[s]
    live, step = np.flatnonzero(times[s] > 1), 1
    while len(live):
        key = rank[live] * n + rank[live + step]
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        group = key // n
        place = group + np.arange(len(live)) - _run_starts(group)
        first = _run_starts(key)
        rank[live] = place[first]
        shared = np.bincount(first, minlength=len(live))[first] > 1
        live, step = live[shared], 2 * step
    return rank


def common(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many numbers are equal from each place of ``a`` and of ``b`` on; a number that occurs once ends each comparison."""
    found, live, n = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    while len(live) > FEW:
        live = live[s[a[live] + n] == s[b[live] + n]]
        n += 1
        found[live] = n
    for k in live.tolist():
        i, j, size = int(a[k]) + n, int(b[k]) + n, 64
        while True:
            x, y = s[i : i + size], s[j : j + size]
            m = min(len(x), len(y))
            parted = np.flatnonzero(x[:m] != y[:m])
            if len(parted):
                found[k] = i + int(parted[0]) - int(a[k])
                break
            i, j, size = i + m, j + m, 2 * size
    return found


def common_prefixes(s: np.ndarray, rank: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many numbers each suffix in order shares with the one before it.

    Compared only where the numbers in front of the two differ; elsewhere it is one less than at the place before.
    """
    n = len(s)
    before = order[rank - 1]
    own = (rank == 0) | (s[np.arange(n) - 1] != s[before - 1])
    own[0] = True
    own[before == 0] = True
    at = np.flatnonzero(own & (rank > 0))
    shared = np.zeros(n, np.int64)
    shared[at] = common(s, at, before[at])
    base = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    return (shared[base] - (np.arange(n) - base))[order]


def suffix_tree(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The inner nodes below the root: depth, first suffix, end; and where children of a node part, with that node."""
    depth, first, end, owner = [], [], [], []
    at = np.flatnonzero(lcp)
    path: list[int] = []
    last = -1
    for k, d in zip(at.tolist(), lcp[at].tolist(), strict=True):
        if k != last + 1:
            for x in path:
                end[x] = last + 1
            path = []
        lo = k - 1
        while path and depth[path[-1]] > d:
            x = path.pop()
            end[x], lo = k, first[x]
        if not path or depth[path[-1]] < d:
            path.append(len(depth))
            depth.append(d)
            first.append(lo)
            end.append(0)
        owner.append(path[-1])
        last = k
    for x in path:
        end[x] = last + 1
    return *(np.array(x, np.int64) for x in (depth, first, end)), at, np.array(owner, np.int64)


def branching_repeats(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and period of every branching tandem repeat of a numbered sequence, each once."""
    n, rank = len(s), suffix_ranks(s)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    depth, first, end, parts, owner = suffix_tree(common_prefixes(s, rank, order))
    if not len(depth):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by = np.argsort(owner, kind="stable")
    parts, owner = parts[by], owner[by]
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    # each node's children: from its first suffix to the first parting, between partings, and behind the last
    start = np.insert(parts, heads, first[owner[heads]])
    node = np.insert(owner, heads, owner[heads])
    last = np.append(np.flatnonzero(np.diff(node)), len(node) - 1)
    stop = np.append(start[1:], 0)
    stop[last] = end[node[last]]
    size = stop - start
    # all but the largest child of each
    ranked = np.lexsort((-size, node))
    small = np.ones(len(node), bool)
    small[ranked[np.flatnonzero(np.diff(node[ranked], prepend=-1))]] = False
    start, size, node = start[small], size[small], node[small]
    ends = np.cumsum(size)
    found_i, found_q, done = [], [], 0
    while done < len(size):
        base = ends[done - 1] if done else 0
        to = max(done + 1, int(np.searchsorted(ends, base + HELD_LEAVES, "right")))
        of = np.repeat(np.arange(done, to), size[done:to])
        leaf = order[start[of] + np.arange(len(of)) - (ends[of] - size[of] - base)]
        q, lo, hi = depth[node[of]], first[node[of]], end[node[of]]
        for i, j in ((leaf, leaf + q), (leaf - q, leaf)):
            ok = (i >= 0) & (j < n)
            i, p, other = i[ok], q[ok], (j if i is leaf else i)[ok]
            inside = (rank[other] >= lo[ok]) & (rank[other] < hi[ok])
            i, p = i[inside], p[inside]
            parted = s[i] != s[i + 2 * p]
            found_i.append(i[parted])
            found_q.append(p[parted])
        done = to
    key = np.unique(np.concatenate(found_i) * n + np.concatenate(found_q))
    return key // n, key % n


def runs_of(s: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all maximal runs of ``least`` numbers or more, in order of start and period."""
    i, q = branching_repeats(s)
    end = i + 2 * q
    order = np.lexsort((q, end))
    q, end = q[order], end[order]
    back, n = s[::-1], len(s)
    found = []
    while len(q):
        # the smallest period that ends at a place, rotated to the left
        head = _run_starts(end)
        own = np.flatnonzero(head == np.arange(len(q)))
        i = end[own] - 2 * q[own]
        start = i - common(back, n - i, n - i - q[own])
        found.append((start, end[own], q[own]))
        # its multiples within the same stretch are no periods of their own
        of = np.searchsorted(own, head)
        left = np.ones(len(q), bool)
        left[own] = False
        left &= (q % q[head] != 0) | (end - start[of] < 2 * q)
        q, end = q[left], end[left]
    start, end, q = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
    long = end - start >= np.maximum(least, 2 * q)
    start, end, q = start[long], end[long], q[long]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def kept_mask(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` places are in no run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) == 0


def _runs(least: int):
    def run(batches):
        for batch in batches:
            texts, ids = batch["text"].to_pylist(), batch["doc_id"]
            for a, b in chunks(texts):
                words = [(t or "").encode().split() for t in texts[a:b]]
                s, starts = numbered(words)
                start, end, period = runs_of(s, least)
                kept = kept_mask(len(s), start, end, period)
                of = np.searchsorted(starts, start, "right") - 1
                offsets = np.searchsorted(of, np.arange(b - a + 1))
                columns = [pa.array(x) for x in (start - starts[of], end - start, period)]
                runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(RUN)))
                joined = [b" ".join(compress(w, kept[at : at + len(w)].tolist()) if offsets[k] < offsets[k + 1] else w).decode() for k, (w, at) in enumerate(zip(words, starts.tolist(), strict=True))]
                yield pa.record_batch({"doc_id": ids.slice(a, b - a), "n_words": pa.array([len(w) for w in words], pa.int64()), "runs": runs, "collapsed": pa.array(joined, pa.string())})

    return run


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """The maximal periodic runs of each row of ``docs`` (doc_id, text): doc_id, n_words, runs, collapsed.

    Words are runs of characters other than ``[\\x20\\x09-\\x0D]`` and compare as they are. A run is a stretch of
    ``least`` words or more that holds its smallest period twice at least and that no neighbouring word extends; ``runs`` has start
    (a word's number), length and period of each, by start, then period. ``collapsed`` is the text's words joined by one
    space, without those that any run contains behind its first period. Null, empty and wordless texts have no runs
    and an empty ``collapsed``; repeated rows and rows without an id each have a row of their own; other columns are
    not read; an empty table gives an empty result. A text is held whole by one task, about 200 bytes a word at a time.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_runs(least), SCHEMA)
