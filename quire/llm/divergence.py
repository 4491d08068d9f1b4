"""Terms on which sources of a language diverge, counted in mergeable radix tries.

Tasks count the terms of their texts and cut what they hold into a byte trie for each language and range of prefixes: its leaves in
UTF-8 order, each saying how many bytes of the path it shares with the leaf before, with the documents that hold it and a
counter for each source. Tries of a range merge as they stream by, so a task holds one range's leaves and not one
trie for each task that sent some; leaves in too few documents fall, and the others' counters, stored, give the sources' totals.
A second traversal turns counters into shares: each range sends its sums for pairs of sources, and its first candidates of each
source in value and UTF-8 order.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.arrow import bounded_batches
from quire.sources.shared import materialize

#: Counters that a task holds before it sends them on, leaves of a range by estimate, and cells of a block of shares.
HELD, RANGE_LEAVES, CELLS = 500_000, 500_000, 2_000_000
#: Rows looked at to lay the ranges: one in so many. They decide where leaves go, no count.
LOOK = 16
#: Bytes of a term by which it is dealt to a range; exact as a double.
PREFIX = 6
#: What is no letter of a term becomes a blank: ASCII but letters. A-Z become a-z, all other bytes stay.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCALE, PRIOR = 1_000_000_000, 5
ROW = "range int, lang string, trie binary, sources array<string>"


class Trie(NamedTuple):
    """Leaves of a radix trie in UTF-8 order: terms, documents, and counters (leaf, source's number, count) by leaf."""

    terms: list[bytes]
    docs: np.ndarray
    leaf: np.ndarray
    source: np.ndarray
    count: np.ndarray


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of letters and of characters beyond ASCII, A-Z in lower case."""
    return text.translate(TABLE).split()


def _flat(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of terms, and the start and size of each."""
    sizes = np.fromiter(map(len, terms), np.int64, len(terms))
    return np.frombuffer(b"".join(terms), np.uint8), np.cumsum(sizes) - sizes, sizes


def prefix_numbers(terms: list[bytes]) -> np.ndarray:
    """The first ``PREFIX`` bytes of each term as a number, which rises with the term."""
    flat, starts, sizes = _flat(terms)
    found = np.zeros(len(terms), np.int64)
    for k in range(PREFIX):
        found <<= 8
        there = sizes > k
        found[there] |= flat[starts[there] + k]
    return found


def pack(trie: Trie) -> bytes:
    """A trie's leaves by the bytes that each adds to the path above it."""
    flat, starts, sizes = _flat(trie.terms)
    shared = np.zeros(len(sizes), np.int64)
    live = np.arange(1, len(sizes))
    n = 0
    while len(live):
        live = live[(sizes[live] > n) & (sizes[live - 1] > n)]
        live = live[flat[starts[live] + n] == flat[starts[live - 1] + n]]
        n += 1
        shared[live] = n
    own = flat[np.arange(len(flat)) - np.repeat(starts, sizes) >= np.repeat(shared, sizes)]
    counters = np.bincount(trie.leaf, minlength=len(sizes))
    head = np.array([len(sizes), len(trie.count)], "<i8")
    return b"".join(x.tobytes() for x in (head, trie.docs.astype("<i8"), trie.count.astype("<i8"), shared.astype("<i4"), (sizes - shared).astype("<i4"), counters.astype("<i4"), trie.source.astype("<i4"), own))


def unpack(blob: bytes) -> Trie:
    n, m = np.frombuffer(blob, "<i8", 2).tolist()
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(blob, kind, count, at)
        at += x.nbytes
        return x

    docs, count, shared, sizes, counters, source = take("<i8", n), take("<i8", m), take("<i4", n), take("<i4", n), take("<i4", n), take("<i4", m)
    terms, term = [], b""
    for s, size in zip(shared.tolist(), sizes.tolist(), strict=True):
        term = term[:s] + blob[at : at + size]
        at += size
        terms.append(term)
    return Trie(terms, docs, np.repeat(np.arange(n), counters), source.astype(np.int64), count)


def merge(tries: list[Trie]) -> Trie:
    """The leaves of all tries, equal ones added up; sources have the same numbers in all."""
    flat = pa.array([t for x in tries for t in x.terms], pa.large_binary())
    coded = pc.dictionary_encode(flat)
    code, words = coded.indices.to_numpy(), coded.dictionary
    order = pc.array_sort_indices(words).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    leaf = place[code]
    docs = np.zeros(len(order), np.int64)
    np.add.at(docs, leaf, np.concatenate([x.docs for x in tries]))
    first = np.cumsum([0, *(len(x.terms) for x in tries)])
    of = leaf[np.concatenate([x.leaf + a for x, a in zip(tries, first[:-1].tolist(), strict=True)])]
    source = np.concatenate([x.source for x in tries])
    count = np.concatenate([x.count for x in tries])
    by = np.lexsort((source, of))
    of, source, count = of[by], source[by], count[by]
    new = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(source, prepend=-1) != 0))
    return Trie(words.take(pa.array(order)).to_pylist(), docs, of[new], source[new], np.add.reduceat(count, new) if len(new) else count)


def part(trie: Trie, keep: np.ndarray) -> Trie:
    """The leaves of ``keep`` (their places, ascending)."""
    place = np.full(len(trie.terms), -1)
    place[keep] = np.arange(len(keep))
    there = place[trie.leaf] >= 0
    return Trie([trie.terms[k] for k in keep.tolist()], trie.docs[keep], place[trie.leaf[there]], trie.source[there], trie.count[there])


def _record(ranges, langs, blobs, sources):
    return pa.record_batch({"range": pa.array(ranges, pa.int32()), "lang": pa.array(langs, pa.string()), "trie": pa.array(blobs, pa.binary()), "sources": pa.array(sources, pa.list_(pa.string()))})


def _held_tries(docs: Counter, counts: dict[str, Counter]) -> tuple[Trie, list[str]]:
    sources = sorted(counts)
    terms = sorted(docs)
    place = dict(zip(terms, range(len(terms)), strict=True))
    leaf = np.fromiter((place[t] for s in sources for t in counts[s]), np.int64)
    count = np.fromiter((n for s in sources for n in counts[s].values()), np.int64)
    source = np.repeat(np.arange(len(sources)), [len(counts[s]) for s in sources])
    by = np.argsort(leaf, kind="stable")
    return Trie(terms, np.fromiter(map(docs.__getitem__, terms), np.int64, len(terms)), leaf[by], source[by], count[by]), sources


def _count(bounds: np.ndarray):
    def send(docs, counts):
        for lang in docs:
            trie, sources = _held_tries(docs[lang], counts[lang])
            where = np.searchsorted(bounds, prefix_numbers(trie.terms), "right")
            at = np.flatnonzero(np.diff(where, prepend=-1))
            ends = np.append(at[1:], len(where))
            first = np.searchsorted(trie.leaf, at)
            last = np.searchsorted(trie.leaf, ends)
            for a, b, f, e in zip(at.tolist(), ends.tolist(), first.tolist(), last.tolist(), strict=True):
                cut = Trie(trie.terms[a:b], trie.docs[a:b], trie.leaf[f:e] - a, trie.source[f:e], trie.count[f:e])
                yield _record([int(where[a])], [lang], [pack(cut)], [sources])

    def run(batches):
        docs, counts, held = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter)), 0
        for batch in batches:
            for text, lang, source in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True):
                terms = terms_of(text.encode())
                own = counts[lang][source]
                held -= len(own)
                own.update(terms)
                held += len(own)
                docs[lang].update(set(terms))
                if held >= HELD:
                    yield from send(docs, counts)
                    docs, counts, held = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter)), 0
        if held:
            yield from send(docs, counts)

    return run


def _look(batches):
    for batch in batches:
        terms = sorted({(lang, t) for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True) for t in terms_of(text.encode())})
        yield pa.record_batch({"prefix": pa.array(prefix_numbers([t for _, t in terms]), pa.int64())})


def _merge_ranges(least: int):
    """Rows sorted by range and language: their tries merged as they come, leaves in fewer than ``least`` documents left out."""

    def whole(key, number, held):
        trie = merge(held)
        trie = part(trie, np.flatnonzero(trie.docs >= least))
        if trie.terms:
            yield _record([key[0]], [key[1]], [pack(trie)], [list(number)])

    def run(batches):
        key, number, held, fresh = None, {}, [], 0
        for batch in batches:
            for own, lang, blob, sources in zip(*(batch[c].to_pylist() for c in ("range", "lang", "trie", "sources")), strict=True):
                if key != (own, lang):
                    if held:
                        yield from whole(key, number, held)
                    key, number, held, fresh = (own, lang), {}, [], 0
                trie = unpack(blob)
                named = np.array([number.setdefault(s, len(number)) for s in sources], np.int64)
                held.append(trie._replace(source=named[trie.source]))
                fresh += len(trie.count) if len(held) > 1 else 0
                if fresh > max(HELD, len(held[0].count)):
                    held, fresh = [merge(held)], 0
        if held:
            yield from whole(key, number, held)

    return run


def _totals(batches):
    for batch in batches:
        for lang, blob, sources in zip(*(batch[c].to_pylist() for c in ("lang", "trie", "sources")), strict=True):
            trie = unpack(blob)
            n = np.zeros(len(sources), np.int64)
            np.add.at(n, trie.source, trie.count)
            yield pa.record_batch({"lang": pa.array([lang] * len(sources)), "source": pa.array(sources), "n": pa.array(n), "leaves": pa.array([len(trie.terms) if k == 0 else 0 for k in range(len(sources))], pa.int64())})


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total), exact while a total is below 2**53: SCALE is divided off in three steps of a thousand."""
    found = count // total
    rest = count - found * total
    for _ in range(3):
        rest = rest * 1000
        digits = rest // total
        rest -= digits * total
        found = found * 1000 + digits
    return 1 + found


def _compare(top: int):
    """For each stored trie, with its language's sources and totals: sums of pairs, and the first candidates of each source."""

    def of_block(trie: Trie, sources: np.ndarray, totals: np.ndarray, n_terms: int, block: slice):
        a, b = np.searchsorted(trie.leaf, (block.start, block.stop))
        counts = np.zeros((block.stop - block.start, len(totals)), np.int64)
        counts[trie.leaf[a:b] - block.start, sources[trie.source[a:b]]] = trie.count[a:b]
        p = shares(counts + PRIOR, totals + PRIOR * n_terms)
        q = shares(counts.sum(1) + PRIOR, totals.sum() + PRIOR * n_terms)
        sums = [np.abs(p[:, k + 1 :] - p[:, k : k + 1]).sum(0) for k in range(len(totals))]
        found = []
        for k in range(len(totals)):
            over = np.flatnonzero((counts[:, k] > 0) & (p[:, k] > q))
            value = p[over, k] - q[over]
            first = np.argsort(-value, kind="stable")[:top]
            found += [(k, trie.terms[block.start + i], v) for i, v in zip(over[first].tolist(), value[first].tolist(), strict=True)]
        return sums, found

    def run(batches):
        for batch in batches:
            for lang, blob, own, names, totals, n_terms in zip(*(batch[c].to_pylist() for c in ("lang", "trie", "sources", "names", "totals", "n_terms")), strict=True):
                trie = unpack(blob) if blob is not None else Trie([], *(np.zeros(0, np.int64) for _ in range(4)))
                place = {s: k for k, s in enumerate(names)}
                sources, totals = np.array([place[s] for s in own or ()], np.int64), np.array(totals, np.int64)
                sums, found = [np.zeros(len(names) - k - 1, np.int64) for k in range(len(names))], []
                step = max(1, CELLS // len(names))
                for at in range(0, len(trie.terms), step):
                    more, candidates = of_block(trie, sources, totals, n_terms, slice(at, min(at + step, len(trie.terms))))
                    sums = [x + y for x, y in zip(sums, more, strict=True)]
                    found += candidates
                for k, x in enumerate(sums):
                    yield _found(lang, [names[k]] * len(x), "pair", names[k + 1 :], x)
                yield _found(lang, [names[k] for k, _, _ in found], "term", [t.decode() for _, t, _ in found], [v for _, _, v in found])

    return run


def _found(lang, source, part, item, value):
    return pa.record_batch({"lang": pa.array([lang] * len(source), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array([part] * len(source), pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """How far the sources of each language of ``docs`` (text, lang, source) diverge: lang, source, part, item, value, rank.

    Terms are runs of letters and characters beyond ASCII, A-Z in lower case; a language keeps those in ``least`` of its
    documents. A source's share of a term is ``1 + floor(10**9 * (count + 5) / (total + 5 * terms))``, and so is its language's. Part ``pair``:
    each other source of the language with the distances of all terms' shares added up, 0 without terms. Part ``term``: the ``top`` terms whose share
    exceeds the language's most. Ranks go by value, largest first, then by the item's UTF-8. Nulls count as ''; sources without any term
    have pairs too; repeated rows count as often as they stand; a language of one source has no pairs; an empty table gives an empty result.

    A task holds one range's leaves, and a language's sources and totals stand in one row: the pairs are their square.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    looked = materialize(rows.where(F.pmod(F.xxhash64("text"), F.lit(LOOK)) == 0).select("text", "lang").mapInArrow(_look, "prefix long"), "prefixes")
    ranges = max(4, -(-looked.count() * LOOK // RANGE_LEAVES))
    bounds = looked.where("prefix is not null").approxQuantile("prefix", [k / ranges for k in range(1, ranges)], 0.1 / ranges)
    sent = rows.mapInArrow(_count(np.unique(np.array(bounds, np.int64))), ROW)
    merged = sent.repartition(ranges, "range").sortWithinPartitions("range", "lang").mapInArrow(_merge_ranges(least), ROW)
    kept = materialize(merged, "tries")
    totals = kept.mapInArrow(_totals, "lang string, source string, n long, leaves long").groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("leaves").alias("leaves"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill(0, ["n", "leaves"])
    langs = groups.groupBy("lang").agg(F.sum("leaves").alias("n_terms"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("s"))
    langs = materialize(langs.select(F.col("lang"), "n_terms", F.col("s.source").alias("names"), F.col("s.n").alias("totals")), "langs")
    sized = kept.join(langs, "lang").unionByName(langs.withColumns({"range": F.lit(-1), "trie": F.lit(None).cast("binary"), "sources": F.lit(None).cast("array<string>")}))
    found = materialize(sized.mapInArrow(_compare(top), "lang string, source string, part string, item string, value long"), "distances")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x")
    pairs = pairs.select("lang", ends, "part", "value").select("lang", "x.source", "part", "x.item", "value")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(by)) for x in (pairs, found.where("part = 'term'"))]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top).select(ranked[0].columns))
