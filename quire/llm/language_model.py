"""An interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

Tokens are a text's words and then one end; the first word's context is a start. Tasks count bigrams of
a few hundred thousand tokens at a time and deal the sums out by ranges of the context's hash, a few rows
of binary arrays each; contexts that are frequent enough to crowd a range are dealt by the second word.
A range's sums become a sorted array of bigram hashes with counts and one of contexts with their totals,
and the numbers of distinct contexts of each second word are dealt out again by that word. The arrays are
files in the shared folder; a worker maps them and looks up the sorted distinct bigrams of a batch.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import bounded_batches
from quire.llm.files import map_array, write_array
from quire.llm.hashing import chunks, mix, word_hashes
from quire.sources.shared import materialize, new_path

#: Tokens of a range, tokens counted together in a task, and characters of a batch that is scored.
RANGE_TOKENS, HELD_TOKENS, SCORED = 2_000_000, 1_000_000, 2 << 20
#: Rows looked at to find the contexts that crowd a range: one in so many. They decide where sums go, no count.
LOOK = 16
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Second words keep 48 bits of their hash: one in 2**48 / (number of words) shares its counts with another.
SHORT = np.uint64((1 << 48) - 1)
#: Counts of bigrams from MOST on stand in a range's ``large`` file. Only those of frequent contexts can be: all
#: other contexts occur less often than a range has tokens, so that their counts fit 32 bits.
MOST = (1 << 32) - 1
BIGRAM = np.dtype([("key", "<u8"), ("n", "<u4")])
LARGE = np.dtype([("key", "<u8"), ("n", "<u8")])
CONTEXT = np.dtype([("key", "<u8"), ("n", "<u8"), ("n1", "<u8"), ("n2", "<u8"), ("n3", "<u8")])
AHEAD = np.dtype([("key", "<u8"), ("n", "<u8")])


def _range_of(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """The range of each hash of ``bits`` bits: rises with the hash."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(ranges)) >> np.uint64(32)


def bigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and tokens of all texts in order, and each text's first token (one entry more than texts)."""
    words, firsts = word_hashes(texts)
    at = firsts[1:]
    return np.insert(words, firsts[:-1], START), np.insert(words, at, END), firsts + np.arange(len(firsts))


def _key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v ^ (w * np.uint64(0x9E3779B97F4A7C15)))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _spans(keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    at = _runs(keys)
    return list(zip(at.tolist(), [*at[1:].tolist(), len(keys)][: len(at)], strict=True))


def _summed(v: np.ndarray, w: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigrams sorted and added up."""
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    at = _runs(v, w)
    count = np.diff(np.append(at, len(v))) if n is None else np.add.reduceat(n[order], at) if len(at) else np.zeros(0, np.int64)
    return v[at], w[at], count


def _packed(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted sums in few bytes: each context once, 48 bits of a second word, one byte of most counts."""
    at = _runs(v)
    large = np.flatnonzero(n > 255)
    head = np.array([len(at), len(v), len(large)], "<u4")
    return b"".join(
        x.tobytes()
        for x in (head, v[at].astype("<u8"), np.diff(np.append(at, len(v))).astype("<u4"), (w & np.uint64(0xFFFFFFFF)).astype("<u4"), (w >> np.uint64(32)).astype("<u2"), np.minimum(n, 255).astype("u1"), large.astype("<u4"), n[large].astype("<u8"))
    )


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, m, k = (int(x) for x in np.frombuffer(blob, "<u4", 3))
    at = 12

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(blob, kind, count, at)
        at += x.nbytes
        return x

    heads, lengths, low, high, n = take("<u8", a), take("<u4", a), take("<u4", m), take("<u2", m), take("u1", m).astype(np.int64)
    large, more = take("<u4", k), take("<u8", k)
    n[large] = more.astype(np.int64)
    return np.repeat(heads, lengths), low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)), n


def _frequent(batches):
    for batch in batches:
        texts = batch["text"].to_pylist()
        for a, b in chunks(texts):
            v, n = np.unique(bigrams(texts[a:b])[0], return_counts=True)
            keep = n * 20_000 >= n.sum()
            keep[: len(n) and 1] = True
            rest = n.sum() - n[keep].sum()
            yield pa.record_batch({"v": pa.array(np.append(v[keep].view(np.int64), np.int64(0))), "n": pa.array(np.append(n[keep], rest).astype(np.int64))})


def _count(hot: np.ndarray, ranges: int):
    def deal(vs, ws):
        v, w, n = _summed(np.concatenate(vs), np.concatenate(ws) & SHORT, None)
        is_hot = np.isin(v, hot)
        target, blob = [], []
        cold = ~is_hot
        for keep, bits, by in ((cold, 64, v), (is_hot, 48, w)):
            a, b, c = v[keep], w[keep], n[keep]
            where = _range_of(by[keep], bits, ranges)
            if bits == 48:
                order = np.argsort(where, kind="stable")
                a, b, c, where = a[order], b[order], c[order], where[order]
            for s, e in _spans(where):
                target.append(int(where[s]))
                blob.append(_packed(a[s:e], b[s:e], c[s:e]))
        return pa.record_batch({"range": pa.array(target, pa.int32()), "blob": pa.array(blob, pa.binary())})

    def run(batches):
        vs, ws, held = [], [], 0
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in chunks(texts):
                v, w, _ = bigrams(texts[a:b])
                vs.append(v)
                ws.append(w)
                held += len(v)
                if held >= HELD_TOKENS:
                    yield deal(vs, ws)
                    vs, ws, held = [], [], 0
        if held:
            yield deal(vs, ws)

    return run


def _of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _context_rows(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    at = _runs(v)
    out = np.zeros(len(at), CONTEXT)
    out["key"] = v[at]
    if len(at):
        out["n"] = np.add.reduceat(n, at)
        for name, test in (("n1", n == 1), ("n2", n == 2), ("n3", n >= 3)):
            out[name] = np.add.reduceat(test.astype(np.int64), at)
    return out


def _store(folder: str, hot: np.ndarray, ranges: int):
    """A range's sums: writes its bigrams and contexts; returns its parts of hot contexts and of second words."""

    def run(table: pa.Table) -> pa.Table:
        own = int(table["range"][0].as_py())
        parts = [_unpacked(x.as_py()) for x in table["blob"]]
        v, w, n = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        pairs = np.zeros(len(v), BIGRAM)
        pairs["key"], pairs["n"] = _key(v, w), np.minimum(n, MOST)
        large = np.zeros(int((n >= MOST).sum()), LARGE)
        large["key"], large["n"] = pairs["key"][n >= MOST], n[n >= MOST]
        pairs.sort(order="key")
        write_array(folder, f"bigram-{own}", pairs)
        if len(large):
            large.sort(order="key")
            write_array(folder, f"large-{own}", large)
        is_hot = np.isin(v, hot)
        contexts = _context_rows(v[~is_hot], n[~is_hot])
        write_array(folder, f"context-{own}", contexts)
        stats = [int(n.sum()), len(v), len(contexts), *_of_counts(n)]
        rows = [(own, "stats", b"", stats)] + [(own, "hot", b"", [int(x["key"].view(np.int64)), *(int(x[k]) for k in ("n", "n1", "n2", "n3"))]) for x in _context_rows(v[is_hot], n[is_hot])]
        words, times = np.unique(w, return_counts=True)
        where = _range_of(words, 48, ranges)
        for s, e in _spans(where):
            rows.append((int(where[s]), "ahead", _packed(words[s:e], words[s:e] * np.uint64(0), times[s:e]), []))
        return pa.table({"range": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows]), "blob": pa.array([r[2] for r in rows], pa.binary()), "numbers": pa.array([r[3] for r in rows], pa.list_(pa.int64()))})

    return run


def _store_ahead(folder: str):
    def run(table: pa.Table) -> pa.Table:
        own = int(table["range"][0].as_py())
        parts = [_unpacked(x.as_py()) for x in table["blob"]]
        w, _, n = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        out = np.zeros(len(w), AHEAD)
        out["key"], out["n"] = w, n
        write_array(folder, f"ahead-{own}", out)
        return pa.table({"numbers": pa.array([[len(w), int((n >= 3).sum()), *_of_counts(n)]], pa.list_(pa.int64()))})

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of events seen once, twice, three and four times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9)
    return tuple(min(max(d, 0.05), float(k)) for k, d in enumerate(found, 1))


def train(docs: DataFrame, split: bool = True) -> dict:
    """Count the texts of ``docs`` and store the model; returns its small header.

    With ``split``, contexts of over a quarter of a range's tokens are dealt by the second word; the model is the same without.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(LOOK)) == 0).select("text").mapInArrow(_frequent, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
    some = materialize(some, "frequent")
    looked = some.agg(F.sum("n")).first()[0] or 0
    ranges = max(4, -(-looked * LOOK // RANGE_TOKENS))
    hot = some.where(F.col("n") * 4 * ranges > looked).where("v <> 0").select("v").collect() if split else []  # 4 * ranges at most
    hot = np.sort(np.array([r.v for r in hot], np.int64).view(np.uint64))
    folder = new_path(spark, "bigrams")
    sums = rows.select("text").mapInArrow(_count(hot, ranges), "range int, blob binary")
    stored = materialize(sums.groupBy("range").applyInArrow(_store(folder, hot, ranges), "range int, kind string, blob binary, numbers array<long>"), "stored")
    add = lambda df, n: [df.agg(*(F.sum(F.get("numbers", F.lit(i))).alias(f"s{i}") for i in range(n))).first()[i] or 0 for i in range(n)]
    tokens, types, contexts, *c = add(stored.where("kind = 'stats'"), 7)
    parts = stored.where("kind = 'hot'").groupBy(F.get("numbers", F.lit(0)).alias("v")).agg(*(F.sum(F.get("numbers", F.lit(i))).alias(k) for i, k in enumerate(("n", "n1", "n2", "n3"), 1))).collect()
    table = np.zeros(len(parts), CONTEXT)
    for i, r in enumerate(parts):
        table[i] = (np.int64(r.v).view(np.uint64), r.n, r.n1, r.n2, r.n3)
    table.sort(order="key")
    ahead = materialize(stored.where("kind = 'ahead'").select("range", "blob").groupBy("range").applyInArrow(_store_ahead(folder), "numbers array<long>"), "ahead")
    _, three, *a = add(ahead, 6)
    return {"folder": folder, "ranges": ranges, "hot": hot, "hot_contexts": table, "tokens": tokens, "types": types, "words": contexts + len(table), "discounts": discounts(c), "low_discounts": discounts(a), "low_counts": (a[0], a[1], three)}


@lru_cache(4096)
def _mapped(folder: str, kind: str, own: int) -> np.ndarray:
    return map_array(folder, f"{kind}-{own}", {"bigram": BIGRAM, "large": LARGE, "context": CONTEXT, "ahead": AHEAD}[kind])


def _look_up(folder: str, kind: str, where: np.ndarray, keys: np.ndarray, fields: tuple[str, ...]) -> list[np.ndarray]:
    """Fields of sorted stored rows by key, 0 where there is none."""
    out = [np.zeros(len(keys), np.int64) for _ in fields]
    order = np.lexsort((keys, where))
    near, key = where[order], keys[order]
    for s, e in _spans(near):
        rows = _mapped(folder, kind, int(near[s]))
        if len(rows):
            at = np.minimum(np.searchsorted(rows["key"], key[s:e]), len(rows) - 1)
            found = rows[at]
            hit = found["key"] == key[s:e]
            for x, f in zip(out, fields, strict=True):
                x[order[s:e]] = np.where(hit, found[f], 0)
    return out


def _discounted(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(n - np.where(n == 0, 0, np.where(n == 1, d[0], np.where(n == 2, d[1], d[2]))), 0)


def _score(model: dict):
    folder, ranges, hot = model["folder"], model["ranges"], model["hot"]
    big_n, big_v = model["tokens"], model["words"]

    def of(texts):
        v, w, firsts = bigrams(texts)
        every = np.unique(np.concatenate((v, w)))
        vi, wi = np.searchsorted(every, v), np.searchsorted(every, w)
        fields = ("n", "n1", "n2", "n3")
        n, n1, n2, n3 = _look_up(folder, "context", _range_of(every, 64, ranges), every, fields)
        known = model["hot_contexts"]
        at = np.searchsorted(every, known["key"])
        met = at < len(every)
        met[met] = every[at[met]] == known["key"][met]
        for x, f in zip((n, n1, n2, n3), fields, strict=True):
            x[at[met]] = known[f][met]
        short = every & SHORT
        ahead = _look_up(folder, "ahead", _range_of(short, 48, ranges), short, ("n",))[0]
        seen = n.copy()  # a token's count is its count as a context; the end's is the start's
        seen[every == END] = n[every == START]
        types, d, low = max(1, model["types"]), model["discounts"], model["low_discounts"]
        spare = sum(x * y for x, y in zip(low, model["low_counts"], strict=True)) / types if model["types"] else 1.0
        unigram = _discounted(ahead, low) / types + spare / (big_v + 1)
        pair, back = np.unique(vi * len(every) + wi, return_inverse=True)
        a, b = pair // len(every), pair % len(every)
        where = np.where(np.isin(every[a], hot), _range_of(short[b], 48, ranges), _range_of(every[a], 64, ranges))
        key = _key(every[a], short[b])
        c = _look_up(folder, "bigram", where, key, ("n",))[0]
        if (most := c == MOST).any():
            c[most] = _look_up(folder, "large", where[most], key[most], ("n",))[0]
        total = np.maximum(n[a], 1)
        left = np.where(n[a] > 0, (d[0] * n1[a] + d[1] * n2[a] + d[2] * n3[a]) / total, 1.0)
        chance = np.log10(_discounted(c, d) / total + left * unigram[b])[back]
        plain = np.log10((seen + 1) / (big_n + big_v + 1))[wi]
        add = lambda x: np.add.reduceat(x, firsts[:-1])  # noqa: E731  every text has an end
        return np.diff(firsts), add((seen[wi] > 0).astype(np.int64)), add(plain), add(chance)

    def run(batches):
        for batch in batches:
            texts, ids = batch["text"].to_pylist(), batch["doc_id"]
            for a, b in chunks(texts, SCORED):
                tokens, known, plain, chance = of(texts[a:b])
                yield pa.record_batch({"doc_id": ids.slice(a, b - a), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()), "base_score": pa.array(plain), "score": pa.array(chance)})

    return run


def perplexities(docs: DataFrame, train_on: str = "true") -> DataFrame:
    """Log10 probabilities of each row of ``docs`` (doc_id, text) under the model of some of its rows.

    The model learns the rows for which the SQL condition ``train_on`` over doc_id holds. Returns doc_id,
    n_tokens, n_known, train_tokens, base_score (add-one unigram), score (the model) and perplexity
    (10 to the power -score / n_tokens). Null and empty texts are one end token. Unknown words share the
    lowest order's spare mass. Repeated rows are counted and scored as often as they stand. An empty table
    gives an empty result; without training rows all tokens are equally likely.
    """
    model = train(docs.where(train_on))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_score(model), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", F.expr("power(10.0D, -score / n_tokens)").alias("perplexity"))
