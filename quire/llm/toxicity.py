"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are its distinct character n-grams, lower case, hashed. Feature f has the value
r_f = log of the smoothed ratio of its counts in toxic and clean training texts; logistic regression on
these values gives the weights. The fit takes a bounded sample of labelled rows; scoring takes every text
whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import bounded_batches
from quire.llm.hashing import chunks, mix

#: n-gram length, hash bits, and the most training rows of each class: those of least hash.
N, BITS, SAMPLE = 4, 18, 2500
#: Of the fit: smoothing of the ratios, ridge penalty, steps, and rows that must have a feature.
ALPHA, RIDGE, STEPS, LEAST = 1.0, 1e-2, 80, 10

#: How much of the classes' log odds the intercept takes: less than all, as labels of the rare class are noisy.
PRIOR = 0.5


def features(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's distinct hashed n-grams. Texts are padded with a space at both ends; null has none."""
    parts = [f" {' '.join(t.lower().split())} " if t else "" for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    windows = np.zeros(max(0, len(codes) - N + 1), np.uint64)
    for j in range(N):
        windows = windows * np.uint64(0x100000001B3) + codes[j : j + len(windows)]
    windows = (mix(windows) >> np.uint64(64 - BITS)).astype(np.int32)
    return [np.unique(windows[e - len(p) : max(e - N + 1, e - len(p))]) for p, e in zip(parts, ends.tolist(), strict=True)]


def _extract(batches):
    for batch in batches:
        texts, toxic = batch["text"].to_pylist(), batch["toxic"]
        for a, b in chunks(texts):
            found = features(texts[a:b])
            yield pa.record_batch({"toxic": toxic.slice(a, b - a), "f": pa.array([x.tobytes() for x in found], pa.binary())})


def fit(rows: list[np.ndarray], toxic: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Weights by feature and the intercept. ``share``: how much of all labelled rows is toxic."""
    weights = np.zeros(1 << BITS, np.float32)
    prior = PRIOR * float(np.log(share / (1 - share))) if 0 < share < 1 else (10.0 if share >= 1 else -10.0)
    if not rows or toxic.all() or not toxic.any():
        return weights, prior
    index, length = np.concatenate(rows).astype(np.int64), np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), length)
    yes = np.bincount(index[toxic[owner]], minlength=1 << BITS)
    no = np.bincount(index[~toxic[owner]], minlength=1 << BITS)
    ratio = np.log((yes + ALPHA) / (yes + ALPHA).sum() * (no + ALPHA).sum() / (no + ALPHA))
    ratio[yes + no < LEAST] = 0
    keep = ratio[index] != 0
    index, owner = index[keep], owner[keep]
    value = ratio[index]
    balance = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    scale = np.bincount(owner, value * value, len(rows)).max() / 4
    w, b, step, old = np.zeros(1 << BITS), 0.0, 1.0 / max(scale / 8, 1.0), (np.zeros(1 << BITS), 0.0)
    for t in range(STEPS):
        push = t / (t + 3)
        u, c = w + push * (w - old[0]), b + push * (b - old[1])
        z = np.bincount(owner, u[index] * value, len(rows)) + c
        error = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic)
        old = (w, b)
        w = u - step * (np.bincount(index, error[owner] * value, 1 << BITS) + RIDGE * u)
        b = c - 4 * step * error.sum()
    return (w * ratio).astype(np.float32), b + prior


def _score(weights: np.ndarray, intercept: float):
    def run(batches):
        for batch in batches:
            texts, ids = batch["text"].to_pylist(), batch["doc_id"]
            for a, b in chunks(texts):
                z = np.array([weights[x].sum(dtype=np.float64) for x in features(texts[a:b])]) + intercept
                yield pa.record_batch({"doc_id": ids.slice(a, b - a), "score": pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))})

    return run


def scores(docs: DataFrame, labels: DataFrame, train_on: str = "true") -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text): 0 to 1, higher where toxic is likelier.

    ``labels`` (doc_id, toxic: 0 or 1) teaches, of the rows for which the SQL condition ``train_on`` over
    doc_id holds: at most SAMPLE rows of each class, chosen by hash. Nulls teach nothing. Null and empty
    texts get the intercept's score, and so do all texts where there is nothing to learn from. An empty
    table gives an empty result; repeated rows score alike.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("int").alias("toxic")).where(train_on)
    count = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pick = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    chosen = pick(0).unionByName(pick(1)).dropDuplicates(["doc_id"])  # at most 2 * SAMPLE rows
    one = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # rows that repeat a doc_id teach once
    got = one.orderBy("doc_id").select("toxic", "text").mapInArrow(_extract, "toxic int, f binary").collect()
    toxic = np.array([r.toxic == 1 for r in got], bool)
    total = sum(count.values())
    weights, intercept = fit([np.frombuffer(r.f, np.int32) for r in got], toxic, count.get(1, 0) / total if total else 0.5)
    return rows.mapInArrow(_score(weights, intercept), "doc_id long, score double")
