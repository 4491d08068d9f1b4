"""Exact dedup by polynomial fingerprints that combine, confirmed chunk by chunk.

A text's bytes b_0, b_1, ... have the fingerprint sum(b_i * B**i), under two primes. Chunks are hashed on their
own and shifted by their distance from the text's start, so a text is the sum of its chunks: texts of one chunk
are finished where they are read, those of over ``huge`` bytes are dealt out as chunks that many tasks hash. Texts of
equal size and fingerprint are candidates. Their chunks are compared byte for byte by place: each task passes the
distinct chunks of a place on, so that a group of any size sends one a task. Only where a place has several are texts
different that looked alike, and those are grouped by the texts themselves.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import bounded_batches
from quire.sources.shared import materialize, small_side

#: Bytes of a chunk, and of a text from which on its chunks are dealt out. Byte times power, summed over a chunk, stays below 2**63.
CHUNK, HUGE = 1 << 16, 1 << 24
#: (prime below 2**31, base) of the two hashes; the size is part of the key too.
KEYS = ((2147483647, 1103515249), (2147483629, 1812433253))
#: Classes whose fingerprints are sent to all executors.
MOST_SENT = 1_000_000
SPACES = re.compile(rb"[\x20\x09-\x0D]+")
PRINT = ["h1", "h2", "size"]
Keys = tuple[tuple[int, int], tuple[int, int]]


@cache
def _powers(prime: int, base: int) -> np.ndarray:
    """base**0 to base**(CHUNK - 1) modulo the prime, by doubling."""
    done = np.ones(1, np.int64)
    while len(done) < CHUNK:
        done = np.concatenate((done, done * pow(base, len(done), prime) % prime))
    return done


def chunk_hash(data: bytes, key: tuple[int, int]) -> int:
    """The hash of one chunk."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    return int((x * _powers(*key)[: len(x)]).sum() % key[0])


def shifted(h: int, by: int, key: tuple[int, int]) -> int:
    """A hash as it counts in a text where ``by`` bytes come before."""
    return h * pow(key[1], by, key[0]) % key[0]


def fingerprint(data: bytes, keys: Keys = KEYS) -> tuple[int, int]:
    """Of whole bytes: the sums of their chunks' shifted hashes."""
    return tuple(sum(shifted(chunk_hash(data[at : at + CHUNK], k), at, k) for at in range(0, len(data), CHUNK)) % k[0] for k in keys)


def _fingerprints(texts: list[bytes], keys: Keys) -> list[tuple[int, int]]:
    """Of many texts; those of one chunk are hashed together."""
    short = [i for i, t in enumerate(texts) if len(t) <= CHUNK]
    found = [(0, 0) if len(t) <= CHUNK else fingerprint(t, keys) for t in texts]
    sizes = np.array([len(texts[i]) for i in short], np.int64)
    starts = np.cumsum(sizes) - sizes
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.frombuffer(b"".join(texts[i] for i in short), np.uint8).astype(np.int64)
        place = np.arange(len(flat)) - np.repeat(starts, sizes)
        sums = [np.add.reduceat(flat * _powers(*k)[place], starts[full]) % k[0] for k in keys]
        for j, a, b in zip(full.tolist(), *(x.tolist() for x in sums), strict=True):
            found[short[j]] = (a, b)
    return found


def normalized(text: str | None) -> bytes:
    """A text's bytes with each run of blanks as one space; none for null."""
    return SPACES.sub(b" ", (text or "").encode())


def _held(sizes: list[int], most: int = 4 << 20):
    """Ranges of neighbours of about ``most`` bytes in all, one at least."""
    start = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _prints(huge: int, keys: Keys):
    """Rows (size, digest, fingerprint) of texts; of huge ones, a row for each chunk, to be hashed elsewhere."""

    def rows(ids, nums, sizes, digests, prints, at, chunk):
        a, b = ([p[k] if p else None for p in prints] for k in (0, 1))
        return pa.record_batch(
            {"doc_id": pa.array(ids, pa.int64()), "row": pa.array(nums, pa.int64()), "size": pa.array(sizes, pa.int64()), "text_sha256": pa.array(digests, pa.string()), "h1": pa.array(a, pa.int64()), "h2": pa.array(b, pa.int64()), "at": pa.array(at, pa.int64()), "chunk": pa.array(chunk, pa.binary())}
        )

    def run(batches):
        for batch in batches:
            ids, nums = batch["doc_id"].to_pylist(), batch["row"].to_pylist()
            texts = [normalized(t) for t in batch["text"].to_pylist()]
            sizes = [len(t) for t in texts]
            digests = [hashlib.sha256(t).hexdigest() for t in texts]
            here = [i for i, n in enumerate(sizes) if n <= huge]
            pick = lambda x, places: [x[i] for i in places]
            for s, e in _held(pick(sizes, here)):
                k = here[s:e]
                yield rows(pick(ids, k), pick(nums, k), pick(sizes, k), pick(digests, k), _fingerprints(pick(texts, k), keys), [0] * len(k), [None] * len(k))
            for i, n in enumerate(sizes):
                for at in range(0, n if n > huge else 0, CHUNK):
                    yield rows([ids[i]], [nums[i]], [n], [digests[i]], [None], [at], [texts[i][at : at + CHUNK]])

    return run


def _hash_chunks(keys: Keys):
    def run(batches):
        for batch in batches:
            at, chunks = batch["at"].to_pylist(), batch["chunk"].to_pylist()
            a, b = ([shifted(chunk_hash(c, k), x, k) for x, c in zip(at, chunks, strict=True)] for k in keys)
            yield pa.record_batch({"row": batch["row"], "h1": pa.array(a, pa.int64()), "h2": pa.array(b, pa.int64())})

    return run


def _chunks_of(huge: int, keys: Keys):
    """The chunks of all texts but huge ones, under their fingerprints."""

    def run(batches):
        for batch in batches:
            texts = [t for t in (normalized(x) for x in batch["text"].to_pylist()) if len(t) <= huge]
            for s, e in _held([len(t) for t in texts]):
                cut = [(*p, len(t), at, t[at : at + CHUNK]) for p, t in zip(_fingerprints(texts[s:e], keys), texts[s:e], strict=True) for at in range(0, max(1, len(t)), CHUNK)]
                yield pa.record_batch({n: pa.array([c[k] for c in cut], pa.binary() if n == "chunk" else pa.int64()) for k, n in enumerate((*PRINT, "at", "chunk"))})

    return run


def _whole(keys: Keys):
    """Rows with their whole normalised texts and fingerprints."""

    def run(batches):
        for batch in batches:
            texts = [normalized(x) for x in batch["text"].to_pylist()]
            for s, e in _held([len(t) for t in texts]):
                t = texts[s:e]
                prints = _fingerprints(t, keys)
                yield pa.record_batch(
                    {"doc_id": batch["doc_id"].slice(s, e - s), "row": batch["row"].slice(s, e - s), "text_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in t]), "h1": pa.array([p[0] for p in prints], pa.int64()), "h2": pa.array([p[1] for p in prints], pa.int64()), "size": pa.array([len(x) for x in t], pa.int64()), "whole": pa.array(t, pa.binary())}
                )

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with a number each, which holds from where they are stored on."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))


def prints(docs: DataFrame, huge: int = HUGE, keys: Keys = KEYS) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, text_sha256, h1, h2, size) of every row, stored; and the chunks of huge texts (h1, h2, size, at, chunk)."""
    stored = materialize(_numbered(docs).mapInArrow(_prints(huge, keys), "doc_id long, row long, size long, text_sha256 string, h1 long, h2 long, at long, chunk binary"), "prints")
    chunks = stored.where("chunk is not null")
    n = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = chunks.select("row", "at", "chunk").repartition(n, "row", "at").mapInArrow(_hash_chunks(keys), "row long, h1 long, h2 long")
    # sums of numbers below 2**31 stay exact up to 2**32 chunks
    sums = sums.groupBy("row").agg(*(F.pmod(F.sum(h), F.lit(k[0])).alias(h) for h, k in zip(("h1", "h2"), keys, strict=True)))
    columns = ["row", "doc_id", "text_sha256", *PRINT]
    long = chunks.drop("h1", "h2").join(sums, "row")
    return stored.where("chunk is null").select(*columns).unionByName(long.where("at = 0").select(*columns)), long.select(*PRINT, "at", "chunk")


def _judged(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with what stays of their class: the smallest doc_id (none counts last), then the smallest row number."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("at")))
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("group_size"), first.alias("first")).where("group_size > 1")
    groups = materialize(groups.select(*by, "group_size", F.col("first.id").alias("keep_id"), F.col("first.at").alias("keep_row")), "groups")
    alone = F.col("group_size").isNull()
    return rows.join(small_side(groups, MOST_SENT), by, "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256"
    )


def exact_duplicates(docs: DataFrame, huge: int = HUGE, keys: Keys = KEYS) -> DataFrame:
    """Classes of equal texts of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` became one space; null counts as empty, and blanks at
    an end stay one space. All rows stay, one is ``kept`` in each class: that of the smallest doc_id, no id counting last, and any one of
    rows that share it. ``keep_id`` is its doc_id, ``group_size`` the class's rows, ``text_sha256`` the normalised text's digest.
    Other columns are not read; an empty table gives an empty result. A text is held whole by the task that reads it.
    """
    bounded_batches(docs.sparkSession)
    rows, chunks = prints(docs, huge, keys)
    alike = materialize(rows.groupBy(*PRINT).count().where("count > 1").select(*PRINT), "alike")
    chunks = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_chunks_of(huge, keys), "h1 long, h2 long, size long, at long, chunk binary").unionByName(chunks)
    if alike.count() <= MOST_SENT:  # beyond that, lone texts are compared along: a join would send all texts as well
        chunks = chunks.join(F.broadcast(alike), PRINT, "left_semi")
    clashes = materialize(chunks.distinct().groupBy(*PRINT, "at").count().where("count > 1").select(*PRINT).distinct(), "clashes")
    if clashes.isEmpty():
        return _judged(rows, PRINT)
    apart = small_side(clashes, MOST_SENT)
    whole = _numbered(docs).mapInArrow(_whole(keys), "doc_id long, row long, text_sha256 string, h1 long, h2 long, size long, whole binary").join(apart, PRINT, "left_semi")
    return _judged(rows.join(apart, PRINT, "left_anti"), PRINT).unionByName(_judged(materialize(whole.drop(*PRINT), "whole"), ["whole"]))
