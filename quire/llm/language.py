"""Language identification by hyperdimensional profiles.

Every letter of any script has a random vector of +1 and -1, hashed from its code point. A letter trigram's vector is the product of its letters'
vectors, permuted by their place (bound); a text's vector is the sum of its trigrams' (bundled); a
language's prototype is the sum over its training texts, less what all languages share. A text gets the
language of greatest cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import bounded_batches
from quire.llm.hashing import chunks, mix

#: Vector length and the seed of the letters' vectors.
DIM, SEED = 1024, np.uint64(9)
#: Bits of a code point; a trigram's three make one number.
BITS = 21
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Each code point's letter, in lower case; 0 for what is no letter. Made by rule from the character database."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                table[c] = ord(chr(c).lower()[0])
        _letters.append(table)
    return _letters[0]


def trigrams(texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Each text's distinct trigram codes and their counts, and whether it has a letter. A run of other characters is one letter 0."""
    codes, counts, letters = [], [], []
    table = letter_table()
    for t in texts:
        x = np.concatenate(([0], table[np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32)], [0])).astype(np.int64)
        x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]
        letters.append(bool(x.any()))
        some, n = np.unique((x[:-2] << (2 * BITS)) | (x[1:-1] << BITS) | x[2:], return_counts=True)
        codes.append(some)
        counts.append(n)
    return codes, counts, np.array(letters, bool)


def signs(letters: np.ndarray) -> np.ndarray:
    """Each letter's vector of +1 and -1, a row each, from a hash of its code point."""
    words = mix(letters.astype(np.uint64)[:, None] * np.uint64(DIM) + np.arange(DIM // 64, dtype=np.uint64) + (SEED << np.uint64(40)))
    return (np.unpackbits(words.view(np.uint8).reshape(len(letters), -1), axis=1).astype(np.int8) * 2 - 1)[:, :DIM]


def vectors(codes: np.ndarray) -> np.ndarray:
    """The bound vectors of trigram codes: a row each."""
    three = np.stack((codes >> (2 * BITS), (codes >> BITS) & ((1 << BITS) - 1), codes & ((1 << BITS) - 1)))
    letters, at = np.unique(three, return_inverse=True)
    base, at = signs(letters), at.reshape(three.shape)
    return np.roll(base, 2, axis=1)[at[0]] * np.roll(base, 1, axis=1)[at[1]] * base[at[2]]


def _profile(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch["text"].to_pylist(), batch["lang"].to_pylist()
        for a, b in chunks(texts):
            by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for lang, codes, counts in zip(langs[a:b], *trigrams(texts[a:b])[:2], strict=True):
                by.setdefault(lang, []).append((codes, counts))
            for lang, parts in by.items():
                codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([n for _, n in parts]), len(codes))
                total = sums.setdefault(lang, np.zeros(DIM))
                for s in range(0, len(codes), 4096):
                    total += counts[s : s + 4096].astype(np.float32) @ vectors(codes[s : s + 4096]).astype(np.float32)
    for lang, total in sums.items():
        yield pa.record_batch({"lang": pa.array([lang] * DIM), "at": pa.array(range(DIM), pa.int32()), "value": pa.array(np.rint(total).astype(np.int64))})


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from (text, lang); only DIM sums a language reach the driver."""
    bounded_batches(docs.sparkSession)
    rows = docs.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = rows.mapInArrow(_profile, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value")).collect()
    langs = sorted({r.lang for r in found})
    table = np.zeros((len(langs), DIM))
    place = {x: i for i, x in enumerate(langs)}
    for r in found:
        table[place[r.lang], r.at] = r.value
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    table = table / np.where(norm, norm, 1)
    if len(langs) > 1:
        table = table - table.mean(axis=0)
        norm = np.linalg.norm(table, axis=1, keepdims=True)
        table = table / np.where(norm, norm, 1)
    return langs, table


def _identify(langs: list[str], table: np.ndarray):
    def run(batches):
        for batch in batches:
            texts, ids = batch["text"].to_pylist(), batch["doc_id"]
            for a, b in chunks(texts, 1 << 19):
                codes, counts, letters = trigrams(texts[a:b])
                every = np.unique(np.concatenate(codes))
                near, bulk = np.zeros((b - a, len(langs))), np.zeros((b - a, DIM), np.float32)
                for at in range(0, len(every), 4096):
                    part = every[at : at + 4096]
                    dense = np.zeros((b - a, len(part)), np.float32)
                    for i, (c, n) in enumerate(zip(codes, counts, strict=True)):
                        lo, hi = np.searchsorted(c, (part[0], part[-1] + 1))
                        dense[i, np.searchsorted(part, c[lo:hi])] = n[lo:hi]
                    bulk += dense @ vectors(part).astype(np.float32)
                near = bulk @ table.T.astype(np.float32) / np.maximum(np.linalg.norm(bulk, axis=1, keepdims=True), 1e-9)
                best = near.argmax(axis=1) if langs else np.zeros(b - a, int)
                known = letters & bool(langs)
                yield pa.record_batch(
                    {
                        "doc_id": ids.slice(a, b - a),
                        "lang_pred": pa.array([langs[j] if k else "und" for j, k in zip(best.tolist(), known.tolist(), strict=True)], pa.string()),
                        "score": pa.array([min(1.0, max(0.0, float(near[i, j]))) if k else 0.0 for i, (j, k) in enumerate(zip(best.tolist(), known.tolist(), strict=True))], pa.float64()),
                    }
                )

    return run


def identify(docs: DataFrame, train_on: str = "true") -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``docs`` (doc_id, text, lang).

    Prototypes are learned from the rows for which the SQL condition ``train_on`` over doc_id holds and
    text and lang aren't null. score is the cosine, 0 at least. Null texts and texts without a letter are
    ``und`` at 0, and so is every text where nothing could be learned. Ties go to the language first in
    order. An empty table gives an empty result; repeated rows are treated alike.
    """
    langs, table = prototypes(docs.where(train_on))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_identify(langs, table), "doc_id long, lang_pred string, score double")
