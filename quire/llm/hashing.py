"""Vectorised word and shingle hashes for Arrow batches.

Words are maximal runs of bytes other than ``[\\x20\\x09-\\x0D]``; A-Z count as a-z. All functions take
lists of ``str | None``; a null text has no words.
"""

from __future__ import annotations

import numpy as np

#: Fixed odd multipliers: the rolling hash's base, its inverse modulo 2^64, and splitmix64's constants.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes hashed at a time; bounds the temporary arrays whatever a text's length.
SEGMENT = 1 << 20

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _segment_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a byte array."""
    edge = np.diff(np.concatenate(([True], _space[buf], [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power_tables(max(len(buf), SEGMENT))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def word_spans(texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes joined, each word's hash, start and end in them, and each text's first word.

    The last array has one entry more than there are texts.
    """
    parts = [b"" if t is None else t.encode("utf-8", "replace").lower() for t in texts]
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    data = b"\n".join([*parts, b""])
    buf = np.frombuffer(data, np.uint8)
    hashes, starts, ends, at = [], [], [], 0
    while at < len(buf):
        to = min(len(buf), at + SEGMENT)
        if to < len(buf):
            back = np.flatnonzero(_space[buf[at:to]])
            if len(back):
                to = at + int(back[-1]) + 1
            else:
                more = next((p for s in range(to, len(buf), SEGMENT) if len(p := np.flatnonzero(_space[buf[s : s + SEGMENT]]) + s)), np.array([len(buf) - 1]))
                to = int(more[0]) + 1
        h, s, e = _segment_words(buf[at:to])
        hashes.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = to
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    starts_all = join(starts, np.int64)
    firsts = np.searchsorted(starts_all, np.concatenate(([0], np.cumsum(sizes))))
    return data, join(hashes, np.uint64), starts_all, join(ends, np.int64), firsts


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Each word's hash, and each text's first word (one entry more than there are texts)."""
    _, hashes, _, _, firsts = word_spans(texts)
    return hashes, firsts


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of ``width``-word windows.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    hashes, firsts = word_hashes(texts)
    weights = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    n = len(hashes)
    windows = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        windows += hashes[j : j + len(windows)] * weights[j]
    windows = mix(windows)
    found = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= width:
            found.append(np.unique(windows[a : b - width + 1]))
        elif b > a:
            short = (hashes[a:b] * weights[: b - a]).sum(dtype=np.uint64) + np.uint64((b - a) * 0x1F3D5B79)
            found.append(mix(np.array([short], np.uint64)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def chunks(texts: list[str | None], most: int = 2 << 20):
    """Ranges (start, end) of ``texts`` of about ``most`` characters each, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
