"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's lattice has an edge for every piece; a piece never spans two words, so the lattice is a chain of
short units whose distinct ones are built once a batch. Backward sums turn edge scores into the chances of
the next piece, and a perturbed A-star search walks prefixes from the top: a node's perturbed score is
the greatest of all completions below it, its best child inherits it, and the rest of its children are
one open node whose score is a Gumbel variable cut off there. Popping the best open node gives the next
segmentation, so the k found are distinct and a sample without replacement of the lattice's distribution.

Spaces become the piece mark; a leading mark is added and taken off again, and nothing else of the text
is changed. What no piece covers is spelled in byte pieces, so decoding gives the text back exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.arrow import bounded_batches
from quire.llm.hashing import BASE, _power_tables, mix
from quire.llm.native import quoted

#: The default vocabulary, and characters of a batch: its edges take some 300 bytes a character while it is sampled.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 18
#: The mark of a word's start in the vocabulary.
MARK = "▁"
#: Steps of a path whose open siblings are scored first, and more than the greatest Gumbel variable that ``uniform`` gives.
AHEAD, REACH = 32, 37.0


def vocabulary(model: str = MODEL) -> tuple[list[bytes], list[float], int]:
    """Each id's bytes (a mark is a space; control and unknown ids have none), its log probability, and the id of byte 0.

    The file's scores are ranks of merges; a piece of rank r gets a probability proportional to 1 / (r + 10).
    """
    from sentencepiece import SentencePieceProcessor

    source = SentencePieceProcessor(model_file=model)
    ids = range(source.vocab_size())
    spelled = [b"" if source.is_control(i) or source.is_unknown(i) or source.is_unused(i) else bytes([int(source.id_to_piece(i)[3:5], 16)]) if source.is_byte(i) else source.id_to_piece(i).replace(MARK, " ").encode() for i in ids]
    rank = np.array([min(-source.get_score(i), len(ids)) for i in ids])
    rank = np.where([source.is_byte(i) for i in ids], len(ids), rank)
    weight = np.where([bool(s) for s in spelled], 1 / (rank + 10), 0)
    with np.errstate(divide="ignore"):
        logs = np.log(weight / weight.sum())
    return spelled, logs.tolist(), next(i for i in ids if source.is_byte(i))


class Lattice:
    """Edges of all prefixes of units: pieces by length, and which bytes may begin a longer piece."""

    def __init__(self, spelled: list[bytes], logs: list[float], byte_0: int) -> None:
        self.spelled, self.byte_0, self.logs = spelled, byte_0, np.array(logs)
        self.byte_logs = self.logs[byte_0 : byte_0 + 256]
        by_length: dict[int, dict[bytes, list[int]]] = {}
        for i, s in enumerate(spelled):
            if s and not byte_0 <= i < byte_0 + 256:
                for n in range(1, len(s) + 1):
                    row = by_length.setdefault(n, {}).setdefault(s[:n], [-1, 0])
                    if n == len(s):
                        row[0] = i
                    else:
                        row[1] = 1
        self.tables = []
        for n in sorted(by_length):
            up = _power_tables(64)[0]
            texts = np.frombuffer(b"".join(by_length[n]), np.uint8).reshape(-1, n).astype(np.uint64) + np.uint64(1)
            keys = (texts * up[1 : n + 1]).sum(axis=1, dtype=np.uint64)
            order = np.argsort(keys)
            rows = np.array(list(by_length[n].values()))[order]
            keys = np.append(keys[order], np.uint64((1 << 64) - 1))  # the last stands for no piece
            rows = np.append(rows, [[-1, 0]], axis=0)
            shift = np.uint64(62 - len(keys).bit_length())  # a key's leading bits say where to look for it
            places = np.searchsorted(keys, np.arange(1 << 64 - int(shift), dtype=np.uint64) << shift)
            self.tables.append((keys, shift, places.astype(np.int32), rows[:, 0].astype(np.int32), rows[:, 1].astype(bool)))

    def _edges(self, data: np.ndarray, stop: np.ndarray, chars: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Starts and piece ids of the edges of each length from 1 byte up."""
        n = len(data)
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[1 : n + 1], out=sums[1:])
        alive, found = chars, []
        for length, (keys, shift, places, ids, longer) in enumerate(self.tables, 1):
            if length > 1:
                alive = alive[alive + length <= stop[alive]]
            if not len(alive):
                break
            key = (sums[alive + length] - sums[alive]) * down[alive]
            at = places[key >> shift]
            behind = np.flatnonzero(keys[at] < key)
            while len(behind):
                at[behind] += 1
                behind = behind[keys[at[behind]] < key[behind]]
            hit = np.flatnonzero(keys[at] == key)
            alive, at = alive[hit], at[hit]
            piece = ids[at]
            whole = piece >= 0
            found.append((alive[whole], piece[whole]))
            alive = alive[longer[at]]
        return found

    def build(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """The lattice of the units ``data[starts:ends]``, which follow one another.

        Edges stand by start, longest first: ``first`` and ``last`` of each byte. ``below`` is the chance of
        the edges up to one, among those of its start; 1 for the last, and no number of ``uniform`` exceeds it.
        """
        n = len(data)
        stop = np.repeat(ends, ends - starts)
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(chars, n))
        found = self._edges(data, stop, chars)
        covered = np.zeros(n, bool)
        for length, (src, _) in enumerate(found, 1):
            if length <= 4:
                own = np.zeros(n, bool)
                own[src] = True
                covered[chars[(width == length) & own[chars]]] = True
        bare = chars[~covered[chars]]
        spans = width[~covered[chars]]
        spell = np.concatenate(([0.0], np.cumsum(self.byte_logs[data])))
        degree = np.zeros(n + 1, np.int32)
        for src, _ in found:
            degree[src] += 1
        degree[bare] += 1
        self.first = np.cumsum(degree) - degree
        self.last = self.first + degree - 1
        total = int(degree.sum())
        self.src = np.repeat(np.arange(n + 1), degree)
        self.dst, self.piece, score = np.empty(total, np.int64), np.empty(total, np.int32), np.empty(total)
        free = self.first.copy()
        for length, (src, piece) in [*reversed([*enumerate(found, 1)]), (0, (bare, None))]:
            at = free[src]
            free[src] += 1
            self.dst[at] = src + (spans if piece is None else length)
            self.piece[at] = np.where(spans == 1, self.byte_0 + data[bare].astype(np.int32), -1) if piece is None else piece
            score[at] = spell[bare + spans] - spell[bare] if piece is None else self.logs[piece]
        beta, part = np.zeros(n + 1), np.empty(total)
        to = np.where(self.dst < np.repeat(stop, degree[:n]), self.dst, n)  # a unit's end is the place n, whose sum is 0
        far = (stop - np.arange(n))[chars]
        order = np.argsort(far.astype(np.uint16) if far.max(initial=0) < 1 << 16 else far, kind="stable")
        cuts = np.flatnonzero(np.diff(far[order], prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            pos = chars[order[a:b]]
            edge, left = self.first[pos], degree[pos]
            sums = part[edge] = score[edge] + beta[to[edge]]
            for j in range(1, int(left.max())):
                some = np.flatnonzero(left > j)
                e = edge[some] + j
                sums[some] = part[e] = np.logaddexp(sums[some], score[e] + beta[to[e]])
            beta[pos] = sums
        score += beta[to]  # in place from here on, as these are the longest arrays
        del to
        whole = np.repeat(beta, degree)
        score -= whole
        part -= whole
        self.log_p, self.below = np.minimum(score, 0, out=score), np.exp(part, out=part)
        self.below[self.last[chars]] = 1
        self.data = data

    def clear(self) -> None:
        """Lets go of the last batch's units and edges: a worker is idle for long, and others share its memory."""
        self.src = self.dst = self.piece = self.log_p = self.below = self.first = self.last = self.data = None

    def walk(self, at: np.ndarray, stop: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A random path from each byte ``at`` to ``stop``: all edges in order, and each path's number of edges."""
        count = np.zeros(len(at), np.int64)
        active = np.flatnonzero(at < stop)
        pos, end, key = at[active], stop[active], keys[active]
        steps, step = [], 0
        while len(active):
            u = uniform(key + np.uint64(step * 0x632BE59BD9B4E019 & (1 << 64) - 1))
            edge = self.first[pos]
            todo = np.flatnonzero(self.below[edge] < u)
            while len(todo):
                edge[todo] += 1
                todo = todo[self.below[edge[todo]] < u[todo]]
            steps.append((active, edge))
            count[active] += 1
            pos = self.dst[edge]
            go = np.flatnonzero(pos < end)
            active, pos, end, key = active[go], pos[go], end[go], key[go]
            step += 1
        base = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for t, (who, edge) in enumerate(steps):
            out[base[who] + t] = edge
        return out, count

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """The piece ids of a path; characters without a piece spelled in bytes."""
        found = self.piece[edges]
        rare = np.flatnonzero(found < 0)
        if not len(rare):
            return found
        parts, at = [], 0
        for i in rare.tolist():
            e = edges[i]
            parts += [found[at:i], self.byte_0 + self.data[self.src[e] : self.dst[e]].astype(np.int32)]
            at = i + 1
        return np.concatenate([*parts, found[at:]])


def uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    return ((mix(keys) >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def _below(phi: np.ndarray, top: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Gumbel variables of location ``phi``, cut off at ``top``."""
    return phi - np.log(np.exp(np.minimum(phi - top, 700)) - np.log(uniform(keys)))


class _Path:
    """One round's new nodes for every text: edges, log chances before and after them, and open siblings' scores.

    Scores stand for the first steps of a path, from ``open_at`` on: all that may be among its ``k`` best. The
    chance before a step only falls, and no open sibling's score exceeds it by ``REACH``.
    """

    def __init__(self, lattice: Lattice, edges: np.ndarray, bounds: np.ndarray, start: np.ndarray, top: np.ndarray, keys: np.ndarray, k: int) -> None:
        log_p = lattice.log_p[edges]
        self.edges, self.bounds, self.before, self.end = edges, bounds, np.empty(len(edges)), start.copy()
        for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if b > a:  # by text, so that sums don't depend on a batch's other texts
                sums = start[d] + np.cumsum(log_p[a:b])
                self.before[a], self.before[a + 1 : b], self.end[d] = start[d], sums[:-1], sums[-1]
        steps = np.diff(bounds)
        first = max(AHEAD, k)
        some = np.minimum(steps, first)
        self._score(lattice, log_p, some, top, keys)
        long = np.flatnonzero(steps > first)
        least = np.full(len(steps), np.inf)
        least[long] = np.partition(self.open[self.open_at[long][:, None] + np.arange(first)], first - k, axis=1)[:, first - k] - REACH
        while len(long := long[self.before[bounds[long] + some[long]] >= least[long]]):
            some[long] = np.minimum(2 * some[long], steps[long])
            long = long[some[long] < steps[long]]
        if (some > first).any():
            self._score(lattice, log_p, some, top, keys)

    def _score(self, lattice: Lattice, log_p: np.ndarray, some: np.ndarray, top: np.ndarray, keys: np.ndarray) -> None:
        """Scores of the first ``some`` steps of each text."""
        self.open_at = np.concatenate(([0], np.cumsum(some)))
        own = np.repeat(np.arange(len(some)), some)
        index = np.arange(len(own)) - self.open_at[own]
        at = self.bounds[own] + index
        src = lattice.src[self.edges[at]]
        rest = np.log(np.maximum(-np.expm1(log_p[at]), 1e-300))
        rest = np.where(lattice.first[src] == lattice.last[src], -np.inf, rest)
        self.open = np.where(np.isneginf(rest), -np.inf, _below(self.before[at] + rest, top[own], keys[own] + index.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))


def sample(lattice: Lattice, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its k segmentations or as many as there are: ids, log probability, perturbed score, inclusion.

    Segmentations come by falling perturbed score. The inclusion score is the chance of a segmentation to
    be among the k, given the next perturbed score; 1 where nothing is left.
    """
    parts = [b" " + t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    doc_at = np.cumsum([0, *map(len, parts)])
    control = (data >= 9) & (data <= 13)
    begin = np.zeros(len(data) + 1, bool)
    begin[doc_at] = True
    begin[:-1] |= control
    begin[1:] |= control
    space = data == 32
    begin[1:-1] |= space[1:] & ~space[:-1]
    cuts = np.flatnonzero(begin)
    starts, ends = cuts[:-1], cuts[1:]
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(BASE))
    del sums
    _, where, unit = np.unique(hashes, return_index=True, return_inverse=True)
    size = (ends - starts)[where]
    unit_start = np.cumsum(size) - size
    unit_end = unit_start + size
    lattice.build(data[np.repeat(starts[where] - unit_start, size) + np.arange(int(size.sum()))], unit_start, unit_end)
    begins, stops = unit_start[unit], unit_end[unit]
    unit_at = np.searchsorted(starts, doc_at)
    n = len(texts)
    own = np.repeat(np.arange(n), np.diff(unit_at))
    place = (np.arange(len(starts)) - unit_at[:-1][own]).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)

    def round_key(r: int, keys: np.ndarray = keys) -> np.ndarray:
        return mix(keys + np.uint64((r + 1) * 0xA0761D6478BD642F & (1 << 64) - 1))

    edges, count = lattice.walk(begins, stops, round_key(0)[own] + place)
    step_at = np.concatenate(([0], np.cumsum(count)))
    unit_of_step = np.repeat(np.arange(len(count)), count)
    top = -np.log(-np.log(uniform(round_key(-1))))
    paths = [_Path(lattice, edges, step_at[unit_at], np.zeros(n), top, round_key(1), k)]
    units = [unit_of_step]
    heads: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(n)]  # by text and round: edges before the round's own
    taken: dict[tuple[int, int], list[int]] = {}
    found: list[list[tuple[int, float, float]]] = [[(0, float(paths[0].end[d]), float(top[d]))] for d in range(n)]

    def best_open(d: int) -> tuple[float, int, int]:
        best = (-np.inf, -1, -1)
        for r, path in enumerate(paths):
            a, b = int(path.open_at[d]), int(path.open_at[d + 1])
            if b > a:
                i = int(path.open[a:b].argmax())
                best = max(best, (float(path.open[a + i]), r, int(path.bounds[d]) + i))
        return best

    for r in range(1, k):
        chance = uniform(round_key(3 * r))
        new_at, new_stop, new_key, sizes = [], [], [], np.zeros(n, np.int64)
        own_key, start, tops = round_key(3 * r + 1), np.zeros(n), np.zeros(n)
        branch: list[tuple[int, int]] = []
        again: list[tuple[_Path, int, int, float, float]] = []
        for d in range(n):
            heads[d].append(None)
            score, q, i = best_open(d)
            if q < 0 or score == -np.inf:
                branch.append((-1, 0))
                continue
            path = paths[q]
            out = taken.setdefault((q, i), [int(path.edges[i])])
            s = int(lattice.src[path.edges[i]])
            rest = [e for e in range(int(lattice.first[s]), int(lattice.last[s]) + 1) if e not in out]
            p = np.exp(lattice.log_p[rest])
            e = rest[min(int(np.searchsorted(np.cumsum(p) / p.sum(), chance[d])), len(rest) - 1)]
            out.append(e)
            left = float(p.sum() - np.exp(lattice.log_p[e]))
            phi = path.before[i] + (np.log(left) if left > 0 and len(rest) > 1 else -np.inf)
            again.append((path, int(path.open_at[d]) + i - int(path.bounds[d]), d, phi, score))
            heads[d][r] = np.concatenate((heads[d][q], path.edges[int(path.bounds[d]) : i], [e]))
            start[d], tops[d] = path.before[i] + lattice.log_p[e], score
            u = int(units[q][i])
            after = np.arange(u + 1, unit_at[d + 1])
            new_at.append(np.concatenate(([lattice.dst[e]], begins[after])))
            new_stop.append(np.concatenate(([stops[u]], stops[after])))
            new_key.append(own_key[d] + place[u : unit_at[d + 1]])
            sizes[d] = len(after) + 1
            branch.append((u, 1))
            found[d].append((r, 0.0, score))
        phis, scores = np.array([x[3] for x in again]), np.array([x[4] for x in again])
        for (path, i, *_), score in zip(again, _below(phis, scores, own_key[[x[2] for x in again]] + np.uint64(1)).tolist() if again else [], strict=True):
            path.open[i] = score
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        edges, count = lattice.walk(join(new_at, np.int64), join(new_stop, np.int64), join(new_key, np.uint64))
        step_at = np.concatenate(([0], np.cumsum(count)))
        bounds = step_at[np.concatenate(([0], np.cumsum(sizes)))]
        names = [np.arange(u, u + m) for (u, _), m in zip(branch, sizes.tolist(), strict=True) if m]
        units.append(np.repeat(join(names, np.int64), count))
        paths.append(_Path(lattice, edges, bounds, start, tops, round_key(3 * r + 2), k))
        for d in range(n):
            if found[d][-1][0] == r:
                found[d][-1] = (r, float(paths[r].end[d]), found[d][-1][2])
    out = []
    for d in range(n):
        kappa = best_open(d)[0]
        rows = []
        for r, phi, score in found[d]:
            path = paths[r]
            whole = np.concatenate((heads[d][r], path.edges[int(path.bounds[d]) : int(path.bounds[d + 1])]))
            rows.append((lattice.ids(whole), phi, score, 1.0 if kappa == -np.inf else float(-np.expm1(-np.exp(min(phi - kappa, 700.0))))))
        out.append(rows)
    return out


_lattices: dict[int, Lattice] = {}


def _lattice(key: int, shared) -> Lattice:
    """The lattice of a vocabulary, the only one that a worker holds."""
    if key not in _lattices:
        _lattices.clear()
        _lattices[key] = Lattice(*shared.value)
    return _lattices[key]


def _encode(shared, key: int, k: int, seed: int):
    def emit(held):
        lattice = _lattice(key, shared)
        ids = [d for d, t in held if t]
        keys = mix(np.array([0 if d is None else d for d in ids], np.int64).astype(np.uint64) * np.uint64(BASE) + np.uint64(seed))
        found = iter(sample(lattice, [t for _, t in held if t], keys, k) if ids else [])
        lattice.clear()
        rows = [(d, rank, *x) for d, t in held for rank, x in enumerate(next(found) if t else [(None if t is None else np.zeros(0, np.int32), 0.0, 0.0, 1.0)], 1)]
        lengths = np.cumsum([0, *(0 if r[2] is None else len(r[2]) for r in rows)])
        values = np.concatenate([np.zeros(0, np.int32), *(r[2] for r in rows if r[2] is not None)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(values), mask=pa.array([r[2] is None for r in rows], pa.bool_()))
        columns = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "rank": pa.array([r[1] for r in rows], pa.int32()), "ids": lists}
        return pa.record_batch(columns | {n: pa.array([r[i] for r in rows], pa.float64()) for i, n in ((3, "log_prob"), (4, "perturbed"), (5, "inclusion"))})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                held.append((d, t))
                size += len(t or "")
                if size >= CHUNK:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    return run


def encode(docs: DataFrame, k: int = 2, seed: int = 4, model: str = MODEL) -> DataFrame:
    """k distinct sampled segmentations of every whole text of ``docs`` (doc_id, text).

    Returns doc_id, rank (from 1, by falling perturbed score), ids, log_prob, perturbed and inclusion; fewer
    rows where a text has fewer segmentations. Randomness depends on ``seed`` and doc_id alone, so rows
    alike come out alike. An empty text has one row without ids, a null text one row of null ids. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = spelled, logs, byte_0 = vocabulary(model)
    shared = spark.sparkContext.broadcast(pieces)  # one vocabulary: a few MB
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(shared, hash((*spelled, *logs, byte_0)), k, seed), "doc_id long, rank int, ids array<int>, log_prob double, perturbed double, inclusion double")


def _decode(shared, names: list[str]):
    def run(batches):
        spelled = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            ids = batch["ids"]
            offsets = ids.offsets.to_numpy()
            pieces = spelled.take(ids.flatten())  # their bytes stand one after another
            at = np.frombuffer(pieces.buffers()[1], np.int64) if len(pieces) else np.zeros(1, np.int64)
            data = memoryview(pieces.buffers()[2] or b"")
            bounds = at[offsets - offsets[0]].tolist()
            texts = [str(data[a + 1 : b], "utf-8", "replace") if ok else None for a, b, ok in zip(bounds[:-1], bounds[1:], ids.is_valid().to_pylist(), strict=True)]
            yield pa.record_batch({**{n: batch[n] for n in names}, "text": pa.array(texts, pa.string())})

    return run


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``rows`` with ``ids`` replaced by the text they spell; null ids give null, no ids the empty text."""
    spark: SparkSession = rows.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary(model)[0])
    others = [f for f in rows.schema if f.name not in ("ids", "text")]
    # under plain names on the way: a name with dots or quotes in it can't be handed to Python
    plain = [f"c{i}" for i in range(len(others))]
    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(plain, others, strict=True)), T.StructField("text", T.StringType())])
    given = rows.select(*(F.col(quoted(f.name)).alias(n) for n, f in zip(plain, others, strict=True)), "ids")
    return given.mapInArrow(_decode(shared, plain), schema).toDF(*(f.name for f in others), "text")
