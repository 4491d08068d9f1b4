"""Top-k search, segmentation and the pipeline."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brute import classes, statistics
from quire.llm import hashing, line_dedup, mixing, segmentation, topk


def test_top_k(spark):
    random.seed(3)
    rows = [(i, [random.choice([-0.5, 0.25, 0.1, 0.7]) for _ in range(6)]) for i in range(900)]
    rows += [(900 + i, [0.5] * 6) for i in range(300)] + [(5000, None), (5050, [None] * 6), (5100, [math.nan] * 6), (None, [1.0] * 6), (5150, []), (50, rows[50][1])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5).collect()
    sound = [(n, i, [math.floor(256 * float(np.float32(c))) for c in x]) for n, (i, x) in enumerate(rows) if i is not None and x and all(c is not None and math.isfinite(c) for c in x)]
    want = Counter()
    for n, i, x in sound:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j, m) for m, j, y in sound if m != n)[:5]
            want.update((i, r, j, -s) for r, (s, j, _) in enumerate(best, 1))
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def test_top_k_clusters(spark, monkeypatch):
    """Vectors round many centres in small shards: pruned clusters hold nothing that is missed."""
    monkeypatch.setattr(topk, "SHARD_VALUES", 1)
    monkeypatch.setattr(topk, "CLUSTERS", 12)
    rng = np.random.default_rng(5)
    spots = rng.normal(size=(9, 8))
    rows = [(i, (spots[i % 9] * (1 + i % 3) + rng.normal(size=8) * 0.05).astype(np.float32).tolist()) for i in range(2000)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    v = np.floor(256 * np.array([x for _, x in rows], np.float32).astype(np.float64)).astype(np.int64)
    want = []
    for i in range(0, 2000, 50):
        score = v @ v[i]
        best = sorted((-int(x), j) for j, x in enumerate(score) if j != i)[:5]
        want += [(i, n, j, -x) for n, (x, j) in enumerate(best, 1)]
    assert got == want


def test_top_k_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.fixture(scope="module")
def lattice():
    return segmentation.Lattice(*segmentation.vocabulary())


def test_sampling_without_replacement(lattice):
    """Pairs of segmentations of a short text come as drawing without replacement gives them."""
    n = 6000
    found = segmentation.sample(lattice, ["then"] * n, hashing.mix(np.arange(n).astype(np.uint64)), 2)
    chance = {tuple(ids): math.exp(p) for rows in found for ids, p, _, _ in rows}
    assert math.isclose(sum(chance.values()), 1, rel_tol=0.01)
    first, pairs = Counter(tuple(r[0][0]) for r in found), Counter((tuple(r[0][0]), tuple(r[1][0])) for r in found)
    for a, p in chance.items():
        assert abs(first[a] / n - p) < 0.03
        for b, q in chance.items():
            if a != b:
                assert abs(pairs[a, b] / n - p * q / (1 - p)) < 0.03
    for rows in found[:200]:
        assert rows[0][2] > rows[1][2] and all(0 <= x[3] <= 1 for x in rows)


def test_batches_do_not_matter(lattice):
    texts = ["The first text\nwith lines.", "Zwei  Wörter", "三 \U0001f600 ▁ mark"]
    keys = hashing.mix(np.arange(3).astype(np.uint64))
    whole = segmentation.sample(lattice, texts, keys, 3)
    for i, t in enumerate(texts):
        alone = segmentation.sample(lattice, [t], keys[i : i + 1], 3)[0]
        assert [(x[0].tolist(), *x[1:]) for x in alone] == [(x[0].tolist(), *x[1:]) for x in whole[i]]


def test_few_siblings_scored(lattice, monkeypatch):
    """Of long texts only the first steps' siblings are scored, and the segmentations are those of scoring all."""
    texts = ["Some words of a long text, " * 3000, "then", "wort " * 400, "deadbeef" * 5000]
    keys = hashing.mix(np.arange(4).astype(np.uint64))
    scored, below = [], segmentation._below
    monkeypatch.setattr(segmentation, "_below", lambda phi, *x: scored.append(len(phi)) or below(phi, *x))
    few = segmentation.sample(lattice, texts, keys, 5)
    assert sum(scored) < 0.2 * sum(len(x[0]) for rows in few for x in rows)
    monkeypatch.setattr(segmentation, "AHEAD", 1 << 20)
    whole = segmentation.sample(lattice, texts, keys, 5)
    assert [[(x[0].tolist(), *x[1:]) for x in rows] for rows in few] == [[(x[0].tolist(), *x[1:]) for x in rows] for rows in whole]


def test_decode_plain(spark):
    """Decoding against pieces joined one by one: null and no ids, a mark alone, bytes that are not UTF-8."""
    spelled, _, byte_0 = segmentation.vocabulary()
    mark = spelled.index(b" ")
    rows = [(0, None), (1, []), (2, [mark]), (3, [mark, byte_0 + 0xC3, byte_0 + 0xA9, byte_0 + 0xFF]), (4, [*range(300, 900)] * 30)]
    got = segmentation.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()
    assert {r.doc_id: r.text for r in got} == {i: None if x is None else b"".join(spelled[p] for p in x)[1:].decode("utf-8", "replace") for i, x in rows}


def test_round_trip(docs, edge, none):
    for rows in (docs, edge):
        found = segmentation.encode(rows, k=3)
        back = segmentation.decode(found)
        texts = {r.doc_id: r.text for r in rows.collect()}
        got = back.collect()
        assert {r.doc_id for r in got} == set(texts)
        assert all(r.text == texts[r.doc_id] for r in got)
        for r in found.groupBy("doc_id", "rank").count().where("count > 1").collect():
            assert r.doc_id == 1
    distinct = segmentation.encode(docs).groupBy("doc_id").agg({"ids": "count"}).collect()
    assert len(distinct) == docs.count()
    assert segmentation.encode(none).count() == 0


def _plain_lines(rows):
    """Texts without the lines that over RATIO of their source's pages, and LEAST_PAGES at least, hold."""
    pages, often = Counter(), Counter()
    bare = lambda x: x.strip(" \t\n\x0b\f\r")
    for r in rows:
        pages[r.source] += 1
        often.update({(r.source, bare(x)) for x in (r.text or "").split("\n") if bare(x)})
    bad = {k for k, n in often.items() if n >= line_dedup.LEAST_PAGES and n > line_dedup.RATIO * pages[k[0]]}
    return {r.doc_id: None if r.text is None else "\n".join(x for x in r.text.split("\n") if (r.source, bare(x)) not in bad) for r in rows}


def test_stages(spark, docs):
    """Each stage against a plain version of it over its own input, and all in a row."""
    sf_dir = "/root/testdata/sf0.001"
    rows, seen = docs, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, sf_dir)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            out = out.cache()
        seen[name] = ({r.doc_id: r for r in rows.collect()}, out.collect())
        rows = out
    before, after = seen["quality_rules"]
    found = {i: statistics(r.text) for i, r in before.items()}
    fails = {i for i, (n, _, _, _, again) in found.items() if n < 50 or 100 * again > 50 * n}
    ids = {r.doc_id for r in after}
    assert not ids & fails and len(ids) == len(after) and len(set(before) - fails - ids) < 0.1 * len(before)
    before, after = seen["line_dedup"]
    assert {r.doc_id: r.text for r in after} == _plain_lines(before.values())
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = seen["near_dedup"]
    assert sorted(r.doc_id for r in after) == sorted(i for i, (n, least) in classes({i: r.text for i, r in before.items()}, 80).items() if i == least or not n)
    assert all(r == before[r.doc_id] for r in after)
    before, after = seen["mixing"]
    taken = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(list(before.values()), docs.schema)).collect()}
    words_of = Counter()
    for r in after:
        whole, part = before[r.doc_id].text.split(), r.text.split()
        assert whole[: len(part)] == part
        words_of[r.doc_id] += len(part)
    assert words_of == Counter({i: n for i, n in taken.items() if n})
    before, after = seen["sentencepiece"]
    copies = Counter((r.doc_id, r.text) for r in seen["mixing"][1])
    back = Counter((r.doc_id, r.text) for r in segmentation.decode(rows).collect() if r["rank"] == 1)
    assert back == copies
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect())


def test_stages_edges(spark, edge, none):
    for rows in (none, edge):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, "/root/testdata/sf0.001").count() >= 0


def test_stages_odd_names(spark, edge):
    """Dots, quotes and blanks in names, and names that differ from a helper's by case: all columns keep their values."""
    odd = {"a.b": "x", "a`b": "x + 1", "text.x": "x + 2", "c d": "x + 3", "KEYS": "x + 4", "`": "x + 5", "select": "x + 6"}
    rows = edge.select("doc_id", "text", "lang", "source", "n_chars", *(F.expr(v).alias(k) for k, v in odd.items()))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, "/root/testdata/sf0.001")
        assert out.columns == rows.columns
        assert all(tuple(r)[5:] == tuple(range(7)) for r in out.collect())
    found = segmentation.encode(rows).withColumns({"a.b": F.lit(7), "c`d": F.lit(8)})
    back = segmentation.decode(found)
    assert back.columns == [c for c in found.columns if c != "ids"] + ["text"] and all((r["a.b"], r["c`d"]) == (7, 8) for r in back.collect())


def test_batches_leave_no_edges_behind():
    """A worker's sampling takes tens of MB whatever the texts, of which a batch leaves nothing once it is out; batches don't change results."""
    draw = random.Random(5)
    texts = ["".join(draw.choice("bdfklmnoaeiu") for _ in range(9)) + f" {i} " for i in range(20_000)]
    texts = [(i, "".join(texts[i : i + 100])) for i in range(0, 20_000, 20)]
    batch = lambda rows: pa.record_batch({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    shared, again = (type("Shared", (), {"value": v})() for v in [segmentation.vocabulary()] * 2)
    run = segmentation._encode(shared, 1, 2, 4)
    few = [r for b in run(iter([batch(texts[:3])])) for r in b.to_pylist()]
    tracemalloc.start()
    try:
        out, held = run(iter([batch(texts)])), []
        first = next(out).to_pylist()[: len(few)]
        for _ in out:
            held.append(tracemalloc.get_traced_memory()[0] / 1e6)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert first == few
    assert held and max(held) < 30 and peak < 150
    assert segmentation._lattice(1, shared) is segmentation._lattice(1, again)
