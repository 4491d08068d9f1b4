"""Incremental runs: what changed runs again, and nothing else."""

import json

from pyspark.sql import functions as F

from quire.operators import rendering, reprocess, span_tree
from quire.operators.reprocess import Stage


def inputs(spark, texts):
    return spark.createDataFrame([(p, "native", json.dumps({"pages": [{"page_idx": 0, "blocks": [{"type": "text", "content": t}]}]})) for p, t in texts.items()], "paper string, part string, json string").withColumn("sha256", F.sha2("json", 256))


def stages(spark, given, version="1", seen=None):
    def normalise(papers, before):
        native = given.join(papers, "paper", "left_semi").select(F.col("paper").alias("doc"), "json")
        return span_tree.span_blocks(native).select(F.col("doc").alias("paper"), "page", "pos", "kind", "runs")

    def render(papers, before):
        if seen is not None:
            seen.append(sorted(r.paper for r in before["normalise"].collect()))
        return rendering.document_markdown(before["normalise"], "paper")

    return [(Stage("normalise", "1", ("native",)), normalise), (Stage("render", version, (), ("normalise",)), render)]


def test_runs(spark, tmp_path):
    ledger, texts, seen = f"{tmp_path}/ledger", {"a": "one", "b": "two", "c": "three"}, []

    def go(version="1"):
        given = inputs(spark, texts)
        return reprocess.run(spark, given.select("paper", "part", "sha256"), stages(spark, given, version, seen), ledger)

    def shown():
        held = reprocess.latest(spark.read.parquet(ledger)).where("stage = 'render'")
        return {r.paper: r.markdown.split("\n")[-2] for r in reprocess.rows_of(spark, held, None).collect()}

    assert go() == {"normalise": 3, "render": 3} and shown() == {"a": "one", "b": "two", "c": "three"}
    assert go() == {"normalise": 0, "render": 0}
    texts |= {"b": "changed", "d": "more"}
    assert go() == {"normalise": 2, "render": 2} and seen[-1] == ["b", "d"]
    assert shown() == {"a": "one", "b": "changed", "c": "three", "d": "more"}
    assert go("2") == {"normalise": 0, "render": 4} and seen[-1] == ["a", "b", "c", "d"]
    del texts["a"]
    given = inputs(spark, texts)
    wanted = reprocess.digests(given, [s for s, _ in stages(spark, given, "2")])
    found = {(r.paper, r.stage): r.state for r in reprocess.states(wanted, spark.read.parquet(ledger)).collect()}
    assert found == {(p, s): "gone" if p == "a" else "current" for p in "abcd" for s in ("normalise", "render")}


def test_killed_run(spark, tmp_path):
    """A stage that fails leaves no digest of its own: the next run does it, and not the one before it, again."""
    ledger, given = f"{tmp_path}/ledger", inputs(spark, {"a": "one"})
    good = stages(spark, given)

    def broken(papers, before):
        raise RuntimeError("killed")

    try:
        reprocess.run(spark, given, [good[0], (good[1][0], broken)], ledger)
    except RuntimeError:
        pass
    assert reprocess.run(spark, given, good, ledger) == {"normalise": 0, "render": 1}


def test_digests(spark):
    rows = spark.createDataFrame([("p", "x", "2"), ("p", "x", "1"), ("q", "y", "1")], "paper string, part string, sha256 string")
    one = lambda *s: {(r.paper, r.stage): r.digest for r in reprocess.digests(rows, list(s)).collect()}
    a, b = one(Stage("s", "1", ("x",)), Stage("t", "1", (), ("s",))), one(Stage("s", "2", ("x",)), Stage("t", "1", (), ("s",)))
    assert len(set(a.values())) == 4 and not set(a.values()) & set(b.values())
    assert one(Stage("s", "1", ("x",))) == {k: v for k, v in a.items() if k[1] == "s"}
