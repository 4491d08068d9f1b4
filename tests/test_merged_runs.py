"""Sharded runs and manifests' bundles."""

import json

from quire import app
from quire.operators import merged_runs


def test_merged(spark):
    rows = [
        ("r1", "a", "published", "export", "A", 1), ("r1", "b", "failed", "extract", None, 1), ("r2", "b", "published", "export", "B", 2), ("r1", "c", "published", "export", "C", 1), ("r2", "c", "replaced", "export", "C", 3),
        ("r1", "d", "published", "export", "D1", 5), ("r2", "d", "published", "export", "D2", 4), ("r1", "e", "held", "intake", None, 1), ("r2", "e", "failed", "intake", None, 1), ("r1", "f", "failed", "x", None, 1), ("r1", "f", "published", "y", "F", 2),
    ]
    found = merged_runs.merged(spark.createDataFrame(rows, "run string, sha256 string, status string, stage string, directory string, finished int"))
    got = {r.sha256: (r.status, r.directory, r.run, r.runs, r.state) for r in found.collect()}
    assert got == {"a": ("published", "A", "r1", 1, "single"), "b": ("published", "B", "r2", 2, "retried"), "c": ("replaced", "C", "r2", 2, "repeat"), "d": ("published", "D1", "r1", 2, "conflict"), "e": ("failed", None, "r2", 2, "retried"), "f": ("published", "F", "r1", 1, "single")}
    assert {(r.status, r.state): r.sources for r in merged_runs.summary(found).collect()}[("published", "single")] == 2
    assert merged_runs.merged(found.where("false").select("run", "sha256", "status", "stage", "directory", "finished")).count() == 0


def test_bundles(spark):
    entries = spark.createDataFrame([("x", "p1", ["s1", None, "s2"], ["h"]), ("y", "p2", None, None), ("z", "p3", ["s1copy"], []), ("w", "gone", ["s2"], [])], "id string, paper string, supplements array<string>, html array<string>")
    files = spark.createDataFrame([("p1", "1"), ("p2", "2"), ("p3", "3"), ("s1", "4"), ("s2", "5"), ("s1copy", "4")], "path string, sha256 string")
    members = merged_runs.bundles(entries, files).cache()
    assert sorted((r.id, r.role, r.n, r.sha256) for r in members.where("id = 'x'").collect() if r.role != "page") == [("x", "paper", 0, "1"), ("x", "supplement", 0, "4"), ("x", "supplement", 2, "5")]
    assert sorted((r.sha256, r.first, r.id, r.path) for r in merged_runs.clashes(members).collect()) == [("4", "x", "z", "s1copy"), ("5", "w", "x", "s2")]
    assert sorted(tuple(r) for r in merged_runs.pairing(members).collect()) == [("x", "1", ["4", "5"], ["h"]), ("y", "2", [], []), ("z", "3", ["4"], [])]


def test_commands(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, data in (("a.pdf", b"%PDF-1"), ("b.pdf", b"%PDF-2"), ("s.pdf", b"%PDF-2")):
        (folder / name).write_bytes(data)
    lines = [{"schema": "batch_manifest", "schema_version": 1}, {"id": "x", "paper": "in/a.pdf", "supplements": ["in/s.pdf"]}, {"id": "y", "paper": "in/b.pdf", "html": ["in/y.html"]}, {"id": "z", "paper": "in/gone.pdf"}, {"id": "", "paper": "q"}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, lines)))
    shown = lambda *given: [json.loads(x) for x in (app.main([str(g) for g in given], spark), capsys.readouterr().out)[1].splitlines() if x.startswith("{")]
    got = {r["id"]: (len(r["supplements"]), r["pages"], r.get("same_bytes_as")) for r in shown("bundles", tmp_path / "m.jsonl", folder)}
    assert got == {"x": (1, [], None), "y": (0, ["y.html"], ["x"])}
    results = [{"run": "1", "sha256": "a", "status": "failed", "finished": "2026-01-01"}, {"run": "2", "sha256": "a", "status": "published", "directory": "A", "finished": "2026-01-02"}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, results)))
    assert [(r["sha256"], r["result"], r["state"], r["runs"]) for r in shown("merge", tmp_path / "r.jsonl")] == [("a", "published", "retried", 2)]
