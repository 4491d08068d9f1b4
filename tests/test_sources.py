"""Readers, sinks, strict records, native documents and the intake stream on small files."""

import hashlib
import json

from quire.operators import normalize, validate
from quire.sources import files, sinks
from quire.streaming.intake import intake


def test_pdf_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"no")
    (tmp_path / "c.txt").write_bytes(b"%PDF-")
    rows = files.pdf_files(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.sha256, r.reason) for r in rows] == [("a.PDF", hashlib.sha256(b"%PDF-1.7 x").hexdigest(), None), ("b.pdf", None, "no PDF signature")]


def test_manifest(spark, tmp_path):
    lines = ['{"schema": "batch_manifest", "schema_version": 1}', "# note", '{"id": "x", "paper": "a.pdf"}', '{"id": "x", "paper": " ", "more": 1}', "{broken"]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    got = {r.line: list(r.problems) for r in files.manifest(spark, str(tmp_path / "m.jsonl")).collect()}
    assert got == {3: ["repeated id"], 4: ["unknown fields: more", "no paper", "repeated id"], 5: ["not JSON"]}


def test_captures(spark):
    mhtml = b"MIME-Version: 1.0\r\nSnapshot-Content-Location: http://x/y\r\nContent-Type: multipart/related; boundary=B\r\n\r\n--B\r\nContent-Type: text/html; charset=latin-1\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<p>=E9</p>\r\n--B--\r\n"
    rows = spark.createDataFrame([(1, mhtml), (2, b"<!-- saved from url=(0014)http://z --><p>\xc3\xa9"), (3, None)], "i int, c binary")
    got = [r.x for r in rows.select("i", files.captured("c").alias("x")).orderBy("i").collect()]
    assert (got[0].kind, got[0].address, got[0].html.strip()) == ("mhtml", "http://x/y", "<p>é</p>")
    assert (got[1].kind, got[1].address) == ("html", "http://z") and got[1].html.endswith("é") and got[2].html == ""


def test_bibtex():
    got = files.bibtex_entries('@article{k1, title = {A {B} c}, year=2019, note = "x, y"}\n@misc{k2, a = {open')
    assert got == [("article", "k1", {"title": "A {B} c", "year": "2019", "note": "x, y"})]


def test_catalog_and_index(spark, tmp_path):
    rows = spark.createDataFrame([(2, "d2", "10.1/A", None, "The t", "t", ["X"], "abs", "body words", 2000, ["s1", "s2"], ["10.1/b"])], "schema_version int, directory string, doi string, arxiv string, title string, title_key string, authors array<string>, abstract string, body string, year int, sources array<string>, candidates array<string>")
    sinks.write_catalog(rows, str(tmp_path / "catalog"))
    again = files.catalog(spark, str(tmp_path / "catalog"), rows.schema.simpleString()[7:-1].replace(":", " "), (2,))
    assert again.count() == 1
    sinks.build_index(again, str(tmp_path / "index"))
    assert [(r.sha256, r.role) for r in sinks.index_table(spark, str(tmp_path / "index"), "sources").orderBy("position").collect()] == [("s1", "main"), ("s2", "supplement")]
    assert sinks.index_table(spark, str(tmp_path / "index"), "postings").count() == 5


def test_integrity(spark):
    listed = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 1, "z")], "path string, size int, sha256 string")
    found = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("d", 1, "w")], "path string, size int, sha256 string")
    assert {r.path: r.problem for r in validate.integrity(listed, found).collect()} == {"b": "changed", "c": "missing", "d": "unlisted"}


def test_native_blocks(spark):
    pages = [{"page_idx": 1, "blocks": [{"type": "text", "index": 0, "text": "second"}]}, {"page_idx": 0, "blocks": [{"type": "title", "index": 0, "level": 1, "text": "T", "bbox": [0, 0, 1, 1]}, {"type": "header", "index": 1, "text": "H"}, {"type": "odd", "index": 2}]}]
    rows = normalize.blocks(spark.createDataFrame([("d", json.dumps({"pages": pages}))], "doc string, json string")).orderBy("pos").collect()
    assert [(r.page, r.kind, r.role, r.text) for r in rows] == [(1, "heading", None, "T"), (1, "furniture", "header", "H"), (1, "unknown", None, None), (2, "paragraph", None, "second")]
    assert rows[0].box.x1 == 1.0 and rows[2].raw and len({r.id for r in rows}) == 4


def test_tree(spark):
    rows = spark.createDataFrame([("d", "a", None, 0), ("d", "c", "a", 1), ("d", "b", "a", 0), ("d", "e", "b", 0), ("d", "x", "y", 0), ("d", "y", "x", 0)], "doc string, ref string, parent string, rank int")
    assert [r.ref for r in normalize.flatten_tree(rows).orderBy("path").collect()] == ["a", "b", "e", "c"]


def test_intake(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"path": "1", "sha256": "x", "seen": "2024-01-01T00:00:00"}\n{"path": "2", "sha256": "x", "seen": "2024-01-01T00:00:01"}\n{"path": "3", "sha256": "y", "seen": "2024-01-01T00:00:00"}\n')
    q = intake(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("taken").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.sha256 for r in spark.table("taken").collect()) == ["x", "y"]
