"""The library's folder, its settings and its commands."""

import json

import pytest

from quire import app
from quire.sources import library


@pytest.fixture
def shelf(tmp_path):
    """A library of three papers, one of them in a shard's folder; a hidden folder and a folder inside a paper don't count."""
    papers = {"Ada_2019_Light": ("Light waves in air", "10.1000/a", 2019, "Lovelace", "h1"), "2020/Bo_2020_Sound": ("Sound waves in water", "10.1000/b", 2020, "Bosch", "h2"), "Cy_2021_Heat": ("Heat in metal rods", None, 2021, "Cyr", "h3")}
    for directory, (title, doi, year, family, digest) in papers.items():
        folder = tmp_path / "lib" / directory
        folder.mkdir(parents=True)
        fields = {"title": {"value": title}, "year": {"value": year}, "authors": {"value": [{"given": "X", "family": family}]}}
        for name, record in {
            "manifest": {"schema": "manifest", "schema_version": 2, "generation": "g"},
            "metadata": {"schema": "metadata", "schema_version": 1 if doi else 3, "fields": fields, "identity": {"doi": doi, "registry_record": {"abstract": f"About {title.lower()}"}}, "bibliographic_status": "VALIDATED" if doi else "UNVERIFIED"},
            "extraction": {"sources": [{"sha256": digest, "fingerprint": {}}]},
        }.items():
            (folder / f"{name}.json").write_text(json.dumps(record))
    for extra in (".private/p", "Ada_2019_Light/inner"):
        (tmp_path / "lib" / extra).mkdir(parents=True)
        (tmp_path / "lib" / extra / "manifest.json").write_text("{}")
    return tmp_path


def run(capsys, spark, *arguments):
    code = app.main([str(a) for a in arguments], spark)
    return code, [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_papers(spark, shelf):
    assert [r.directory for r in library.paper_directories(spark, str(shelf / "lib")).collect()] == ["2020/Bo_2020_Sound", "Ada_2019_Light", "Cy_2021_Heat"]
    rows = library.papers(spark, str(shelf / "lib")).collect()
    assert all(r.metadata and r.document is None for r in rows)


def test_commands(spark, shelf, capsys):
    lib = shelf / "lib"
    code, moves = run(capsys, spark, "organize", lib, "--layout", "by-year")
    assert code == 0 and sorted((m["old"], m["new"]) for m in moves) == [("Ada_2019_Light", "2019/Ada_2019_Light"), ("Cy_2021_Heat", "unverified/Cy_2021_Heat")]
    assert run(capsys, spark, "publish", lib)[0] == 0
    code, made = run(capsys, spark, "index", lib, shelf / "index")
    assert (code, made[0]["papers"]) == (0, 3)
    _, hits = run(capsys, spark, "search", '"waves in" about', shelf / "index")
    assert sorted(h["directory"] for h in hits) == ["2020/Bo_2020_Sound", "Ada_2019_Light"]
    (shelf / "want.bib").write_text("@article{one, doi = {10.1000/A}}\n@article{two, title = {Sound waves in water}, author = {Bosch, X.}, year = {2021}}\n@article{three, title = {Other things}}\n")
    _, found = run(capsys, spark, "lookup", shelf / "want.bib", lib)
    assert {f["query"]: (f.get("directory"), f["status"]) for f in found} == {"one": ("Ada_2019_Light", "present"), "two": ("2020/Bo_2020_Sound", "candidate"), "three": (None, "absent")}
    (shelf / "versions.json").write_text('{"schema":"manifest","oldest":1,"current":2}\n{"schema":"metadata","oldest":1,"current":2}\n')
    states = {s["directory"]: s["state"] for s in run(capsys, spark, "migrate", lib, shelf / "versions.json")[1]}
    assert states == {"Ada_2019_Light": "outdated", "2020/Bo_2020_Sound": "outdated", "Cy_2021_Heat": "unsupported"} or set(states.values()) <= {"unsupported", "outdated"}
    (shelf / "files.json").write_text('{"directory":"Ada_2019_Light","sha256":"h1","name":"a"}\n{"directory":"Ada_2019_Light","sha256":"n","name":"c"}\n{"directory":"Ada_2019_Light","sha256":"n","name":"b"}\n')
    got = {f["name"]: f["outcome"] for f in run(capsys, spark, "attach", lib, shelf / "files.json")[1]}
    assert got == {"a": "already_kept", "b": "attached", "c": "repeated"}


def test_batch(spark, shelf, capsys):
    folder = shelf / "in"
    folder.mkdir()
    for name, data in {"one.pdf": b"%PDF-1", "two.PDF": b"%PDF-1", "one_si.pdf": b"%PDF-2", "no.pdf": b"x"}.items():
        (folder / name).write_bytes(data)
    code, planned = run(capsys, spark, "batch", folder, shelf / "lib")
    assert code == 0 and sorted((p["status"], p["aliases"]) for p in planned) == [("supplement", 0), ("to_extract", 1)]
    parts = [run(capsys, spark, "batch", folder, shelf / "lib", "--shard", f"{k}/2")[1] for k in (1, 2)]
    assert sum(map(len, parts)) == 2
    assert len(run(capsys, spark, "dedup", folder, "--out", shelf / "out")[1]) == 2


def test_settings(tmp_path):
    defaults = {"layout": "flat", "limit": 5, "email": None}
    (tmp_path / "user.toml").write_text('limit = 6\nemail = "a@b.c"\n')
    (tmp_path / "given.toml").write_text("limit = 7\n")
    found = library.settings(defaults, str(tmp_path / "user.toml"), str(tmp_path / "given.toml"), {"layout": "by-year", "email": None})
    assert found == {"layout": ("by-year", "option"), "limit": (7, "file"), "email": ("a@b.c", "user")}
    (tmp_path / "bad.toml").write_text('limit = "x"\n')
    with pytest.raises(ValueError, match="limit"):
        library.settings(defaults, None, str(tmp_path / "bad.toml"))
    with pytest.raises(ValueError, match="unknown"):
        library.settings(defaults, options={"other": 1})


def test_responses_and_ledger(spark, tmp_path):
    rows = spark.createDataFrame([("u", "crossref", "10.1/a", None, 404, "2021", None), ("u", "crossref", "10.1/a", None, 200, "2022", "{}"), ("v", "datacite", "10.1/b", None, 200, "2020", "{}")], library.RESPONSES)
    library.store_responses(rows.limit(1), str(tmp_path / "r"))
    library.store_responses(rows.where("status = 200"), str(tmp_path / "r"))
    assert sorted((r.url, r.status) for r in library.responses(spark, str(tmp_path / "r")).collect()) == [("u", 200), ("v", 200)]
    calls = spark.createDataFrame([("t", "f", "m", 10, 2, 0.5)], library.LEDGER)
    library.record_spending(calls, str(tmp_path / "l"))
    library.record_spending(calls, str(tmp_path / "l"))
    assert [(r.model, r.calls, r.usd) for r in library.spending(spark, str(tmp_path / "l")).collect()] == [("m", 2, 1.0)]
