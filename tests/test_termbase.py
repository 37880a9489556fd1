"""Termbase store, operators, exports, report, pipeline, service and command line."""

import csv
import json
import random
import sqlite3
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from lexforge import cli
from lexforge.operators import export as ex
from lexforge.operators import termbase as tb
from lexforge.operators.report import ADVICE, generate_report
from lexforge.pipeline import run_pipeline
from lexforge.service import Service
from lexforge.sources.lookup import available, flatten_wikipedia, source_limit, youdao_signature
from lexforge.sources.store import Termbase, delete_termbase, list_termbases


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/bases"


def test_like_matches_sqlite(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("aAbB%_\\éÀ中", k=rng.randint(0, 6))) for _ in range(200)]
    con = sqlite3.connect(":memory:")
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for _ in range(12):
        q = "".join(rng.choices("aAbB%_\\éÀ中", k=rng.randint(0, 3)))
        want = [w for w in words if con.execute("select ? like ?", (w, f"%{q}%")).fetchone()[0]]
        assert sorted(r["w"] for r in df.filter(tb.like(F.col("w"), q)).collect()) == sorted(want), q


def test_store_round_trip(spark, root, tmp_path):
    base = Termbase.create(spark, root, "it", "it")
    with pytest.raises(FileExistsError):
        Termbase.create(spark, root, "it")
    with pytest.raises(FileNotFoundError):
        Termbase(spark, root, "nothing")
    a, b = base.add_term("server", translation="服务器", domain="it", status="confirmed"), base.add_term("cloud")
    assert (a, b) == (1, 2) and base.get_term(1)["word"] == "server" and base.get_term(9) is None
    base.update_term(2, domain="it", nonsense="x")
    assert base.get_term(2)["domain"] == "it"
    base.add_association(1, "host", "synonym", 0.5)
    base.add_association(1, "client", "collocation", 0.9)
    with pytest.raises(ValueError):
        base.add_association(99, "x")
    assert [x["related_word"] for x in base.get_associations(1)] == ["client", "host"]
    base.delete_term(1)
    assert base.get_associations(1) == [] and base.add_term("new") == 3
    path = tmp_path / "in.csv"
    path.write_bytes(b'\xef\xbb\xbfword,translation,domain\ncloud,,it\n  fog , "mist" ,it\nfog,mist,x\n   ,y,z\n"a ""q"", b",two\nlines"x\n'.replace(b'"mist"', b"mist"))
    assert base.import_csv(str(path)) >= 2
    words = [r["word"] for r in base.terms.orderBy("id").collect()]
    assert words[:2] == ["cloud", "new"] and words.count("fog") == 1
    other = Termbase.create(spark, root, "other")
    other.add_term("cloud")
    other.add_term("rain", translation="雨")
    other.add_term("rain", translation="雨")
    assert base.merge(other) == {"added": 1, "skipped": 2, "total_other": 3}
    base.set_meta("owner", "me")
    assert base.get_meta("owner") == "me" and base.name == "it" and base.domain == "it"
    assert [x["name"] for x in list_termbases(spark, root)] == ["it", "other"]
    s = base.stats()
    assert s["total_terms"] == base.terms.count() and sum(s["by_status"].values()) == s["total_terms"]
    delete_termbase(spark, root, "other")
    with pytest.raises(FileNotFoundError):
        delete_termbase(spark, root, "other")


def test_null_translations_are_always_new(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "x"), (4, "b", "x")], "id long, word string, translation string")
    assert sorted(r["id"] for r in tb.new_rows(rows.limit(0), rows, ["id"]).collect()) == [1, 2, 3]
    assert tb.new_rows(rows, rows, ["id"], dedup=False).count() == 4


def test_exports(spark, root, tmp_path):
    base = Termbase.create(spark, root, "t", "it")
    for w, t, st in (("b & <c>", "乙", "confirmed"), ("a", "", "draft"), ("c", "丙", "confirmed")):
        base.add_term(w, translation=t, status=st, domain="it", type_="noun")
    p = str(tmp_path / "x")
    assert ex.export(base, "csv", p) == 3 and open(p, "rb").read(3) == b"\xef\xbb\xbf"
    assert len(list(csv.DictReader(open(p, encoding="utf-8-sig")))) == 3
    assert ex.export(base, "csv", p, "confirmed") == 2
    assert ex.export(base, "tbx", p) == 3
    entries = ET.parse(p).getroot().findall(".//{urn:iso:std:iso:30042:ed-1}termEntry")
    assert len(entries) == 3 and len(entries[0]) == 1
    assert ex.export(base, "json", p) == 3
    body = json.load(open(p, encoding="utf-8"))
    assert [t["word"] for t in body["terms"]] == ["a", "b & <c>", "c"] and body["stats"]["confirmed"] == 2
    assert ex.export(base, "xlsx", p) == 3
    sheet = zipfile.ZipFile(p).read("xl/worksheets/sheet1.xml").decode()
    ET.fromstring(sheet)
    assert 'ref="A1:G4"' in sheet and "b &amp; &lt;c&gt;" in sheet
    with pytest.raises(ValueError):
        ex.export(base, "doc", p)
    empty = Termbase.create(spark, root, "none")
    assert [ex.export(empty, f, p) for f in ("csv", "tbx", "json", "xlsx")] == [0, 0, 0, 0]


def test_report():
    a = {"lang": "mixed", "chars_total": 9, "chars_no_space": 8, "words_cn": 1, "words_en": 2, "paragraphs": 1, "sentences": 1, "domain": "legal", "difficulty": "hard", "domain_scores": {"legal": 0.5, "it": 0.0}}
    text = generate_report(a, [{"term": "x", "frequency": 2, "score": 1.0, "word_type": "a"}, {"term": "y", "frequency": 1, "score": 0.5, "word_type": "b"}], {"name": "n", "total_terms": 4, "confirmed": 1, "associations": 0, "domain": "it", "by_domain": {"": 4}, "by_status": {"draft": 4}, "recent": []}, "P", "f.txt", "note")
    for part in ("# Pre-Translation Report: P", "## 2. Text Analysis", "██████████░░░░░░░░░░ 50.0%", "## 3. Extracted Terms (Top 2)", "| 1 | x | 2 | 1.00 | a |", "### Terms by Type", "- **uncategorized:** 4", ADVICE["hard"], "Only 1 of 4 terms", "'x' appears 2 times"):
        assert part in text
    assert ADVICE["none"] in generate_report()


def test_pipeline_and_service(spark, root, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    pages = {"en": '{"type": "standard", "title": "T", "extract": "E"}'}
    fetch = lambda term, source: pages.get(source[-2:])
    text = "本合同由甲方签订。合同条款有效。NASA signs the contract. New York City."
    r = run_pipeline(spark, root, text=text, project_name="My Job", export_formats=["csv", ".TBX", "odd"], fetch=fetch)
    assert r.errors == ["Unknown format: odd"] and set(r.exports) == {"csv", "tbx"} and r.termbase_name == "my-job"
    assert r.termbase_terms == len(r.terms) == r.search_results_count > 0
    base = Termbase(spark, root, "my-job")
    assert base.domain == r.analysis["domain"] and {x["status"] for x in base.terms.collect()} == {"draft"}
    assert run_pipeline(spark, root).errors and (tmp_path / "my-job-report.md").exists()
    s = Service(spark, root)
    assert s.handle("POST", "/api/analyze", {"text": " "})[0] == 400
    ok, body = s.handle("POST", "/api/analyze", {"text": text})
    assert ok == 200 and body["lang"] == "mixed" and "Language" in body["summary"]
    assert s.handle("POST", "/api/db/init", {"name": "z"})[0] == 200 and s.handle("POST", "/api/db/init", {"name": "z"})[0] == 409
    assert s.handle("POST", "/api/term/add", {"word": "w", "db": "z"})[1] == {"id": 1}
    assert s.handle("POST", "/api/term/search", {"query": "W", "db": "z"})[1]["results"][0]["word"] == "w"
    assert s.handle("GET", "/api/db/info", {"db": "nope"})[0] == 404 and len(s.handle("GET", "/api/sources")[1]["sources"]) == 3
    assert s.handle("POST", "/api/search", {"term": "x"})[1] == {"results": []}
    assert s.handle("POST", "/api/pipeline", {"text": text, "project_name": "q"})[1]["report"].startswith("# Pre-Translation")


def test_lookup_rules(spark, monkeypatch):
    assert source_limit(20) == 6 and source_limit(1) == 1
    monkeypatch.delenv("LEXFORGE_YOUDAO_KEY", raising=False)
    assert available("wikipedia") and not available("youdao")
    assert len(youdao_signature("k", "t", "s", "1", "x")) == 64
    raw = spark.createDataFrame([("a", "zh", '{"title":"Z","extract":"z"}'), ("b", "en", '{"title":"B","extract":"b"}'), ("b", "zh", '{"title":"C","extract":"c"}')], "query string, lang string, json string")
    assert sorted((r["query"], r["word"]) for r in flatten_wikipedia(raw, 1).collect()) == [("a", "Z"), ("b", "B")]


def test_command_line(spark, root, tmp_path, capsys):
    f = tmp_path / "t.txt"
    f.write_text("The database server. 数据数据", encoding="utf-8")
    run = lambda *a: cli.main(["--root", root, *a], spark)
    assert run("analyze", str(f)) == 0 and "Domain: it" in capsys.readouterr().out
    assert run("extract", str(f)) == 0 and "数据" in capsys.readouterr().out
    assert run("db", "init", "terms") == 0 and run("db", "init", "terms") == 1
    assert run("term", "add", "server", "--translation", "服务器") == 0 and run("term", "update", "1", "--status", "confirmed") == 0
    Termbase(spark, root).add_association(1, "host", "synonym", 0.4)
    capsys.readouterr()
    assert run("search", "SERV", "--source", "local") == 0 and capsys.readouterr().out.startswith("host\tsynonym\tmanual\t0.4")
    batch = tmp_path / "b.txt"
    batch.write_text("server\n\n server \nnothing\n", encoding="utf-8")
    assert run("batch", str(batch), "--source", "local", "-o", str(tmp_path / "o.csv")) == 0
    assert len(list(csv.reader(open(tmp_path / "o.csv", encoding="utf-8")))) == 3
    assert run("db", "list") == 0 and "terms\t\tauto\t1" in capsys.readouterr().out
    assert run("db", "export", str(tmp_path / "e.json"), "--format", "json") == 0 and run("db", "info") == 0
    assert run("report", str(f), "--db", "terms") == 0 and run("term", "delete", "1") == 0 and run("sources") == 0
    assert run("db", "delete", "terms") == 0 and run("db", "info") == 1
