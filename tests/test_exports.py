"""Exports put together from parts, byte for byte those of Python's own writers."""

import csv
import io
import json
import random
import xml.etree.ElementTree as ET

import pytest

from lexforge.operators import export as ex

FIELDS = ["id", "word", "translation", "type", "domain", "status", "lang", "notes"]


def rows(n):
    rng = random.Random(n)
    some = ["a", "b,c", 'say "x"', "two\nlines", "cr\r", "\ttab", "<&>", "中文", "\\", "", None, "\x01\x1f\b\f", "é'", " "]
    return [(i, *[rng.choice(some) for _ in range(4)], rng.choice(["draft", "confirmed"]), rng.choice(["en", "auto", "zh", "", None, 'x"<\n']), rng.choice(some)) for i in range(n)]


@pytest.fixture(params=[0, 1, 60])
def case(request, spark):
    data = rows(request.param)
    df = spark.createDataFrame(data, "id long, word string, translation string, type string, domain string, status string, lang string, notes string")
    return [dict(zip(FIELDS, r, strict=True)) for r in data], df.repartition(5)


def ordered(data):
    return sorted(data, key=lambda r: (r["word"] is not None, (r["word"] or "").encode(), r["id"]))


@pytest.mark.parametrize("status", [None, "confirmed"])
def test_csv(case, tmp_path, status):
    data, df = case
    data = [r for r in data if not status or r["status"] == status]
    assert ex.export_csv(df, str(tmp_path / "x.csv"), status) == len(data)
    out = io.StringIO(newline="")
    w = csv.writer(out)
    w.writerow(ex.EXPORTED)
    w.writerows(["" if r[c] is None else r[c] for c in ex.EXPORTED] for r in data)
    assert (tmp_path / "x.csv").read_bytes() == b"\xef\xbb\xbf" + out.getvalue().encode()
    assert [p.name for p in tmp_path.iterdir()] == ["x.csv"]


def test_json(case, tmp_path):
    data, df = case
    stats = {"name": "n", "domain": "d", "confirmed": 1, "by_domain": {"": 2}, "by_status": {}}
    assert ex.export_json(df, stats, str(tmp_path / "x.json")) == len(data)
    body = {"termbase": "n", "domain": "d", "total": len(data), "stats": {"confirmed": 1, "by_domain": {"": 2}, "by_status": {}}, "terms": ordered(data)}
    assert (tmp_path / "x.json").read_bytes() == json.dumps(body, ensure_ascii=False, indent=2).encode()


def test_tbx(case, tmp_path):
    data, df = case
    assert ex.export_tbx(df, "n & m", str(tmp_path / "x.tbx")) == len(data)
    root = ET.Element("martif", {"type": "TBX", "xml:lang": "en", "xmlns": "urn:iso:std:iso:30042:ed-1"})
    head = ET.SubElement(root, "martifHeader")
    desc = ET.SubElement(head, "fileDesc")
    ET.SubElement(desc, "title").text = "n & m"
    ET.SubElement(desc, "source").text = "lexforge"
    ET.SubElement(ET.SubElement(head, "encodingDesc"), "encoding").text = "UTF-8"
    body = ET.SubElement(ET.SubElement(root, "text"), "body")
    for r in ordered(data):
        if r["word"]:
            entry = ET.SubElement(body, "termEntry", {"id": f"t{r['id']}"})
            tig = ET.SubElement(ET.SubElement(entry, "langSet", {"xml:lang": r["lang"] or "en"}), "tig")
            ET.SubElement(tig, "term").text = r["word"]
            for kind, c in (("partOfSpeech", "type"), ("subjectField", "domain"), ("status", "status")):
                if r[c]:
                    ET.SubElement(tig, "termNote", {"type": kind}).text = r[c]
            if r["translation"]:
                tig = ET.SubElement(ET.SubElement(entry, "langSet", {"xml:lang": "zh" if r["lang"] in ("en", "auto") else "en"}), "tig")
                ET.SubElement(tig, "term").text = r["translation"]
    ET.indent(root)
    want = io.BytesIO()
    ET.ElementTree(root).write(want, encoding="UTF-8", xml_declaration=True)
    assert (tmp_path / "x.tbx").read_bytes() == want.getvalue()
