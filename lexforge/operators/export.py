"""Single-file exports of a termbase: CSV with byte order mark, XLSX, TBX and JSON.

The rows of CSV, TBX and JSON become text in Spark, a range of the order to a task, and are written as parts; the file
is then put together from these by the file system, with its head and tail, so no row passes through Python and the
driver's memory stays the same whatever the size. Paths without a scheme are local files. A workbook holds at most a
million rows by its format; its rows come through toLocalIterator(), a partition at a time.
"""

from __future__ import annotations

import json
import os
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.operators.termbase import export_rows, with_status
from lexforge.schemas import EXPORTED
from lexforge.sources.files import Files
from lexforge.sources.shared import drop, scratch

_BOM = b"\xef\xbb\xbf"
_SHEET_HEAD = ["Word", "Translation", "Type", "Domain", "Status", "Language", "Notes"]
_SHEET_WIDTHS = [30, 30, 15, 15, 12, 10, 30]
_ROW = ["id", "word", "translation", "type", "domain", "status", "lang", "notes"]


def _rows(terms: DataFrame, status: str | None) -> Iterator[dict]:
    for r in export_rows(terms, status).toLocalIterator():
        yield r.asDict()


def _local(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


def write_lines(lines: DataFrame, order: list[str], path: str, head: bytes, tail: bytes = b"", sep: str = "\n", last: bool = True) -> None:
    """One file of head, the lines (column line) in order, each with sep after it (the last one only if last), and tail."""
    spark = lines.sparkSession
    parts = scratch(spark, "export")
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.option("lineSep", sep).text(parts)
    files = Files(spark)
    names = [f"{parts}/{n}" for n in files.names(parts) if n.startswith("part-")]
    files.join(names, _local(path), head, tail, 0 if last else len(sep.encode()))
    drop(spark, parts)


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda v, p: F.replace(v, F.lit(p[0]), F.lit(p[1])), pairs, c)


def csv_lines(terms: DataFrame, status: str | None = None) -> DataFrame:
    """id and line: the seven exported columns, quoted where they hold a comma, a quote or a line break."""

    def cell(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return with_status(terms, status).select("id", F.concat_ws(",", *[cell(c) for c in EXPORTED]).alias("line"))


def export_csv(terms: DataFrame, path: str, status: str | None = None, bom: bool = True) -> int:
    """The seven exported columns by id. The number of rows."""
    head = (_BOM if bom else b"") + (",".join(EXPORTED) + "\r\n").encode()
    write_lines(csv_lines(terms, status), ["id"], path, head, sep="\r\n")
    return with_status(terms, status).count()


#: Characters that JSON text can't hold as they are.
_JSON = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]
_JSON += [(chr(k), f"\\u{k:04x}") for k in range(32) if chr(k) not in "\n\r\t\b\f"]


def json_lines(terms: DataFrame, status: str | None = None) -> DataFrame:
    """id, word and line: a term as an indented object, without a comma after it."""

    def field(c: str) -> Column:
        v = F.col(c).cast("string")
        if c != "id":
            v = F.concat(F.lit('"'), F.when(v.rlike(r'[\x00-\x1f"\\]'), _replaced(v, _JSON)).otherwise(v), F.lit('"'))
        return F.concat(F.lit(f'      "{c}": '), F.coalesce(v, F.lit("null")))

    text = F.concat(F.lit("    {\n"), F.concat_ws(",\n", *[field(c) for c in _ROW]), F.lit("\n    }"))
    return with_status(terms, status).select("id", "word", text.alias("line"))


def export_json(terms: DataFrame, stats: dict, path: str, status: str | None = None) -> int:
    """Name, domain, statistics of the whole base and the (filtered) terms, by word."""
    n = with_status(terms, status).count()
    body = {"termbase": stats["name"], "domain": stats["domain"], "total": n, "stats": {k: stats[k] for k in ("confirmed", "by_domain", "by_status")}, "terms": []}
    whole = json.dumps(body, ensure_ascii=False, indent=2)
    head, tail = (whole[: -len("]\n}")] + "\n", "\n  ]\n}") if n else (whole, "")
    write_lines(json_lines(terms, status), ["word", "id"], path, head.encode(), tail.encode(), ",\n", last=False)
    return n


_ENTRY = "@entries@"


def _tbx_frame(name: str, some: bool) -> tuple[bytes, bytes]:
    """What stands before and after the entries of an ISO 30042 file."""
    root = ET.Element("martif", {"type": "TBX", "xml:lang": "en", "xmlns": "urn:iso:std:iso:30042:ed-1"})
    desc = ET.SubElement(ET.SubElement(root, "martifHeader"), "fileDesc")
    for tag, text in (("title", name or "TermBase"), ("source", "lexforge")):
        ET.SubElement(desc, tag).text = text
    ET.SubElement(ET.SubElement(root[0], "encodingDesc"), "encoding").text = "UTF-8"
    body = ET.SubElement(ET.SubElement(root, "text"), "body")
    if some:
        ET.SubElement(body, _ENTRY)
    ET.indent(root)
    whole = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
    if not some:
        return whole, b""
    head, _, tail = whole.rpartition(f"      <{_ENTRY} />\n".encode())
    return head, tail


def tbx_lines(terms: DataFrame, status: str | None = None) -> DataFrame:
    """id, word and line: an entry for each term that has a word."""
    text = lambda c: _replaced(F.col(c), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])
    attribute = lambda v: _replaced(v, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;")])
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""

    def group(lang: Column, term: str, notes: Column) -> Column:
        return F.concat(F.lit('\n        <langSet xml:lang="'), lang, F.lit('">\n          <tig>\n            <term>'), text(term), F.lit("</term>"), notes, F.lit("\n          </tig>\n        </langSet>"))

    def note(kind: str, c: str) -> Column:
        return F.when(filled(c), F.concat(F.lit(f'\n            <termNote type="{kind}">'), text(c), F.lit("</termNote>"))).otherwise("")

    notes = F.concat(note("partOfSpeech", "type"), note("subjectField", "domain"), note("status", "status"))
    source = F.when(filled("lang"), attribute(F.col("lang"))).otherwise("en")
    target = F.when(F.coalesce(F.col("lang"), F.lit("")).isin("en", "auto"), "zh").otherwise("en")
    entry = F.concat(
        F.lit('      <termEntry id="t'), F.col("id").cast("string"), F.lit('">'), group(source, "word", notes),
        F.when(filled("translation"), group(target, "translation", F.lit(""))).otherwise(""), F.lit("\n      </termEntry>"),
    )
    return with_status(terms, status).filter(filled("word")).select("id", "word", entry.alias("line"))


def export_tbx(terms: DataFrame, name: str, path: str, status: str | None = None) -> int:
    """ISO 30042 entries by word. The number of rows; those without a word count but make no entry."""
    lines = tbx_lines(terms, status)
    head, tail = _tbx_frame(name, bool(lines.limit(1).count()))
    write_lines(lines, ["word", "id"], path, head, tail)
    return with_status(terms, status).count()


def export_xlsx(terms: DataFrame, path: str, status: str | None = None) -> int:
    """A formatted workbook, written as Office Open XML parts: bold white head on blue, borders, widths, a frozen
    head row and a filter over all rows."""
    keys = ["word", "translation", "type", "domain", "status", "lang", "notes"]
    rows = [[r[k] or "" for k in keys] for r in _rows(terms, status)]

    def line(i: int, values: list[str], style: int) -> str:
        cells = "".join(f'<c r="{chr(65 + c)}{i}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(_plain(v))}</t></is></c>' for c, v in enumerate(values))
        return f'<row r="{i}">{cells}</row>'

    data = "".join([line(1, _SHEET_HEAD, 1), *(line(i, r, 2) for i, r in enumerate(rows, 2))])
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(_SHEET_WIDTHS, 1))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    edges = "".join(f'<{e} style="thin"><color auto="1"/></{e}>' for e in ("left", "right", "top", "bottom"))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="TermBase" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="2"><font><sz val="11"/></font><font><b/><sz val="11"/><color rgb="FFFFFFFF"/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF4472C4"/></patternFill></fill></fills><borders count="2"><border/><border>{edges}</border></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" fillId="2" borderId="1" applyAlignment="1"><alignment horizontal="center" vertical="center"/></xf><xf borderId="1" applyAlignment="1"><alignment vertical="center"/></xf></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{cols}</cols><sheetData>{data}</sheetData><autoFilter ref="A1:G{len(rows) + 1}"/></worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + body)
    return len(rows)


def _plain(v: str) -> str:
    """Without the control characters that XML can't hold."""
    return "".join(c for c in v if c >= " " or c in "\t\n\r")


def export(base, fmt: str, path: str, status: str | None = None) -> int:
    """Export a Termbase by format name; ValueError for an unknown one."""
    if fmt == "csv":
        return export_csv(base.terms, path, status)
    if fmt == "xlsx":
        return export_xlsx(base.terms, path, status)
    if fmt == "tbx":
        return export_tbx(base.terms, base.name, path, status)
    if fmt == "json":
        return export_json(base.terms, base.stats(), path, status)
    raise ValueError(f"Unknown format: {fmt}")
