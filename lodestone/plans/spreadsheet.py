"""Findings as a spreadsheet: an Office Open XML workbook written without further libraries."""

from __future__ import annotations

import os
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import SEVERITIES
from lodestone.operators.findings import numbered, summary
from lodestone.operators.impact import with_impact
from lodestone.plans import documents

# Columns with their widths, and a fill for each severity.
COLUMNS = (("Finding ID", 15), ("Title", 35), ("OWASP Category", 18), ("Severity", 12), ("CWE", 12), ("Location", 60), ("Description", 50), ("Impact", 55), ("Mitigation", 55))
FILLS = {"critical": "DC3545", "high": "FD7E14", "medium": "FFC107", "low": "28A745", "info": "17A2B8"}
NO_REMEDY = "Refer to the CWE/OWASP reference for recommended remediation steps."
#: Rows that a sheet can hold, its header included.
MOST_ROWS = 1_048_576
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def rows(findings: DataFrame) -> DataFrame:
    """The nine columns, most severe first, and before them a row's number in the report."""
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    place = F.concat_ws(":", "file_path", F.col("line_number").cast("string"))
    return numbered(with_impact(findings)).orderBy("finding_no").select(
        "finding_no", "rule_id", some("rule_name").alias("title"), some("owasp").alias("owasp"), F.upper("severity").alias("severity"), some("cwe").alias("cwe"), place.alias("location"),
        some("description").alias("description"), some("impact").alias("impact"), F.coalesce("remediation", F.lit(NO_REMEDY)).alias("mitigation"),
    )


def _cell(at: str, value, style: int = 0) -> str:
    if isinstance(value, int):
        return f'<c r="{at}" s="{style}"><v>{value}</v></c>'
    return f'<c r="{at}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(_NOT_XML.sub("", str(value))[:32_767])}</t></is></c>'


def _row(number: int, cells: Iterable[tuple]) -> str:
    return f'<row r="{number}">' + "".join(_cell(f"{chr(65 + k)}{number}", *c) for k, c in enumerate(cells)) + "</row>"


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _styles() -> str:
    """0 plain, 1 header, 2 bold, 3 and on a fill for each severity."""
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in ("0F3460", *FILLS.values()))
    formats = '<xf fontId="0" fillId="0"/><xf fontId="2" fillId="2" applyFill="1" applyFont="1"/><xf fontId="1" fillId="0" applyFont="1"/>' + "".join(f'<xf fontId="1" fillId="{3 + k}" applyFill="1" applyFont="1"/>' for k in range(len(FILLS)))
    return (
        f'{_HEAD}<styleSheet {_MAIN}><fonts count="3"><font/><font><b/></font><font><b/><color rgb="FFFFFFFF"/></font></fonts>'
        f'<fills count="{3 + len(FILLS)}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills>'
        f'<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{3 + len(FILLS)}">{formats}</cellXfs></styleSheet>'
    )


def _sheet_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each finding as the text of its row; runs in tasks."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        texts = [_row(number + 1, [(v, 3 + list(FILLS).index(v.lower()) if k == 3 and v.lower() in FILLS else 0) for k, v in enumerate(r)]) for number, *r in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_pydict({"value": pa.array(texts, pa.string())})


def _write_sheet(findings: DataFrame, total: int, path: str) -> None:
    """The sheet of all findings, its rows written by executors."""
    if total >= MOST_ROWS:
        raise ValueError(f"a sheet holds {MOST_ROWS - 1} findings; write a CSV folder instead")
    columns = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, (_, w) in enumerate(COLUMNS, 1))
    head = f'{_HEAD}<worksheet {_MAIN}><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols>{columns}</cols><sheetData>'
    foot = f'</sheetData><autoFilter ref="A1:{chr(64 + len(COLUMNS))}{total + 1}"/></worksheet>'
    documents.write(rows(findings).mapInArrow(_sheet_rows, "value string"), path, head + _row(1, [(name, 1) for name, _ in COLUMNS]), "", foot)


def write(findings: DataFrame, path: str, files_scanned: int = 0) -> None:
    """Write a workbook of a summary and all findings; the driver compresses the sheet that executors have written."""
    counts = {r.severity: r.n for r in summary(findings).collect()}
    head = [(1, [("Report Summary", 2)]), (3, [("Total Findings", 2), (sum(counts.values()),)]), (4, [("Files Scanned", 2), (files_scanned,)]), (6, [("Severity", 1), ("Count", 1)])]
    head += [(7 + k, [(s.upper(), 3 + k), (counts.get(s, 0),)]) for k, s in enumerate(SEVERITIES)]
    totals = f'{_HEAD}<worksheet {_MAIN}><cols><col min="1" max="1" width="20" customWidth="1"/><col min="2" max="2" width="15" customWidth="1"/></cols><sheetData>' + "".join(_row(*r) for r in head) + "</sheetData></worksheet>"
    book = f'{_HEAD}<workbook {_MAIN} xmlns:r="{_REL}"><sheets><sheet name="Summary" sheetId="1" r:id="rId1"/><sheet name="Security Findings" sheetId="2" r:id="rId2"/></sheets></workbook>'
    links = f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{_REL}/{t}" Target="{p}"/>' for k, (t, p) in enumerate((("worksheet", "worksheets/sheet1.xml"), ("worksheet", "worksheets/sheet2.xml"), ("styles", "styles.xml")), 1)) + "</Relationships>"
    root = f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    types = f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Override PartName="/xl/{p}" ContentType="{kinds}.{t}+xml"/>' for p, t in (("workbook.xml", "sheet.main"), ("worksheets/sheet1.xml", "worksheet"), ("worksheets/sheet2.xml", "worksheet"), ("styles.xml", "styles"))) + "</Types>"
    sheet = f"{path}.sheet-{uuid.uuid4().hex}"
    _write_sheet(findings, sum(counts.values()), sheet)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name, text in (("[Content_Types].xml", types), ("_rels/.rels", root), ("xl/workbook.xml", book), ("xl/_rels/workbook.xml.rels", links), ("xl/styles.xml", _styles()), ("xl/worksheets/sheet1.xml", totals)):
            out.writestr(name, text)
        out.write(sheet, "xl/worksheets/sheet2.xml")
    os.remove(sheet)
