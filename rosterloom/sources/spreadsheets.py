"""Workbooks.

A workbook is a ZIP of XML parts; the helpers read and write the few parts a
roster needs.  They run inside tasks, one attachment at a time.
"""

from __future__ import annotations

import functools
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_UNPRINTABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
_SPECIAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f&<>]")

# Cell texts that mean no value (fixed values).
MISSING = frozenset(
    ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
     "NULL", "NaN", "None", "n/a", "nan", "null"]
)
ROW_SCHEMA = "row_idx int, data map<string,string>, sheet string, read_error string"


# --- writing ---------------------------------------------------------------------
@functools.lru_cache(maxsize=1024)
def _letters(index: int) -> str:
    name = ""
    while index >= 0:
        name = chr(65 + index % 26) + name
        index = index // 26 - 1
    return name


def _cell_text(value) -> str:
    text = str(value)
    return escape(_UNPRINTABLE.sub("", text)) if _SPECIAL.search(text) else text


def _sheet_xml(rows: list[list[str]]) -> str:
    lines = []
    for r, row in enumerate(rows, start=1):
        cells = "".join(
            [
                f'<c r="{_letters(c)}{r}" s="1" t="inlineStr"><is><t xml:space="preserve">{_cell_text(value)}</t></is></c>'
                for c, value in enumerate(row)
            ]
        )
        lines.append(f'<row r="{r}">{cells}</row>')
    return f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{"".join(lines)}</sheetData></worksheet>'


def write_workbook(sheets: dict[str, list[list[str]]]) -> bytes:
    """Workbook of text cells.  Equal input gives equal bytes."""
    names = list(sheets)
    numbered = list(enumerate(names, start=1))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types">'
        f'<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{_SHEET_TYPE}.sheet.main+xml"/>'
        f'<Override PartName="/xl/styles.xml" ContentType="{_SHEET_TYPE}.styles+xml"/>'
        + "".join(
            f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_SHEET_TYPE}.worksheet+xml"/>' for i, _ in numbered
        )
        + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_OFFICE}"><sheets>'
        + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in numbered)
        + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">'
        + "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in numbered)
        + f'<Relationship Id="rId{len(names) + 1}" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN[1:-1]}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills>'
        f'<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        f'<cellXfs count="2"><xf/><xf numFmtId="49" applyNumberFormat="1"/></cellXfs></styleSheet>',
    }
    for i, name in numbered:
        parts[f"xl/worksheets/sheet{i}.xml"] = _sheet_xml(sheets[name])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for path, text in parts.items():
            stamp = zipfile.ZipInfo(path, date_time=(1980, 1, 1, 0, 0, 0))
            stamp.compress_type = zipfile.ZIP_DEFLATED
            archive.writestr(stamp, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


# --- reading ---------------------------------------------------------------------
def _text_of(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format is a date."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode") or "")
        for f in root.iter(f"{_MAIN}numFmt")
    }
    dated = {i for i, code in custom.items() if re.search("[ymdh]", code, re.I)} | {14, 15, 16, 17, 18, 19, 20, 21, 22}
    formats = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId") or 0) in dated}


def _column(reference: str) -> int:
    index = 0
    for letter in re.match("[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _cell(cell, shared: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return _text_of(cell) or None
    node = cell.find(f"{_MAIN}v")
    if node is None or node.text is None:
        return None
    if kind == "s":
        return shared[int(node.text)] or None
    if kind == "b":
        return "True" if node.text == "1" else "False"
    if kind in ("str", "e"):
        return node.text if kind == "str" else None
    number = float(node.text)
    if int(cell.get("s") or 0) in dates:
        return str(datetime(1899, 12, 30) + timedelta(seconds=round(number * 86400)))
    return str(int(number)) if number.is_integer() else node.text


def read_workbook(content: bytes) -> Iterator[tuple[str, list[list[str | None]]]]:
    """Sheets in workbook order as lists of cell texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            root = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
            shared = [_text_of(item) for item in root.iter(f"{_MAIN}si")]
        dates = _date_styles(archive)
        targets = {
            r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
        }
        for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(f"{_REL}id")]
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            rows = []
            for row in ElementTree.fromstring(archive.read(path)).iter(f"{_MAIN}row"):
                cells = {
                    _column(c.get("r")) if c.get("r") else i: _cell(c, shared, dates)
                    for i, c in enumerate(row.iter(f"{_MAIN}c"))
                }
                at = int(row.get("r") or len(rows) + 1)
                rows.extend([] for _ in range(at - 1 - len(rows)))
                rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
            yield sheet.get("name"), rows


def _named(header: list[str | None], width: int) -> list[str]:
    """Column names: blanks are numbered, repeats get a suffix."""
    seen: dict[str, int] = {}
    names = []
    for i in range(width):
        name = (header[i] if i < len(header) else None) or f"Unnamed: {i}"
        count = seen.get(name, 0)
        seen[name] = count + 1
        names.append(f"{name}.{count}" if count else name)
    return names


def workbook_rows(
    content: bytes, errors: list[str] | None = None, min_data_rows: int = 1
) -> Iterator[tuple[int, dict[str, str], str]]:
    """Data rows of the first sheet with at least ``min_data_rows`` below its
    header.  What cannot be read is told in ``errors``."""
    try:
        for sheet, rows in read_workbook(content):
            if len(rows) > min_data_rows:
                names = _named(rows[0], max(map(len, rows)))
                for index, row in enumerate(rows[1:]):
                    data = {names[i]: v for i, v in enumerate(row) if v is not None}
                    if data:
                        yield index, data, sheet
                return
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError) as problem:
        if errors is not None:
            errors.append(f"Unreadable workbook: {problem}")


def _batched(rows, keys, size: int = 5_000):
    """Output frames of bounded size, whatever one attachment holds."""
    buffer = []
    for key, row in rows:
        buffer.append((*key, *row))
        if len(buffer) == size:
            yield pd.DataFrame(buffer, columns=[*keys, "row_idx", "data", "sheet", "read_error"])
            buffer = []
    if buffer:
        yield pd.DataFrame(buffer, columns=[*keys, "row_idx", "data", "sheet", "read_error"])


def _read_attachments(df: DataFrame, content: str, reader, method: str) -> DataFrame:
    keys = [c for c in df.columns if c != content]
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + ROW_SCHEMA

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for batch in batches:
                for record in batch.itertuples(index=False):
                    values = record._asdict() if not keys else dict(zip(batch.columns, record))
                    own, errors = tuple(values[k] for k in keys), []
                    for row in reader(values[content], errors):
                        yield own, (*row, None)
                    for error in errors:
                        yield own, (-1, None, None, error)

        return _batched(rows(), keys)

    out = df.select(*keys, content).mapInPandas(read, schema)
    return out.withColumns({"confidence": F.lit(0.95), "extraction_method": F.lit(method)})


def read_xlsx_attachments(df: DataFrame, content: str = "content") -> DataFrame:
    """Rows of workbooks, one file per call of the reader, spread over tasks."""
    return _read_attachments(df, content, workbook_rows, "xlsx")
