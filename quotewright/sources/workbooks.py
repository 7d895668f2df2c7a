"""Price books as ``.xlsx`` files, many at a time.

Spark lists and ships the files; each task unpacks the workbooks it was given and
passes their rows on in batches. Packing is the same step backwards.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotewright.schemas import BOOK, CELLS, ROW, SHEET_HEADERS, SHEET_POSITIONS, SHEETS
from quotewright.session import ship_by_value

ship_by_value(__name__)
BATCH_ROWS = 5000

# Namespaces of the workbook format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"


def _text(element) -> str:
    """All text runs of an element, phonetic hints left out."""
    if element is None:
        return ""
    runs = [t.text or "" for t in element.findall(f"{MAIN}t")]
    runs += [t.text or "" for r in element.findall(f"{MAIN}r") for t in r.findall(f"{MAIN}t")]
    return "".join(runs)


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _cell(c, shared: list[str]) -> str | None:
    kind = c.get("t")
    if kind == "inlineStr":
        text = _text(c.find(f"{MAIN}is"))
    else:
        text = c.findtext(f"{MAIN}v") or ""
        if kind == "s" and text:
            text = shared[int(text)]
        elif kind == "b":
            text = "TRUE" if text == "1" else "FALSE"
        elif kind == "e":
            text = ""
    return text.strip() or None


def _rows(archive: zipfile.ZipFile) -> Iterator[tuple[int, int, list[str | None]]]:
    """(sheet, row, cells) of every non-blank row; row 0 of a sheet is its header."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in archive.namelist():
        root = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
        shared = [_text(si) for si in root.findall(f"{MAIN}si")]
    targets = {
        r.get("Id"): r.get("Target")
        for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels")).iter(PACKAGE)
    }
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    for sheet_ix, sheet in enumerate(book.iter(f"{MAIN}sheet")):
        target = targets[sheet.get(RELATION)]
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        row_ix = 0
        with archive.open(part) as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{MAIN}row":
                    continue
                cells: list[str | None] = []
                for c in row.findall(f"{MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    cells.append(_cell(c, shared))
                row.clear()
                if any(cells):
                    yield sheet_ix, row_ix, cells
                    row_ix += 1


def _typed_rows(archive: zipfile.ZipFile) -> Iterator[tuple]:
    """(sheet, row, cells, named cells): the header, row 0, says where the named cells are."""
    places: list[int | None] = []
    for sheet_ix, row_ix, cells in _rows(archive):
        if row_ix == 0:
            headers = SHEET_HEADERS[SHEETS[sheet_ix]].values() if sheet_ix < len(SHEETS) else ()
            places = [cells.index(h) if h in cells else None for h in headers]
        named = [cells[at] if at is not None and at < len(cells) else None for at in places]
        yield sheet_ix, row_ix, cells, named


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A workbook's rows are held back until it is read to its end: all of them or none."""
    columns = CELLS.fieldNames()
    for files in batches:
        for path, content in zip(files["path"], files["content"]):
            held: list[pd.DataFrame] = []
            batch: list[tuple] = []
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for row in _typed_rows(archive):
                        batch.append((path, *row, None))
                        if len(batch) == BATCH_ROWS:
                            held.append(pd.DataFrame(batch, columns=columns))
                            batch = []
            except (zipfile.BadZipFile, zlib.error, EOFError, KeyError, ElementTree.ParseError, IndexError,
                    ValueError) as e:
                held, batch = [], [(path, None, None, None, None, f"{type(e).__name__}: {e}")]
            if batch:
                held.append(pd.DataFrame(batch, columns=columns))
            yield from held


def ingest_workbooks(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """Every cell row of every workbook below ``path``. A file that cannot be read to its end
    gives one row with ``error`` set, and no other. The file's path is its ``book_id``.

    Each use of the result parses the files; :func:`stage_workbooks` parses them once.
    """
    return parse_workbooks(
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True).load(path).select("path", "content"))


def stage_workbooks(cells: DataFrame, path: str) -> DataFrame:
    """``cells`` written to ``path``, by sheet, and read from there: a sheet then reads its rows only."""
    cells.write.partitionBy("sheet_ix").parquet(path)
    return cells.sparkSession.read.schema(CELLS).parquet(path)


def parse_workbooks(files: DataFrame) -> DataFrame:
    """As :func:`ingest_workbooks`, from a table of ``path`` and ``content``."""
    return files.mapInPandas(_parse, CELLS)


def workbook_rejects(cells: DataFrame) -> DataFrame:
    """Files that could not be read to the end."""
    return cells.where(F.col("error").isNotNull()).select(BOOK, "error")


def workbook_sheet(cells: DataFrame, sheet: str) -> DataFrame:
    """One raw sheet of every workbook: some columns by position, some by header."""
    picked = [F.get("cells", F.lit(i)).alias(n) for n, i in SHEET_POSITIONS[sheet].items()]
    found = [F.get("named", F.lit(i)).alias(n) for i, n in enumerate(SHEET_HEADERS[sheet])]
    body = cells.where((F.col("sheet_ix") == SHEETS.index(sheet)) & (F.col(ROW) > 0))
    return body.select(BOOK, ROW, *picked, *found)


def workbook_sheets(cells: DataFrame) -> dict[str, DataFrame]:
    return {sheet: workbook_sheet(cells, sheet) for sheet in SHEETS}


# --- packing -------------------------------------------------------------------------------

# The parts of a minimal workbook and the row limit of its format.
MAX_SHEET_ROWS = 1_048_576
CONTENT_TYPES = (
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument'
    '.spreadsheetml.sheet.main+xml"/>{}</Types>'
)
SHEET_TYPE = (
    '<Override PartName="/xl/worksheets/sheet{}.xml" ContentType="application/vnd'
    '.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
)
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
ROOT_RELATIONS = (
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    f'<Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
)
FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def workbook_bytes(sheets: list[list[list[str | None]]]) -> bytes:
    """One workbook with these sheets of text cells."""
    main, ns = MAIN.strip("{}"), 'xmlns="{}"'
    numbers = range(1, len(sheets) + 1)
    parts = {
        "[Content_Types].xml": CONTENT_TYPES.format("".join(SHEET_TYPE.format(n) for n in numbers)),
        "_rels/.rels": ROOT_RELATIONS,
        "xl/workbook.xml": f'<workbook {ns.format(main)} xmlns:r="{OFFICE}"><sheets>' + "".join(
            f'<sheet name="Sheet{n}" sheetId="{n}" r:id="rId{n}"/>' for n in numbers)
        + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/'
        '2006/relationships">' + "".join(
            f'<Relationship Id="rId{n}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{n}.xml"/>'
            for n in numbers) + "</Relationships>",
    }
    for n, sheet in zip(numbers, sheets):
        rows = "".join(
            f'<row r="{r}">' + "".join(
                f'<c r="{_letters(i)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
                for i, v in enumerate(cells) if v is not None) + "</row>"
            for r, cells in enumerate(sheet, start=1))
        parts[f"xl/worksheets/sheet{n}.xml"] = (
            f"<worksheet {ns.format(main)}><sheetData>{rows}</sheetData></worksheet>")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(name, f'<?xml version="1.0" encoding="UTF-8"?>{text}')
    return buffer.getvalue()


def pack_workbooks(rows: DataFrame, headers: list[list[str]],
                   rows_per_workbook: int = 10_000) -> DataFrame:
    """Cell rows (``book_id``, ``sheet_ix``, ``row_ix`` from 1, ``cells``) -> workbooks as a table
    of ``path`` and ``content``. ``headers`` holds the top row of every sheet. A workbook is built
    whole in one task, so a book is cut into as many as its row range needs."""
    if rows_per_workbook >= MAX_SHEET_ROWS:
        raise ValueError(f"a sheet holds at most {MAX_SHEET_ROWS} rows")

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        sheets: list[list] = [[header] for header in headers]
        part = part.sort_values(["sheet_ix", "row_ix"])
        for sheet_ix, cells in zip(part["sheet_ix"], part["cells"]):
            sheets[sheet_ix].append(list(cells))
        return pd.DataFrame([(key[0], workbook_bytes(sheets))], columns=["path", "content"])

    number = F.floor((F.col(ROW) - 1) / rows_per_workbook).cast("string")
    return rows.select(F.concat_ws("-", BOOK, number).alias("path"), "sheet_ix", ROW, "cells").groupBy(
        "path").applyInPandas(pack, FILES)
