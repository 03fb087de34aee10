"""Spreadsheet workbooks: first sheet, first row as header, one workbook per task row."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import clean_headers, strip

# Fixed values of the workbook format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"

# Built-in number formats that show a date or a time of day, and the day from
# which serial numbers count, by the workbook's date system.
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), 45, 47, *range(50, 59)])
_DAY_ZERO = {False: datetime(1899, 12, 30), True: datetime(1904, 1, 1)}

_ROWS_PER_BATCH = 5_000
_ROW_SCHEMA = "path string, row_no bigint, names array<string>, texts array<string>"


def read_workbooks(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(path, content)`` per workbook file."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def scan_spreadsheets(workbooks: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of the first sheet of every workbook in ``(path, content)``.

    Headers are cleaned per workbook, text is stripped and rows without any value are
    left out. Columns right of the last header are named by their place. Cells are text, as
    ``cells map<string,string>`` or as the named columns. A number shown as a date or time
    is ``yyyy-MM-dd HH:mm:ss``, or ``HH:mm:ss`` below one day; durations stay numbers.
    Workbooks are read in parallel, each streamed row by row; a sheet cannot exceed the
    format's 1,048,576 rows.
    """
    rows = workbooks.select("path", "content").mapInPandas(_sheet_rows, _ROW_SCHEMA)
    cells = F.map_from_arrays("names", F.transform("texts", strip))
    rows = rows.select("path", "row_no", cells.alias("cells"))
    if columns is None:
        return rows
    return rows.select(
        "path", "row_no", *[F.try_element_at("cells", F.lit(name)).alias(name) for name in columns]
    )


def _sheet_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            rows = _first_sheet(content)
            header = next(rows, None)
            if header is None:
                continue
            width, names = -1, []
            batch: list[tuple] = []
            for number, row in enumerate(rows):
                if max(row, default=-1) >= width:
                    width = max([*header, *row, -1]) + 1
                    names = clean_headers([header.get(i) or f"Unnamed: {i}" for i in range(width)])
                texts = [row.get(i) for i in range(width)]
                if any(t is not None for t in texts):
                    batch.append((path, number, names, texts))
                if len(batch) == _ROWS_PER_BATCH:
                    yield pd.DataFrame(batch, columns=["path", "row_no", "names", "texts"])
                    batch = []
            if batch:
                yield pd.DataFrame(batch, columns=["path", "row_no", "names", "texts"])


def _first_sheet(content: bytes) -> Iterator[dict[int, str]]:
    """Rows of the first sheet as ``column index -> text``."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
        sheet = workbook.find(f"{_MAIN}sheets/{_MAIN}sheet")
        about = workbook.find(f"{_MAIN}workbookPr")
        from_1904 = about is not None and about.get("date1904") in ("1", "true")
        links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(_REL)
        target = next(link.get("Target") for link in links if link.get("Id") == sheet.get(_REL_ID))
        shared, dates = _shared_strings(book), _date_styles(book)
        name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        with book.open(name) as stream:
            for _, element in ElementTree.iterparse(stream):
                if element.tag == f"{_MAIN}row":
                    yield dict(_cells(element, shared, dates, from_1904))
                    element.clear()


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root.iter(f"{_MAIN}si")]


def _date_styles(book: zipfile.ZipFile) -> set[str]:
    """The cell styles whose number format shows a date or a time of day."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {f.get("numFmtId"): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}

    def shows_date(number: str) -> bool:
        if number not in own:
            return int(number) in _DATE_FORMATS
        # quoted text, escaped letters, colours and conditions are no part of the pattern
        bare = re.sub(r'"[^"]*"|\\.|_.|\*.', "", own[number])
        if re.search(r"\[(h+|m+|s+)\]", bare, re.I):
            return False
        return re.search(r"[dmyhs]", re.sub(r"\[[^\]]*\]|general", "", bare, flags=re.I), re.I) is not None

    styles = root.find(f"{_MAIN}cellXfs")
    return {str(k) for k, xf in enumerate(styles if styles is not None else ()) if shows_date(xf.get("numFmtId", "0"))}


def _date(serial: str, from_1904: bool) -> str:
    """A serial number of days as text, to the second; what is no date stays as it is."""
    try:
        days = float(serial)
        if 0 <= days < 1:
            return (_DAY_ZERO[False] + timedelta(seconds=round(days * 86_400))).strftime("%H:%M:%S")
        # the format counts a 29 February 1900 that never was
        early = 1 if not from_1904 and 0 < days < 60 else 0
        return str(_DAY_ZERO[from_1904] + timedelta(days=early, seconds=round(days * 86_400)))
    except (ValueError, OverflowError):
        return serial


def _cells(row: ElementTree.Element, shared: list[str], dates: set[str], from_1904: bool) -> Iterator[tuple[int, str]]:
    for position, cell in enumerate(row.iter(f"{_MAIN}c")):
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
        else:
            text = cell.findtext(f"{_MAIN}v")
            if text is not None and kind == "s":
                text = shared[int(text)]
            elif text is not None and kind == "b":
                text = "true" if text == "1" else "false"
            elif text is not None and kind == "n" and cell.get("s") in dates:
                text = _date(text, from_1904)
        if text is not None and kind != "e":
            yield _column_index(cell.get("r"), position), text


def _column_index(reference: str | None, position: int) -> int:
    """``C7`` -> 2; cells without a reference count by position."""
    if not reference:
        return position
    index = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1
