"""Folders of .xlsx workbooks.

A workbook can only be read as a whole, so Spark hands out one file per record
and each task turns its files into cells.  The output has a fixed schema, one row
per cell; ``workbook_table`` turns it into columns.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

CELL_SCHEMA = "path string, sheet string, row_no int, col_no int, header string, value string, kind string"
SHEET_SCHEMA = "path string, sheet_no int, sheet string"

# The number formats that mean a date or a time, and day zero.
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
DAY_ZERO = datetime(1899, 12, 30)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _children(root, name: str):
    return [e for e in root.iter() if _local(e.tag) == name]


def _xml(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _text(node) -> str:
    return "".join(t.text or "" for t in _children(node, "t"))


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, part name) in workbook order."""
    links = {
        r.get("Id"): r.get("Target").lstrip("/")
        for r in _children(_xml(book, "xl/_rels/workbook.xml.rels"), "Relationship")
    }
    out = []
    for s in _children(_xml(book, "xl/workbook.xml"), "sheet"):
        link = next(v for k, v in s.attrib.items() if _local(k) == "id")
        target = links[link]
        out.append((s.get("name"), target if target.startswith("xl/") else "xl/" + target))
    return out


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group(0):
        n = n * 26 + ord(ch) - 64
    return n


def _cell(node, strings: list[str], date_styles: set[int]) -> tuple[str | None, str]:
    kind = node.get("t", "n")
    if kind == "inlineStr":
        return _text(node), "text"
    raw = next((c.text for c in node if _local(c.tag) == "v"), None)
    if raw is None:
        return None, "empty"
    if kind == "s":
        return strings[int(raw)], "text"
    if kind == "b":
        return ("True" if raw == "1" else "False"), "bool"
    if kind in ("str", "e"):
        return raw, "text"
    if kind == "n" and int(node.get("s", "0")) in date_styles:
        at = DAY_ZERO + timedelta(days=float(raw))
        return at.strftime("%Y/%m/%d %H:%M:%S"), "date"
    if re.fullmatch(r"-?\d+\.0+", raw):
        raw = raw.split(".")[0]
    return raw, "number"


def _rows(book: zipfile.ZipFile, part: str) -> Iterator[tuple[int, list[tuple[int, str | None, str]]]]:
    shared = _xml(book, "xl/sharedStrings.xml")
    strings = [_text(s) for s in _children(shared, "si")] if shared is not None else []
    styles = _xml(book, "xl/styles.xml")
    formats = next((e for e in styles if _local(e.tag) == "cellXfs"), []) if styles is not None else []
    dates = {i for i, x in enumerate(formats) if int(x.get("numFmtId", "0")) in DATE_FORMATS}
    expected = 1
    with book.open(part) as stream:
        for _, node in ElementTree.iterparse(stream):
            if _local(node.tag) != "row":
                continue
            number = int(node.get("r", expected))
            for gap in range(expected, number):
                yield gap, []
            cells = []
            for i, c in enumerate([c for c in node if _local(c.tag) == "c"], 1):
                ref = c.get("r")
                cells.append((_column(ref) if ref else i, *_cell(c, strings, dates)))
            yield number, cells
            expected = number + 1
            node.clear()


def workbook_cells(content: bytes, sheet: str, header: bool) -> Iterator[tuple]:
    """(sheet, row number, column number, header, value, kind) of one sheet; the
    first sheet if the named one does not exist."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        parts = _sheets(book)
        if not parts:
            return
        name, part = next(((n, p) for n, p in parts if n == sheet), parts[0])
        titles: dict[int, str] | None = None if header else {}
        line = 0
        for _, cells in _rows(book, part):
            if titles is None:
                titles = {c: v or "" for c, v, _ in cells}
                continue
            line += 1
            # An empty row still counts as one.
            for col, value, kind in cells or [(1, None, "empty")]:
                yield name, line, col, titles.get(col, "") if header else f"Column{col}", value, kind


def parse_workbooks(files: DataFrame, sheet: str = "", header: bool = True, batch: int = 50_000) -> DataFrame:
    """Cells of every workbook of a frame with ``path`` and ``content``."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CELL_SCHEMA.split(", ")]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                held = []
                for cell in workbook_cells(bytes(content), sheet, header):
                    held.append((path, *cell))
                    if len(held) >= batch:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names)

    return files.select("path", "content").mapInPandas(read, CELL_SCHEMA)


def list_sheets(files: DataFrame) -> DataFrame:
    """The sheet names of every workbook."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as book:
                    out += [(path, i, name) for i, (name, _) in enumerate(_sheets(book), 1)]
            yield pd.DataFrame(out, columns=["path", "sheet_no", "sheet"])

    return files.select("path", "content").mapInPandas(read, SHEET_SCHEMA)


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path)


def read_workbooks(spark: SparkSession, path: str, sheet: str = "", header: bool = True) -> DataFrame:
    return parse_workbooks(workbook_files(spark, path), sheet, header)


def workbook_headers(files: DataFrame, sheet: str = "", header: bool = True) -> list[str]:
    """Column names of one workbook, in order; only that file is parsed."""
    cells = parse_workbooks(files.limit(1), sheet, header)
    titles = cells.groupBy("header").agg(F.min("col_no").alias("first")).orderBy("first")
    return [r["header"] for r in titles.collect()]


def workbook_table(cells: DataFrame, columns: Sequence[str], max_rows: int = 0) -> DataFrame:
    """One row per sheet row, with the named headers as text columns.  A header
    that occurs twice means its last column."""
    here = [F.col("header") == c for c in columns]
    picks = [F.max_by(F.when(h, F.col("value")), F.when(h, F.col("col_no"))).alias(c) for h, c in zip(here, columns)]
    rows = cells.where(F.col("row_no") <= max_rows) if max_rows > 0 else cells
    return rows.groupBy("path", "row_no").agg(*picks)
