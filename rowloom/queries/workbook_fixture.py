"""Small workbooks made from table rows, as input for the workbook reader."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006/relationships"


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def sheet_xml(rows: Sequence[Sequence[object]], dates: Sequence[int] = ()) -> str:
    lines = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, value in enumerate(row, 1):
            ref = f"{_letters(c)}{r}"
            if value is None:
                continue
            if isinstance(value, bool):
                cells.append(f'<c r="{ref}" t="b"><v>{int(value)}</v></c>')
            elif isinstance(value, (int, float)):
                style = ' s="1"' if c in dates else ""
                cells.append(f'<c r="{ref}"{style}><v>{value!r}</v></c>')
            else:
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(value))}</t></is></c>')
        if cells:
            lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    return f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>'


def workbook_bytes(sheets: dict[str, str]) -> bytes:
    """A workbook of the given sheet documents; style 1 is a date."""
    names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    links = "".join(
        f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>'
        for i in range(1, len(sheets) + 1)
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PKG}">{links}</Relationships>')
        book.writestr(
            "xl/styles.xml",
            f'<styleSheet xmlns="{_MAIN}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        )
        for i, document in enumerate(sheets.values(), 1):
            book.writestr(f"xl/worksheets/sheet{i}.xml", document)
    return out.getvalue()


def workbooks(df: DataFrame, name: str, columns: Sequence[str], order_by: str) -> DataFrame:
    """One workbook per value of ``name`` (which must bound the rows of a book)."""
    wanted = list(columns)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order_by)
        body = [wanted, *[[None if pd.isna(v) else v for v in r] for r in rows[wanted].astype(object).values.tolist()]]
        content = workbook_bytes({"Info": sheet_xml([["rows"], [len(rows)]]), "Data": sheet_xml(body)})
        return pd.DataFrame({"path": [rows[name].iloc[0]], "content": [content]})

    chosen = df.select(*[F.col(c) for c in dict.fromkeys([name, *wanted, order_by])])
    return chosen.groupBy(name).applyInPandas(pack, "path string, content binary")
