"""Files made by Spark from the test tables, for the queries that read files."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The parts of a workbook around its sheet.
_TYPES = (
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/></Types>'
)
_BOOK = (
    '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{}</sheets></workbook>'
)
_LINKS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_SHEET = (
    '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'
)


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell_xml(value, ref: str) -> str:
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, str):
        return f'<c r="{ref}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'
    return f'<c r="{ref}"><v>{value!r}</v></c>'


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A minimal workbook from rows of plain Python values."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        tags = [f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)]
        z.writestr("xl/workbook.xml", _BOOK.format("".join(tags)))
        links = [f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)]
        z.writestr("xl/_rels/workbook.xml.rels", _LINKS.format("".join(links)))
        for i, rows in enumerate(sheets.values(), 1):
            xml = "".join(
                f'<row r="{r}">' + "".join(_cell_xml(v, f"{_letters(c)}{r}") for c, v in enumerate(row)) + "</row>"
                for r, row in enumerate(rows, 1)
            )
            z.writestr(f"xl/worksheets/sheet{i}.xml", _SHEET.format(xml))
    return out.getvalue()


def workbooks(df: DataFrame, key: str, rows_per_file: int = 1000) -> DataFrame:
    """``(path, content)`` workbooks of at most ``rows_per_file`` consecutive keys each."""
    names = df.columns

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        book = workbook({"notes": [["not this one"]], "data": [names, *pdf[names].astype(object).values.tolist()]})
        return pd.DataFrame({"path": [f"book-{pdf['chunk'].iloc[0]:09d}.xlsx"], "content": [book]})

    chunked = df.withColumn("chunk", F.floor(F.col(key) / rows_per_file))
    return chunked.groupBy("chunk").applyInPandas(build, "path string, content binary")


def archives(df: DataFrame, key: str, text: str, rows_per_file: int = 1000) -> DataFrame:
    """``(path, content)`` zip archives with one entry per row."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for k, t in zip(pdf[key], pdf[text]):
                z.writestr(f"rows/{k}.txt", t)
        return pd.DataFrame({"path": [f"{pdf['chunk'].iloc[0]}.zip"], "content": [out.getvalue()]})

    chunked = df.select(key, text).withColumn("chunk", F.floor(F.col(key) / rows_per_file))
    return chunked.groupBy("chunk").applyInPandas(build, "path string, content binary")


def json_documents(df: DataFrame, key: str, path: str, data_key: str | None, rows_per_file: int = 1000) -> None:
    """One JSON document per file: an array of records, or that array under a key."""
    record = F.to_json(F.struct(*df.columns))
    chunked = df.select(F.floor(F.col(key) / rows_per_file).alias("doc"), record.alias("r"))
    body = F.concat(F.lit("["), F.array_join(F.collect_list("r"), ",\n"), F.lit("]"))
    if data_key is not None:
        body = F.concat(F.lit(f'{{"task_info": "made from a table", "{data_key}": '), body, F.lit("}"))
    chunked.groupBy("doc").agg(body.alias("value")).write.partitionBy("doc").text(path)
