"""Excel workbooks: many files in parallel, each parsed once, then typed by Spark."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelab.session import materialize
from tablelab.sources.folders import SPLIT_FOLDERS, check_split_folders, split_of

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

# Built-in number formats that show dates or times.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}

BATCH_ROWS = 10_000
# cell kinds: integer, number, boolean, date, text; an empty cell is null
_CELL = "array<struct<k:string,v:string>>"


def column_number(letters: str) -> int:
    """``A`` -> 0, ``Z`` -> 25, ``AA`` -> 26."""
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n - 1


def wanted_columns(usecols: str | None) -> set[int] | None:
    """``A,C,E:F`` as 0-based positions, ranges inclusive; None keeps every column."""
    if usecols is None:
        return None
    out: set[int] = set()
    for part in usecols.replace(" ", "").split(","):
        if not re.fullmatch(r"[A-Za-z]+(:[A-Za-z]+)?", part):
            raise ValueError(f"usecols should look like A:E or A,C,E:F, got {usecols}")
        low, _, high = part.partition(":")
        out |= set(range(column_number(low), column_number(high or low) + 1))
    return out


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    for _, e in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
        if e.tag == f"{_MAIN}si":
            out.append("".join(t.text or "" for t in e.iter(f"{_MAIN}t")))
            e.clear()
    return out


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.parse(book.open("xl/styles.xml")).getroot()
    custom = {
        int(f.get("numFmtId"))
        for f in root.iter(f"{_MAIN}numFmt")
        if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")).lower())
    }
    cells = root.find(f"{_MAIN}cellXfs")
    if cells is None:
        return set()
    formats = [int(x.get("numFmtId", 0)) for x in cells]
    return {i for i, f in enumerate(formats) if f in DATE_FORMATS or f in custom}


def _sheet_file(book: zipfile.ZipFile, sheet: int | str) -> str:
    root = ElementTree.parse(book.open("xl/workbook.xml")).getroot()
    sheets = [(s.get("name"), s.get(f"{_REL}id")) for s in root.iter(f"{_MAIN}sheet")]
    if isinstance(sheet, int):
        if not 0 <= sheet < len(sheets):
            raise ValueError(f"no sheet {sheet}, the workbook has {len(sheets)}")
        rid = sheets[sheet][1]
    else:
        ids = [r for n, r in sheets if n == sheet]
        if not ids:
            raise ValueError(f"no sheet named {sheet}")
        rid = ids[0]
    links = ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()
    target = next(x.get("Target") for x in links if x.get("Id") == rid)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _cell(e, strings: list[str], dates: set[int]):
    kind, v = e.get("t", "n"), e.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return ("s", "".join(t.text or "" for t in e.iter(f"{_MAIN}t")))
    if v is None or v.text is None or kind == "e":
        return None
    if kind == "s":
        return ("s", strings[int(v.text)])
    if kind == "str":
        return ("s", v.text)
    if kind == "b":
        return ("b", "true" if v.text == "1" else "false")
    number = float(v.text)
    if int(e.get("s", 0)) in dates:
        return ("d", (datetime(1899, 12, 30) + timedelta(days=number)).isoformat(sep=" "))
    return ("i", str(int(number))) if number.is_integer() and "." not in v.text else ("n", repr(number))


def _rows(content: bytes, sheet: int | str, keep: set[int] | None) -> Iterator[tuple[int, list]]:
    """``(row number, cells)`` of a sheet, streamed. Blank rows in front of a filled one are rows too."""
    book = zipfile.ZipFile(io.BytesIO(content))
    strings, dates = _strings(book), _date_styles(book)
    at = done = -1
    for _, e in ElementTree.iterparse(book.open(_sheet_file(book, sheet))):
        if e.tag != f"{_MAIN}row":
            continue
        at = int(e.get("r", at + 2)) - 1
        cells: dict[int, tuple | None] = {}
        for place, c in enumerate(e.iter(f"{_MAIN}c")):
            ref = c.get("r")
            column = column_number(re.match("[A-Za-z]+", ref)[0]) if ref else place
            cells[column] = _cell(c, strings, dates)
        width = max((i for i, c in cells.items() if c is not None), default=-1) + 1
        if width:
            for blank in range(done + 1, at):
                yield blank, []
            yield at, [cells.get(i) for i in range(width) if keep is None or i in keep]
            done = at
        e.clear()


def excel_rows(
    files: DataFrame, sheet: int | str = 0, header: int | None = 0, usecols: str | None = None,
    keep_source: bool = False,
) -> DataFrame:
    """Rows of workbooks given as ``(path, content)``, in one frame with common columns.

    Workbooks must agree in their column names. There are as many columns as the widest row has. Whole numbers become long, other numbers double,
    booleans boolean, dates timestamp and everything else text; mixed columns become text.
    """
    keep = wanted_columns(usecols)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                out = []
                try:
                    for r, cells in _rows(bytes(content), sheet, keep):
                        if header is not None and r < header:
                            continue
                        out.append((path, -1 if r == header else r, cells))
                        if len(out) == BATCH_ROWS:
                            yield pd.DataFrame(out, columns=["path", "r", "cells"])
                            out = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
                    raise ValueError(f"{path} is not an Excel workbook: {e}") from e
                yield pd.DataFrame(out, columns=["path", "r", "cells"])

    cells = materialize(
        files.select("path", "content").mapInPandas(parse, f"path string, r long, cells {_CELL}"), "excel"
    )
    body = cells.filter("r >= 0")
    kinds = (
        body.select(F.posexplode("cells").alias("i", "c")).groupBy("i")
        .agg(F.collect_set("c.k").alias("k")).collect()  # one row per column
    )
    width = max((r["i"] for r in kinds if r["k"]), default=-1) + 1
    if header is None:
        names = [str(i) for i in range(width)]
    else:
        heads = cells.filter("r = -1").select(F.transform("cells", lambda c: c["v"]).alias("h"))
        found = heads.distinct().limit(2).collect()
        if len(found) != 1:
            raise ValueError("workbooks without a header" if not found else "workbooks differ in their columns")
        names = _column_names(found[0]["h"], width)
    if not names:
        raise ValueError("workbooks hold no columns")
    types = {r["i"]: _column_type(set(r["k"])) for r in kinds}
    columns = []
    for i, name in enumerate(names):
        value = F.get("cells", F.lit(i))["v"]
        columns.append(value.cast(types.get(i, "string")).alias(name))
    out = body.select(*columns, F.col("path").alias("_src"), F.col("r").alias("_blk"))
    return out if keep_source else out.drop("_src", "_blk")


def _column_names(header: list, width: int) -> list[str]:
    """A name for every column of header or data: blanks by place, repeated names numbered."""
    names: list[str] = []
    for i in range(max(len(header), width)):
        name = header[i] if i < len(header) and header[i] is not None else f"Unnamed: {i}"
        n, free = 0, name
        while free in names:
            n += 1
            free = f"{name}.{n}"
        names.append(free)
    return names


def _column_type(kinds: set[str]) -> str:
    if kinds == {"i"}:
        return "bigint"
    if kinds and kinds <= {"i", "n"}:
        return "double"
    return {frozenset("b"): "boolean", frozenset("d"): "timestamp_ntz"}.get(frozenset(kinds), "string")


def read_excel(
    spark: SparkSession, path: str | list[str], sheet: int | str = 0, header: int | None = 0,
    usecols: str | None = None, splits_in_folders: bool = False, keep_source: bool = False,
) -> DataFrame:
    """Workbook files, optionally below split folders. Files are the unit of parallelism."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", splits_in_folders)
        .load(path).select("path", "content")
    )
    if splits_in_folders:
        check_split_folders(files)
    out = excel_rows(files, sheet, header, usecols, keep_source=True)
    if splits_in_folders:
        out = out.withColumn("split", split_of(F.col("_src")))
    return out if keep_source else out.drop("_src", "_blk")


__all__ = ["SPLIT_FOLDERS", "column_number", "excel_rows", "read_excel", "wanted_columns"]
