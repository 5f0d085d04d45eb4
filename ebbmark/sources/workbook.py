"""Workbook (.xlsx) scan: the first sheet of each file.

Spark lists and distributes the files with its ``binaryFile`` source, one task per workbook (a sheet
holds at most 1,048,576 rows); the small parser below turns one file into rows of text cells, and
type inference then runs on all rows as for CSV.
"""

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

from ebbmark.session import stage
from ebbmark.sources.infer import infer_types

_BATCH = 5000
# The built-in number formats that show a date or time.
_DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
_DAY_ZERO = datetime(1899, 12, 30)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    parsed = files.mapInPandas(_sheet_rows, "path string, row bigint, cells array<string>")
    rows = stage(parsed, "workbook")  # header, inference and every later use read the parsed rows
    heads = rows.where("row = 0").select("cells").distinct().take(2)
    if len(heads) != 1:
        raise ValueError(f"The workbooks in {path} hold {'no rows' if not heads else 'different headers'}")
    names = _unique_names(heads[0].cells)
    cells = [F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(names)]
    return infer_types(rows.where("row > 0").select(*cells), timestamps=True)


def _unique_names(header: list[str | None]) -> list[str]:
    names: list[str] = []
    for i, cell in enumerate(header):
        base = cell or f"Unnamed: {i}"
        name, n = base, 0
        while name in names:
            n += 1
            name = f"{base}.{n}"
        names.append(name)
    return names


def _sheet_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            pending: list[tuple[str, int, list]] = []
            for number, cells in enumerate(_parse(content)):
                pending.append((path, number, cells))
                if len(pending) == _BATCH:
                    yield pd.DataFrame(pending, columns=["path", "row", "cells"])
                    pending = []
            if pending:
                yield pd.DataFrame(pending, columns=["path", "row", "cells"])


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _texts(element) -> str:
    return "".join(e.text or "" for e in element.iter() if _tag(e) == "t")


def _parse(content: bytes) -> Iterator[list[str | None]]:
    """The rows of the first sheet that hold a value, each as a list of cell texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        members = set(book.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in members:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = [_texts(e) for e in root if _tag(e) == "si"]
        dated = _date_styles(book.read("xl/styles.xml")) if "xl/styles.xml" in members else []
        with book.open(_first_sheet(book)) as sheet:
            for _, element in ElementTree.iterparse(sheet):
                if _tag(element) != "row":
                    continue
                cells: list[str | None] = []
                for cell in element:
                    index = _column_index(cell.get("r"), len(cells))
                    cells.extend([None] * (index + 1 - len(cells)))
                    cells[index] = _cell_text(cell, shared, dated)
                element.clear()
                if any(c is not None for c in cells):
                    yield cells


def _first_sheet(book: zipfile.ZipFile) -> str:
    workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
    first = next(e for e in workbook.iter() if _tag(e) == "sheet")
    link = next(v for k, v in first.attrib.items() if k.endswith("}id"))
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(e.get("Target") for e in links if e.get("Id") == link)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _date_styles(styles: bytes) -> list[bool]:
    """For each cell style, whether it shows a date."""
    root = ElementTree.fromstring(styles)
    dated = set(_DATE_FORMATS)
    for e in root.iter():
        if _tag(e) == "numFmt":
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")).lower()
            if re.search(r"[dyhs]|m{2,}", code):
                dated.add(int(e.get("numFmtId")))
    formats = next((e for e in root if _tag(e) == "cellXfs"), [])
    return [int(e.get("numFmtId", 0)) in dated for e in formats]


def _column_index(reference: str | None, default: int) -> int:
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return default
    index = 0
    for letter in letters.group():
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1


def _cell_text(cell, shared: list[str], dated: list[bool]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _texts(cell)
    value = next((e.text for e in cell if _tag(e) == "v"), None)
    if value is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind == "n" and (style := int(cell.get("s", 0))) < len(dated) and dated[style]:
        moment = _DAY_ZERO + timedelta(seconds=round(float(value) * 86400))
        return moment.isoformat()
    return value
