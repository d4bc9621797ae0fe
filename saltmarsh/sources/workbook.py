"""XLSX scan: many workbooks, one file per row, cells read inside the tasks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, types as T

# XML names of the workbook format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

# A sheet whose name holds one of these is preferred over the first sheet.
SHEET_WORDS = ("mobile", "sales")


def _sheet_part(book: zipfile.ZipFile) -> str:
    """Archive member of the preferred sheet."""
    sheets = list(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"))
    if not sheets:
        raise ValueError("workbook without sheets")
    named = [s for s in sheets if any(word in s.get("name", "").lower() for word in SHEET_WORDS)]
    wanted = (named or sheets)[0].get(REL_ID)
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(link.get("Target") for link in links if link.get("Id") == wanted)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _column(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _rows(content: bytes) -> Iterator[list[str | None]]:
    """Cell texts of the preferred sheet, row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            items = ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")
            shared = ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in items]
        with book.open(_sheet_part(book)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{MAIN}row":
                    continue
                cells: list[str | None] = []
                for i, cell in enumerate(row.iter(f"{MAIN}c")):
                    at = _column(cell.get("r")) if cell.get("r") else i
                    cells.extend([None] * (at + 1 - len(cells)))
                    if cell.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                        continue
                    value = cell.find(f"{MAIN}v")
                    if value is not None and value.text is not None:
                        cells[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
                yield cells
                row.clear()


def workbook_rows(files: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of workbooks given as (path, content); all cells as text, matched by header."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = _rows(content)
                header = next(rows, [])
                place = {name: i for i, name in enumerate(header) if name}
                records: list[list[str | None]] = []
                for cells in rows:
                    picked = [cells[place[c]] if c in place and place[c] < len(cells) else None for c in columns]
                    records.append([path, *picked])
                    if len(records) == 10_000:
                        yield pd.DataFrame(records, columns=["path", *columns])
                        records = []
                if records:
                    yield pd.DataFrame(records, columns=["path", *columns])

    schema = T.StructType([T.StructField(c, T.StringType()) for c in ["path", *columns]])
    return files.select("path", "content").mapInPandas(parse, schema)


def workbook_columns(files: DataFrame) -> list[str]:
    """Union of the headers of all workbooks, sorted; one short list per file leaves the tasks."""

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = {n for content in batch["content"] for n in next(_rows(content), []) if n}
            yield pd.DataFrame({"name": sorted(names)})

    found = files.select("path", "content").mapInPandas(headers, "name string").distinct()
    return sorted(row["name"] for row in found.collect())  # one row per column name


def read_workbooks(spark: SparkSession, path: str, columns: list[str] | None = None, glob: str = "*.xlsx") -> DataFrame:
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    )
    rows = workbook_rows(files, columns or workbook_columns(files))
    return rows.select(*[c for c in rows.columns if c != "path"])
