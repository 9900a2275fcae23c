"""Workbooks (.xlsx) as a data source: each sheet of each file is a partition, and sheets that a filter rules out aren't opened.

A workbook is a zip of XML. The list of its sheets is read while the scan is planned, from each file's end and one small
part; a sheet's rows are read as a stream, by the task that has the sheet, with the shared texts held in memory. Files are
reached through pyarrow's file systems. Cells come as texts, as they are stored: numbers without their format, dates as
day numbers, truth as 0 and 1; a cell that isn't there is NULL. Older .xls files are another format and are not read.

    workbook.register(spark)
    spark.read.format("workbook").load(folder).where("sheet = '2023'")       # path, sheet, line, cells
    spark.read.format("workbook").option("list", "true").load(folder)        # path, sheet, place
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions import nulls
from .tabular import SchemaDriftError

# Names of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _open(path: str):
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


def _files(path: str) -> list[str]:
    """The .xlsx files of a folder, or the one file."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    scheme = path[: path.index(place)] if place in path else ""
    return sorted(scheme + x.path for x in store.get_file_info(fs.FileSelector(place)) if x.type == fs.FileType.File and x.path.lower().endswith(".xlsx") and not x.base_name.startswith("~$"))


def sheets_of(path: str) -> list[tuple[str, str]]:
    """Name and part of each sheet, in their order."""
    with _open(path) as f, zipfile.ZipFile(f) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        relations = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = {r.get("Id"): r.get("Target") for r in relations.iter(f"{PACKAGE}Relationship")}
        out = []
        for s in book.iter(f"{MAIN}sheet"):
            part = target[s.get(f"{RELATION}id")]
            out.append((s.get("name"), part.lstrip("/") if part.startswith("/") else f"xl/{part}"))
        return out


def column_number(reference: str) -> int:
    """From 0: A1 is 0, AB7 is 27."""
    n = 0
    for x in reference:
        if not x.isalpha():
            break
        n = n * 26 + ord(x.upper()) - 64
    return n - 1


def _text(node) -> str:
    """All runs of a text, without what is said of how to pronounce it."""
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t") if t not in {x for p in node.iter(f"{MAIN}rPh") for x in p.iter()})


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag == f"{MAIN}si":
                out.append(_text(node))
                node.clear()
    return out


def rows_of(path: str, part: str) -> Iterator[tuple[int, list[str | None]]]:
    """Line (from 0, as numbered in the sheet) and cells of each row that the sheet has."""
    with _open(path) as f, zipfile.ZipFile(f) as z:
        shared, line, root = _shared(z), -1, None
        with z.open(part) as sheet:
            for event, node in ElementTree.iterparse(sheet, events=("start", "end")):
                if root is None:
                    root = node
                if event != "end" or node.tag != f"{MAIN}row":
                    continue
                line = int(node.get("r")) - 1 if node.get("r") else line + 1
                cells: list[str | None] = []
                for c in node.iter(f"{MAIN}c"):
                    at = column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    value, kind = c.find(f"{MAIN}v"), c.get("t")
                    if kind == "inlineStr":
                        cells.append(_text(c))
                    elif value is None or value.text is None:
                        cells.append(None)
                    else:
                        cells.append(shared[int(value.text)] if kind == "s" else value.text)
                yield line, cells
                for done in list(root):  # rows that have been told are let go
                    if done.tag == f"{MAIN}sheetData":
                        done.clear()


@dataclass
class Sheet(InputPartition):
    path: str
    name: str
    part: str
    place: int


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.list = options["path"], options.get("list", "false").lower() == "true"
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what is asked of sheet and path; the rest is left to Spark."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in ("sheet", "path"):
                asked = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[name] = self.wanted.get(name, asked) & asked
            else:
                yield f

    def partitions(self) -> list[Sheet]:
        may = lambda name, value: name not in self.wanted or value in self.wanted[name]
        found = [Sheet(p, name, part, i) for p in _files(self.path) if may("path", p) for i, (name, part) in enumerate(sheets_of(p)) if may("sheet", name)]
        return found or [Sheet("", "", "", -1)]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        if partition.place < 0:
            return
        if self.list:
            yield partition.path, partition.name, partition.place
            return
        for line, cells in rows_of(partition.path, partition.part):
            yield partition.path, partition.name, line, cells


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "path string, sheet string, place int" if self.options.get("list", "false").lower() == "true" else "path string, sheet string, line int, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, which then hands filters to such sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Workbook)


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, place of all sheets of all workbooks of a folder."""
    register(spark)
    return spark.read.format("workbook").option("list", "true").load(path)


def header_rows(rows: DataFrame, tokens: list[str], most: int = 15) -> DataFrame:
    """path, sheet, line, cells: of each sheet the first of `most` lines that holds all tokens in its cells, whatever their case."""
    joined = F.lower(F.array_join("cells", " "))
    hit = F.lit(True)
    for t in tokens:
        hit = hit & F.contains(joined, F.lit(t.lower()))
    first = rows.where((F.col("line") < most) & hit).groupBy("path", "sheet").agg(F.min_by(F.struct("line", "cells"), "line").alias("h"))
    return first.select("path", "sheet", "h.line", "h.cells")


def below_header(rows: DataFrame, tokens: dict[str, str], most: int = 15) -> DataFrame:
    """path, sheet, line and a column for each token of the rows below each sheet's header: the first header cell that holds the token names it.

    tokens: column name by the text to look for. Sheets may order their columns differently; a sheet without a header row
    gives no rows. Lines without any known cell are left out.
    """
    heads = header_rows(rows, list(tokens), most)
    place = lambda t: F.array_position(F.transform("__head", lambda x: F.coalesce(F.contains(F.lower(x), F.lit(t.lower())), F.lit(False))), True)
    met = rows.join(heads.select("path", "sheet", F.col("line").alias("__from"), F.col("cells").alias("__head")), ["path", "sheet"]).where(F.col("line") > F.col("__from"))
    out = met.select("path", "sheet", "line", *[F.get("cells", (place(t) - 1).cast("int")).alias(c) for t, c in tokens.items()])
    some = F.lit(False)
    for c in tokens.values():
        some = some | ~nulls.blank(c)
    return out.where(some)


def read_sheets(spark: SparkSession, path: str, tokens: dict[str, str], sheet: str | None = None) -> DataFrame:
    """below_header of all workbooks of a folder, or of the sheets of one name; an error if no sheet has such a header."""
    register(spark)
    rows = spark.read.format("workbook").load(path)
    rows = rows if sheet is None else rows.where(F.col("sheet") == sheet)
    out = below_header(rows, tokens)
    if header_rows(rows, list(tokens)).isEmpty():
        raise SchemaDriftError(f"no sheet in {path} has a row with {list(tokens)}")
    return out
