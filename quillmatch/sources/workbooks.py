"""Workbooks as a data source: spark.read.format("workbook") and df.write.format("workbook").

Reading, a partition is one sheet of one file, so a workbook of many sheets is read by many tasks, and a filter on sheet or source_file leaves the
others unopened. A file or sheet that can't be read is one row with its error. Writing, cells become workbooks; a task writes whole
files under names of its own, which get their place when the job commits.

Paths go through pyarrow's file systems (local, HDFS, S3, GCS); where only Spark's own readers reach the files, io.scan_workbooks() reads them.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

CELLS = "source_file string, sheet string, row int, col int, value string, value_type string, error string"
BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, TypeError, OSError, EOFError)
#: Threads that list the sheets of files while a query is planned.
LISTERS = 32
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_KINDS = {"s": "text", "inlineStr": "text", "str": "text", "b": "bool"}


def sheet_parts(z: zipfile.ZipFile) -> dict[str, str]:
    """Sheet name -> its part of the archive, in order. Only the table of contents is read."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
        target = targets[s.get(_REL)]
        out[s.get("name")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
    return out


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{_NS}si":
                out.append("".join(t.text or "" for t in e.iter(f"{_NS}t")))
                e.clear()
    return out


def column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def sheet_cells(z: zipfile.ZipFile, part: str, shared: Sequence[str]) -> Iterator[tuple]:
    """(row, col, value, type) of every cell with a value, and (min row, min col, 'max row,max col', 'merge'); a row at a time is held."""
    number = lambda ref: int(re.sub(r"\D", "", ref))
    with z.open(part) as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{_NS}c":
                kind, v = e.get("t", "n"), e.find(f"{_NS}v")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in e.iter(f"{_NS}t"))
                else:
                    value = None if v is None else v.text
                if value is None:
                    continue
                if kind == "s":
                    value = shared[int(value)]
                elif kind == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                elif kind == "n" and re.fullmatch(r"-?\d+\.0*", value):
                    value = value.split(".")[0]
                yield number(e.get("r")), column(e.get("r")), value, _KINDS.get(kind, "number")
            elif e.tag == f"{_NS}row":
                e.clear()
            elif e.tag == f"{_NS}mergeCell":
                a, b = e.get("ref").split(":")
                yield number(a), column(a), f"{number(b)},{column(b)}", "merge"


@dataclass
class SheetPartition(InputPartition):
    path: str
    sheet: str | None
    part: str | None


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


class WorkbookSource(DataSource):
    """Options: path (a file or folder), glob (default *.xlsx), sheet (only this one)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        filters = str(self.options.get("pushdown", "false")).lower() == "true"
        return (FilteredReader if filters else WorkbookReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter(dict(self.options), schema.names, overwrite)


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.glob = options["path"], options.get("glob", "*.xlsx")
        self.sheets: set[str] | None = {options["sheet"]} if "sheet" in options else None
        self.files: set[str] | None = None

    def partitions(self) -> Sequence[InputPartition]:
        where, root = fs.FileSystem.from_uri(self.path)
        info = where.get_file_info(root)
        found = [info] if info.is_file else where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        paths = sorted(i.path for i in found if i.is_file and fnmatch(i.base_name, self.glob) and not i.base_name.startswith("."))
        paths = [p for p in paths if self.files is None or p in self.files]

        def sheets(path: str) -> list[SheetPartition]:
            try:
                with where.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                    return [SheetPartition(path, s, part) for s, part in sheet_parts(z).items() if self.sheets is None or s in self.sheets]
            except BROKEN:
                return [] if self.sheets is not None else [SheetPartition(path, None, None)]  # read() tells what is wrong

        with ThreadPoolExecutor(LISTERS) as pool:
            return [p for some in pool.map(sheets, paths) for p in some]

    def read(self, partition: SheetPartition | None) -> Iterator[tuple]:
        if partition is None:  # no file, no sheet
            return
        where, _ = fs.FileSystem.from_uri(self.path)
        try:
            with where.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
                if partition.part is None:
                    sheet_parts(z)
                    return
                for cell in sheet_cells(z, partition.part, shared_strings(z)):
                    yield (partition.path, partition.sheet, *cell, None)
        except BROKEN as e:
            yield partition.path, partition.sheet, 0, 0, None, "error", _said(e)


class FilteredReader(WorkbookReader):
    """Takes filters on sheet and source_file, where the session lets Python sources have filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("sheet",):
                self.sheets = values if self.sheets is None else self.sheets & values
            elif values is not None and f.attribute == ("source_file",):
                self.files = values if self.files is None else self.files & values
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WorkbookWriter(DataSourceWriter):
    """Rows (source_file, sheet, row, col, value, value_type) in that order, each file in one task. source_file is the file's name."""

    def __init__(self, options: dict, names: list[str], overwrite: bool) -> None:
        self.path, self.names = options["path"], names
        self.run = uuid.uuid4().hex
        if overwrite:
            where, root = fs.FileSystem.from_uri(self.path)
            if where.get_file_info(root).type == fs.FileType.Directory:
                where.delete_dir_contents(root)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(root, recursive=True)
        at = [self.names.index(c) for c in ("source_file", "sheet", "row", "col", "value", "value_type")]
        done: list[tuple[str, str]] = []
        book = None
        for row in rows:
            file, sheet, r, c, value, kind = (row[i] for i in at)
            if book is None or file != book.name:
                if book is not None:
                    book.close()
                done.append((f"{root}/.{self.run}-{uuid.uuid4().hex}", f"{root}/{file}"))
                book = _Book(where.open_output_stream(done[-1][0]), file)
            book.cell(sheet, r, c, value, kind)
        if book is not None:
            book.close()
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        where, _ = fs.FileSystem.from_uri(self.path)
        for made, place in (f for m in messages if m is not None for f in m.files):
            where.move(made, place)

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        for info in where.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith(f".{self.run}-"):
                where.delete_file(info.path)


class _Book:
    """One workbook, written as its cells come: a sheet is open at a time, a row is held."""

    def __init__(self, out, name: str) -> None:
        self.name, self.out = name, out
        self.z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        self.sheets: list[str] = []
        self.part = None
        self.row: int | None = None

    def cell(self, sheet: str, row: int, col: int, value: str | None, kind: str | None) -> None:
        if not self.sheets or sheet != self.sheets[-1]:
            if sheet in self.sheets:
                raise ValueError(f"the cells of {self.name} don't come in order of sheets")
            self._end()
            self.sheets.append(sheet)
            self.part = self.z.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w")
            self._put('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
        if row != self.row:
            if self.row is not None:
                self._put("</row>")
            self._put(f'<row r="{row}">')
            self.row = row
        if value is None:
            return
        name, n = "", col
        while n:
            n, r = divmod(n - 1, 26)
            name = chr(65 + r) + name
        if kind == "number":
            self._put(f'<c r="{name}{row}"><v>{escape(value)}</v></c>')
        elif kind == "bool":
            self._put(f'<c r="{name}{row}" t="b"><v>{int(value == "TRUE")}</v></c>')
        else:
            self._put(f'<c r="{name}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(_ILLEGAL.sub(chr(0xFFFD), value))}</t></is></c>')

    def _put(self, text: str) -> None:
        self.part.write(text.encode())

    def _end(self) -> None:
        if self.part is not None:
            self._put(("</row>" if self.row is not None else "") + "</sheetData></worksheet>")
            self.part.close()
        self.part, self.row = None, None

    def close(self) -> None:
        self._end()
        each = list(enumerate(self.sheets, 1))
        main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package, kind = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
        self.z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="rId{i}"/>' for i, s in each) + "</sheets></workbook>")
        self.z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in each) + "</Relationships>")
        self.z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i, _ in each)
        self.z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        self.z.close()
        self.out.close()


#: What XML 1.0 can't hold.
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def read_workbooks(spark: SparkSession, path: str, glob: str = "*.xlsx", sheet: str | None = None) -> DataFrame:
    """Cells, merges (value_type merge) and errors of all workbooks at path. sheet: only that one is opened; filters on sheet and source_file
    do the same where the session's setting PUSHDOWN is on. No file: no rows."""
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("workbook").option("path", path).option("glob", glob).option("pushdown", spark.conf.get(PUSHDOWN, "false"))
    return (reader if sheet is None else reader.option("sheet", sheet)).load()


def write_workbooks(cells: DataFrame, path: str, overwrite: bool = False) -> None:
    """cells(source_file, sheet, row, col, value, value_type) as a workbook for each source_file, which is its name below path. A file is written by one
    task, from rows that come sorted; characters that XML can't hold become U+FFFD."""
    cells.sparkSession.dataSource.register(WorkbookSource)
    kept = cells.select("source_file", "sheet", "row", "col", "value", "value_type")
    ordered = kept.repartition("source_file").sortWithinPartitions("source_file", "sheet", "row", "col")
    ordered.write.format("workbook").option("path", path).mode("overwrite" if overwrite else "append").save()
