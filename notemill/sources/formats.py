"""Data sources of Spark: ``workbook`` reads and writes folders of XLSX files, ``spreadsheet_csv`` writes CSV with a byte order mark.

Reading. A file of more than SMALL bytes is cut: a task for each sheet, or for each run of its rows that begin within so many bytes
of the sheet's XML (option ``bytesPerTask``). A task inflates the sheet up to its run without parsing it, holds the rows of its run
only, and of the shared strings only those that these rows name. Smaller files are not opened while planning but packed into tasks.
A file that cannot be read is a row with a warning for each task that met the damage; what was read before it stays.

Writing. Each attempt of a task writes files of its own below a staging folder and reports them; the commit moves what was reported and
removes the rest, so neither a failed, repeated or speculative task nor an aborted job leaves anything among the results. Columns must
be text. Overwriting removes the parts of earlier writes first; other files in the folder stay.

Paths are absolute paths or URIs that Arrow knows (file, hdfs, s3, gs, abfs), seen alike by driver and executors. For workbooks behind
other file systems use readers.files and uploads.file_parts, which read whole files.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.csv
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

from ..runtime import reach
from .readers import _column_of

#: Parameters: bytes of a sheet's XML for one task; compressed bytes of files that are read whole, and of a pack of them; rows of a batch.
PER_TASK, SMALL, PACK, BATCH = 16 << 20, 1 << 20, 4 << 20, 1000
#: Fixed value: most rows of a sheet, its header included.
SHEET_ROWS = 1_048_576

PARTS = "name string, source string, part int, header array<string>, row_index long, cells map<string,string>, text string, warning string"
KINDS = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string())

_ROW = re.compile(rb"<(?:[\w.-]+:)?row(?=[\s/>])")
_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")
_TO_ESCAPE = re.compile("[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")
_name = lambda node: node.tag.rpartition("}")[2]


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


def listed(path: str, pattern: str) -> list[fs.FileInfo]:
    """Files of a folder whose names match and are not hidden, by path; an error if there is none."""
    system, folder = place(path)
    found = [x for x in system.get_file_info(fs.FileSelector(folder)) if x.is_file and fnmatch.fnmatchcase(x.base_name, pattern) and x.base_name[0] not in "._"]
    if not found:
        raise FileNotFoundError(f"no {pattern} in {path}")
    return sorted(found, key=lambda x: x.path)


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet, its entry in the file), in the order of the workbook."""
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    nodes = (x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _name(x) == "sheet")
    targets = ((x.get("name"), next(links[v] for k, v in x.attrib.items() if k.rpartition("}")[2].rpartition(":")[2] == "id" and v in links)) for x in nodes)
    return [(sheet, "xl/" + target.lstrip("/").removeprefix("xl/")) for sheet, target in targets]


def _pieces(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of a sheet's XML up to its first row, then of each row, the last with all that follows it."""
    held, at = b"", 0
    while data := stream.read(1 << 18):
        held += data
        cuts = [0, *(m.start() for m in _ROW.finditer(held) if m.start() or at)]
        cuts = list(dict.fromkeys(cuts))
        for a, b in zip(cuts, cuts[1:]):
            yield at + a, held[a:b]
        held, at = held[cuts[-1] :], at + cuts[-1]
    yield at, held


def _cells(row: ElementTree.Element) -> list[tuple[str, str]]:
    """(kind, value) of the cells of a row: kind s for the number of a shared string, else empty."""
    found: dict[int, tuple[str, str]] = {}
    for k, c in enumerate(x for x in row if _name(x) == "c"):
        if c.get("t") == "inlineStr":
            value = "".join(x.text or "" for x in c.iter() if _name(x) == "t")
        else:
            value = next((x.text or "" for x in c if _name(x) == "v"), "")
        found[_column_of(c.get("r")) if c.get("r") else k] = ("s" if c.get("t") == "s" else "", value)
    return [found.get(k, ("", "")) for k in range(max(found, default=-1) + 1)]


def _run_of_rows(stream, begin: int, end: int) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """(number, cells) of the first row of a sheet and of those that begin in a range of its bytes; others are not parsed."""
    parser = ElementTree.XMLPullParser(("start", "end"))
    number, wanted, parents = -1, [], []
    for k, (at, piece) in enumerate(_pieces(stream)):
        if k:
            number += 1
            if number and at >= end:
                break
            if number and at < begin:
                continue
            wanted.append(number)
        parser.feed(piece)
        for event, node in parser.read_events():
            if event == "start":
                parents.append(node)
                continue
            parents.pop()
            if _name(node) == "row":
                yield wanted.pop(0), _cells(node)
                if parents:
                    parents[-1].remove(node)


def _shared(z: zipfile.ZipFile, wanted: set[int]) -> dict[int, str]:
    """Texts of the shared strings that are wanted, read as a stream."""
    found: dict[int, str] = {}
    if not wanted:
        return found
    with z.open("xl/sharedStrings.xml") as f:
        n, root = 0, None
        for event, node in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                root = node if root is None else root
            elif _name(node) == "si":
                if n in wanted:
                    found[n] = "".join(x.text or "" for x in node.iter() if _name(x) == "t")
                n += 1
                root.clear()
    if len(found) < len(wanted):
        raise ValueError("a cell names a shared string that is not there")
    return found


def _rows(z: zipfile.ZipFile, entry: str, begin: int, end: int) -> tuple[list[str], list[tuple[int, list[str]]]]:
    """The header of a sheet, and (row_index, cells) of the rows after it in a range of bytes. Sheets in UTF-16 are one range."""
    with z.open(entry) as f:
        if f.peek(2)[:2] in (b"\xff\xfe", b"\xfe\xff"):
            rows = [(k, _cells(x)) for k, x in enumerate(x for x in ElementTree.parse(f).iter() if _name(x) == "row")] if not begin else []
        else:
            rows = list(_run_of_rows(f, begin, end))
    text = _shared(z, {int(v) for _, row in rows for kind, v in row if kind})
    texts = [(k - 1, [text[int(v)] if kind else v for kind, v in row]) for k, row in rows]
    return (texts[0][1], texts[1:]) if texts else ([], [])


@dataclass
class Piece(InputPartition):
    """Files (path, name) that are read whole, or one file with a sheet (its place) and a range of bytes."""

    files: list[tuple[str, str]]
    sheet: int | None = None
    begin: int = 0
    end: int = 0


class WorkbookReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern = options["path"], options.get("pathGlobFilter", "*.xlsx")
        self.first = options.get("firstSheet", "false").lower() == "true"
        self.decode = options.get("decodeEscapes", "false").lower() == "true"
        self.per_task, self.small = int(options.get("bytesPerTask", PER_TASK)), int(options.get("smallFile", SMALL))

    def partitions(self) -> list[Piece]:
        out, pack, size = [], [], 0
        system, _ = place(self.path)
        for x in listed(self.path, self.pattern):
            if x.size <= self.small:
                if pack and size + x.size > PACK:
                    out.append(Piece(pack))
                    pack, size = [], 0
                pack.append((x.path, x.base_name))
                size += x.size
                continue
            try:
                with system.open_input_file(x.path) as f, zipfile.ZipFile(f) as z:
                    sizes = [z.getinfo(entry).file_size for _, entry in _sheets(z)]
            except Exception:  # noqa: BLE001  the task that reads it whole says what is wrong
                out.append(Piece([(x.path, x.base_name)]))
                continue
            for sheet, n in enumerate(sizes[:1] if self.first else sizes):
                out += [Piece([(x.path, x.base_name)], sheet, at, at + self.per_task) for at in range(0, max(n, 1), self.per_task)]
        return [*out, Piece(pack)] if pack else out

    def _tables(self, path: str, name: str, piece: Piece) -> Iterator[tuple]:
        system, _ = place(self.path)
        with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            for part, (sheet, entry) in enumerate(_sheets(z)):
                if (self.first and part) or (piece.sheet is not None and part != piece.sheet):
                    continue
                n = z.getinfo(entry).file_size
                for begin in range(0, max(n, 1), self.per_task) if piece.sheet is None else (piece.begin,):
                    header, rows = _rows(z, entry, begin, begin + self.per_task)
                    plain = (lambda c: _ESCAPED.sub(lambda m: chr(int(m[1], 16)), c)) if self.decode else (lambda c: c)
                    header, source = [plain(h) for h in header], f"{name}#{sheet}"
                    if not begin:
                        yield name, source, part, header, -1, None, None, None
                    for k, row in rows:
                        yield name, source, part, header, k, [(h, plain(row[j]) if j < len(row) else "") for j, h in enumerate(header) if h], None, None

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(KINDS)], names=[x.split()[0] for x in PARTS.split(", ")])

        for path, name in partition.files:
            rows: list[tuple] = []
            try:
                for row in self._tables(path, name, partition):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield batch(rows)
                        rows = []
            except (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, ValueError, IndexError, TypeError, StopIteration, RuntimeError, NotImplementedError, EOFError) as e:
                rows.append((name, name, 0, None, -1, None, None, f"{name}: cannot be read ({e})"))
            yield batch(rows)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class StagedWriter(DataSourceArrowWriter):
    """Writes files of one kind; what a kind's ``files`` opens is reported, moved on commit, and removed on abort."""

    suffix = ""

    def __init__(self, options, schema: StructType, overwrite: bool):
        if wrong := [f.name for f in schema if not isinstance(f.dataType, StringType)]:
            raise ValueError(f"columns must be text: {wrong}")
        self.path, self.header, self.overwrite = options["path"], schema.names, overwrite
        self.most = int(options.get("rowsPerFile", SHEET_ROWS - 1))
        self.staging = f"_temporary-{uuid.uuid4().hex}"
        system, folder = place(self.path)  # on the driver: a task that outlives its job cannot make the folder anew
        system.create_dir(f"{folder}/{self.staging}")

    def files(self, batches: Iterable[pa.RecordBatch], opened) -> None:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = place(self.path)
        context, names, own = TaskContext.get(), [], uuid.uuid4().hex

        def opened():
            names.append(f"part-{context.partitionId() if context else 0:05d}-{own}-{len(names):04d}.{self.suffix}")
            return system.open_output_stream(f"{folder}/{self.staging}/{names[-1]}", compression=None)

        self.files((b for b in iterator if b.num_rows), opened)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = place(self.path)
        names = [n for m in messages if m for n in m.names]
        if not names:  # the header alone, of an empty table
            names = [self._header_alone()]
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(folder)):
                if x.is_file and re.fullmatch(r"part-.*\.(csv|xlsx)|_SUCCESS", x.base_name):
                    system.delete_file(x.path)
        for n in names:
            system.move(f"{folder}/{self.staging}/{n}", f"{folder}/{n}")
        system.delete_dir(f"{folder}/{self.staging}")
        system.open_output_stream(f"{folder}/_SUCCESS").close()

    def _header_alone(self) -> str:
        system, folder = place(self.path)
        name = f"part-00000-{uuid.uuid4().hex}-0000.{self.suffix}"
        empty = pa.RecordBatch.from_arrays([pa.array([], pa.string())] * len(self.header), names=self.header)
        self.files([empty], lambda: system.open_output_stream(f"{folder}/{self.staging}/{name}", compression=None))
        return name

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = place(self.path)
        if system.get_file_info(f"{folder}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/{self.staging}")


class CsvWriter(StagedWriter):
    suffix = "csv"

    def files(self, batches, opened) -> None:
        out = csv = None
        try:
            for batch in batches:
                if csv is None:
                    out = opened()
                    out.write(b"\xef\xbb\xbf")
                    csv = pa.csv.CSVWriter(out, batch.schema, write_options=pa.csv.WriteOptions(quoting_style="all_valid"))
                csv.write_batch(batch)
        finally:
            if csv is not None:
                csv.close()
            if out is not None:
                out.close()


class WorkbookWriter(StagedWriter):
    suffix = "xlsx"

    def files(self, batches, opened) -> None:
        rest = iter(batches)
        held = next(rest, None)
        while held is not None:
            with opened() as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, text in _PACKAGE.items():
                    z.writestr(name, text)
                with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                    sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>{_row_text(self.header)}'.encode())
                    left = self.most
                    while held is not None and left:
                        part, held = held.slice(0, left), held.slice(left) if held.num_rows > left else None
                        for row in zip(*(c.to_pylist() for c in part.columns)):
                            sheet.write(_row_text(row).encode())
                        left -= part.num_rows
                        held = next(rest, None) if held is None else held
                    sheet.write(b"</sheetData></worksheet>")


def _row_text(cells: Iterable[str | None]) -> str:
    coded = (escape(_TO_ESCAPE.sub(lambda m: f"_x{ord(m[0]):04X}_", c or "")) for c in cells)
    return "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{c}</t></is></c>' for c in coded) + "</row>"


#: The parts that every workbook of one sheet has.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
_CONTENT = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_PACKAGE = {
    "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_CONTENT}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_CONTENT}.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_RELATIONS}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_RELATIONS}"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


class Workbook(DataSource):
    """``workbook``: rows as PARTS; options pathGlobFilter, firstSheet, bytesPerTask, smallFile, decodeEscapes (_x000D_ and the like
    become characters); for writing rowsPerFile. Null cells become empty ones."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return PARTS

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options, schema, overwrite)


class SpreadsheetCsv(DataSource):
    """``spreadsheet_csv``: for writing only; each part begins with a byte order mark and the header, all cells quoted, null ones left
    empty without quotes. readers.csv reads it."""

    @classmethod
    def name(cls) -> str:
        return "spreadsheet_csv"

    def schema(self) -> str:
        raise NotImplementedError("read it with readers.csv")

    def writer(self, schema: StructType, overwrite: bool) -> CsvWriter:
        return CsvWriter(self.options, schema, overwrite)


def registered(spark: SparkSession) -> SparkSession:
    for source in (Workbook, SpreadsheetCsv):
        reach(spark).dataSource.register(source)
    return spark


def workbook_parts(spark: SparkSession, folder: str, **options) -> DataFrame:
    """PARTS of all workbooks of a folder; an error if there is none."""
    listed(folder, options.get("pathGlobFilter", "*.xlsx"))
    return registered(spark).read.format("workbook").options(**options).load(folder)


def save(df: DataFrame, kind: str, folder: str, mode: str = "append", **options) -> None:
    """df in one of the formats of this module, every column as text."""
    as_text = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))
    registered(df.sparkSession)
    as_text.write.format(kind).mode(mode).options(**options).save(folder)
