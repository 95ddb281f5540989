"""Readers of record files: CSV, JSON lines, JSON uploads, workbooks, documents and plain text of several encodings."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug
from ..runtime import reach

#: Encodings tried in this order; the last accepts any byte.
ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr", "latin-1")
TEXT_SUFFIXES = ("txt", "md", "json", "jsonl", "xml", "html")


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, suffix, content, length of each file, by path; an error if there is none."""
    found = reach(spark).read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.regexp_extract("path", "([^/]*)/?\\z", 1)
    found = found.select("path", name.alias("name"), F.lower(F.regexp_extract(name, "(?<=.)\\.([^.]*)\\z", 1)).alias("suffix"), "content", "length")
    if found.select("path").isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return found


#: Parameter: bytes of a file that are in memory at a time while it is hashed.
HASHED = 8 << 20


def digests(found: DataFrame) -> DataFrame:
    """name, suffix, length, sha256 of files. Files of a system that Arrow knows are hashed piece by piece from their paths, so their
    content is never in memory as a whole; files that only Spark reads, or that have no path, are hashed from their content."""
    first = found.select("path").first() if "path" in found.columns else None
    if not first or not re.match("/|(file|hdfs|s3|s3a|gs|abfs|abfss):", first.path):
        return found.select("name", "suffix", "length", F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .formats import place

        for batch in batches:
            sums = []
            for path in batch.column(0).to_pylist():
                system, at = place(path)
                own = hashlib.sha256()
                with system.open_input_stream(at) as f:
                    while piece := f.read(HASHED):
                        own.update(piece)
                sums.append(own.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sums, pa.string())], names=["name", "suffix", "length", "sha256"])

    return found.select("path", "name", "suffix", "length").mapInArrow(run, "name string, suffix string, length long, sha256 string")


def manifest(found: DataFrame) -> DataFrame:
    """original_name, saved_name, bytes, sha256 of files."""
    stem = F.regexp_replace("name", "(?<=.)\\.[^.]*\\z", "")
    saved = F.concat(slug(stem, "upload"), F.lit("_"), F.left("sha256", F.lit(8)), F.when(F.col("suffix") != "", F.concat(F.lit("."), "suffix")).otherwise(""))
    return digests(found).select(F.col("name").alias("original_name"), saved.alias("saved_name"), F.col("length").alias("bytes"), "sha256")


def csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as text, empty cells as empty text; quotes are doubled, cells may hold line ends, a byte order mark is
    skipped. With ``columns``, they must be there."""
    read = reach(spark).read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("inferSchema", False)
    out = read.csv(path).na.fill("")
    if columns and (missing := [c for c in columns if c not in out.columns]):
        raise ValueError(f"missing columns: {missing}")
    return out.select(*columns) if columns else out


def jsonl(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Text columns of JSON lines. Lines that are no objects are skipped, as are rows that hold an error."""
    lines = reach(spark).read.text(path).withColumn("v", F.try_parse_json("value"))
    kept = lines.where(F.schema_of_variant("v").startswith("OBJECT") & F.coalesce(F.try_variant_get("v", "$.error", "string") == "", F.try_variant_get("v", "$.error", "string").isNull()))
    return kept.select(*(F.try_variant_get("v", f"$['{c}']", "string").alias(c) for c in columns))


def json_records(rows: DataFrame, json_col: str) -> DataFrame:
    """rows with one ``record`` (variant) for each object of their JSON: a list, or a list under rows, records or patients,
    or a single object."""
    v = F.try_parse_json(F.col(json_col))
    items = lambda path: F.try_variant_get(v, path, "array<variant>")
    listed = F.coalesce(items("$.rows"), items("$.records"), items("$.patients"), items("$"), F.array(v))
    return rows.select("*", F.explode(listed).alias("record")).drop(json_col).where(F.schema_of_variant("record").startswith("OBJECT"))


def _column_of(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def workbook(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(sheet name, rows of cell texts) of an XLSX file, from its XML parts."""
    name = lambda tag: tag.rpartition("}")[2]
    text = lambda node: "".join(x.text or "" for x in node.iter() if name(x.tag) == "t")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in parts:
            shared = [text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if name(x.tag) == "si"]
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if name(x.tag) == "sheet"):
            target = next(links[v] for k, v in sheet.attrib.items() if name(k) == "id")
            rows = []
            for row in (x for x in ElementTree.fromstring(z.read("xl/" + target.lstrip("/").removeprefix("xl/"))).iter() if name(x.tag) == "row"):
                cells: dict[int, str] = {}
                for k, c in enumerate(x for x in row if name(x.tag) == "c"):
                    value = next((x.text or "" for x in c if name(x.tag) == "v"), "")
                    kind = c.get("t")
                    cells[_column_of(c.get("r")) if c.get("r") else k] = shared[int(value)] if kind == "s" else text(c) if kind == "inlineStr" else value
                rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
            yield sheet.get("name"), rows


def workbooks(found: DataFrame, first_sheet: bool = True) -> DataFrame:
    """name, sheet, row_index, cells (map of header to text) of each row of workbooks; warning instead where a file cannot
    be read. A file is one row of the input, so files are read in parallel."""

    def run(batches):
        for batch in batches:
            out = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    for sheet, rows in workbook(content):
                        for k, row in enumerate(rows[1:]):
                            out.append((name, sheet, k, [(h, row[j] if j < len(row) else "") for j, h in enumerate(rows[0]) if h], None))
                        if first_sheet:
                            break
                except Exception as e:  # noqa: BLE001  any damage to an uploaded file is a warning
                    out.append((name, None, None, None, f"{name}: cannot be read ({e})"))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=["name", "sheet", "row_index", "cells", "warning"])

    return found.select("name", "content").mapInArrow(run, "name string, sheet string, row_index long, cells map<string,string>, warning string")


def as_columns(rows: DataFrame, *columns: str) -> DataFrame:
    """Workbook rows with the named cells as columns; files that lack one are left out."""
    has = F.forall(F.array(*map(F.lit, columns)), lambda c: F.map_contains_key("cells", c))
    return rows.where(F.col("cells").isNotNull() & has).select("name", "sheet", "row_index", *(F.try_element_at("cells", F.lit(c)).alias(c) for c in columns))


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX file that are not empty, one a line."""
    name = lambda tag: tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    found = ("".join(x.text or "" for x in p.iter() if name(x.tag) == "t").strip() for p in root.iter() if name(p.tag) == "p")
    return "\n".join(p for p in found if p)


def decoded(data: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 accepts any byte")


def texts(found: DataFrame) -> DataFrame:
    """name, text, warning of files by their suffix: documents and plain text; other kinds are a warning."""

    def run(batches):
        for batch in batches:
            out = []
            for name, suffix, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                try:
                    if suffix == "docx":
                        out.append((name, docx_text(content), None))
                    elif suffix in TEXT_SUFFIXES or not suffix:
                        out.append((name, decoded(content), None))
                    else:
                        out.append((name, None, f"{name}: no text is read from .{suffix}"))
                except Exception as e:  # noqa: BLE001
                    out.append((name, None, f"{name}: cannot be read ({e})"))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(3)], names=["name", "text", "warning"])

    return found.select("name", "suffix", "content").mapInArrow(run, "name string, text string, warning string")


def prompts(rows: DataFrame) -> DataFrame:
    """key, text of a workbook's optional sheets: Common_Prompts (key, prompt_text) and Sheet1 (professor, style_prompt)."""
    cell = lambda c: F.try_element_at("cells", F.lit(c))
    common = rows.where("sheet = 'Common_Prompts'").select(F.lit("common").alias("kind"), cell("key").alias("key"), cell("prompt_text").alias("text"))
    styles = rows.where("sheet = 'Sheet1'").select(F.lit("style").alias("kind"), cell("professor").alias("key"), cell("style_prompt").alias("text"))
    return common.unionByName(styles).where(F.coalesce(F.col("text"), F.lit("")) != "")

