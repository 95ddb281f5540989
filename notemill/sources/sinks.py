"""Sinks: CSV, JSON documents, JSON lines, Markdown; Spark's committers write them, so a lost task leaves nothing behind."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Sequence
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share: under spark.checkpoint.dir; only on a local master, as in tests, one is made."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base or tempfile.mkdtemp(prefix='notemill-')}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: a later read repeats no model call, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Quoted CSV with a header in each part; cells keep their white space and line ends."""
    options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
    df.write.mode(mode).options(**options).csv(path)


def export_csv(df: DataFrame, path: str, most: int = 1_000_000) -> int:
    """One CSV file with a byte order mark for spreadsheet programs, row by row through the driver, by which its size is
    limited: more than ``most`` rows are an error. formats.save(df, "spreadsheet_csv", folder) writes any size, a file for each task."""
    import csv

    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            n += 1
            if n > most:
                raise ValueError(f"more than {most} rows; use formats.save")
            out.writerow(["" if x is None else x for x in row])
    return n


def stable_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, keys in order, nulls kept."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    stable_json(df).write.mode(mode).text(path)


def write_json_documents(timelines: DataFrame, path: str, mode: str = "error") -> None:
    """Sorted documents of each record as nested JSON."""
    timelines.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_partial(df: DataFrame, path: str, batch: int) -> None:
    """Results of one batch, beside those of earlier ones; writing the batch again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def markdown(rows: DataFrame, title: str, head: dict[str, str], sections: dict[str, str], order: str) -> DataFrame:
    """A report as lines of one column in order: a heading, then each row's fields and sections."""
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = [F.concat(F.lit("## "), field(order)), *(F.concat(F.lit(f"- {k}: "), field(c)) for k, c in head.items())]
    for name, c in sections.items():
        parts += [F.lit(""), F.lit(f"### {name}"), field(c)]
    body = rows.select(F.col(order).alias("o"), F.concat_ws("\n", *parts).alias("value"))
    return body.orderBy("o").select(F.concat(F.col("value"), F.lit("\n")).alias("value"))


def workbook_bytes(sheets: dict[str, Sequence[Sequence[str]]]) -> bytes:
    """An XLSX file of text cells: rows of each sheet."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", "<workbook xmlns:r='r'><sheets>" + "".join(f"<sheet name='{escape(n)}' r:id='r{k}'/>" for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<x>" + "".join(f"<Relationship Id='r{k}' Target='worksheets/s{k}.xml'/>" for k in range(len(sheets))) + "</x>")
        for k, rows in enumerate(sheets.values()):
            body = "".join("<row>" + "".join(f"<c t='inlineStr'><is><t>{escape(c)}</t></is></c>" for c in row) + "</row>" for row in rows)
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def document_bytes(paragraphs: Iterable[str]) -> bytes:
    """A DOCX file of paragraphs."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        body = "".join(f"<w:p><w:t>{escape(p)}</w:t></w:p>" for p in paragraphs)
        z.writestr("word/document.xml", f"<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'>{body}</w:document>")
    return out.getvalue()
