"""Uploads and folders of workbooks: any supported file to record rows, style samples, merged professor files."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions.text import as_col, clean_scalar, nfc, professor_of, short_hash, slug, trim
from ..sources.formats import KINDS, PARTS, workbook_parts
from ..sources.readers import TEXT_SUFFIXES, decoded, docx_text, workbook
from .records import INPUT_COLUMNS, OUTPUT_COLUMNS, UPLOAD_IDS

#: Columns that make a table a table of records, and those of a professor's workbook.
PROFESSOR, RECORD, INPUT, OUTPUT = "Professor_ID", "수술ID", "Input", "Output"
REQUIRED = (RECORD, INPUT, OUTPUT)
#: Fixed value: style samples of one run.
STYLE_SAMPLES = 5


def _as_text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def parts_of(name: str, suffix: str, content: bytes, first_sheet: bool = False, json_as_text: bool = False) -> Iterator[tuple[str, list[str] | None, list[list[str]], str | None]]:
    """(source, header, rows, text) of each table of a file (no text), or its text (no header)."""
    if suffix == "csv":
        rows = list(csv.reader(io.StringIO(decoded(content), newline="")))
        yield name, rows[0] if rows else [], [r for r in rows[1:] if r], None
    elif suffix in ("xlsx", "xls"):
        for sheet, rows in workbook(content):
            yield f"{name}#{sheet}", rows[0] if rows else [], rows[1:], None
            if first_sheet:
                break
    elif suffix == "json":
        text = decoded(content)
        try:
            value = json.loads(text)
        except ValueError:
            yield name, None, [], text
            return
        if isinstance(value, dict) and not json_as_text:
            listed = value.get("rows") or value.get("records") or value.get("patients")
            value = listed if isinstance(listed, list) else value
        if not json_as_text and isinstance(value, list) and all(isinstance(x, dict) for x in value):
            header = list(dict.fromkeys(k for x in value for k in x))
            yield name, header, [[_as_text(x.get(k)) for k in header] for x in value], None
        else:
            yield name, None, [], json.dumps(value, ensure_ascii=False, indent=2)
    elif suffix == "docx":
        yield name, None, [], docx_text(content)
    elif suffix in TEXT_SUFFIXES or not suffix:
        yield name, None, [], decoded(content)
    else:
        raise ValueError(f"text extraction is not supported for .{suffix}")


def file_parts(found: DataFrame, first_sheet: bool = False, json_as_text: bool = False) -> DataFrame:
    """PARTS of files (name, suffix, content): for each table one row of row_index -1 with its header, one a record with its
    cells; one row for a text; one with a warning for a file that cannot be read. Files are read in parallel, each in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, suffix, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                out = []
                try:
                    for part, (source, header, rows, text) in enumerate(parts_of(name, suffix, content, first_sheet, json_as_text)):
                        out.append((name, source, part, header, -1, None, text, None))
                        for k, row in enumerate(rows):
                            out.append((name, source, part, header, k, [(h, row[j] if j < len(row) else "") for j, h in enumerate(header) if h], None, None))
                except Exception as e:  # noqa: BLE001  any damage to an uploaded file is a warning
                    out = [(name, name, 0, None, -1, None, None, f"{name}: cannot be read ({e})")]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(KINDS)], names=[x.split()[0] for x in PARTS.split(", ")])

    return found.select("name", "suffix", "content").mapInArrow(run, PARTS)


def cell(column: Column | str) -> Column:
    """The cell of a column named by a column or by text, empty if there is none."""
    name = F.lit(column) if isinstance(column, str) else column
    return F.coalesce(F.try_element_at(F.col("cells"), name), F.lit(""))


def plain_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "(?U)[\\s_]+", ""))


def resolved(header: Column, candidates: tuple[str, ...]) -> Column:
    """The first candidate in the header as written, else without case, white space and underscores; null if there is none."""
    listed = F.array(*map(F.lit, candidates))
    exact = F.get(F.filter(listed, lambda c: F.array_contains(header, c)), F.lit(0))
    like = F.get(F.filter(F.transform(listed, lambda c: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(header, lambda h: plain_name(h) == plain_name(c))), -1)), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(exact, like)


def stem_of(source: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(source, "^.*/", ""), "(?<=.)\\.[^.]*\\z", "")


def chosen_id(fallback: Column) -> Column:
    """The first of UPLOAD_IDS whose cell is not blank, else the fallback."""
    ids = F.filter(F.transform(F.array(*map(F.lit, UPLOAD_IDS)), lambda c: trim(F.coalesce(F.try_element_at(F.col("cells"), c), F.lit("")))), lambda x: x != "")
    return F.coalesce(F.get(ids, F.lit(0)), fallback)


def numbered(source: Column | str) -> Column:
    return F.concat(slug(stem_of(as_col(source))), F.lit("_"), (F.col("row_index") + 1).cast("string"))


def input_rows(found: DataFrame, professor: str, output_type: str) -> tuple[DataFrame, DataFrame]:
    """(rows, warnings) of uploaded files, of any supported kind: Professor_ID, 수술ID, Input, Output, Output_Type, Source_File.

    A table of records gives its rows; a table with a column that can hold the input gives rows of the default professor; any
    other table, and any text, is one row. Rows without an input are left out.
    """
    parts = file_parts(found)
    records = F.forall(F.array(*map(F.lit, (PROFESSOR, RECORD, INPUT))), lambda c: F.array_contains("header", c))
    source = F.when(records, F.lit(INPUT)).otherwise(resolved(F.col("header"), INPUT_COLUMNS))
    note = F.when(records, F.lit(OUTPUT)).otherwise(resolved(F.col("header"), OUTPUT_COLUMNS))
    parts = parts.withColumn("records", F.coalesce(records, F.lit(False))).withColumn("source_column", source).withColumn("note_column", note)
    own = F.when(F.col("records"), F.coalesce(F.nullif(trim(cell(PROFESSOR)), F.lit("")), F.lit(professor))).otherwise(F.lit(professor))
    tail = [F.lit(output_type).alias("Output_Type"), F.col("source").alias("Source_File"), "part", "row_index"]
    tables = parts.where("row_index >= 0 and source_column is not null").select(own.alias(PROFESSOR), chosen_id(numbered("source")).alias(RECORD), clean_scalar(cell(F.col("source_column"))).alias(INPUT), clean_scalar(cell(F.coalesce("note_column", F.lit("")))).alias(OUTPUT), *tail)
    lines = F.transform(F.filter(F.transform(F.filter("header", lambda h: h != ""), lambda h: F.struct(h.alias("k"), clean_scalar(F.try_element_at("cells", h)).alias("v"))), lambda x: x["v"] != ""), lambda x: F.concat(F.lit("- "), x["k"], F.lit(": "), x["v"]))
    other = parts.where("row_index >= 0 and source_column is null").select("source", "part", "row_index", F.concat_ws("\n", F.concat(F.lit("Row "), (F.col("row_index") + 1).cast("string")), lines).alias("block"))
    other = other.groupBy("source", "part").agg(F.array_sort(F.collect_list(F.struct("row_index", "block"))).alias("blocks"))  # a rendered table is one row, so it lies in one task
    rendered = other.select("source", "part", F.concat_ws("\n\n", F.concat(F.lit("[Source table: "), "source", F.lit("]")), F.transform("blocks", lambda b: b["block"])).alias("text"))
    texts = parts.where("text is not null").select("source", "part", "text").unionByName(rendered).withColumn("row_index", F.lit(0).cast("long"))
    single = texts.withColumn(INPUT, clean_scalar("text")).select(F.lit(professor).alias(PROFESSOR), F.concat(slug(stem_of(F.col("source"))), F.lit("_"), short_hash(INPUT, 6)).alias(RECORD), INPUT, F.lit("").alias(OUTPUT), *tail)
    rows = tables.unionByName(single).where(F.col(INPUT) != "")
    warnings = parts.where("warning is not null").select("name", "warning")
    if rows.isEmpty():
        nothing = "No usable input rows were extracted from uploaded input documents."
        warnings = warnings.unionByName(found.sparkSession.createDataFrame([("", nothing)], "name string, warning string"))
    return rows.drop("part", "row_index"), warnings


def style_samples(found: DataFrame, most: int = STYLE_SAMPLES) -> tuple[DataFrame, DataFrame]:
    """(samples, warnings) of uploaded style files: Input, Output, reference_id, source_file, source_row; the first ``most`` by
    file and row, from the first ``most`` files. A table without a column that can hold a note is a warning; a text is one note, and
    so is a JSON file of any shape, as indented text."""
    names = found.select("name").distinct().withColumn("file_no", F.row_number().over(W.orderBy("name")))  # names of one upload
    parts = file_parts(found, json_as_text=True).join(F.broadcast(names), "name").withColumn("note_column", resolved(F.col("header"), OUTPUT_COLUMNS)).withColumn("source_column", resolved(F.col("header"), INPUT_COLUMNS))
    parts = parts.where(F.col("file_no") <= most)
    place = [F.col("source").alias("source_file"), (F.col("row_index") + 1).cast("string").alias("source_row"), "file_no", "part", "row_index"]
    rows = parts.where("row_index >= 0 and note_column is not null").select(clean_scalar(cell(F.coalesce("source_column", F.lit("")))).alias(INPUT), clean_scalar(cell(F.col("note_column"))).alias(OUTPUT), chosen_id(numbered("source")).alias("reference_id"), *place)
    whole = parts.where("text is not null").withColumn("row_index", F.lit(0).cast("long")).select(F.lit("").alias(INPUT), clean_scalar("text").alias(OUTPUT), numbered("source").alias("reference_id"), *place)
    samples = rows.where(F.col(OUTPUT) != "").unionByName(whole).orderBy("file_no", "part", "row_index").limit(most)
    lost = parts.where("row_index = -1 and header is not null and note_column is null").select("name", F.concat("source", F.lit(": no output/reference-note column detected")).alias("warning"))
    more = names.agg(F.max("file_no").alias("n")).where(F.col("n") > most).select(F.lit("").alias("name"), F.lit(f"Only the first {most} style sample uploads were used.").alias("warning"))
    return samples.drop("file_no", "part", "row_index"), parts.where("warning is not null").select("name", "warning").unionByName(lost).unionByName(more)


def merged_workbooks(spark: SparkSession, folder: str, keep_empty_output: bool = True, in_order: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, summary, warnings) of all workbooks in a folder: Professor_ID (from the file's name), 수술ID, Input, Output.

    Cells are trimmed and in normal form C; rows without an id or an input are left out, and those without an output unless
    keep_empty_output. in_order sorts by professor and id. summary: source_file, professor_id, input_rows, output_rows,
    skipped_rows. Workbooks that cannot be read or lack a column are a warning; no workbook, or no valid one, is an error.
    Large workbooks are read in several tasks (sources.formats).
    """
    parts = workbook_parts(spark, folder, firstSheet="true")
    lost = parts.where("warning is not null")
    whole = parts.join(lost.select("name").distinct(), "name", "left_anti").unionByName(lost)
    return _merged(whole, keep_empty_output, in_order)


def merged_files(found: DataFrame, keep_empty_output: bool = True, in_order: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """merged_workbooks of workbooks (name, suffix, content) wherever they come from."""
    return _merged(file_parts(found, first_sheet=True), keep_empty_output, in_order)


def _merged(parts: DataFrame, keep_empty_output: bool, in_order: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    complete = F.forall(F.array(*map(F.lit, REQUIRED)), lambda c: F.array_contains("header", c))
    lost = F.filter(F.array(*map(F.lit, REQUIRED)), lambda c: ~F.array_contains(F.col("header"), c))
    parts = parts.withColumn("complete", F.coalesce(complete, F.lit(False)))
    if parts.where("row_index = -1 and complete").isEmpty():
        raise RuntimeError("none of the workbooks is valid")
    valid = parts.where("complete").withColumn("professor_id", trim(professor_of(nfc(F.col("name")))))
    text = lambda c: trim(nfc(cell(c)))
    rows = valid.where("row_index >= 0").select("name", "row_index", F.col("professor_id").alias(PROFESSOR), *(text(c).alias(c) for c in REQUIRED))
    keep = (F.col(PROFESSOR) != "") & (F.col(RECORD) != "") & (F.col(INPUT) != "") & (F.lit(keep_empty_output) | (F.col(OUTPUT) != ""))
    counted = rows.groupBy("name").agg(F.count("*").alias("input_rows"), F.count_if(keep).alias("output_rows"))
    summary = valid.where("row_index = -1").select("name", "professor_id").join(counted, "name", "left").na.fill(0)
    summary = summary.select(F.col("name").alias("source_file"), "professor_id", "input_rows", "output_rows", (F.col("input_rows") - F.col("output_rows")).alias("skipped_rows"))
    kept = rows.where(keep)
    kept = kept.orderBy(PROFESSOR, RECORD, "name", "row_index") if in_order else kept
    missing = parts.where("row_index = -1 and header is not null and not complete").select("name", F.concat("name", F.lit(": missing columns "), F.array_join(lost, ", ")).alias("warning"))
    return kept.select(PROFESSOR, *REQUIRED), summary, parts.where("warning is not null").select("name", "warning").unionByName(missing)
