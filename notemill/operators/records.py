"""Records: merged and checked, identified, cut into ranges, deduplicated, resumed, sampled."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_scalar, short_hash, slug
from .ranks import drawn_rows

#: Columns that can hold a record's id, best first.
ID_COLUMNS = ("record_id", "Record_ID", "patient_id", "Patient_ID", "encounter_id", "visit_id", "case_id", "수술ID", "operation_id", "Operation_ID")


def require(df: DataFrame, *columns: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def with_default(df: DataFrame, column: str, value: str = "") -> DataFrame:
    return df if column in df.columns else df.withColumn(column, F.lit(value))


def resolve(columns: list[str], candidates: tuple[str, ...]) -> str | None:
    """The first candidate among the columns, as written, else without case, white space and underscores; of columns that are
    equal then, the last."""
    plain = lambda c: re.sub(r"[\s_]+", "", c).lower()
    known = {plain(c): c for c in columns}
    return next((c for c in candidates if c in columns), None) or next((known[plain(c)] for c in candidates if plain(c) in known), None)


def record_id(df: DataFrame, candidates: tuple[str, ...] = ID_COLUMNS) -> Column:
    """The first candidate that is not empty, else any column named like an id, else empty."""
    others = [c for c in df.columns if c not in candidates and ("id" in c.lower() or "번호" in c)]
    named = [c for c in candidates if c in df.columns]
    return F.coalesce(*(F.nullif(clean_scalar(F.col(f"`{c}`")), F.lit("")) for c in (*named, *others)), F.lit(""))


def merged(records: DataFrame, keep_empty_output: bool = True) -> DataFrame:
    """Records with a professor, an id and an input, trimmed, in the order of professor and id (as text)."""
    out = records.withColumns({c: clean_scalar(c, unescaped=False) for c in ("professor", "record_id", "input", "output")})
    out = out.where((F.col("professor") != "") & (F.col("record_id") != "") & (F.col("input") != ""))
    return out if keep_empty_output else out.where(F.col("output") != "")


def merge_metrics(records: DataFrame) -> DataFrame:
    """One row: rows, professors, distinct and repeated (professor, id) pairs, null cells."""
    nulls = reduce(lambda a, b: a + b, (F.col(f"`{c}`").isNull().cast("long") for c in records.columns))
    pairs = F.count_distinct(F.struct("professor", "record_id"))
    return records.agg(F.count("*").alias("n_rows"), F.count_distinct("professor").alias("n_professors"), pairs.alias("n_pairs"), (F.count("*") - pairs).alias("n_repeated"), F.coalesce(F.sum(nulls), F.lit(0)).alias("null_cells"))


def keep_first(df: DataFrame, key: str, order: str, count: str | None = None) -> DataFrame:
    """The first row of each key, with ``count`` also how many rows have it. Groups by 128 bits of the key, so that long keys
    are not compared; aggregates before its shuffle, so a key of very many rows is no burden."""
    rest = [c for c in df.columns if c not in (key, order)]
    bits = [F.xxhash64(key).alias("_a"), F.xxhash64(F.lit("second"), F.col(key)).alias("_b")]
    found = df.select(*bits, F.struct(key, order, *rest).alias("_r")).groupBy("_a", "_b").agg(F.min_by("_r", F.col(f"_r.{order}")).alias("_r"), F.count("*").alias("_n"))
    return found.select(*(F.col(f"_r.{c}").alias(c) for c in (key, order, *rest)), *([F.col("_n").alias(count)] if count else []))


def row_range(df: DataFrame, start: int = 0, most: int = 0, index: str = "row_index") -> DataFrame:
    """Rows by their index; most = 0 means all."""
    out = df.where(F.col(index) >= start)
    return out.where(F.col(index) < start + most) if most > 0 else out


def head(df: DataFrame, n: int, index: str = "row_index") -> DataFrame:
    if n < 0:
        raise ValueError("the number of rows must not be negative")
    return df.orderBy(index).limit(n) if n else df


def pending(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is not done: what a resumed run still has to do."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti").select(*rows.columns)


def hash_sample(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """n distinct keys of each group by rank of SHA-256 over seed, group and key; all if fewer; n = 0 means all. A group's
    sample does not depend on other groups. The first n of each task go to the shuffle."""
    keys = df.select(group, key).distinct()
    if n <= 0:
        return keys
    draw = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"), F.col(key).cast("string")), 256)
    ranked = keys.withColumn("_d", draw).withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy("_d", key)))
    return ranked.where(F.col("_r") <= n).drop("_d", "_r")


def seeded_sample(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """n distinct keys of each group, drawn by Python's generator seeded with 'seed:group' from the sorted keys; all if fewer; n = 0
    means all. The generator draws places from a group's number of keys; the keys at these places are found by counts over
    sorted parts, so a group of any size stays spread out."""
    keys = df.select(group, key).distinct()
    return keys if n <= 0 else drawn_rows(keys, group, n, seed, key).select(group, key)


#: Columns that may hold the input or the note of an uploaded table, best first.
INPUT_COLUMNS = ("input", "Input", "INPUT", "source", "Source", "original_record", "Original_Record", "medical_record", "Medical_Record", "의료기록지", "원본의료기록지")
OUTPUT_COLUMNS = (
    "reference", "Reference", "references", "References", "output", "Output", "OUTPUT", "actual_output", "Actual_Output",
    "reference_output", "Reference_Output", "ground_truth", "Ground_Truth", "GT", "note", "Note", "outpatient_note",
    "Outpatient_Note", "외래기록지", "퇴원기록지", "실제외래기록지",
)
UPLOAD_IDS = ("수술ID", "환자 ID", "환자ID", "Patient_ID", "patient_id", "record_id", "Record_ID", "No.", "No", "no")


def table_text(df: DataFrame, title: str, order: str) -> DataFrame:
    """A small table as one text: a title, then each row with its cells that are not empty. One row: text."""
    cells = F.array(*(F.struct(F.lit(c).alias("k"), clean_scalar(F.col(f"`{c}`")).alias("v")) for c in df.columns))
    lines = F.transform(F.filter(cells, lambda x: x["v"] != ""), lambda x: F.concat(F.lit("- "), x["k"], F.lit(": "), x["v"]))
    rows = df.select(F.col(order).alias("_o"), lines.alias("lines")).agg(F.array_sort(F.collect_list(F.struct("_o", "lines"))).alias("rows"))
    blocks = F.transform("rows", lambda r, i: F.concat_ws("\n", F.concat(F.lit("Row "), (i + 1).cast("string")), r["lines"]))
    return rows.select(F.concat_ws("\n\n", F.lit(f"[Source table: {title}]"), blocks).alias("text"))


def upload_rows(df: DataFrame, name: str, professor: str, index: str = "row_index") -> DataFrame:
    """Rows of an uploaded table that has an input column: professor, record_id, input, output, source_file."""
    data = [c for c in df.columns if c != index]
    source, note = resolve(data, INPUT_COLUMNS), resolve(data, OUTPUT_COLUMNS)
    if source is None:
        raise ValueError(f"{name}: no column holds the input")
    ids = [F.nullif(clean_scalar(F.col(f"`{c}`"), False), F.lit("")) for c in UPLOAD_IDS if c in data]
    stem = name.rsplit(".", 1)[0]
    fallback = F.concat(slug(F.lit(stem)), F.lit("_"), (F.col(index) + 1).cast("string"))
    out = df.select(F.lit(professor).alias("professor"), F.coalesce(*ids, fallback).alias("record_id"), clean_scalar(F.col(f"`{source}`")).alias("input"), (clean_scalar(F.col(f"`{note}`")) if note else F.lit("")).alias("output"), F.lit(name).alias("source_file"))
    return out.where(F.col("input") != "")


def text_rows(files: DataFrame, name: str = "name", text: str = "text", professor: str = "default") -> DataFrame:
    """One row for each uploaded text that is not empty; its id is the file's name and a hash of the text."""
    cleaned = clean_scalar(text)
    stem = F.regexp_replace(F.regexp_replace(F.col(name), "^.*/", ""), "(?<=.)\\.[^.]*\\z", "")
    out = files.select(F.lit(professor).alias("professor"), F.concat(slug(stem), F.lit("_"), short_hash(cleaned, 6)).alias("record_id"), cleaned.alias("input"), F.lit("").alias("output"), F.col(name).alias("source_file"))
    return out.where(F.col("input") != "")

