"""Queries on files: folders of workbooks, uploads of any kind, sinks that are read again, model replies."""

from __future__ import annotations

import csv
import io
import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import backends, facts, judging, notes as n, records as r, references, uploads
from ..sources import formats, readers, sinks
from .adapters import load, view
from .catalogue import query


def _made(rows: DataFrame, make) -> DataFrame:
    """name, suffix, content of a file for each group: rows of (name, cells array of arrays) through make(suffix, name, cells)."""

    def run(batches):
        for batch in batches:
            names, suffixes = (batch.column(k).to_pylist() for k in (0, 1))
            content = [make(s, n_, c) for n_, s, c in zip(names, suffixes, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(content, pa.binary())], names=["name", "suffix", "content"])

    return rows.select("name", "suffix", "cells").mapInArrow(run, "name string, suffix string, content binary")


def _workbook(suffix, name, cells):
    return sinks.workbook_bytes({"first": [["extra", "수술ID", "Input", "Output"], *cells], "second": [["Input"], ["not read"]]})


def _suppliers(spark, sf) -> DataFrame:
    """A workbook for each nation, its suppliers as records; some lack an input, some an output."""
    s = load(spark, sf, "supplier").join(load(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    cells = F.array(F.lit("x"), F.concat(F.lit(" "), key.cast("string")), F.when(key % 7 == 0, " ").otherwise(F.col("s_name")), F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("out "), key.cast("string"))))
    rows = s.groupBy(F.concat("n_name", F.lit("_All.xlsx")).alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), cells.alias("c")))), lambda x: x["c"]).alias("cells"))
    return _made(rows.withColumn("suffix", F.lit("xlsx")), _workbook)


_SUPPLIERS = "(SELECT n_name, s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE s_name END AS input, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'out ' || CAST(s_suppkey AS VARCHAR) END AS output FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query(f"SELECT n_name AS professor, CAST(k AS VARCHAR) AS record_id, input, output FROM {_SUPPLIERS} WHERE input <> ''")
def merge_workbooks(spark, sf):
    records, _, _ = uploads.merged_files(_suppliers(spark, sf), in_order=False)
    return records.toDF("professor", "record_id", "input", "output")


@query(f"""
SELECT n_name || '_All.xlsx' AS source_file, n_name AS professor_id, count(*) AS input_rows, count(*) FILTER (WHERE input <> '' AND output <> '') AS output_rows,
  count(*) FILTER (WHERE input = '' OR output = '') AS skipped_rows FROM {_SUPPLIERS} GROUP BY n_name""")
def merge_summary(spark, sf):
    return uploads.merged_files(_suppliers(spark, sf), keep_empty_output=False)[1]


#: Files of five kinds, by customer.
_KIND = ("csv", "json", "xlsx", "txt", "docx")


def _upload(suffix, name, cells):
    if suffix == "csv":
        out = io.StringIO()
        csv.writer(out).writerows([["Medical Record", "patient_id", "Outpatient Note"], *cells])
        return out.getvalue().encode("utf-8-sig")
    if suffix == "json":
        return json.dumps({"records": [{"input": a, "record_id": b, "GT": c} for a, b, c in cells]}).encode()
    if suffix == "xlsx":
        return sinks.workbook_bytes({"one": [["Professor_ID", "수술ID", "Input", "Output"], *(["P", b, a, c] for a, b, c in cells)]})
    text = "\n".join(a for a, _, _ in cells)
    return text.encode("cp949") if suffix == "txt" else sinks.document_bytes(text.split("\n"))


def _files(spark, sf) -> DataFrame:
    c, key = load(spark, sf, "customer"), F.col("c_custkey")
    suffix = F.element_at(F.array(*map(F.lit, _KIND)), (F.col("c_nationkey") % 5 + 1).cast("int"))
    cells = F.array(F.concat(F.col("c_name"), F.lit(" in "), "c_mktsegment"), F.when(key % 3 == 0, "").otherwise(key.cast("string")), F.when(key % 4 == 0, " nan").otherwise(F.lower("c_mktsegment")))
    rows = c.groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), cells.alias("c")))), lambda x: x["c"]).alias("cells"))
    rows = rows.withColumn("suffix", suffix).withColumn("name", F.concat(F.lit("up "), F.col("c_nationkey").cast("string"), F.lit("."), "suffix"))
    return _made(rows, _upload)


_CELLS = """(SELECT c_nationkey AS f, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, c_nationkey % 5 AS kind, c_name || ' in ' || c_mktsegment AS input,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE lower(c_mktsegment) END AS note FROM customer)"""
_SOURCE = "'up ' || CAST(f AS VARCHAR) || CASE kind WHEN 0 THEN '.csv' WHEN 1 THEN '.json' WHEN 2 THEN '.xlsx#one' WHEN 3 THEN '.txt' ELSE '.docx' END"


@query(f"""
SELECT CASE kind WHEN 2 THEN 'P' ELSE 'default' END AS professor, CASE WHEN id <> '' THEN id ELSE 'up_' || CAST(f AS VARCHAR) || '_' || CAST(i AS VARCHAR) END AS record_id, input, note AS output, {_SOURCE} AS source_file
FROM {_CELLS} WHERE kind < 3
UNION ALL SELECT 'default', 'up_' || CAST(f AS VARCHAR) || '_' || left(sha256('﻿' || whole), 6), whole, '', {_SOURCE}
FROM (SELECT f, kind, string_agg(input, chr(10) ORDER BY i) AS whole FROM {_CELLS} WHERE kind >= 3 GROUP BY f, kind)""")
def upload_rows(spark, sf):
    rows, _ = uploads.input_rows(_files(spark, sf), "default", "note")
    return rows.select(F.col("Professor_ID").alias("professor"), F.col("수술ID").alias("record_id"), F.col("Input").alias("input"), F.col("Output").alias("output"), F.col("Source_File").alias("source_file"))


@query(f"""
SELECT CASE WHEN id <> '' THEN id ELSE 'up_' || CAST(f AS VARCHAR) || '_' || CAST(i AS VARCHAR) END AS reference_id, input, note AS output, {_SOURCE} AS source_file, CAST(i AS VARCHAR) AS source_row
FROM {_CELLS} WHERE kind IN (0, 2) AND note <> ''
UNION ALL SELECT 'up_' || CAST(f AS VARCHAR) || '_1', '', string_agg(input, chr(10) ORDER BY i), {_SOURCE}, '1' FROM {_CELLS} WHERE kind >= 3 GROUP BY f, kind
UNION ALL SELECT 'up_' || CAST(f AS VARCHAR) || '_1', '', '{{' || chr(10) || '  "records": [' || chr(10) || string_agg(
  '    {{' || chr(10) || '      "input": "' || input || '",' || chr(10) || '      "record_id": "' || id || '",' || chr(10) || '      "GT": "' || CASE WHEN note = '' THEN ' nan' ELSE note END || '"' || chr(10) || '    }}',
  ',' || chr(10) ORDER BY i) || chr(10) || '  ]' || chr(10) || '}}', {_SOURCE}, '1' FROM {_CELLS} WHERE kind = 1 GROUP BY f, kind""")
def style_sample_rows(spark, sf):
    """All samples of all files."""
    samples, _ = uploads.style_samples(_files(spark, sf), most=1 << 30)
    return samples.select("reference_id", F.col("Input").alias("input"), F.col("Output").alias("output"), "source_file", "source_row")


@query("SELECT doc_id, text, source FROM documents")
def partial_saves(spark, sf):
    """Results saved in three parts, one of them twice, read as one."""
    folder = sinks.scratch(spark, f"partial-{uuid.uuid4().hex}")
    docs = load(spark, sf, "documents").select("doc_id", "text", "source")
    for k in (0, 1, 2, 1):
        sinks.append_partial(docs.where(F.col("doc_id") % 3 == k), folder, k)
    return spark.read.parquet(folder).select("doc_id", "text", "source")


@query("""
SELECT o_custkey AS row_index, count(*) AS n_docs FROM orders GROUP BY o_custkey""")
def json_documents(spark, sf):
    """Sorted documents of each record written as nested JSON and read again."""
    from ..operators import documents

    folder = sinks.scratch(spark, f"json-{uuid.uuid4().hex}")
    sinks.write_json_documents(documents.record_timelines(view(spark, sf, "order_rec"), "row_index"), folder)
    back = spark.read.schema("row_index long, documents array<struct<date:string>>").json(folder)
    return back.select("row_index", F.size("documents").cast("long").alias("n_docs"))


@query("""
SELECT '## ' || CAST(n_nationkey AS VARCHAR) || chr(10) || '- Region: ' || CAST(n_regionkey AS VARCHAR) || chr(10) || chr(10) || '### Name' || chr(10) || n_name || chr(10) AS value FROM nation""")
def markdown_report(spark, sf):
    return sinks.markdown(load(spark, sf, "nation"), "Nations", {"Region": "n_regionkey"}, {"Name": "n_name"}, "n_nationkey")


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || ' and more' WHEN 3 THEN NULL ELSE event_type END AS a, CASE event_id % 4 WHEN 3 THEN NULL ELSE 'z' END AS b FROM events""")
def repaired_replies(spark, sf):
    """Replies of a model: with a stray string, with words around, clean, and hopeless."""
    k, kind = F.col("event_id") % 4, F.col("event_type")
    stray, plain = F.concat(F.lit('{"a": "'), kind, F.lit('", "and  more", "b": "z"}')), F.concat(F.lit('{"a": "'), kind, F.lit('", "b": "z"}'))
    reply = F.when(k == 0, stray).when(k == 1, F.concat(F.lit("<unused7> Sure: "), plain, F.lit(" bye"))).when(k == 2, plain).otherwise('{"a": ')
    v = facts.json_object(reply)
    return load(spark, sf, "events").select("event_id", F.try_variant_get(v, "$.a", "string").alias("a"), F.try_variant_get(v, "$.b", "string").alias("b"))


@query("""
SELECT doc_id, '[OFFLINE NOTE ' || left(sha256('system' || text), 8) || ']' AS response, CAST(NULL AS VARCHAR) AS error FROM documents""")
def offline_answers(spark, sf):
    calls = load(spark, sf, "documents").select("doc_id", F.lit("system").alias("system"), F.col("text").alias("user"))
    return backends.ask(calls, backends.Config("placeholder")).select("doc_id", "response", "error")


@query("""
SELECT doc_id, 'Keep it short. ' || source AS prompt FROM documents""")
def style_sanitize(spark, sf):
    rules = F.lit(" RETURN valid JSON only. \n\n\n\n")
    text = F.concat(F.lit("  Keep it short. Ensure output is valid JSON only."), F.lit(" Output valid json only."), F.col("source"))
    shown = t.collapse(t.sanitize_style(F.concat(text, rules)))
    return load(spark, sf, "documents").select("doc_id", F.regexp_replace(shown, "short\\. +", "short. ").alias("prompt"))


@query("""
WITH x AS (SELECT professor, record_id, length(output) AS l FROM @ref),
a AS (SELECT professor, record_id, l, row_number() OVER (PARTITION BY professor ORDER BY l, record_id) AS up, count(*) OVER (PARTITION BY professor) AS n FROM x),
b AS (SELECT professor, record_id, row_number() OVER (PARTITION BY professor ORDER BY l DESC, record_id) AS down FROM a WHERE up > 1)
SELECT professor, record_id, CAST(1 AS INT) AS pick FROM a WHERE up = 1 AND n > 2 UNION ALL SELECT b.professor, b.record_id, 2 FROM b JOIN (SELECT DISTINCT professor FROM a WHERE n > 2) USING (professor) WHERE down = 1""")
def reference_select_two(spark, sf):
    """The shortest and the longest note of each professor with more than two."""
    return references.selected(references.usable(view(spark, sf, "ref")), 2).join(view(spark, sf, "ref").groupBy("professor").agg(F.count("*").alias("n")).where("n > 2"), "professor").select("professor", "record_id", "pick")


@query("""
SELECT professor, record_id, CAST(row_number() OVER (PARTITION BY professor ORDER BY record_id) AS INT) AS pick FROM @ref""")
def reference_select_all(spark, sf):
    return references.selected(references.usable(view(spark, sf, "ref")), 1 << 20)


@query("""
WITH x AS (SELECT professor, record_id, output, row_number() OVER (PARTITION BY professor ORDER BY length(output), record_id) AS k FROM @ref),
p AS (SELECT a.professor, a.record_id, b.k, b.output, row_number() OVER (PARTITION BY a.professor, a.record_id ORDER BY b.k) AS i FROM x a JOIN x b ON a.professor = b.professor AND a.record_id <> b.record_id AND b.k <= 4)
SELECT x.professor, x.record_id, coalesce(sha256(string_agg('[Reference ' || CAST(i AS VARCHAR) || ']' || chr(10) || p.output, chr(10) || chr(10) ORDER BY i)), sha256('(no reference)')) AS block_sha256
FROM x LEFT JOIN p ON p.professor = x.professor AND p.record_id = x.record_id AND i <= 3 GROUP BY x.professor, x.record_id""")
def reference_blocks(spark, sf):
    """The three shortest references of the professor but the record itself, as one text."""
    pool = view(spark, sf, "ref").withColumn("output", F.btrim("output"))
    whole = references.shortest_references(pool, 4)
    got = references.reference_blocks(view(spark, sf, "ref"), whole, 3, 1 << 30)
    return got.select("professor", "record_id", F.sha2("block", 256).alias("block_sha256"))


@query("""
SELECT p_brand AS professor, min(p_brand || ' line') AS line FROM part WHERE p_brand || ' line' IS NOT NULL GROUP BY p_brand HAVING count(*) FILTER (WHERE p_size % 50 = 7) = 0""")
def shared_openings(spark, sf):
    """The first line of notes where all of a brand share it; one note with another first line ends that."""
    first = F.when(F.col("p_size") % 50 == 7, "another").otherwise(F.concat("p_brand", F.lit(" line")))
    notes = load(spark, sf, "part").select(F.col("p_brand").alias("professor"), F.col("p_partkey").alias("row_index"), F.concat(F.lit("\n "), first, F.lit(" \n"), "p_name").alias("output"))
    return references.opening_line(notes).where("line <> 'another'")


_CALL = "'<reference>' || chr(10) || 'truth ' || CAST(doc_id AS VARCHAR) || chr(10) || '</reference>' || chr(10) || '<note>' || chr(10) || source || chr(10) || '</note>' || chr(10)"
_FAITH = "'<source>' || chr(10) || source || ' ' || CAST(doc_id AS VARCHAR) || chr(10) || '</source>' || chr(10) || '<note>' || chr(10) || source || chr(10) || '</note>' || chr(10)"


@query(f"""
WITH d AS (SELECT doc_id, source, CAST(('0x' || left(sha256('faithfulness' || {_FAITH}), 8)) AS BIGINT) AS f, CAST(('0x' || left(sha256('completeness' || {_CALL}), 8)) AS BIGINT) AS c FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS record_id, CAST(CASE WHEN f % 5 = 0 THEN 2 ELSE 3 + f % 3 END AS INT) AS likert, CASE WHEN f % 5 = 0 THEN 2 ELSE 1 END AS n_claims, CASE WHEN f % 5 = 0 THEN 1 ELSE 0 END AS n_unsupported,
  2 AS n_critical, CASE WHEN c % 4 = 0 THEN 1 ELSE 0 END AS n_absent, f % 5 <> 0 AS hallucination_free, c % 4 <> 0 AS complete_strict FROM d""")
def judge_run(spark, sf):
    """A whole judging run of one method, which is the style opponent too, by the offline judge."""
    notes = load(spark, sf, "documents").select(F.lit("only").alias("method"), F.col("doc_id").cast("string").alias("record_id"), F.col("source").alias("professor"), F.col("source").alias("note"), F.concat("source", F.lit(" "), F.col("doc_id").cast("string")).alias("source"), F.concat(F.lit("truth "), F.col("doc_id").cast("string")).alias("gt"))
    cache = spark.createDataFrame([], "key string, response string")
    verdicts, _, _ = judging.evaluate(notes, notes.select("record_id"), ["only"], "only", backends.Config(json=True), cache)
    return verdicts.select("record_id", "likert", "n_claims", "n_unsupported", "n_critical", "n_absent", "hallucination_free", "complete_strict")


@query("""
SELECT c_custkey AS k, 'none' AS note, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def required_and_default_columns(spark, sf):
    rows = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = r.with_default(r.require(rows.select(F.col("c_custkey").alias("k"), F.col("n_name").alias("name")), "k", "name"), "note", "none")
    return rows.select("k", "note", "name")


@query("""
SELECT o_orderkey AS k, o_orderpriority AS text FROM orders""")
def required_csv(spark, sf):
    """A CSV written and read again with its required columns."""
    folder = sinks.scratch(spark, f"csv-{uuid.uuid4().hex}")
    sinks.write_csv(load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("text"), F.lit("\"x\"\n").alias("more")), folder)
    back = readers.csv(spark, folder, ["k", "text"])
    return back.select(F.col("k").cast("long").alias("k"), "text")


@query("""
SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents""")
def workbook_source(spark, sf):
    """Documents written as a folder of workbooks and read again, large ones by runs of rows."""
    folder = sinks.scratch(spark, f"books-{uuid.uuid4().hex}")
    formats.save(load(spark, sf, "documents").select("doc_id", "text", "lang", "source"), "workbook", folder)
    rows = formats.workbook_parts(spark, folder, decodeEscapes="true").where("row_index >= 0")
    return rows.select(F.col("cells")["doc_id"].cast("long").alias("doc_id"), *(F.col("cells")[c].alias(c) for c in ("text", "lang", "source")))


@query("""
SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents""")
def spreadsheet_csv(spark, sf):
    """Documents written as CSV for spreadsheet programs, a byte order mark in each part, and read again."""
    folder = sinks.scratch(spark, f"marked-{uuid.uuid4().hex}")
    formats.save(load(spark, sf, "documents").select("doc_id", "text", "lang", "source"), "spreadsheet_csv", folder)
    back = readers.csv(spark, folder, ["doc_id", "text", "lang", "source"])
    return back.withColumn("doc_id", F.col("doc_id").cast("long"))


@query("""
SELECT DISTINCT 'style' AS kind, source AS key, 'prompt of ' || source AS text FROM documents UNION ALL SELECT 'common', 'global_medical_safety_prompt', 'be safe'""")
def workbook_prompts(spark, sf):
    """Common prompts and fallback styles of a workbook; rows without a text are left out."""
    names = load(spark, sf, "documents").groupBy(F.lit("book.xlsx").alias("name")).agg(F.transform(F.array_sort(F.collect_set("source")), lambda s: F.array(s)).alias("cells"))
    make = lambda suffix, name, cells: sinks.workbook_bytes({"Common_Prompts": [["key", "prompt_text"], ["global_medical_safety_prompt", "be safe"], ["compact_specialty_rule_pack", ""]], "Sheet1": [["professor", "style_prompt"], *([c[0], f"prompt of {c[0]}"] for c in cells)]})
    found = _made(names.withColumn("suffix", F.lit("xlsx")), make)
    return readers.prompts(readers.workbooks(found, first_sheet=False))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'style_prompt lacks: ' ELSE '' END AS lacks FROM part""")
def style_duties(spark, sf):
    """Whether a style prompt says what it must."""
    duty = F.lit(n.DUTIES[0][1])
    prompt = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" "), duty))
    keys = F.array(*map(F.lit, n.STYLE_KEYS))
    found = n.style_warnings(keys, prompt, F.lit(0.0), F.lit("p"), F.lit("p"))
    lacks = F.exists(found, lambda x: F.contains(x, F.lit(n.DUTIES[0][0])))
    return load(spark, sf, "part").select("p_partkey", F.when(lacks, "style_prompt lacks: ").otherwise("").alias("lacks"))
