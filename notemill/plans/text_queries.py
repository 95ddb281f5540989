"""Queries on scalar text functions, uploads and record tables."""

from __future__ import annotations

import uuid

import random

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import records as r
from ..sources import readers, sinks
from .adapters import load, view
from .catalogue import query

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""
SELECT professor, record_id, sha256(trim(input, {_WS})) AS input_sha256, trim(output, {_WS}) AS output FROM @rec
WHERE trim(input, {_WS}) <> '' AND trim(output, {_WS}) <> ''""")
def merge_records(spark, sf):
    out = r.merged(view(spark, sf, "rec"), keep_empty_output=False)
    return out.select("professor", "record_id", F.sha2("input", 256).alias("input_sha256"), "output").orderBy("professor", "record_id")


@query("""
SELECT count(*) AS n_rows, count(DISTINCT source) AS n_professors, count(*) AS n_pairs, CAST(0 AS BIGINT) AS n_repeated,
       CAST(sum(CAST(l.toxic IS NULL AS INT)) AS BIGINT) AS null_cells
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def merge_metrics(spark, sf):
    rec = load(spark, sf, "documents").join(load(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return r.merge_metrics(rec.select(F.col("source").alias("professor"), F.col("doc_id").alias("record_id"), "text", "toxic"))


_MESSY = "CASE event_id % 5 WHEN 0 THEN ' nan ' WHEN 1 THEN 'None' WHEN 2 THEN '  a\\\\nb ' || event_type || '\\\\t' WHEN 3 THEN NULL ELSE props END"


@query("""
SELECT event_id, CASE event_id % 5 WHEN 2 THEN 'a' || chr(10) || 'b ' || event_type || chr(9) WHEN 4 THEN props ELSE '' END AS cleaned,
  CASE event_id % 5 WHEN 2 THEN 'a\\nb ' || event_type || '\\t' WHEN 4 THEN props ELSE '' END AS kept FROM events""".replace("\\\\", "\\"))
def clean_scalar(spark, sf):
    rows = load(spark, sf, "events").withColumn("messy", F.expr(_MESSY))
    return rows.select("event_id", t.clean_scalar("messy").alias("cleaned"), t.clean_scalar("messy", unescaped=False).alias("kept"))


@query(f"SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\\s\\v]+', ' ', 'g'), {_WS})) AS normalized_sha256 FROM documents")
def match_normalize(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.sha2(t.match_normalize("text"), 256).alias("normalized_sha256"))


def _cut(limit: int) -> str:
    left, right = limit // 2, max(0, limit - limit // 2 - 32)
    end = f"ltrim(right(t, {right}), {_WS})" if right else "''"
    return f"CASE WHEN length(t) <= {limit} THEN t ELSE rtrim(left(t, {left}), {_WS}) || chr(10) || '...[TRUNCATED]...' || chr(10) || {end} END"


@query(f"""
SELECT doc_id, {_cut(200)} AS cut_200, {_cut(65)} AS cut_65, {_cut(64)} AS cut_64, '' AS cut_0, CAST(length(t) AS BIGINT) AS whole_chars
FROM (SELECT doc_id, trim(text, {_WS}) AS t FROM documents)""")
def truncate_middle(spark, sf):
    cut = lambda n, **kw: t.truncate_middle("text", n, unescaped=False, **kw)
    return load(spark, sf, "documents").select("doc_id", *(cut(n).alias(f"cut_{n}") for n in (200, 65, 64, 0)), F.length(cut(0, unlimited=True)).cast("long").alias("whole_chars"))


@query(f"""
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(ls[1], '') AS first_line, CAST(coalesce(list_max(list_transform(ls, lambda x: length(x))), 0) AS BIGINT) AS longest
FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r\\v\\f]'), lambda x: trim(x, {_WS})), lambda x: x <> '') AS ls FROM documents)""")
def line_stats(spark, sf):
    found = load(spark, sf, "documents").select("doc_id", t.lines("text").alias("ls"))
    return found.select("doc_id", F.size("ls").cast("long").alias("n_lines"), F.coalesce(F.get("ls", F.lit(0)), F.lit("")).alias("first_line"), F.coalesce(F.array_max(F.transform("ls", F.length)), F.lit(0)).cast("long").alias("longest"))


@query(f"SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN '' ELSE trim(text, {_WS}) END AS note FROM conversations")
def strip_thinking(spark, sf):
    wrapped = F.expr("CASE turn % 3 WHEN 0 THEN '<think>plan\\n' || role || '</THINK>\\n```json\\n' || text || '\\n```' WHEN 1 THEN text ELSE '<Think>never closed ' || text END")
    return load(spark, sf, "conversations").select("conv_id", "turn", t.strip_thinking(wrapped).alias("note"))


@query(f"""
SELECT conv_id, turn, trim(text, {_WS}) AS note, CASE turn % 4 WHEN 0 THEN 'unwrapped JSON field: note' WHEN 1 THEN 'unwrapped single-string JSON object' WHEN 2 THEN 'unwrapped JSON string' END AS warning
FROM conversations""")
def unwrap_note_json(spark, sf):
    c = load(spark, sf, "conversations")
    kinds = (F.to_json(F.struct(F.col("text").alias("note"), "role")), F.to_json(F.struct(F.col("text").alias("said"), "turn")), F.regexp_extract(F.to_json(F.struct(F.col("text").alias("x"))), "(?s)^\\{\"x\":(.*)\\}$", 1))
    reply = F.when(F.col("turn") % 4 == 0, kinds[0]).when(F.col("turn") % 4 == 1, kinds[1]).when(F.col("turn") % 4 == 2, kinds[2]).otherwise(F.col("text"))
    return c.select("conv_id", "turn", t.unwrap_note(reply).alias("n")).select("conv_id", "turn", "n.note", "n.warning")


_PAGE = "replace(replace(replace(trim(html, {ws}), '\\r\\n', chr(10)), '\\n', chr(10)), '\\t', chr(9))".replace("{ws}", _WS)


@query(f"""
SELECT page_id, 'default' AS professor, 'page_' || CAST(page_id AS VARCHAR) || '_' || left(sha256('﻿' || {_PAGE}), 6) AS record_id,
       sha256({_PAGE}) AS input_sha256 FROM pages WHERE trim(html, {_WS}) <> ''""")
def html_as_text_row(spark, sf):
    files = load(spark, sf, "pages").select("page_id", F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.col("html").alias("text"))
    out = r.text_rows(files)
    number = F.regexp_extract("source_file", "\\d+", 0).cast("long")
    return out.select(number.alias("page_id"), "professor", "record_id", F.sha2("input", 256).alias("input_sha256"))


@query("""
SELECT doc_id, CASE WHEN text = '' THEN '' ELSE '[redacted, ' || CAST(length(text) AS VARCHAR) || ' chars]' END AS text, source FROM documents ORDER BY doc_id LIMIT 100""")
def redact_preview(spark, sf):
    """A preview shows the first 100 rows."""
    return load(spark, sf, "documents").orderBy("doc_id").limit(100).select("doc_id", t.redacted("text").alias("text"), "source")


@query(f"""
SELECT doc_id, left(CASE WHEN s = '' THEN 'run' ELSE s END, 64) AS slug, left(sha256('﻿' || text), 10) AS short_hash
FROM (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(trim(text, {_WS}), '[\\s\\v]+', '_', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}_.-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS s FROM documents)""")
def slug_ids(spark, sf):
    return load(spark, sf, "documents").select("doc_id", t.slug("text").alias("slug"), t.short_hash("text").alias("short_hash"))


@query("""
SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'q' || CAST(d.doc_id AS VARCHAR) WHEN d.doc_id % 2 = 0 THEN d.source ELSE CAST(d.doc_id AS VARCHAR) END AS record_id
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def record_id_coalesce(spark, sf):
    rows = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")
    first = F.when(F.col("quality") == 1, F.concat(F.lit("q"), F.col("doc_id").cast("string"))).otherwise(" nan ")
    rows = rows.select(first.alias("record_id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("visit_id"), "doc_id")
    return rows.select("doc_id", r.record_id(rows).alias("record_id"))


@query("""
SELECT '[Source table: nation]' || chr(10) || chr(10) || string_agg('Row ' || CAST(n_nationkey + 1 AS VARCHAR) || chr(10) || '- n_nationkey: ' || CAST(n_nationkey AS VARCHAR) || chr(10)
  || '- n_name: ' || n_name || chr(10) || '- n_regionkey: ' || CAST(n_regionkey AS VARCHAR), chr(10) || chr(10) ORDER BY n_nationkey) AS text FROM nation""")
def table_to_text(spark, sf):
    return r.table_text(load(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), "nation", "n_nationkey")


@query("""
SELECT min(doc_id) AS row_index, text, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY text""")
def keep_first_dedup(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("row_index"), "text")
    return r.keep_first(docs, "text", "row_index", "n").select("row_index", "text", "n")


@query("""
SELECT doc_id AS row_index, 'range' AS part FROM documents WHERE doc_id >= 20 AND doc_id < 70
UNION ALL SELECT doc_id, 'head' FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 15)""")
def row_range(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("row_index"))
    return r.row_range(docs, 20, 50).withColumn("part", F.lit("range")).unionByName(r.head(docs, 15).withColumn("part", F.lit("head")))


@query("SELECT professor, record_id FROM @rec WHERE output = ''")
def resume_anti_join(spark, sf):
    rec = view(spark, sf, "rec")
    return r.pending(rec, rec.where("output <> ''"), "professor", "record_id").select("professor", "record_id")


@query("""
SELECT professor, record_id FROM (SELECT professor, record_id, row_number() OVER (PARTITION BY professor ORDER BY sha256('1225:' || professor || ':' || record_id), record_id) AS k FROM @rec) WHERE k <= 10""")
def hash_sample(spark, sf):
    return r.hash_sample(view(spark, sf, "rec"), "professor", "record_id", 10, 1225)


#: Places that Python's generator draws, for the professors and the sizes of the small tables.
_DRAWN = ", ".join(f"('src{i}', {size}, {sorted(random.Random(f'1225:src{i}').sample(range(size), 10))})" for i in range(20) for size in (50,))


@query(f"""
SELECT professor, record_id FROM (SELECT professor, record_id, row_number() OVER (PARTITION BY professor ORDER BY record_id) - 1 AS k, count(*) OVER (PARTITION BY professor) AS n FROM (SELECT DISTINCT professor, record_id FROM @rec)) x
LEFT JOIN (VALUES {_DRAWN}) d(p, size, places) ON p = professor AND size = n WHERE n <= 10 OR list_contains(places, k)""")
def seeded_sample(spark, sf):
    return r.seeded_sample(view(spark, sf, "rec"), "professor", "record_id", 10, 1225)


@query("SELECT doc_id, nfc_normalize(text || 'e' || chr(769) || ' ' || chr(4352) || chr(4449)) AS normal FROM documents")
def nfc_text(spark, sf):
    return load(spark, sf, "documents").select("doc_id", t.nfc(F.concat("text", F.lit("é 가"))).alias("normal"))


@query("""
SELECT page_id, right(html, 200) AS tail, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped,
  CASE page_id % 4 WHEN 0 THEN 'text/csv' WHEN 1 THEN 'application/x-ndjson' WHEN 2 THEN 'application/json' ELSE 'application/octet-stream' END AS mime FROM pages""")
def string_utilities(spark, sf):
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, (".CSV", ".jsonl", ".json", ".html"))), (F.col("page_id") % 4 + 1).cast("int")))
    return load(spark, sf, "pages").select("page_id", t.tail("html", 200).alias("tail"), t.html_escape("html").alias("escaped"), t.mime(name).alias("mime"))


@query("""
SELECT record_id, professor, (SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM documents) AS professors FROM @rec WHERE professor = 'src3'""")
def professor_filter(spark, sf):
    rec = view(spark, sf, "rec")
    names = rec.agg(F.array_join(F.array_sort(F.collect_set("professor")), ",").alias("professors"))
    return rec.where(t.clean_scalar("professor") == "src3").select("record_id", "professor").crossJoin(F.broadcast(names))  # one row


@query(f"""
SELECT 'docs.csv' AS source_file, CAST(doc_id AS VARCHAR) AS record_id, sha256(replace(replace(trim(text, {_WS}), '\\n', chr(10)), '\\t', chr(9))) AS input_sha256 FROM documents WHERE trim(text, {_WS}) <> ''
UNION ALL SELECT 'pages.csv', 'pages_' || CAST(page_id + 1 AS VARCHAR), sha256(replace(replace(trim(html, {_WS}), '\\n', chr(10)), '\\t', chr(9))) FROM pages WHERE trim(html, {_WS}) <> ''""")
def union_uploads(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("row_index"), F.col("doc_id").cast("string").alias("record_id"), F.col("text").alias("Input"))
    pages = load(spark, sf, "pages").select(F.col("page_id").alias("row_index"), F.col("html").alias("medical_record"))
    both = r.upload_rows(docs, "docs.csv", "p").unionByName(r.upload_rows(pages, "pages.csv", "p"), allowMissingColumns=True)
    return both.select("source_file", "record_id", F.sha2("input", 256).alias("input_sha256"))


@query("""
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+tion'))), ',') AS terms FROM documents""")
def sorted_terms(spark, sf):
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+tion"), F.lit(0))))
    return load(spark, sf, "documents").select("doc_id", F.array_join(found, ",").alias("terms"))


@query("SELECT event_id, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events")
def json_rows(spark, sf):
    lines = load(spark, sf, "events").select("event_id", F.concat(F.lit('{"rows":['), "props", F.lit("]}")).alias("json"))
    rows = readers.json_records(lines, "json")
    return rows.select("event_id", F.variant_get("record", "$.k", "long").alias("k"))


@query("""
SELECT doc_id, sha256(text) AS text_sha256, lang, source FROM documents UNION ALL
SELECT doc_id, sha256(text), lang, source FROM documents""")
def csv_json_roundtrip(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source")
    folder = sinks.scratch(spark, f"roundtrip-{uuid.uuid4().hex}")
    sinks.write_csv(docs, f"{folder}/csv")
    sinks.write_jsonl(docs, f"{folder}/jsonl")
    back = readers.csv(spark, f"{folder}/csv", docs.columns).unionByName(readers.jsonl(spark, f"{folder}/jsonl", docs.columns))
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias("text_sha256"), "lang", "source")


@query()
def upload_manifest(spark, sf):
    return readers.manifest(readers.files(spark, sf, "*.parquet"))
