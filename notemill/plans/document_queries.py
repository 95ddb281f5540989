"""Queries on source documents: split, dated, ranked, sorted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, rules
from ..functions.text import match_normalize
from ..operators import documents as d
from .adapters import load, view
from .catalogue import query

#: The documents of order_rec told from the columns of orders.
_ORDERS = """
SELECT o_custkey AS row_index, CAST(n AS BIGINT) AS doc_no, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS day, o_orderstatus AS s,
  CASE o_orderstatus WHEN 'F' THEN 'Operative Report' WHEN 'O' THEN 'Preoperative Outpatient Note' ELSE 'Discharge Summary' END AS kind,
  CASE o_orderstatus WHEN 'F' THEN 40 WHEN 'O' THEN 20 ELSE 50 END AS phase,
  CASE o_orderstatus WHEN 'F' THEN '수술일 ' WHEN 'O' THEN 'visit ' ELSE '퇴원일 ' END AS word
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) n FROM orders)
"""
_RAW = "'[' || CAST(doc_no AS VARCHAR) || '] ' || kind || ': {{ ' || word || day || ' }}'"


def _orders(spark, sf):
    return d.dated(d.split_documents(view(spark, sf, "order_rec"), "row_index"))


@query(f"""
SELECT row_index, count(*) AS n_docs, string_agg(day, ',' ORDER BY phase, day, doc_no) AS dates,
       string_agg({_RAW}, chr(10) || chr(10) ORDER BY phase, day, doc_no) AS timeline
FROM ({_ORDERS}) GROUP BY row_index""")
def timeline_sort(spark, sf):
    out = d.record_timelines(view(spark, sf, "order_rec"), "row_index")
    days = F.array_join(F.transform("documents", lambda x: x["date"]), ",")
    return out.select("row_index", F.col("n_docs").cast("long").alias("n_docs"), days.alias("dates"), "timeline")


@query("""
SELECT conv_id AS row_index, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS doc_no, turn + 1 AS source_index,
  CASE role WHEN 'system' THEN 'Discharge Summary' WHEN 'assistant' THEN 'Operative Report' ELSE 'Initial Consultation Note' END AS document_type,
  trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS body
FROM conversations WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def split_documents(spark, sf):
    out = d.split_documents(view(spark, sf, "conv_rec"), "row_index")
    return out.select("row_index", F.col("doc_no").cast("long").alias("doc_no"), F.col("source_index").cast("long").alias("source_index"), "document_type", "body")


@query("""
SELECT row_index, CAST(1 AS BIGINT) AS doc_no, 'Raw Input' AS document_type, CAST(length(input) AS BIGINT) AS n_chars, sha256(input) AS text_sha256
FROM @conv_rec""")
def whole_record_chunk(spark, sf):
    out = d.split_documents(view(spark, sf, "conv_rec"), "row_index", whole=True)
    return out.select("row_index", F.col("doc_no").cast("long").alias("doc_no"), "document_type", F.length("raw_text").cast("long").alias("n_chars"), F.sha2("raw_text", 256).alias("text_sha256"))


@query(f"SELECT row_index, doc_no, kind AS document_type, CAST(phase AS BIGINT) AS phase_rank FROM ({_ORDERS})")
def document_phase_rank(spark, sf):
    out = d.split_documents(view(spark, sf, "order_rec"), "row_index")
    return out.select("row_index", F.col("doc_no").cast("long").alias("doc_no"), "document_type", rules.phase_rank(F.col("document_type")).cast("long").alias("phase_rank"))


@query(f"SELECT row_index, doc_no, CAST(1 AS BIGINT) AS mention_no, day AS normalized_date, day AS raw_text FROM ({_ORDERS})")
def date_mentions_iso(spark, sf):
    out = _orders(spark, sf).select("row_index", "doc_no", F.posexplode("mentions").alias("k", "m"))
    return out.select("row_index", F.col("doc_no").cast("long").alias("doc_no"), (F.col("k") + 1).cast("long").alias("mention_no"), "m.normalized_date", "m.raw_text")


@query(f"""
SELECT row_index, doc_no, normalized_date, raw_text, role FROM ({_ORDERS}) o, LATERAL (VALUES
  (day, day, 'comparison_date'),
  (CAST(CAST(day AS DATE) + 1 AS VARCHAR), replace(CAST(CAST(day AS DATE) + 1 AS VARCHAR), '-', ' '), 'study_date'),
  (CAST(make_date(year(CAST(day AS DATE) + 1), month(CAST(day AS DATE) + 2), day(CAST(day AS DATE) + 2)) AS VARCHAR), CAST(month(CAST(day AS DATE) + 2) AS VARCHAR) || '.' || CAST(day(CAST(day AS DATE) + 2) AS VARCHAR) || ' (year inferred)', 'date_mention')
) v(normalized_date, raw_text, role) """)
def date_mentions_full(spark, sf):
    """Texts with a dashed, a spaced and a bracketed date, far enough apart not to share contexts. The bracketed one has the
    year of the date before it, also where it follows the year's end."""
    o = d.split_documents(view(spark, sf, "order_rec"), "row_index").withColumn("day", F.to_date(F.regexp_extract("raw_text", "\\d{4}-\\d{2}-\\d{2}", 0)))
    gap = F.lit(" " + "word " * 40)
    later = F.date_add("day", 2)
    text = F.concat(F.lit("2024-13-40"), gap, F.lit("compared with "), F.date_format("day", "yyyy-MM-dd"), gap, F.lit("pft of "), F.date_format(F.date_add("day", 1), "yyyy MM dd"), gap, F.lit("again ("), F.month(later), F.lit("."), F.dayofmonth(later), F.lit(")"))
    found = o.select("row_index", "doc_no", F.explode(dates.all_mentions(text, F.lit("Note"))).alias("m"))
    return found.select("row_index", F.col("doc_no").cast("long").alias("doc_no"), "m.normalized_date", "m.raw_text", "m.role")


@query(f"SELECT row_index, doc_no, CASE s WHEN 'F' THEN 'operation_date' WHEN 'O' THEN 'date_mention' ELSE 'discharge_date' END AS role FROM ({_ORDERS})")
def date_roles(spark, sf):
    return _orders(spark, sf).select("row_index", F.col("doc_no").cast("long").alias("doc_no"), F.explode("mentions.role").alias("role"))


@query(f"""
SELECT row_index, doc_no, day AS document_date, 'explicit_document_date' AS sort_group,
  CASE s WHEN 'F' THEN 'explicit_operation_date' WHEN 'O' THEN 'fallback_date_mention' ELSE 'explicit_discharge_date' END AS date_confidence
FROM ({_ORDERS})""")
def document_date_pick(spark, sf):
    return _orders(spark, sf).select("row_index", F.col("doc_no").cast("long").alias("doc_no"), "document_date", "date_confidence", "sort_group")


@query("""
SELECT o_orderkey, o_orderkey % 2 = 0 AS slashed, o_orderkey % 2 = 0 AS short, o_orderkey % 2 = 1 AS next_day, o_orderkey % 2 = 0 AS month_only FROM orders""")
def date_variant_support(spark, sf):
    """Dates in evidence of the day itself (even keys) or of the day after, in other spellings; the month alone in the same or the next year."""
    o = load(spark, sf, "orders")
    odd = (F.col("o_orderkey") % 2).cast("int")
    claim, day = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_add("o_orderdate", odd)
    yy = F.substring(F.year(day).cast("string"), 3, 2)
    short = F.concat_ws(".", yy, F.month(day).cast("string"), F.dayofmonth(day).cast("string"))
    seen = lambda c, e: dates.date_supported(c, match_normalize(F.concat(F.lit("Visit ON "), e, F.lit(" noted"))))
    month = F.concat((F.year("o_orderdate") + odd).cast("string"), F.lit("."), F.date_format("o_orderdate", "MM"))
    return o.select("o_orderkey", seen(claim, F.date_format(day, "yyyy/MM/dd")).alias("slashed"), seen(claim, short).alias("short"), seen(F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd"), F.date_format(day, "yyyy.MM.dd")).alias("next_day"), seen(F.date_format("o_orderdate", "yyyy-MM"), month).alias("month_only"))


@query(f"""
SELECT row_index, doc_no, CASE s WHEN 'F' THEN day WHEN 'O' THEN CAST(make_date(year(CAST(day AS DATE)), month(CAST(day AS DATE) + 1), day(CAST(day AS DATE) + 1)) AS VARCHAR) ELSE '20' || substr(day, 3) END AS document_date,
  CASE s WHEN 'F' THEN 'explicit_operation_date' WHEN 'O' THEN 'explicit_note_date' ELSE 'explicit_discharge_date' END AS date_confidence,
  CAST(2 AS BIGINT) AS n_mentions,
  CASE s WHEN 'F' THEN 'comparison_date,operation_date' WHEN 'O' THEN 'comparison_date,note_date' ELSE 'prior_measurement_date,discharge_date' END AS roles
FROM ({_ORDERS})""")
def document_date_spellings(spark, sf):
    """The representative date where a day stands twice in two roles (operations), with six digits (discharges), or in brackets
    with its year elsewhere (visits)."""
    o = d.split_documents(view(spark, sf, "order_rec"), "row_index").withColumn("day", F.to_date(F.regexp_extract("raw_text", "\\d{4}-\\d{2}-\\d{2}", 0)))
    day, gap, kind = F.date_format("day", "yyyy-MM-dd"), F.lit(" " + "word " * 40), F.col("document_type")
    after = F.date_add("day", 1)
    text = (
        F.when(F.contains(kind, F.lit("Operative")), F.concat(F.lit("compared with "), day, gap, F.lit("수술일 "), day, gap, F.lit("compared with "), day))
        .when(F.contains(kind, F.lit("Discharge")), F.concat(F.lit("weight on "), F.date_format("day", "yyyy MM dd"), gap, F.lit("퇴원일 "), F.date_format("day", "yyMMdd")))
        .otherwise(F.concat(F.lit("compared with "), day, gap, F.lit("통화 ("), F.month(after), F.lit("."), F.dayofmonth(after), F.lit(")")))
    )
    out = d.dated(o.select("row_index", "doc_no", "document_type", text.alias("raw_text")))
    return out.select("row_index", F.col("doc_no").cast("long").alias("doc_no"), "document_date", "date_confidence", F.size("mentions").cast("long").alias("n_mentions"), F.array_join("mentions.role", ",").alias("roles"))
