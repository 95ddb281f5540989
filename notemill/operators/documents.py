"""Source documents of a record: split, dated, ranked by clinical phase and put in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, rules
from ..functions.text import collapse, trim

#: The header of a document, [n] Type: {{ at the start of a line.
HEADER = "\\[(\\d+)\\]\\s+([^:\\n]+):\\s*\\{\\{"
UNKNOWN, WHOLE = "Unknown Document", "Raw Input"


def body_of(raw: Column) -> Column:
    """Inside the first {{ and a }} that ends the text, if it does; the whole text without {{."""
    inner = F.regexp_extract(raw, "(?s)\\{\\{(.*)\\z", 1)
    return trim(F.when(F.contains(raw, F.lit("{{")), F.regexp_replace(inner, "(?sU)\\}\\}\\s*\\z", "")).otherwise(raw))


def split_text(text: Column) -> Column:
    """array<struct<source_index, document_type, raw_text>> in order: text before the first header and documents without a
    body are left out; a text without headers is one document of unknown type, a blank text none."""
    pieces = F.filter(F.split(text, f"(?:^|\\n)(?={HEADER})", -1), lambda p: F.rlike(p, F.lit(f"^{HEADER}")))

    def one(piece: Column) -> Column:
        kind = trim(collapse(F.regexp_extract(piece, f"^{HEADER}", 2)))
        index = F.regexp_extract(piece, f"^{HEADER}", 1).try_cast("int")
        return F.struct(index.alias("source_index"), F.when(kind == "", UNKNOWN).otherwise(kind).alias("document_type"), trim(piece).alias("raw_text"))

    found = F.filter(F.transform(pieces, one), lambda d: body_of(d["raw_text"]) != "")
    alone = F.array(F.struct(F.lit(None).cast("int").alias("source_index"), F.lit(UNKNOWN).alias("document_type"), trim(text).alias("raw_text")))
    return F.when(F.size(pieces) > 0, found).when(trim(text) != "", alone).otherwise(F.filter(alone, lambda d: F.lit(False)))


def whole_text(text: Column) -> Column:
    """The record as its only document."""
    alone = F.array(F.struct(F.lit(None).cast("int").alias("source_index"), F.lit(WHOLE).alias("document_type"), trim(text).alias("raw_text")))
    return F.when(trim(text) != "", alone).otherwise(F.filter(alone, lambda d: F.lit(False)))


def split_documents(records: DataFrame, key: str, text: str = "input", whole: bool = False) -> DataFrame:
    """One row a document: key, doc_no (from 1, after empty ones went), source_index, document_type, raw_text, body."""
    docs = (whole_text if whole else split_text)(F.coalesce(F.col(text), F.lit("")))
    rows = records.select(F.col(key), F.posexplode(docs).alias("pos", "doc"))
    return rows.select(key, (F.col("pos") + 1).alias("doc_no"), "doc.*").withColumn("body", body_of(F.col("raw_text")))


def dated(documents: DataFrame) -> DataFrame:
    """documents with mentions, document_date, date_confidence, date_source, phase_rank, sort_group."""
    kind, raw = F.col("document_type"), F.col("raw_text")
    out = documents.withColumn("mentions", dates.all_mentions(raw, kind))
    out = out.withColumn("_date", dates.document_date(F.col("mentions"), kind))
    group = F.when(F.col("document_date").isNotNull(), "explicit_document_date").otherwise("undated_clinical_fallback")
    return out.select("*", "_date.*").drop("_date").withColumn("phase_rank", rules.phase_rank(kind)).withColumn("sort_group", group)


def sorted_timelines(documents: DataFrame, key: str) -> DataFrame:
    """One row a record: n_docs, documents (sorted by phase, dated before undated, date, order) and timeline, their raw
    texts with a blank line between. The groups are records; order is an array sort, not a global one."""
    fields = [F.col("phase_rank"), F.col("document_date").isNull().alias("undated"), F.coalesce("document_date", F.lit("")).alias("date"), F.col("doc_no"), F.col("document_type"), F.col("date_confidence"), F.col("sort_group"), F.col("raw_text")]
    out = documents.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("documents"))
    timeline = F.array_join(F.transform("documents", lambda d: d["raw_text"]), "\n\n")
    return out.select(key, F.size("documents").alias("n_docs"), "documents", timeline.alias("timeline"))


def record_timelines(records: DataFrame, key: str, text: str = "input") -> DataFrame:
    """The whole path: split, date, rank and sort."""
    return sorted_timelines(dated(split_documents(records, key, text)), key)
