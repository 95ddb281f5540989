"""Queries on extracted facts: parsing, categories, guardrails, roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import text_hash
from ..operators import backends, bundles, facts as f, pipeline
from .adapters import load, view
from .catalogue import query

#: The facts told from lineitem and part.
_LINES = """
SELECT l_orderkey AS row_index, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k,
  CASE l_linenumber % 4 WHEN 0 THEN 'Operation' WHEN 1 THEN 'Medication' WHEN 2 THEN 'Unlisted' ELSE 'Other' END AS category,
  p_type AS fact, p_name AS evidence FROM lineitem JOIN part ON p_partkey = l_partkey
"""


def _facts(spark, sf):
    v = F.try_parse_json("extracted_facts")  # text that the adapter wrote: no strict parse needed
    return view(spark, sf, "fact").withColumn("facts", f.typed_facts(f.fact_list(v)))


@query(f"SELECT row_index, k AS fact_no, category, fact, evidence, CAST(NULL AS VARCHAR) AS error FROM ({_LINES})")
def parse_facts(spark, sf):
    parsed = view(spark, sf, "fact").select("row_index", f.parse_facts("extracted_facts", trusted=True).alias("p"))
    rows = parsed.select("row_index", "p.error", F.posexplode(f.typed_facts(F.col("p.items"))).alias("k", "f"))
    return rows.select("row_index", (F.col("k") + 1).cast("long").alias("fact_no"), "f.category", "f.fact", "f.evidence", "error")


@query(f"SELECT row_index, k AS fact_no, category, fact, evidence FROM ({_LINES}) WHERE k <= 3")
def compact_facts(spark, sf):
    rows = _facts(spark, sf).select("row_index", F.posexplode(f.compact_facts(F.col("facts"), 260, 3)).alias("k", "f"))
    return rows.select("row_index", (F.col("k") + 1).cast("long").alias("fact_no"), "f.category", "f.fact", "f.evidence")


def _rules_sql(text: str, table, default: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains({text}, {chr(39)}{t}{chr(39)})' for t in terms)} THEN '{name}'" for name, terms in table)
    return f"CASE {cases} ELSE {default} END"


_TEXT = "lower(fact || ' ' || evidence)"
_PLAN = f"CASE WHEN {' OR '.join(f'contains({_TEXT}, {chr(39)}{t}{chr(39)})' for t in rules.PLAN_TERMS)} THEN 'Discharge Plan' ELSE 'Other' END"
_CATEGORY = f"CASE WHEN category = 'Unlisted' THEN {_rules_sql(_TEXT, rules.INFERENCES, _PLAN)} ELSE {_rules_sql(_TEXT, rules.CORRECTIONS, 'category')} END"


@query(f"SELECT category, count(*) AS n_facts, count(DISTINCT row_index) AS n_records FROM (SELECT row_index, {_CATEGORY} AS category FROM ({_LINES})) GROUP BY category")
def fact_categories(spark, sf):
    rows = _facts(spark, sf).select("row_index", F.explode(f.with_categories(F.col("facts"), F.lit("Note"))["category"]).alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("n_facts"), F.count_distinct("row_index").alias("n_records"))


@query(f"""
SELECT row_index, '## Unknown Document' || chr(10) || string_agg(CAST(k AS VARCHAR) || '. [' || category || '] [Unknown date] ' || fact, chr(10) ORDER BY k) AS readable FROM ({_LINES}) GROUP BY row_index""")
def facts_readable(spark, sf):
    return _facts(spark, sf).select("row_index", f.readable(F.col("facts")).alias("readable"))


def _marked(spark, sf):
    """Facts some of which mention what is pruned, and a source that has hypertension for even records."""
    mark = lambda x, i: F.when(i % 3 == 1, F.concat(x["fact"], F.lit(" Weight 70"))).when(i % 3 == 2, F.concat(x["fact"], F.lit(" HTN"))).otherwise(x["fact"])
    marked = F.transform("facts", lambda x, i: x.withField("fact", mark(x, i)))
    source = F.when(F.col("row_index") % 2 == 0, "History of hypertension").otherwise("No history")
    return _facts(spark, sf).select("row_index", marked.alias("facts"), source.alias("source"))


@query(f"""
SELECT row_index, count(*) FILTER (WHERE NOT (contains(t, 'weight') OR contains(t, 'wt:') OR contains(t, 'bmi')
  OR ((contains(t, 'htn') OR contains(t, 'hypertension') OR contains(t, 'arb')) AND row_index % 2 = 1))) AS n_kept, count(*) AS n_facts
FROM (SELECT row_index, lower(fact || CASE (k - 1) % 3 WHEN 1 THEN ' Weight 70' WHEN 2 THEN ' HTN' ELSE '' END || ' ' || evidence) AS t FROM ({_LINES})) GROUP BY row_index""")
def prune_facts(spark, sf):
    kept = f.pruned(F.col("facts"), F.col("source"))
    return _marked(spark, sf).select("row_index", F.size(kept).cast("long").alias("n_kept"), F.size("facts").cast("long").alias("n_facts"))


@query("""
SELECT row_index, CASE row_index % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 1 END AS n_added,
  CASE row_index % 4 WHEN 0 THEN 'No mucosal injury occurred.|A 20 Fr chest tube was placed.' WHEN 1 THEN 'Chest CT noted left upper lobe ground-glass opacities.'
    WHEN 2 THEN '' ELSE 'Azygos vein was divided intraoperatively.' END AS added FROM (SELECT DISTINCT l_orderkey AS row_index FROM lineitem)""")
def complete_facts(spark, sf):
    row = F.col("row_index") % 4
    source = F.when(row == 0, "Mucosal injury: none. Chest tube (20 Fr. straight) is placed").when(row == 1, "LUL GGOs seen").when(row == 2, "chest tube (20 fr").otherwise("Azygos vein: divided")
    kind = F.when(row == 2, "Discharge Summary").otherwise("Operative Report")
    rows = _facts(spark, sf).withColumn("more", f.completed(F.col("facts"), kind, source))
    added = F.slice("more", F.size("facts") + 1, F.greatest(F.size("more") - F.size("facts"), F.lit(0)))
    return rows.select("row_index", (F.size("more") - F.size("facts")).alias("n_added"), F.array_join(F.transform(added, lambda x: x["fact"]), "|").alias("added"))


def _verified(spark, sf):
    """judge_note as verifications: counts become lists."""
    items = lambda c, text: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(i <= F.col(c), F.lit(text)))
    texts = lambda c, text: F.array_compact(items(c, text)).cast("array<string>")
    missing = F.transform(texts("n_absent", "finding"), lambda x: F.struct(F.when(F.col("n_partial") == 1, "critical").otherwise("minor").alias("severity"), x.alias("fact"), F.lit("x").alias("evidence")))
    none = F.array().cast("array<string>")
    v = F.struct(F.lit("DRAFT").alias("verdict"), (F.col("likert") / 5.0).alias("coverage_score"), ((F.col("likert") + 1) / 6.0).alias("evidence_support_score"), texts("n_unsupported", "on arb").alias("unsupported_facts"), none.alias("plain_unsupported"), missing.alias("missing_facts"), none.alias("contradictions"), none.alias("date_errors"), F.array().cast(f.VERIFICATION["clinical_accuracy_issues"]).alias("clinical_accuracy_issues"), F.lit("").alias("feedback"))
    return view(spark, sf, "judge_note").select("method", "record_id", "professor", "likert", "n_unsupported", "n_absent", "n_partial", "n_mixing", "k", v.alias("v"))


#: n_mixing = 1 marks notes whose source mentions what the unsupported facts are about; k % 9 says which rule of operative
#: reports, or of lung function, the source calls for, n_partial = 1 that the facts have what it asks for.
_RULE = "CASE WHEN k % 9 BETWEEN 1 AND 6 AND n_partial = 0 THEN 1 ELSE 0 END"
_ACCURACY = "CASE WHEN k % 9 IN (7, 8) THEN 1 ELSE 0 END"
_KEPT = "(n_mixing = 1 OR k % 4 = 0)"
_BLOCKED = f"(({_KEPT} AND n_unsupported > 0) OR (n_absent > 0 AND n_partial = 1) OR {_RULE} = 1 OR {_ACCURACY} = 1)"
_COVERAGE, _EVIDENCE = "CASE WHEN k % 7 > 0 THEN likert / 5.0 END", "CASE WHEN k % 7 > 0 THEN (likert + 1) / 6.0 END"
_LIFTED = f"CASE WHEN NOT {_KEPT} AND n_unsupported > 0 THEN greatest(coalesce({_EVIDENCE}, 0), 0.95) ELSE {_EVIDENCE} END"
_PASSED = f"NOT {_BLOCKED} AND coalesce({_COVERAGE}, 0) >= 0.85 AND coalesce({_LIFTED}, 0) >= 0.95"
_PHRASES = ("Mass completely is enucleated", "WITHOUT entering mucosal layer", "Mucosal injury: none", "Lacerated lung surface is closed", "Azygos vein: divided", "a chest tube (20 Fr.)", "Complication: No", "PFT done")
_FOUND = ("complete enucleation", "mucosal layer kept", "mucosal injury none", "lung surface repair", "azygos divided", "chest tube placed", "Complication: conversion", "FVC was 1.99")


@query(f"""
SELECT method, record_id, CASE WHEN {_KEPT} THEN n_unsupported ELSE 0 END AS n_unsupported, CASE WHEN n_partial = 1 THEN n_absent ELSE 0 END + {_RULE} AS n_critical, {_ACCURACY} AS n_accuracy,
  CASE k % 9 WHEN 7 THEN 'Complication: No' WHEN 8 THEN 'PFT: 2.50(101)/1.99(116)=80%; Pulmonary Function Lab Report' ELSE '' END AS accuracy_evidence,
  {_BLOCKED} AS blocked, {_PASSED} AS passed, CASE WHEN {_BLOCKED} THEN 'NEEDS_REVISION' WHEN {_PASSED} THEN 'PASS' ELSE 'DRAFT' END AS verdict,
  round(CAST(CASE WHEN {_BLOCKED} THEN least(coalesce({_COVERAGE}, 0), 0.84) ELSE {_COVERAGE} END AS DOUBLE), 6) AS coverage,
  round(CAST(CASE WHEN {_BLOCKED} THEN least(coalesce({_LIFTED}, 0), 0.94) ELSE {_LIFTED} END AS DOUBLE), 6) AS evidence
FROM @judge_note""")
def verify_guardrails(spark, sf):
    """Verifications with lists and scores that are null (k % 5 = 0, k % 7 = 0) and unsupported facts given as plain text (k % 4 = 0)."""
    rule = F.col("k") % 9
    at = lambda xs: F.coalesce(F.get(F.array(*map(F.lit, xs)), (rule - 1).cast("int")), F.lit(""))
    source = F.concat(F.when(F.col("n_mixing") == 1, "takes an ARB. ").otherwise("no drugs. "), at(_PHRASES))
    cells = {"category": F.lit("Note"), "fact": at(_FOUND)}
    fact = F.struct(*(cells.get(k, F.lit(None).cast("string")).alias(k) for k in f.FIELDS))
    facts = F.when((rule > 0) & ((F.col("n_partial") == 1) | (rule > 6)), F.array(fact)).otherwise(F.array().cast(f.NO_FACTS))
    only = lambda k, x: F.when(F.col("k") % k > 0, x)
    v = F.col("v").withField("plain_unsupported", F.when(F.col("k") % 4 == 0, F.col("v.unsupported_facts")))
    v = v.withField("contradictions", only(5, F.col("v.contradictions"))).withField("clinical_accuracy_issues", only(5, F.col("v.clinical_accuracy_issues")))
    v = v.withField("coverage_score", only(7, F.col("v.coverage_score"))).withField("evidence_support_score", only(7, F.col("v.evidence_support_score")))
    rows = _verified(spark, sf).withColumn("g", f.guarded(v, facts, F.lit("Operative Report"), source))
    g = F.col("g")
    return rows.select("method", "record_id", F.size("g.unsupported_facts").alias("n_unsupported"), f.n_critical(g).alias("n_critical"), F.size("g.clinical_accuracy_issues").alias("n_accuracy"), F.array_join(F.transform("g.clinical_accuracy_issues", lambda x: x["evidence"]), "|").alias("accuracy_evidence"), f.is_blocked(g).alias("blocked"), f.is_passed(g).alias("passed"), "g.verdict", F.round("g.coverage_score", 6).alias("coverage"), F.round("g.evidence_support_score", 6).alias("evidence"))


@query("""
WITH r AS (SELECT record_id, round(avg(likert / 5.0), 4) AS coverage, CAST(sum(likert) AS BIGINT) AS iterations, count(*) FILTER (WHERE n_mixing = 1) AS n_errors, bool_and(n_unsupported = 0) AS approved,
  count(*) FILTER (WHERE n_unsupported > 0) + count(*) FILTER (WHERE n_unsupported > 0 AND n_absent > 0) AS n_unresolved, count(*) FILTER (WHERE k % 3 > 0) AS n_facts FROM @judge_note GROUP BY record_id),
c AS (SELECT record_id, string_agg(category || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY category) AS counts
  FROM (SELECT record_id, CASE WHEN k % 3 = 1 THEN 'Other' ELSE method END AS category, count(*) AS n FROM @judge_note WHERE k % 3 > 0 GROUP BY 1, 2) GROUP BY record_id)
SELECT r.* EXCLUDE (n_facts), 'Extracted fact count: ' || CAST(n_facts AS VARCHAR) || chr(10) || 'Category counts: ' || coalesce(counts, 'None') || chr(10) || 'Approved: ' || CASE WHEN approved THEN 'True' ELSE 'False' END || chr(10)
  || 'Coverage score: ' || CAST(CAST(coverage AS DOUBLE) AS VARCHAR) || chr(10) || 'Evidence support score: ' || CAST(CAST(coverage AS DOUBLE) AS VARCHAR) || chr(10) || 'Unresolved issue groups: ' || CAST(n_unresolved AS VARCHAR) AS summary
FROM r LEFT JOIN c USING (record_id)""")
def stage3_rollup(spark, sf):
    rows = _verified(spark, sf).withColumn("approved", F.col("n_unsupported") == 0)
    groups = sum((F.size(F.col(f"v.{k}")) > 0).cast("int") for k in f.ISSUES)
    cells = {"category": F.when(F.col("k") % 3 == 1, "").otherwise(F.col("method"))}  # an empty category counts as Other
    fact = F.when(F.col("k") % 3 > 0, F.struct(*(cells.get(k, F.lit("x")).alias(k) for k in f.FIELDS)))
    out = rows.groupBy("record_id").agg(
        F.collect_list(fact).alias("facts"),
        f.score_mean(F.col("v.coverage_score").cast("string")).alias("coverage"),
        F.sum("likert").alias("iterations"),
        F.count_if(F.col("n_mixing") == 1).alias("n_errors"),
        F.bool_and("approved").alias("approved"),
        F.sum(F.when(~F.col("approved"), groups).otherwise(0)).alias("n_unresolved"),
    )
    return out.withColumn("summary", f.final_summary(F.col("facts"), F.col("approved"), F.col("coverage"), F.col("coverage"), F.col("n_unresolved"))).drop("facts")


@query("""
SELECT method, record_id, n_absent AS n_missing, CASE WHEN n_partial = 1 THEN n_absent ELSE 0 END AS n_critical,
  CASE WHEN n_partial = 1 AND n_mixing = 1 THEN n_absent ELSE 0 END AS n_critical_after FROM @judge_note""")
def issue_severity(spark, sf):
    fact = F.when(F.col("n_mixing") == 1, "finding").otherwise("baseline LFT")
    missing = lambda v: F.transform(v["missing_facts"], lambda m: m.withField("fact", fact))
    rows = _verified(spark, sf).withColumn("v", F.col("v").withField("missing_facts", missing(F.col("v"))))
    return rows.select("method", "record_id", F.size("v.missing_facts").alias("n_missing"), f.n_critical(F.col("v")).alias("n_critical"), f.n_critical(f.sanitized(F.col("v"), F.lit(""))).alias("n_critical_after"))


@query("""
SELECT method, record_id, CASE WHEN n_unsupported = 0 THEN 'verdict as JSON' ELSE 'fix ' || CAST(n_unsupported AS VARCHAR) END AS feedback,
  CASE WHEN n_mixing = 1 THEN 'CHUNK_ERROR' ELSE 'DRAFT' END AS verdict FROM @judge_note""")
def feedback_fallback(spark, sf):
    said = F.when(F.col("n_unsupported") == 0, "  ").otherwise(F.concat(F.lit(" fix "), F.col("n_unsupported").cast("string"), F.lit(" ")))
    rows = _verified(spark, sf).withColumn("v", F.col("v").withField("feedback", said))
    rows = rows.withColumn("v", F.when(F.col("n_mixing") == 1, pipeline.chunk_error(F.col("v"))).otherwise(F.col("v")))
    text = f.feedback(F.col("v").withField("feedback", said))
    return rows.select("method", "record_id", F.when(F.startswith(text, F.lit("{")), "verdict as JSON").otherwise(text).alias("feedback"), "v.verdict")


_FACT = """'{"category":"' || category || '","evidence":"' || evidence || '","fact":"' || fact || '"}'"""
_BUNDLE = f"""'{{"extracted_fact_count_sent":' || CAST(least(count(*), 2) AS VARCHAR) || ',"extracted_fact_count_total":' || CAST(count(*) AS VARCHAR)
  || ',"extracted_facts":[' || string_agg({_FACT}, ',' ORDER BY k) FILTER (WHERE k <= 2) || '],"primary_fact_column":"extracted_facts","readable_fact_summaries":{{}},"row_fields":{{"note":"n' || CAST(row_index AS VARCHAR)
  || '"}},"schema_observed_columns":["extracted_facts","note"]}}'"""


@query(f"""
SELECT row_index, total, least(total, 2) AS sent, '' AS record_id, sha256('﻿' || '{{"facts":' || bundle || ',"record_id":"","row_index":' || CAST(row_index AS VARCHAR) || '}}') AS bundle_hash,
  sha256(left(bundle, length(bundle) - 1) ) AS evidence_head FROM (SELECT row_index, count(*) AS total, {_BUNDLE} AS bundle FROM ({_LINES}) GROUP BY row_index)""")
def fact_bundle(spark, sf):
    """What a generator sees of a record's facts: the first two, with a hash over sorted keys; no professor."""
    rows = view(spark, sf, "fact").withColumn("note", F.concat(F.lit("n"), F.col("row_index").cast("string")))
    out = bundles.fact_bundles(rows, most_facts=2, with_professor=False, trusted=True)  # text that the adapter wrote
    # the evidence without the record's keys is the bundle that the hash covers
    head = F.regexp_extract("evidence", '(?s)^(.*?),"record_id":"unknown"', 1)
    fields = F.regexp_extract("evidence", '(?s)(,"row_fields":\\{.*?\\})', 1)
    whole = F.concat(head, fields, F.regexp_extract("evidence", '(?s)(,"schema_observed_columns":.*)\\}\\z', 1))
    return out.select("row_index", F.col("n_facts").cast("long").alias("total"), F.col("n_sent").cast("long").alias("sent"), "record_id", "bundle_hash", F.sha2(whole, 256).alias("evidence_head"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""
SELECT row_index, record_id, professor, CAST(length(t) AS BIGINT) AS chars, length(t) > 500 AS truncated,
  sha256(CASE WHEN length(t) <= 500 THEN t ELSE rtrim(left(t, 250), {_WS}) || chr(10) || '...[TRUNCATED]...' || chr(10) || ltrim(right(t, 218), {_WS}) END) AS raw_sha256
FROM (SELECT row_index, record_id, professor, replace(replace(replace(trim(input, {_WS}), '\\r\\n', chr(10)), '\\n', chr(10)), '\\t', chr(9)) AS t FROM @rec)""")
def raw_bundle(spark, sf):
    rec = view(spark, sf, "rec").select("row_index", F.col("professor").alias("Professor_ID"), F.col("record_id").alias("수술ID"), F.col("input").alias("Input"))
    out = bundles.raw_bundles(rec, "raw_to_note", most_chars=500)
    return out.select("row_index", "record_id", "professor", F.col("chars").cast("long").alias("chars"), "truncated", F.sha2("evidence", 256).alias("raw_sha256"))


@query("""
SELECT record_id, sha256('﻿' || '{"raw_text":"' || source || '","record_id":"' || record_id || '","row_index":' || record_id || '}') AS bundle_hash,
  sha256('﻿' || source) AS prompt_hash FROM (SELECT CAST(doc_id AS VARCHAR) AS record_id, source FROM documents)""")
def content_hash(spark, sf):
    rec = load(spark, sf, "documents").select(F.col("doc_id").alias("row_index"), F.col("doc_id").cast("string").alias("record_id"), F.col("source").alias("raw_text"))
    bundle = F.to_json(F.struct("raw_text", "record_id", "row_index"))
    return rec.select("record_id", text_hash(bundle).alias("bundle_hash"), text_hash("raw_text").alias("prompt_hash"))


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN event_type || '|' || CAST(user_id AS VARCHAR) WHEN 2 THEN event_type WHEN 3 THEN '' ELSE CAST(user_id + 1 AS VARCHAR) END AS uncertain,
  CASE WHEN event_id % 5 = 3 THEN 'Note' ELSE 'Report ' || event_type END AS source_document, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS n_facts FROM events""")
def uncertain_lists(spark, sf):
    """Replies of extractors whose list of what is uncertain is missing, a list, a text, empty or a number, as one shape."""
    e, k = load(spark, sf, "events"), F.col("event_id") % 5
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    listed = F.concat(F.lit("["), quoted(F.col("event_type")), F.lit(","), F.col("user_id").cast("string"), F.lit("]"))
    value = F.when(k == 1, listed).when(k == 2, quoted(F.col("event_type"))).when(k == 3, F.lit('""')).otherwise((F.col("user_id") + 1).cast("string"))
    own = F.when(k > 0, F.concat(F.lit(',"uncertain_or_conflicting":'), value)).otherwise("")
    source = F.when(k == 3, "").otherwise(F.concat(F.lit('"source_document":'), quoted(F.concat(F.lit("Report "), "event_type")), F.lit(",")))
    listed_facts = F.when(F.col("event_id") % 2 == 0, F.lit('[{"fact":"x"},"y"]')).otherwise(F.lit('"none"'))
    p = f.payload(f.json_object(F.concat(F.lit("{"), source, F.lit('"facts":'), listed_facts, own, F.lit("}"))), F.lit("Note"))
    return e.withColumn("p", p).select("event_id", F.array_join("p.uncertain_or_conflicting", "|").alias("uncertain"), "p.source_document", F.size("p.facts").alias("n_facts"))


@query()
def extract_verify_loop(spark, sf):
    return pipeline.extract_and_verify(view(spark, sf, "conv_rec"), "row_index", backends.Config("placeholder"))


@query("""
SELECT method, count(*) AS n_ok, count(*) FILTER (WHERE n_unsupported = 0) AS n_approved, count(*) FILTER (WHERE n_mixing = 1) AS n_errors, round(avg(likert / 5.0), 6) AS mean_coverage
FROM @judge_note GROUP BY method""")
def progress_stats(spark, sf):
    rows = view(spark, sf, "judge_note")
    return rows.groupBy("method").agg(F.count("*").alias("n_ok"), F.count_if(F.col("n_unsupported") == 0).alias("n_approved"), F.count_if(F.col("n_mixing") == 1).alias("n_errors"), F.round(F.avg(F.col("likert") / 5.0), 6).alias("mean_coverage"))
