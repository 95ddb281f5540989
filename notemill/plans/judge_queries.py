"""Queries on judged notes: offline judge, cache, metric tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import facts, judge as j
from .adapters import load, view
from .catalogue import query

ORDER = ["view", "click", "search", "signup", "purchase"]


def _judged(spark, sf):
    notes = view(spark, sf, "judge_note").withColumn("empty_note", F.col("k") % 17 == 0)
    return j.with_verdicts(notes.withColumn("likert", F.when(F.col("empty_note"), 1).otherwise(F.col("likert"))))


_FLAGS = """(SELECT *, k % 17 = 0 AS e FROM @judge_note)"""


@query("""
SELECT event_id, sha256('{"model":"m","system":"s","task":"t","user":"' || event_type || '"}') AS key,
  CASE WHEN event_type IN ('purchase', 'click') THEN 'known ' || event_type END AS response FROM events""")
def judge_cache_lookup(spark, sf):
    calls = load(spark, sf, "events").select("event_id", j.cache_key(F.lit("m"), F.lit("t"), F.lit("s"), F.col("event_type")).alias("key"))
    cache = load(spark, sf, "events").where("event_type in ('purchase', 'click')").select("event_type").distinct()
    cache = cache.select(j.cache_key(F.lit("m"), F.lit("t"), F.lit("s"), F.col("event_type")).alias("key"), F.concat(F.lit("known "), "event_type").alias("response"))
    return j.with_cache(calls, cache)


@query("""
WITH d AS (SELECT doc_id, CAST(('0x' || left(sha256('faithfulness' || text), 8)) AS BIGINT) AS f, CAST(('0x' || left(sha256('completeness' || text), 8)) AS BIGINT) AS c,
  CAST(('0x' || left(sha256('style' || text), 8)) AS BIGINT) AS s FROM documents)
SELECT doc_id, CASE WHEN f % 5 = 0 THEN 2 ELSE 3 + f % 3 END AS likert, CASE WHEN f % 5 = 0 THEN 1 ELSE 0 END AS n_unsupported, CASE WHEN c % 4 = 0 THEN 1 ELSE 0 END AS n_absent,
  c % 4 <> 0 AS complete, CASE s % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END AS winner FROM d""")
def placeholder_judge(spark, sf):
    docs = load(spark, sf, "documents")
    f, c = j.offline_faithfulness(F.col("text")), j.offline_completeness(F.col("text"))
    rows = docs.select("doc_id", f.alias("f"), c.alias("c"), j.offline_winner(F.col("text")).alias("winner"))
    return rows.select("doc_id", F.col("f.likert").cast("long").alias("likert"), "f.n_unsupported", "c.n_absent", (F.col("c.n_absent") + F.col("c.n_partial") == 0).alias("complete"), "winner")


@query("""
SELECT a.method, a.record_id, CASE WHEN a.k % 17 = 0 AND b.k % 17 = 0 THEN 0.5 WHEN a.k % 17 = 0 THEN 0.0 WHEN b.k % 17 = 0 THEN 1.0
  ELSE (CASE a.k % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.5 END + CASE b.k % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE 0.5 END) / 2 END::DOUBLE AS score,
  b.record_id IS NULL AS no_opponent
FROM @judge_note a LEFT JOIN (SELECT * FROM @judge_note WHERE method = 'purchase' AND k % 5 > 0) b ON b.record_id = a.record_id WHERE a.method <> 'purchase' AND b.record_id IS NOT NULL
UNION ALL SELECT a.method, a.record_id, NULL, true FROM @judge_note a LEFT JOIN (SELECT * FROM @judge_note WHERE method = 'purchase' AND k % 5 > 0) b ON b.record_id = a.record_id
WHERE a.method <> 'purchase' AND b.record_id IS NULL""")
def style_battle(spark, sf):
    """Each method's note against the opponent's of the same record; a record without one is reported, not dropped."""
    notes = view(spark, sf, "judge_note").withColumn("note", F.when(F.col("k") % 17 == 0, "").otherwise("note"))
    other = notes.where("method = 'purchase' and k % 5 > 0").select("record_id", F.col("note").alias("other"), F.col("k").alias("ok"))
    met = notes.where("method <> 'purchase'").join(other, "record_id", "left")
    names = F.array(F.lit("A"), F.lit("B"), F.lit("tie"))
    pick = lambda c: F.element_at(names, (F.col(c) % 3 + 1).cast("int"))
    score = F.when(F.col("other").isNotNull(), j.style_score(F.col("note"), F.col("other"), pick("k"), pick("ok")))
    return met.select("method", "record_id", score.alias("score"), F.col("other").isNull().alias("no_opponent"))


_QUALITY = """
SELECT method, count(*) AS n, round(100 * avg(CAST(NOT e AND likert >= 4 AS INT)), 6) AS faithful_pass_pct, round(100 * avg(CAST(NOT e AND likert = 3 AS INT)), 6) AS faithful_borderline_pct,
  round(100 * avg(CAST(NOT e AND n_unsupported = 0 AS INT)), 6) AS hallucination_free_pct, round(avg(n_unsupported), 6) AS unsupported_per_note,
  round(100 * avg(CAST(NOT e AND n_absent = 0 AND n_partial = 0 AS INT)), 6) AS critical_complete_pct, round(100 * avg(CAST(NOT e AND n_absent = 0 AS INT)), 6) AS critical_complete_lenient_pct,
  round(100 * avg(style_score), 6) AS style_win_pct, count(style_score) AS style_n FROM {from} GROUP BY method"""


@query(f"SELECT q.*, CASE method WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'search' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS ord FROM ({_QUALITY.replace('{from}', f'(SELECT * FROM {_FLAGS} WHERE CAST(record_id AS BIGINT) % 3 > 0)')}) q WHERE method IN ('view', 'click', 'search', 'signup', 'purchase')")
def table1_metrics(spark, sf):
    judged = _judged(spark, sf)
    sample = judged.where("cast(record_id as bigint) % 3 > 0").select("record_id").distinct()  # one sample for all methods
    table = j.quality_table(judged.join(sample, "record_id", "left_semi"))
    return j.in_order(table, ORDER)


@query(_QUALITY.replace("{from}", "(SELECT * REPLACE (CASE WHEN k % 17 = 0 THEN 0 ELSE n_unsupported END AS n_unsupported), k % 17 = 0 AS e FROM @judge_note WHERE method IN ('view', 'click'))"))
def table2_ablation(spark, sf):
    """With the ablation's rule: an empty note has no claims and no critical facts."""
    judged = _judged(spark, sf).where("method in ('view', 'click')")
    return j.quality_table(judged.withColumn("n_unsupported", F.when(F.col("empty_note"), 0).otherwise(F.col("n_unsupported"))))


@query("""
SELECT method, count(*) AS n, count(DISTINCT record_id) AS n_records, round(avg(n_unsupported), 6) AS unsupported_per_note, round(100 * avg(CAST(n_unsupported > 0 AS INT)), 6) AS notes_with_unsupported_pct,
  round(avg(n_absent), 6) AS missing_per_note, round(100 * avg(CAST(n_absent > 0 AS INT)), 6) AS notes_with_missing_pct, round(avg(n_mixing), 6) AS patient_mixing_per_note,
  round(100 * avg(CAST(n_mixing > 0 AS INT)), 6) AS notes_with_mixing_pct FROM @judge_note GROUP BY method""")
def table3_errors(spark, sf):
    return j.error_table(view(spark, sf, "judge_note"))


@query("""
SELECT method, record_id, severity, rank FROM (SELECT method, record_id, CAST(100 * n_mixing + 10 * n_unsupported + n_absent AS BIGINT) AS severity,
  row_number() OVER (PARTITION BY method ORDER BY 100 * n_mixing + 10 * n_unsupported + n_absent DESC, record_id) AS rank FROM @judge_note) WHERE rank <= 5""")
def worst_examples(spark, sf):
    out = j.worst_examples(view(spark, sf, "judge_note"))
    return out.select("method", "record_id", F.col("severity").cast("long").alias("severity"), F.col("rank").cast("long").alias("rank"))


@query("""
SELECT method, record_id, CASE n_partial WHEN 1 THEN CASE n_mixing WHEN 1 THEN 'raw_input_agent1_only' ELSE 'agent1_only' END ELSE CASE n_mixing WHEN 1 THEN 'raw_input_iterative_verified' ELSE 'iterative_verified' END END AS mode,
  'k' || CAST(likert AS VARCHAR) || CASE n_partial WHEN 1 THEN '_random_seed1225' ELSE '_deterministic' END AS tag FROM @judge_note""")
def run_labels(spark, sf):
    mode = rules.mode_name(F.col("n_partial") == 1, F.col("n_mixing") == 1)
    tag = rules.run_tag(F.col("likert").cast("string"), F.when(F.col("n_partial") == 1, "random").otherwise("deterministic"), F.lit("1225"))
    return view(spark, sf, "judge_note").select("method", "record_id", mode.alias("mode"), tag.alias("tag"))


@query("""
SELECT record_id, CASE WHEN output = '' THEN 1 ELSE 4 END AS likert, output <> '' AS hallucination_free, CASE WHEN output = '' THEN 0.0 ELSE NULL END::DOUBLE AS style_score,
  CASE WHEN output = '' THEN 'skipped_no_evidence' ELSE 'placeholder' END AS backend, 'Ours' AS label FROM @rec""")
def empty_note_scoring(spark, sf):
    rec = view(spark, sf, "rec").withColumn("empty_note", F.col("output") == "")
    rec = rec.withColumns({"likert": F.when(F.col("empty_note"), 1).otherwise(4), "n_unsupported": F.lit(0), "n_absent": F.lit(0), "n_partial": F.lit(0)})
    labels = dict(j.METHODS)
    backend = F.when(F.col("empty_note"), "skipped_no_evidence").otherwise("placeholder")
    score = F.when(F.col("empty_note"), F.lit(0.0))  # the opponent has a note
    return j.with_verdicts(rec).select("record_id", "likert", "hallucination_free", score.alias("style_score"), backend.alias("backend"), F.lit(labels["ours"]).alias("label"))


@query("""
SELECT 'missing' AS kind, 'response' AS value UNION ALL SELECT 'method', method FROM (SELECT DISTINCT method FROM @judge_note WHERE method <> '')""")
def config_consistency(spark, sf):
    """Columns that a resumed table lacks, and the distinct settings in it that are not blank."""
    notes = view(spark, sf, "judge_note")
    lacks = sorted({"method", "record_id", "response"} - set(notes.columns))
    missing = spark.createDataFrame([("missing", c) for c in lacks], "kind string, value string")
    return missing.unionByName(notes.where("method <> ''").select(F.lit("method").alias("kind"), F.col("method").alias("value")).distinct())


@query("""
SELECT method, record_id, likert, 1 + n_unsupported AS n_claims, n_unsupported, n_mixing * n_unsupported AS n_mixing, 1 + n_absent + n_partial AS n_critical, n_absent, n_partial, n_absent + n_partial = 0 AS complete_strict, n_absent = 0 AS complete_lenient
FROM @judge_note""")
def judge_replies(spark, sf):
    """Counts of judges' replies in JSON, with words before the object."""
    notes = view(spark, sf, "judge_note")
    some = lambda n, x: F.array_repeat(x, F.col(n) if isinstance(n, str) else F.lit(n))
    listed = lambda *parts: F.concat(F.lit("["), F.array_join(F.concat(*parts), ","), F.lit("]"))
    wrong = F.concat(F.lit('{"verdict":"unsupported","error_type":"'), F.when(F.col("n_mixing") == 1, "Patient_Mixing ").otherwise("fabricated"), F.lit('"}'))
    claims = F.concat(F.lit('Here: {"claims":'), listed(some(1, F.lit('{"verdict":"supported"}')), some("n_unsupported", wrong)), F.lit(',"faithfulness_likert":'), F.col("likert").cast("string"), F.lit("}"))
    status = lambda x: F.lit(f'{{"status":"{x}"}}')
    facts_of = F.concat(F.lit('{"critical_facts":'), listed(some(1, status("present")), some("n_absent", status("absent")), some("n_partial", status("partial"))), F.lit("}"))
    rows = notes.select("method", "record_id", j.faithfulness(facts.json_object(claims)).alias("f"), j.completeness(facts.json_object(facts_of)).alias("c"))
    return rows.select("method", "record_id", "f.likert", "f.n_claims", "f.n_unsupported", "f.n_mixing", "c.n_critical", "c.n_absent", "c.n_partial", "c.complete_strict", "c.complete_lenient")
