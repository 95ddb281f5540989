"""Queries on reference notes, styles and generated notes."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as t
from ..operators import backends, documents, notes as n, pipeline, references as r
from .adapters import load, view
from .catalogue import query

_LEN = "length(output)"


@query("""
SELECT professor, record_id FROM @ref WHERE CAST(record_id AS BIGINT) NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def reference_anti_join(spark, sf):
    targets = load(spark, sf, "labels").where("toxic = 1").join(load(spark, sf, "documents"), "doc_id")
    targets = targets.select(F.col("source").alias("professor"), F.col("doc_id").cast("string").alias("record_id"))
    return r.usable(view(spark, sf, "ref"), targets).select("professor", "record_id")


@query(f"""
SELECT professor, count(*) AS n, round(quantile_cont({_LEN}, 0.25), 6) AS q25, round(quantile_cont({_LEN}, 0.5), 6) AS q50, CAST(max({_LEN}) AS DOUBLE) AS q100 FROM @ref GROUP BY professor""")
def length_quantiles(spark, sf):
    q = r.length_quantiles(view(spark, sf, "ref"))
    return q.select("professor", "n", F.round(F.col("quantiles")[1], 6).alias("q25"), F.round(F.col("quantiles")[2], 6).alias("q50"), F.col("quantiles")[4].alias("q100"))


_NEAR = "SELECT professor, record_id, row_number() OVER (PARTITION BY professor ORDER BY abs(l - {at}), record_id) AS k FROM x WHERE n > 3"


@query(f"""
WITH x AS (SELECT professor, record_id, {_LEN} AS l, count(*) OVER w AS n, min({_LEN}) OVER w AS low, max({_LEN}) OVER w AS high, median({_LEN}) OVER w AS mid FROM @ref WINDOW w AS (PARTITION BY professor)),
a AS (SELECT professor, record_id FROM ({_NEAR.format(at="low")}) WHERE k = 1),
b AS (SELECT professor, record_id FROM ({_NEAR.format(at="mid")} AND (professor, record_id) NOT IN (SELECT (professor, record_id) FROM a)) WHERE k = 1),
c AS (SELECT professor, record_id FROM ({_NEAR.format(at="high")} AND (professor, record_id) NOT IN (SELECT (professor, record_id) FROM a UNION ALL SELECT (professor, record_id) FROM b)) WHERE k = 1)
SELECT *, 1 AS pick FROM a UNION ALL SELECT *, 2 FROM b UNION ALL SELECT *, 3 FROM c
UNION ALL SELECT professor, record_id, CAST(row_number() OVER (PARTITION BY professor ORDER BY record_id) AS INT) FROM x WHERE n <= 3""")
def reference_select_deterministic(spark, sf):
    return r.selected(r.usable(view(spark, sf, "ref")), 3)


#: Places that Python's generator draws, for the professors and the sizes of the small tables.
_DRAWN = ", ".join(f"('src{i}', {size}, {sorted(random.Random(f'1225:src{i}').sample(range(size), 5))})" for i in range(20) for size in range(6, 31))


@query(f"""
SELECT professor, record_id, CAST(row_number() OVER (PARTITION BY professor ORDER BY k) AS INT) AS pick FROM
(SELECT professor, record_id, row_number() OVER (PARTITION BY professor ORDER BY record_id) - 1 AS k, count(*) OVER (PARTITION BY professor) AS n FROM @ref) x
LEFT JOIN (VALUES {_DRAWN}) d(p, size, places) ON p = professor AND size = n WHERE n <= 5 OR list_contains(places, k)""")
def reference_select_random(spark, sf):
    return r.selected(r.usable(view(spark, sf, "ref")), 5, "random", 1225)


@query(f"""
WITH x AS (SELECT professor, record_id, row_number() OVER (PARTITION BY professor ORDER BY {_LEN}, record_id) - 1 AS k, count(*) OVER (PARTITION BY professor) AS n FROM @ref),
p AS (SELECT DISTINCT professor, CAST(round_even(i / 11.0 * (n - 1), 0) AS BIGINT) AS k FROM x, range(12) s(i))
SELECT x.professor, x.record_id, row_number() OVER (PARTITION BY x.professor ORDER BY x.k) AS pick FROM x LEFT JOIN p ON p.professor = x.professor AND p.k = x.k WHERE n <= 12 OR p.k IS NOT NULL""")
def style_references(spark, sf):
    return r.style_references(view(spark, sf, "ref")).select("professor", "record_id", F.col("pick").cast("long").alias("pick"))


_LINES = "list_filter(list_transform(string_split(output, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')"


@query(f"""
SELECT professor, count(*) AS n_examples, round(avg({_LEN}), 6) AS mean_chars, median({_LEN}) AS median_chars, round(avg(len({_LINES})), 6) AS mean_lines, median(len({_LINES})) AS median_lines,
  round(avg(CAST(len(list_filter({_LINES}, lambda x: x[1] IN ('-', '*', '•'))) > 0 AS INT)), 6) AS bullet_rate FROM @ref WHERE trim(output, ' ' || chr(10)) <> '' GROUP BY professor""")
def note_style_stats(spark, sf):
    s = r.note_stats(view(spark, sf, "ref"))
    return s.select("professor", "n_examples", *(F.round(c, 6).alias(c) for c in ("mean_chars", "median_chars", "mean_lines", "median_lines", "bullet_rate")))


@query(f"""
SELECT professor, value, n, rank FROM (SELECT professor, value, count(*) AS n, row_number() OVER (PARTITION BY professor ORDER BY count(*) DESC, min(row_index), value) AS rank
FROM (SELECT professor, row_index, ({_LINES})[1] AS value FROM @ref) WHERE value IS NOT NULL GROUP BY professor, value) WHERE rank <= 8""")
def top_lines_abbrev(spark, sf):
    top = r.top_values(r.first_lines(view(spark, sf, "ref")), 8)
    return top.select("professor", "value", "n", F.col("rank").cast("long").alias("rank"))


@query("""
SELECT rec.record_id, p.n_refs, p.n_refs IS NULL AS unmatched FROM @rec rec LEFT JOIN (SELECT professor, count(*) AS n_refs FROM @ref WHERE CAST(substr(professor, 4) AS INT) % 3 > 0 GROUP BY professor) p USING (professor)""")
def style_join(spark, sf):
    profiles = view(spark, sf, "ref").where(F.substring("professor", 4, 5).cast("int") % 3 > 0).groupBy("professor").agg(F.count("*").alias("n_refs"))
    out = view(spark, sf, "rec").join(profiles, "professor", "left")
    return out.select("record_id", "n_refs", F.col("n_refs").isNull().alias("unmatched"))


@query("""
WITH b AS (SELECT item_id, trim(regexp_replace(replace(lower(u.line), 'ß', 'ss'), '\\s+', ' ', 'g')) AS line FROM benchmark, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line) u)
SELECT DISTINCT d.doc_id AS note_id, b.item_id AS ref_id FROM documents d JOIN b ON length(b.line) >= 28 AND contains(regexp_replace(replace(lower(d.text), 'ß', 'ss'), '\\s+', ' ', 'g'), b.line)
WHERE NOT contains(b.line, 'description') AND NOT contains(b.line, '소견') AND NOT contains(b.line, 'postop 1st visit')""".replace("\\\\", "\\"))
def reference_leakage(spark, sf):
    notes = load(spark, sf, "documents").select(F.col("doc_id").alias("note_id"), F.lit("all").alias("professor"), F.col("text").alias("note"), F.lit("").alias("evidence"))
    refs = load(spark, sf, "benchmark").select(F.col("item_id").alias("ref_id"), F.lit("all").alias("professor"), F.col("text").alias("output"))
    return n.reference_leaks(notes, refs)


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'fail' WHEN doc_id % 5 = 1 THEN 'pass' ELSE 'needs_review' END AS status,
  CASE doc_id % 5 WHEN 0 THEN 'the note is empty' WHEN 1 THEN '' WHEN 2 THEN 'code fence in the note' WHEN 3 THEN 'unsupported date: 2021-02-03' ELSE 'unsupported medical_term: biopsy' END AS warnings,
  CASE doc_id % 5 WHEN 3 THEN '2021-02-03' WHEN 4 THEN 'biopsy' ELSE '' END AS unsupported FROM documents""")
def note_validation(spark, sf):
    k = F.col("doc_id") % 5
    note = F.when(k == 0, " nan ").when(k == 1, "VATS on 2020-01-02, mass 3 cm").when(k == 2, "```\nVATS```").when(k == 3, "VATS 2021-02-03").otherwise("biopsy, biopsy")
    evidence = F.lit("vats on 20.1.2 for a mass of 3 cm; 2020 01 02; 2021 02 03")
    rows = load(spark, sf, "documents").select("doc_id", note.alias("note"), n.note_warnings(note, evidence).alias("w"))
    status = rules.note_status(t.clean_scalar("note"), F.size("w.warnings"), F.lit(False))
    # digits of the unsupported date are in the evidence one by one, so only the date itself is not
    return rows.select("doc_id", status.alias("status"), F.array_join("w.warnings", "|").alias("warnings"), F.array_join("w.unsupported", "|").alias("unsupported"))


_PLAIN = "regexp_replace(replace(lower({}), 'ß', 'ss'), '\\s+', ' ', 'g')"


@query(f"""
WITH x AS (SELECT professor, record_id, output, row_number() OVER (PARTITION BY professor ORDER BY {_LEN}, record_id) - 1 AS k, count(*) OVER (PARTITION BY professor) AS n FROM @ref),
p AS (SELECT DISTINCT professor, CAST(round_even(i / 2.0 * (n - 1), 0) AS BIGINT) AS k FROM x, range(3) s(i)),
e AS (SELECT x.professor, x.record_id, x.output, row_number() OVER (PARTITION BY x.professor ORDER BY x.k) AS pick FROM x LEFT JOIN p ON p.professor = x.professor AND p.k = x.k WHERE n <= 3 OR p.k IS NOT NULL),
n AS (SELECT r.row_index, r.professor, {_PLAIN.format("r.input")} AS note, {_PLAIN.format("CASE r.row_index % 3 WHEN 0 THEN r.input WHEN 1 THEN '' ELSE coalesce(e.output, '') END")} AS evidence
      FROM @rec r LEFT JOIN e ON e.professor = r.professor AND e.pick = 1),
l AS (SELECT professor, record_id, pick, trim({_PLAIN.format("u.line")}) AS line FROM e, LATERAL (SELECT unnest(string_split(output, chr(10))) AS line) u),
h AS (SELECT DISTINCT n.row_index, l.record_id, l.pick FROM n JOIN l ON l.professor = n.professor AND length(l.line) >= 28 AND contains(n.note, l.line) AND NOT contains(n.evidence, l.line)
      WHERE NOT contains(l.line, 'description') AND NOT contains(l.line, '소견') AND NOT contains(l.line, 'postop 1st visit')),
g AS (SELECT row_index, string_agg('copied from the reference record_id=' || record_id, '|' ORDER BY pick) AS copied FROM h GROUP BY row_index)
SELECT row_index, concat_ws('|', copied, CASE WHEN row_index % 4 = 3 THEN 'strict: some extracted facts were not sent' END) AS warnings FROM n LEFT JOIN g USING (row_index)""")
def note_copies(spark, sf):
    """Every document as a note of its professor, on evidence that holds all of it, none of it, or the first reference."""
    shown = n.excerpts(r.style_references(view(spark, sf, "ref"), 3))
    first = shown.where("pick = 1").select("professor", F.col("output").alias("_first"))
    k = F.col("row_index")
    evidence = F.when(k % 3 == 0, F.col("input")).when(k % 3 == 1, "").otherwise(F.coalesce("_first", F.lit("")))
    rows = view(spark, sf, "rec").join(first, "professor", "left").select("row_index", "professor", F.col("input").alias("generated_note"), evidence.alias("evidence"), F.least(k % 4, F.lit(2)).alias("n_sent"), (k % 4).alias("n_facts"))
    found = n.validated(rows, shown, strict=True)
    told = F.filter("w.warnings", lambda x: F.startswith(x, F.lit(n.COPY)) | (x == n.LEFT_OUT))
    return found.select("row_index", F.array_join(told, "|").alias("warnings"))


@query("""
SELECT DISTINCT professor, 'missing key: style_summary|style_prompt is short: ' || CAST(length(professor) + 17 AS VARCHAR) || '|style_prompt lacks: do not summarize the operative report|style_prompt lacks: omit factual but low-priority|style_prompt says nothing on abbreviations' AS warnings,
  5 AS n_rules FROM @ref""")
def style_prompt_checks(spark, sf):
    names = view(spark, sf, "ref").select("professor").distinct()
    prompt = F.concat("professor", F.lit("CURRENT_ROW_FACTS"))
    keys = F.array(*(F.lit(x) for x in n.STYLE_KEYS if x != "style_summary"))
    found = n.style_warnings(keys, prompt, F.lit(0.5), F.col("professor"), F.col("professor"))
    fixed = n.repaired_style(prompt, F.col("professor"), F.lit("Opening"), F.lit(0.5))
    count = F.size(F.split(fixed, "\n- ", -1))
    return names.select("professor", F.array_join(found, "|").alias("warnings"), count.alias("n_rules"))


@query()
def style_prompt_template(spark, sf):
    opening = r.opening_line(view(spark, sf, "ref"))
    names = view(spark, sf, "ref").select("professor").distinct().join(opening, "professor", "left")
    return names.select("professor", t.sanitize_style(F.concat(n.style_prompt(F.col("professor"), F.col("line")), F.lit("\n\n\n\nReturn valid JSON only."))).alias("prompt"))


@query("""
SELECT r.record_id, CASE WHEN l.doc_id IS NULL THEN false ELSE true END AS has_truth, length(coalesce(r.output, '')) > 0 AS has_output, c.n_docs
FROM @rec r LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = r.record_id LEFT JOIN (SELECT CAST(conv_id AS VARCHAR) AS record_id, count(*) AS n_docs FROM conversations GROUP BY 1) c ON c.record_id = r.record_id""")
def ground_truth_join(spark, sf):
    rec = view(spark, sf, "rec")
    truth = load(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("record_id"), F.lit(True).alias("t")).distinct()
    chunks = documents.split_documents(view(spark, sf, "conv_rec"), "row_index").groupBy(F.col("row_index").cast("string").alias("record_id")).agg(F.count("*").alias("n_docs"))
    out = rec.join(truth, "record_id", "left").join(chunks, "record_id", "left")
    return out.select("record_id", F.col("t").isNotNull().alias("has_truth"), (F.length("output") > 0).alias("has_output"), "n_docs")


@query()
def generate_notes_offline(spark, sf):
    config = backends.Config("placeholder")
    profiles = pipeline.style_profiles(r.usable(view(spark, sf, "ref")), config)
    bundles = view(spark, sf, "rec").select("record_id", "professor", F.col("input").alias("evidence"))
    blank = bundles.groupBy("professor").agg(F.lit("").alias("evidence"), F.concat(F.lit("blank "), F.max("record_id")).alias("record_id"))  # one more record each, without evidence
    bundles = bundles.unionByName(blank)
    return pipeline.write_notes(bundles, profiles, config, skip_unmatched=True)

