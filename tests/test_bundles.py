import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from notemill.operators import bundles as b, facts as f


def stable(x):
    return json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def digest(x):
    return hashlib.sha256(stable(x).encode("utf-8-sig")).hexdigest()


FACTS = [{"category": " Operation ", "fact": " a b ", "evidence": "e" * 300, "other": 1, "date": None}, "text", {"fact": "nan"}, 3]
ROWS = [
    (0, "김", "r1", json.dumps({"all_facts": FACTS}, ensure_ascii=False), "raw", "[1, 2]", " nan ", "s" * 3000, "[{]"),
    (1, None, "", "none", "raw", json.dumps([{"fact": "x", "evidence": 'say "hi"'}]), "v", "", "[]"),
]
COLUMNS = "row_index int, Professor_ID string, record_id string, Extracted_Facts string, Input string, my_list string, note string, Stage2_Final_Summary string, odd string"


def test_fact_bundles(spark):
    got = {r.row_index: r for r in b.fact_bundles(spark.createDataFrame(ROWS, COLUMNS), most_facts=3).collect()}
    cut = "e" * 130 + "\n...[TRUNCATED]...\n" + "e" * 98
    facts = {
        "schema_observed_columns": ["Professor_ID", "record_id", "Extracted_Facts", "Input", "my_list", "Stage2_Final_Summary", "odd"],
        "primary_fact_column": "Extracted_Facts", "extracted_fact_count_total": 4, "extracted_fact_count_sent": 3,
        "extracted_facts": [{"category": "Operation", "fact": "a b", "evidence": cut}, "text", {}],
        "readable_fact_summaries": {"Stage2_Final_Summary": "s" * 1250 + "\n...[TRUNCATED]...\n" + "s" * 1218},
        "row_fields": {"Professor_ID": "김", "record_id": "r1", "Stage2_Final_Summary": "s" * 3000, "odd": "[{]"},
    }
    assert json.loads(got[0].evidence) == {"row_index": 0, "record_id": "r1", "professor": "김", **facts}
    assert got[0].bundle_hash == digest({"row_index": 0, "record_id": "r1", "professor": "김", "facts": facts})
    assert (got[1].primary_fact_column, got[1].n_facts) == ("my_list", 1) and json.loads(got[1].evidence)["record_id"] == "unknown"
    assert json.loads(got[1].evidence)["extracted_facts"] == [{"fact": "x", "evidence": 'say "hi"'}]
    plain = b.fact_bundles(spark.createDataFrame(ROWS, COLUMNS), with_professor=False).where("row_index = 1").first()
    assert "professor" not in json.loads(plain.evidence) and plain.bundle_hash != got[1].bundle_hash


def test_bundles_read_each_cell_and_fact_once(spark):
    made = b.fact_bundles(spark.createDataFrame(ROWS, COLUMNS), most_facts=2)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # one pass through Python for the cells of all columns
    assert len(re.findall(r"try_variant_get\(lambda x_\d+#\d+, \$(?:\.evidence)?, (?:Struct|String)", plan)) == 1  # a fact's fields come by one cast
    trusted = b.fact_bundles(spark.createDataFrame(ROWS[:1], COLUMNS), trusted=True)
    assert "ArrowEvalPython" not in trusted._jdf.queryExecution().optimizedPlan().toString()
    odd = [{"category": 1.50, "date": True, "fact": {"b": [None]}, "evidence": " nan ", "Fact": "no"}, {"fact": "e" * 300, "evidence": "e" * 261}]
    got = b.fact_bundles(spark.createDataFrame([(0, json.dumps(odd))], "row_index int, facts string")).first()
    assert json.loads(got.evidence)["extracted_facts"] == [{"category": "1.5", "date": "true", "fact": '{"b":[null]}'}, {"fact": "e" * 300, "evidence": "e" * 130 + "\n...[TRUNCATED]...\n" + "e" * 98}]


def test_raw_bundles_and_selection(spark):
    df = spark.createDataFrame([(0, "p", "r", "word " * 300), (1, "q", "s", None)], "row_index int, Professor_ID string, `수술ID` string, Input string")
    got = {r.row_index: r for r in b.raw_bundles(df, "m", most_chars=500).collect()}
    assert got[0].truncated and got[0].chars == 1499 and len(got[0].evidence) < 500 and not got[1].truncated and got[1].evidence == ""
    assert got[1].bundle_hash == digest({"method": "m", "row_index": 1, "record_id": "s", "raw_text": ""})
    assert [r.row_index for r in b.selected(df, "q", 5).collect()] == [1]
    for bad in (lambda: b.selected(df, "z", None), lambda: b.selected(df, None, -1), lambda: b.raw_bundles(df.drop("Input"), "m")):
        with pytest.raises(ValueError):
            bad()


def test_tables_have_their_record_types(spark):
    from notemill import schema
    from notemill.operators import documents

    df = spark.createDataFrame(ROWS, COLUMNS)
    dated = documents.dated(documents.split_documents(df.selectExpr("row_index", "'2020-01-02' AS input"), "row_index"))
    payload = df.select(f.payload(F.try_parse_json("Extracted_Facts"), F.lit("x")).alias("p")).select("p.facts").schema["facts"].dataType.elementType
    kinds = lambda t: [(x.name, x.dataType.simpleString()) for x in t.fields]
    assert set(kinds(schema.DOCUMENT)) <= set(kinds(dated.schema)) and kinds(dated.schema["mentions"].dataType.elementType) == kinds(schema.MENTION)
    assert kinds(payload) == kinds(schema.FACT) and {x.name for x in schema.BUNDLE} <= set(b.fact_bundles(df).columns)


def test_payload_of_any_shape(spark):
    replies = ['{"facts": "no", "uncertain_or_conflicting": "maybe"}', '{"facts": [{"fact": "chest CT", "category": "Operation"}, 3], "uncertain_or_conflicting": ["a", {"b": 1}], "source_document": "S"}', "{}", '{"uncertain_or_conflicting": 0}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    got = [r.p for r in df.orderBy("i").select(f.payload(F.try_parse_json("r"), F.lit("Note")).alias("p")).collect()]
    assert [(p.source_document, len(p.facts), p.uncertain_or_conflicting) for p in got] == [("Note", 0, ["maybe"]), ("S", 1, ["a", '{"b":1}']), ("Note", 0, []), ("Note", 0, [])]
    assert got[1].facts[0].category == "Key Imaging/Test"


def test_verification_summary(spark):
    none = F.array().cast("array<string>")
    missing = F.array(F.struct(F.lit("critical").alias("severity"), F.lit("m").alias("fact"), F.lit("").alias("evidence")))
    v = F.struct(F.lit("NEEDS_REVISION").alias("verdict"), F.lit(0.5).alias("coverage_score"), F.lit(0.9).alias("evidence_support_score"), F.array(F.lit("u")).alias("unsupported_facts"), missing.alias("missing_facts"), none.alias("contradictions"), none.alias("date_errors"), F.array().cast("array<struct<issue:string,evidence:string>>").alias("clinical_accuracy_issues"))
    chunk = lambda kind, ok: F.struct(F.lit(kind).alias("document_type"), v.alias("v"), F.lit(2).alias("iterations_used"), F.lit(ok).alias("approved"))
    text = lambda *c: spark.range(1).select(f.verification_summary(F.lit(False), F.lit(0.5), F.lit(0.9), F.lit(4), F.array(*c))).first()[0]
    assert text(chunk("A", True), chunk("B", False)).split("\n") == ["Approved: False", "Coverage score: 0.5", "Evidence support score: 0.9", "Total iterations: 4", "", "## Chunk Verdicts", "- A: NEEDS_REVISION (coverage=0.5, evidence=0.9, iterations=2)", "- B: NEEDS_REVISION (coverage=0.5, evidence=0.9, iterations=2)", "", "## Unresolved Issues", "- B / unsupported_facts: u", "- B / missing_facts: m"]
    assert text(chunk("A", True)).endswith("## Unresolved Issues\n- None.")
