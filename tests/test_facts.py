import json

from pyspark.sql import functions as F

from notemill.functions import rules
from notemill.operators import backends, facts as f, pipeline


def one(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells)) if cells else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_mixed_lists_and_errors(spark):
    got = one(spark, f.parse_facts("c"), c='{"facts":[{"fact":"a"},"text",{"fact":"b","category":null}]}')
    assert len(got["items"]) == 3 and got["error"] is None
    typed = one(spark, f.typed_facts(f.parse_facts("c")["items"]), c='{"facts":[{"fact":"a"},"text",{"fact":"b"}]}')
    assert [x["fact"] for x in typed] == ["a", "b"]
    for cell, error in (("", "empty"), ("{", "not JSON"), ("{}", "no list"), ("3", "no list"), ('{"a":1} x', "not JSON")):
        assert error in one(spark, f.parse_facts("c")["error"], c=cell)


def test_json_repair(spark):
    assert f.join_stray_strings('{"a": "x", "y", "b": "z"}') == '{"a": "x y", "b": "z"}'
    assert json.loads(one(spark, f.repaired_json("c"), c='{"a": "x", "y", "b": "z"}')) == {"a": "x y", "b": "z"}
    assert one(spark, F.to_json(f.json_object("c")), c='reply <unused12>: {"a": 1} bye') == '{"a":1}'
    assert one(spark, f.json_object("c").isNull(), c="none")


def test_categories(spark):
    pairs = [("Operation", "chest CT seen", "Key Imaging/Test"), ("Operation", "x", "Operation"), ("bad", "carbon drug", "Medication"), ("bad", "act", "Key Imaging/Test"), ("bad", "zzz", "Other"), ("bad", "plan", "Discharge Plan"), ("bad", "converted", "Procedure Change")]
    df = spark.createDataFrame([p[:2] for p in pairs], "c string, t string")
    got = [r[0] for r in df.select(rules.fact_category(F.col("c"), F.col("t"), F.lit("Note"))).collect()]
    assert got == [p[2] for p in pairs]


def test_completion_sees_what_was_added(spark):
    none = F.array().cast(f.NO_FACTS)
    source = F.lit("without entering mucosal layer; mucosal injury: none")
    got = one(spark, f.completed(none, F.lit("Operative Report"), source))
    assert [x["evidence"] for x in got] == ["without entering mucosal layer", "Mucosal injury: none"]
    assert one(spark, F.size(f.completed(none, F.lit("Note"), source))) == 0


def test_guardrails(spark):
    none = F.array().cast(f.NO_FACTS)
    v = pipeline.blank("DRAFT", 0.9, 0.96, "")
    clear = one(spark, f.guarded(v, none, F.lit("Note"), F.lit("x")))
    assert clear["verdict"] == "PASS"
    missing = one(spark, f.guarded(v, none, F.lit("Operative Report"), F.lit("Azygos vein: divided")))
    assert (missing["verdict"], missing["coverage_score"], missing["evidence_support_score"], len(missing["missing_facts"])) == ("NEEDS_REVISION", 0.84, 0.94, 1)
    leaked = one(spark, f.guarded(v.withField("unsupported_facts", F.array(F.lit("on ARB"))).withField("evidence_support_score", F.lit(0.1)), none, F.lit("Note"), F.lit("x")))
    assert leaked["verdict"] == "PASS" and leaked["evidence_support_score"] == 0.95
    swapped = F.array(F.struct(*(F.lit(x).cast("string").alias(k) for k, x in zip(f.FIELDS, ("", "", "FVC was 1.99", "", "", "")))))
    assert one(spark, f.guarded(v, swapped, F.lit("Note"), F.lit("PFT")))["verdict"] == "NEEDS_REVISION"


def test_rendering(spark):
    facts = F.array(*(F.struct(*(F.lit(x).cast("string").alias(k) for k, x in zip(f.FIELDS, row))) for row in ((None, None, "a", None, "high", "B"), ("Other", "2024", "b", None, None, "A"), ("Other", "2024", "c", None, None, "B"))))
    assert one(spark, f.readable(facts)) == "## B\n1. [Other] [Unknown date] a (confidence: high) - source: B\n2. [Other] [2024] c - source: B\n## A\n1. [Other] [2024] b - source: A"
    assert one(spark, f.category_counts(facts)) == "Other: 3"


def test_loop_with_a_failing_and_a_malformed_model(spark):
    class Broken:
        def __init__(self, config):
            pass

        def chat(self, system, user):
            if "boom" in user:
                raise RuntimeError("no answer")
            if system == backends.REPAIR:
                return "still not json"
            return '{"facts": []}' if "FACTS AS JSON" in system else "not json"

    chunks = spark.createDataFrame([(1, "Note", "fine"), (2, "Note", "boom")], "k int, document_type string, raw_text string")
    real = pipeline.ask
    pipeline.ask = lambda calls, config: real(calls, config, Broken)
    try:
        got = {r.k: r for r in pipeline.extract_chunks(chunks, backends.Config(pause=0)).collect()}
    finally:
        pipeline.ask = real
    assert got[1].approved and got[1].verifier_parse_error and got[1].iterations_used == 1
    assert not got[2].approved and got[2].v["verdict"] == "CHUNK_ERROR" and got[2].iterations_used == 2


def test_cached_calls_are_made_once(spark):
    calls = spark.createDataFrame([("a", "s", "u"), ("a", "s", "u"), ("b", "s", "w")], "key string, system string, user string")
    cache = spark.createDataFrame([("b", "known")], "key string, response string")
    answers, fresh = backends.ask_cached(calls, cache, backends.Config())
    assert fresh.count() == 1 and {r.key: r.response for r in answers.collect()}["b"] == "known" and answers.count() == 3


def test_replies_are_repaired_by_rule_then_by_the_model(spark):
    class Sloppy:
        def __init__(self, config):
            self.n = 0

        def chat(self, system, user):
            if system == backends.REPAIR:
                return '{"mended": true}'
            return {"stray": '{"a": "x", "y", "b": "z"}', "inner": 'so: {"a": 1} <unused3>', "bad": "{a: 1", "none": ""}[user]

    df = spark.createDataFrame([("s", u) for u in ("stray", "inner", "bad", "none")], "system string, user string")
    got = {r.user: (r.response, r.error) for r in backends.ask(df, backends.Config(json=True, pause=0), Sloppy).collect()}
    assert json.loads(got["stray"][0]) == {"a": "x y", "b": "z"} and json.loads(got["inner"][0]) == {"a": 1} and json.loads(got["bad"][0]) == {"mended": True}
    assert got["none"][0] is None and "no JSON object" in got["none"][1]


def test_guardrails_on_nulls(spark):
    none = F.array().cast(f.NO_FACTS)
    v = pipeline.blank("DRAFT", 0.9, 0.96, "")
    for k in f.ISSUES:
        v = v.withField(k, F.lit(None).cast(f.VERIFICATION[k]))
    clear = one(spark, f.guarded(v, none, F.lit("Note"), F.lit("x")))
    assert clear["verdict"] == "PASS" and all(clear[k] == [] for k in f.ISSUES)
    assert one(spark, f.is_blocked(v)) is False and one(spark, f.is_passed(v)) is True
    low = v.withField("coverage_score", F.lit(None).cast("double")).withField("evidence_support_score", F.lit(None).cast("double"))
    blocked = one(spark, f.guarded(low, none, F.lit("Operative Report"), F.lit("Azygos vein: divided")))
    assert (blocked["verdict"], blocked["coverage_score"], blocked["evidence_support_score"]) == ("NEEDS_REVISION", 0.0, 0.0)
    assert one(spark, f.guarded(low, none, F.lit("Note"), F.lit("x")))["verdict"] == "DRAFT"


def test_issues_given_as_text_or_objects(spark):
    reply = json.dumps({
        "verdict": "X", "coverage_score": 0.9, "evidence_support_score": 0.5,
        "unsupported_facts": ["on ARB", {"fact": "htn"}, {"claim": 1}], "missing_facts": ["baseline LFT", {"severity": "critical", "fact": "weight"}],
        "clinical_accuracy_issues": [{"issue": "a", "evidence": "b"}, "c"], "contradictions": "no list",
    })
    v = one(spark, pipeline.verification(F.try_parse_json("c")), c=reply)
    assert v["unsupported_facts"] == ["on ARB", "htn", '{"claim":1}'] and v["plain_unsupported"] == ["on ARB", '{"claim":1}']
    assert [tuple(m) for m in v["missing_facts"]] == [(None, "baseline LFT", None), ("critical", "weight", "")]
    assert [tuple(x) for x in v["clinical_accuracy_issues"]] == [("a", "b"), ("c", None)] and v["contradictions"] == []
    kept = one(spark, f.sanitized(pipeline.verification(F.try_parse_json("c")), F.lit("no such word")), c=reply)
    assert kept["unsupported_facts"] == ["on ARB", '{"claim":1}'] and kept["evidence_support_score"] == 0.5  # text is no object, so no leak
    assert [m["severity"] for m in kept["missing_facts"]] == [None, "minor"]
    facts = F.array(F.struct(*(F.lit(x).cast("string").alias(k) for k, x in zip(f.FIELDS, ("", "", "complication: conversion", "", "", "")))))
    found = one(spark, f.guarded(pipeline.blank("D", 0.9, 0.96, ""), facts, F.lit("Operative Report"), F.lit("Complication: No")))
    assert [tuple(x) for x in found["clinical_accuracy_issues"]] == [(f.TAXONOMY, "Complication: No")]


def test_uncertain_items_go_through_the_loop_into_the_report(spark):
    class Doubtful:
        def __init__(self, config):
            pass

        def chat(self, system, user):
            if "FACTS AS JSON" in system:
                doubt = {"first": ["dose?", {"b": 1}], "second": "side?"}
                source = user.partition("SOURCE:\n")[2]
                said = next((x for k, x in doubt.items() if k in source), [])
                return json.dumps({"facts": [{"fact": "x"}], "uncertain_or_conflicting": said} if "third" not in source else {"all_facts": [{"fact": "lost"}]})
            ok = "dose?" not in user  # the verifier sees the list
            return json.dumps({"verdict": "PASS", "coverage_score": 0.9, "evidence_support_score": 0.96 if ok else 0.1, "missing_facts": [] if ok else [{"severity": "critical", "fact": "m", "evidence": "e"}]})

    text = "[1] Note: {{ first }}\n[2] Note: {{ second }}\n[3] Visit: {{ third }}"
    records = spark.createDataFrame([(1, text)], "row_index int, input string")
    real = pipeline.ask
    pipeline.ask = lambda calls, config: real(calls, config, Doubtful)
    try:
        got = pipeline.extract_and_verify(records, "row_index", backends.Config(pause=0)).first()
    finally:
        pipeline.ask = real
    report, whole = json.loads(got.Verification_Report), json.loads(got.Extracted_Facts)
    assert report["uncertain_or_conflicting"] == [{"document_type": "Note", "items": ["dose?", '{"b":1}']}, {"document_type": "Note", "items": ["side?"]}]
    assert report["unresolved_issues"] == [{"document_type": "Note", "issue_type": "missing_facts", "issues": [{"fact": "m", "severity": "critical", "evidence": "e"}]}]
    assert [c["final_facts"]["uncertain_or_conflicting"] for c in whole["chunks"]] == [["dose?", '{"b":1}'], ["side?"], []]
    assert len(whole["all_facts"]) == 2 and [c["iterations_used"] for c in whole["chunks"]] == [2, 1, 1]


def test_a_facts_words_are_lowered_once(spark):
    df = spark.createDataFrame([("Other", "Seen in the CLINIC, follow-up")], "c string, t string")
    out = df.select(rules.fact_category(F.col("c"), F.col("t"), F.lit("Note")).alias("x"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and "exists(" not in plan and out.first().x == "Discharge Plan"


def test_typed_facts_keep_what_is_no_text(spark):
    facts = '{"facts":[{"fact":7,"evidence":[1,"a"],"date":null,"category":true,"other":{"x":1}},"text",{"Fact":"b","confidence":{"y":2}},{}]}'
    df = spark.createDataFrame([(facts,)], "c string")
    one = lambda x: F.struct(*(F.try_variant_get(x, f"$.{k}", "string").alias(k) for k in f.FIELDS))
    items = f.parse_facts("c")["items"]
    got = df.select(f.typed_facts(items).alias("got"), F.transform(F.filter(items, f.is_fact), one).alias("want")).first()
    assert got.got == got.want and len(got.got) == 3
