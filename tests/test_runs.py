import json

import pytest
from pyspark.sql import functions as F

from notemill import cli, runs
from notemill.operators import pipeline
from tests.test_uploads import put, xlsx


def test_workspaces(tmp_path, monkeypatch):
    run = runs.create_run(tmp_path / "runs", "한글 label!")
    assert "_한글_label_" in run.run_id and (run.root / "logs").is_dir() and run.artifacts() == []
    manifest = runs.write_manifest(run, 3, 1, ["w"], [{"original_name": "a", "bytes": 1}])
    assert json.loads(run.path("manifest").read_text()) == manifest and [p.name for p in run.artifacts()] == ["manifest.json"]
    assert runs.latest_facts(tmp_path / "runs") is None
    run.path("stage2").mkdir()
    assert runs.latest_facts(tmp_path / "runs") is None  # not complete
    (run.path("stage2") / "_SUCCESS").write_text("")
    assert runs.latest_facts(tmp_path / "runs") == run.path("stage2") and run.state() == {"input": False, "stage1": False, "stage2": True, "notes": False}
    monkeypatch.setattr(runs.uuid, "uuid4", lambda: type("U", (), {"hex": "0" * 32})())
    monkeypatch.setattr(runs, "datetime", type("D", (), {"now": staticmethod(lambda tz: type("T", (), {"__format__": lambda self, f: "t"})())}))
    runs.create_run(tmp_path / "same", "x")
    with pytest.raises(RuntimeError, match="unique"):
        runs.create_run(tmp_path / "same", "x")


def test_a_workspace_named_by_a_uri(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    base = f"file:{tmp_path}/work"
    run = runs.create_run(base, "x")
    runs.write_manifest(run, 1, 0, [], [])
    spark.range(3).write.parquet(str(run.path("stage2")))
    assert run.state()["stage2"] and runs.latest_facts(base) == run.path("stage2") and [p.name for p in run.artifacts()] == ["stage2_verified_facts", "manifest.json"]
    assert runs.run_stage(run, "s", lambda: 1 / 0).ok is False and "ZeroDivisionError" in (run.root / "logs" / "s.json").read_text()
    assert [p.name for p in tmp_path.iterdir()] == ["work"]  # no folder "file:" beside it
    assert runs.create_run("relative", "x").path("input").uri.startswith(f"{tmp_path}/relative/")
    with pytest.raises(ValueError, match="overwrite"):
        runs.check_paths({"a": f"file://{tmp_path}/t"}, {"o": f"{tmp_path}/t/"})


def test_chain_stops_at_the_first_failure(tmp_path):
    run, done = runs.create_run(tmp_path, "x"), []
    got = runs.chain(run, [("one", lambda: done.append(1)), ("two", lambda: 1 / 0), ("three", lambda: done.append(3))])
    assert done == [1] and [r.ok for r in got] == [True, False] and "ZeroDivisionError" in got[1].error
    log = json.loads((run.root / "logs/two.json").read_text())
    assert not log["ok"] and "ZeroDivisionError" in log["error"] and log["duration_seconds"] >= 0


def test_guards(spark, tmp_path):
    runs.check_paths({"a": "x"}, {"o": "y", "p": "s3://z"})
    for inputs, outputs in (({"a": "x"}, {"o": "./x"}), ({}, {"o": "x", "p": "x"})):
        with pytest.raises(ValueError):
            runs.check_paths(inputs, outputs)
    df = spark.createDataFrame([(" p ", "1", "3"), ("p", "1", " "), ("q", "2", "3")], "professor string, record_id string, reference_k string")
    assert sorted(map(tuple, runs.done_keys(df, df.columns, {"reference_k": 3}).collect())) == [("p", "1"), ("q", "2")]
    for columns, settings, why in ((["professor", "record_id"], {}, "columns"), (df.columns, {"reference_k": 5}, "reference_k=3")):
        with pytest.raises(ValueError, match=why):
            runs.done_keys(df, columns, settings)
    with pytest.raises(ValueError, match="record_id"):
        runs.done_keys(df.drop("record_id"), df.columns)


def test_system_prompt():
    text = pipeline.system_prompt({"compact_specialty_rule_pack": " rules ", "other": "x"})
    assert "<compact_specialty_rule_pack>\nrules\n</compact_specialty_rule_pack>" in text and "other" not in text
    assert text.endswith("</prompt_injection_guard>") and "global_medical_safety_prompt" not in text


RECORD = "[1] Discharge Summary: {{ 퇴원일 200305 home. }}\n[2] Operative Report: {{ 수술일 2020-01-02 Azygos vein: divided. }}"


def test_commands_from_workbooks_to_tables(spark, tmp_path):
    head = ["수술ID", "Input", "Output"]
    notes = [[str(k), RECORD, f"Postop visit {k}. " * (k + 2)] for k in range(6)]
    folder = put(tmp_path / "in", **{"김_All.xlsx": xlsx(a=[head, *notes]), "이_All.xlsx": xlsx(a=[head, *notes[:4]])})
    others = put(tmp_path / "refs", **{"김_All.xlsx": xlsx(a=[head, *[[f"old{r[0]}", *r[1:]] for r in notes]])})  # targets are no references
    at = lambda x: str(tmp_path / x)
    do = lambda *x: cli.main(list(x), spark)
    do("merge", "--input", others, "--output", at("pool"))
    assert [f["output_rows"] for f in do("merge", "--input", folder, "--output", at("merged"))["files"]] == [6, 4]
    assert do("sort", "--input", at("merged"), "--output", at("sorted"), "--json", at("json")) == {"records": 1}
    assert do("sort", "--input", at("merged"), "--output", at("sorted"), "--max-patients", "0") == {"records": 10}
    first = spark.read.parquet(at("sorted")).orderBy("row_index").first()
    assert first["Sorted_Timeline"].startswith("[2] Operative") and first["row_index"] == 0 and first["Professor_ID"] == "김"
    model = ("--backend", "placeholder")
    assert do("extract", *model, "--input", at("sorted"), "--output", at("facts"), "--max-patients", "0", "--report", at("report"))["records"] == 10
    facts = spark.read.parquet(at("facts")).first()
    assert "## Chunk Verdicts" in facts["Verification_Summary"] and json.loads(facts["Verification_Report"])["mode"] == "iterative_verified" and "Azygos" in facts["Extracted_Facts"]
    assert "### Verification" in "\n".join(r.value for r in spark.read.text(at("report")).collect())
    write = ("generate", *model, "--input", at("facts"), "--reference", at("pool"), "--output", at("notes"), "--audit", at("audit"), "--skip-unmatched", "--save-prompts")
    with pytest.raises(ValueError, match="overwrite"):
        do(*write[:7], "--output", at("facts"), "--audit", at("audit"))
    made = do(*write)
    assert sum(made.values()) == spark.read.parquet(at("notes")).count() == 6  # the other professor has no profile
    audit = [json.loads(r.value) for r in spark.read.text(at("audit")).collect()]
    assert all(x["validation"]["status"] in made and json.loads(x["generation_prompt_json"])[0]["role"] == "system" for x in audit)
    assert do(*write, "--resume") == {}  # all is done
    with pytest.raises(ValueError, match="reference_k"):
        do(*write, "--resume", "--sample-count", "2")
    got = do("experiments", *model, "--input", at("facts"), "--reference", at("pool"), "--output", at("exp"), "--ks", "1,2", "--skip-unmatched")
    assert got == {"k1_deterministic": "ok", "k1_random_seed1225": "ok", "k2_deterministic": "ok", "k2_random_seed1225": "ok"}


def test_commands_of_evaluation(spark, tmp_path):
    for m in ("ours", "raw_to_note"):
        rows = [(k, f"r{k}", f"p{k % 2}", f"{m} {k}" if k else "", "source", f"truth {k}") for k in range(6)]
        spark.createDataFrame(rows, "row_index long, record_id string, professor string, generated_note string, Input string, Output string").write.parquet(str(tmp_path / "m" / m))
    at = lambda x: str(tmp_path / x)
    judge = ("evaluate", "--backend", "placeholder", "--methods", "raw_to_note,ours", "--opponent", "raw_to_note", "--input", at("m"), "--cache", at("cache"), "--sample-per-professor", "2")
    assert cli.main([*judge, "--output", at("v")], spark) == {"notes": 8, "errors": 0}
    n = spark.read.parquet(at("cache")).count()
    assert cli.main([*judge, "--output", at("v")], spark) == {"notes": 8, "errors": 0} and spark.read.parquet(at("cache")).count() == n  # nothing is asked twice
    assert cli.main(["tables", "--methods", "raw_to_note,ours", "--input", at("v"), "--output", at("t")], spark) == {"methods": ["raw_to_note", "ours"]}
    assert spark.read.parquet(at("t/errors")).where(F.col("n") == 4).count() == 2


def test_run_command(spark, tmp_path):
    inputs, style = put(tmp_path / "i", **{"a.csv": "Professor_ID,수술ID,Input,Output\n,7,\"" + RECORD.replace('"', "") + "\",\n", "b.pdf": "x"}), put(tmp_path / "s", **{"s.csv": "note\n" + "\n".join(f"Outpatient note number {k}" for k in range(4))})
    got = cli.main(["run", "--backend", "placeholder", "--input", inputs, "--style", style, "--output", str(tmp_path / "w"), "--skip-unmatched"], spark)
    assert got["ok"] and got["stages"] == ["sort", "extract", "generate"] and all(got["state"].values())
    manifest = json.loads((tmp_path / "w" / got["run_id"] / "manifest.json").read_text(encoding="utf-8"))
    assert manifest["input_rows"] == 1 and manifest["style_sample_rows"] == 4 and "b.pdf" in manifest["warnings"][0]


def test_three_tables_over_one_cache(spark, tmp_path):
    for m in ("ours", "raw_to_note", "chunk"):
        rows = [(k, f"r{k}", f"p{k % 2}", f"{m} {k}" if k or m == "chunk" else "", "source", f"truth {k}") for k in range(6)]
        spark.createDataFrame(rows, "row_index long, record_id string, professor string, generated_note string, Input string, Output string").coalesce(1).write.parquet(str(tmp_path / "m" / m))
    at = lambda x: str(tmp_path / x)
    job = ["all-tables", "--backend", "placeholder", "--methods", "chunk,ours", "--ablation", "ours,chunk", "--opponent", "chunk", "--input", at("m"), "--cache", at("cache"), "--sample-per-professor", "0", "--output", at("t")]
    got = cli.main(job, spark)
    assert got["notes"] == {"comparison": 12, "ablation": 12} and got["calls"]["comparison"] > 0 and got["calls"]["ablation"] == got["calls"]["errors"] == 0
    assert spark.read.parquet(at("cache")).count() == got["calls"]["comparison"]
    for name, facts in (("comparison", 2), ("ablation", 0)):
        assert {r["method"]: (r["n"], r["style_n"]) for r in spark.read.parquet(at(f"t/{name}")).collect()} == {"chunk": (6, 0), "ours": (6, 6)}
        empty = spark.read.parquet(at(f"t/{name}_verdicts")).where("empty_note").collect()
        assert [(r.method, r.record_id, r.n_critical, r.style_score, r.complete_lenient) for r in empty] == [("ours", "r0", facts, 0.0, False)]
    assert spark.read.parquet(at("t/errors")).where("n = 6").count() == 2
