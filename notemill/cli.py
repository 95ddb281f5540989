"""Command line: ``python -m notemill.cli COMMAND ...``; each command is a job over tables or folders.

merge, sort, extract, generate, evaluate work on Parquet tables or, for merge, a folder of workbooks; run does uploads to notes in one
workspace; experiments generates several configurations, tables aggregates verdicts, all-tables judges and aggregates all three tables over one cache.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from . import runs
from .operators import bundles, documents, judge, judging, pipeline, references, uploads
from .operators.backends import Config, available
from .operators.records import pending, row_range, seeded_sample
from .runtime import reach
from .sources import readers, sinks

#: Columns of records.
PROFESSOR, RECORD, INPUT, OUTPUT = uploads.PROFESSOR, uploads.RECORD, uploads.INPUT, uploads.OUTPUT


def numbered(df: DataFrame) -> DataFrame:
    """df with row_index from 0 in the order of professor and id: places within sorted partitions, and one row a partition for
    what lies before it."""
    if "row_index" in df.columns:
        return df
    by = [c for c in (PROFESSOR, RECORD) if c in df.columns]
    ordered = sinks.stored((df.orderBy(*by) if by else df).withColumn("row_index", F.monotonically_increasing_id()), "numbered")
    part, inner = F.shiftright("row_index", 33), F.col("row_index").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("_part")).agg((F.max(inner) + 1).alias("n"))
    before = sizes.select("_part", (F.sum("n").over(W.orderBy("_part")) - F.col("n")).alias("_before"))
    return ordered.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("row_index", inner + F.col("_before")).drop("_part", "_before")


def config_of(a: argparse.Namespace) -> Config:
    kind = "placeholder" if getattr(a, "dry_run", False) else a.backend
    return Config(kind, a.url, a.model, seed=a.seed, retries=a.retries, key=a.key, workers=a.workers, at_once=a.at_once)


def merge(spark: SparkSession, a: argparse.Namespace) -> dict:
    records, summary, warnings = uploads.merged_workbooks(spark, a.input, a.keep_empty_output, a.sort)
    records.write.mode("overwrite").parquet(a.output)
    return {"files": [r.asDict() for r in summary.orderBy("source_file").collect()], "warnings": [r["warning"] for r in warnings.collect()]}


def sort(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = row_range(numbered(spark.read.parquet(a.input)), a.start_index, a.max_patients)
    found = documents.record_timelines(rows, "row_index", INPUT)
    out = rows.join(found, "row_index").withColumnRenamed("timeline", "Sorted_Timeline")
    out.write.mode("overwrite").parquet(a.output)
    if a.json:
        sinks.write_json_documents(found, a.json, "overwrite")
    return {"records": spark.read.parquet(a.output).count()}


def extract(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = row_range(numbered(spark.read.parquet(a.input)), a.start_index, a.max_patients)
    text = INPUT if a.raw_input_whole else "Sorted_Timeline"
    found = pipeline.extract_and_verify(rows, "row_index", config_of(a), text, a.raw_input_whole, a.extract_only, iterations=a.max_iterations, coverage=a.coverage, evidence=a.evidence)
    rows.join(found, "row_index").write.mode("overwrite").parquet(a.output)
    done = spark.read.parquet(a.output)
    if a.report:
        head = {"Professor_ID": PROFESSOR, "Patient_ID": RECORD, "Status": "Stage2_Status", "Approved": "Stage2_Approved", "Coverage score": "Stage2_Coverage_Score"}
        sections = {"Final Summary": "Stage2_Final_Summary", "Verification": "Verification_Summary", "Extracted Facts": "Extracted_Facts_Readable"}
        sinks.markdown(done, "Fact extraction", head, sections, "row_index").write.mode("overwrite").text(a.report)
    return {"records": done.count(), "approved": done.where("Stage2_Approved").count()}


def generate(spark: SparkSession, a: argparse.Namespace) -> dict:
    runs.check_paths({"facts": a.input, "reference": a.reference}, {"output": a.output, "audit": a.audit})
    config = config_of(a)
    rows = bundles.selected(numbered(spark.read.parquet(a.input)), a.professor, a.max_rows)
    made = bundles.raw_bundles(rows, "raw_to_note", most_chars=a.max_input_chars) if a.raw else bundles.fact_bundles(rows, most_facts=a.max_fact_items)
    made = sinks.stored(made, "bundles")  # read several times
    pool = numbered(spark.read.parquet(a.reference)).select("row_index", F.col(PROFESSOR).alias("professor"), F.col(RECORD).alias("record_id"), F.col(OUTPUT).alias("output"))
    pool = references.usable(pool, made)
    common, fallback = None, None
    if a.prompts:
        found = readers.prompts(readers.workbooks(readers.files(spark, a.prompts, "*.xlsx"), first_sheet=False))
        common, fallback = pipeline.common_prompts(found), found.where("kind = 'style'")
    profiles = sinks.stored(pipeline.style_profiles(pool, config, a.sample_count, fallback=fallback, mode=a.selection, seed=a.seed), "profiles")
    shown = sinks.stored(pipeline.style_excerpts(pool, a.sample_count, mode=a.selection, seed=a.seed), "excerpts")
    tag = {"reference_k": a.sample_count, "reference_selection": a.selection, "reference_seed": a.seed}
    columns = ["record_id", "professor", "generated_note", "validation_status", "validation_warnings", "unsupported_terms_or_claims", "generation_prompt_hash", "style_prompt_hash", "backend", "error", *(["dynamic_style_prompt", "generation_prompt_json"] if a.save_prompts else []), *tag]
    if a.resume and _exists(spark, a.output):
        made = pending(made, runs.done_keys(spark.read.parquet(a.output), columns, tag), "professor", "record_id")
    written = pipeline.write_notes(made, profiles, config, a.skip_unmatched, a.dry_run, pipeline.system_prompt(common), a.save_prompts, shown, a.strict_validation)
    written = sinks.stored(written.withColumns({k: F.lit(str(v)) for k, v in tag.items()}), "written")  # notes and audit are of one pass
    written.write.mode("append" if a.resume else "overwrite").parquet(a.output)
    pipeline.audit_rows(written).write.mode("append" if a.resume else "overwrite").text(a.audit)
    return {r["validation_status"]: r["count"] for r in written.groupBy("validation_status").count().collect()}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def method_notes(spark: SparkSession, folder: str, methods: Sequence[str]) -> DataFrame:
    """The results of methods, a table each in a folder, as notes with their method."""
    frames = [judging.method_frame(numbered(spark.read.parquet(f"{folder}/{m}")), "row_index").withColumn("method", F.lit(m)) for m in methods]
    return reduce(DataFrame.unionByName, frames)


def judged_notes(spark: SparkSession, a: argparse.Namespace, methods: list[str], output: str, ask_of_empty: bool = True) -> int:
    """Verdicts on the notes of methods, written to output; how many calls were made that the cache (a table of rows appended by
    every evaluation, of equal keys the first response counts) did not know."""
    notes = sinks.stored(method_notes(spark, a.input, judging.methods_of(methods, a.opponent)), "method-notes")
    anchor = notes.where(F.col("method") == methods[0])
    sample = seeded_sample(anchor, "professor", "record_id", a.sample_per_professor, a.seed)
    cache = spark.read.parquet(a.cache) if _exists(spark, a.cache) else spark.createDataFrame([], "key string, response string, model string")
    verdicts, _, fresh = judging.evaluate(notes, sample, methods, a.opponent, replace(config_of(a), json=True), cache.select("key", "response"), ask_of_empty=ask_of_empty)
    verdicts.write.mode("overwrite").parquet(output)
    fresh = sinks.stored(fresh, "answers")
    fresh.write.mode("append").parquet(a.cache)
    return fresh.count()


def evaluate(spark: SparkSession, a: argparse.Namespace) -> dict:
    judged_notes(spark, a, a.methods.split(","), a.output)
    found = spark.read.parquet(a.output)
    return {"notes": found.count(), "errors": found.where("error is not null").count()}


def tables(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Quality, ablation (the same over other methods) and error tables of verdicts."""
    good = spark.read.parquet(a.input).where("error is null")
    methods = a.methods.split(",")
    quality = judge.in_order(judge.quality_table(good), methods)
    errors = judge.in_order(judge.error_table(good), methods)
    for name, table in (("quality", quality), ("errors", errors), ("worst", judge.worst_examples(good))):
        table.write.mode("overwrite").parquet(f"{a.output}/{name}")
    return {"methods": [r["method"] for r in quality.collect()]}


def all_tables(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The three tables in turn over one cache: the comparison of methods, the ablation over --ablation (of an empty note nothing is
    asked there, so it has no critical facts), and the errors, from the comparison's verdicts without further calls."""
    first, second = a.methods.split(","), a.ablation.split(",")
    calls = {"comparison": judged_notes(spark, a, first, f"{a.output}/comparison_verdicts")}
    calls["ablation"] = judged_notes(spark, a, second, f"{a.output}/ablation_verdicts", ask_of_empty=False)
    good = lambda name: spark.read.parquet(f"{a.output}/{name}_verdicts").where("error is null")
    compared, ablated = good("comparison"), good("ablation")
    out = {"comparison": judge.in_order(judge.quality_table(compared), first), "ablation": judge.in_order(judge.quality_table(ablated), second), "errors": judge.in_order(judge.error_table(compared), first), "worst": judge.worst_examples(compared)}
    for name, table in out.items():
        table.write.mode("overwrite").parquet(f"{a.output}/{name}")
    return {"calls": calls | {"errors": 0}, "notes": {name: spark.read.parquet(f"{a.output}/{name}_verdicts").count() for name in ("comparison", "ablation")}}


def experiments(spark: SparkSession, a: argparse.Namespace) -> dict:
    """generate for each k and mode of selection, --jobs configurations at a time; one that fails doesn't stop the rest. Each has
    --workers times --at-once calls in flight at most."""
    stages, run = [], runs.create_run(a.output, "experiments")
    for k in map(int, a.ks.split(",")):
        for mode in a.modes.split(","):
            name = f"k{k}_{mode}" + (f"_seed{a.seed}" if mode == "random" else "")
            own = argparse.Namespace(**{**vars(a), "sample_count": k, "selection": mode, "output": f"{run.root}/{name}", "audit": f"{run.root}/{name}_audit"})
            stages.append((name, lambda own=own: generate(spark, own)))
    return {r.stage: "ok" if r.ok else "failed" for r in runs.side_by_side(spark, run, stages, a.jobs)}


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Uploads to notes in a new workspace: rows, timelines, facts, notes; stops at the first stage that fails."""
    work = runs.create_run(a.output, a.label)
    found = readers.files(spark, a.input)
    rows, warnings = uploads.input_rows(found, a.professor or "default", "note")
    rows.write.parquet(str(work.path("input")))
    samples, more = uploads.style_samples(readers.files(spark, a.style))
    samples.select(F.lit(a.professor or "default").alias(PROFESSOR), F.col("reference_id").alias(RECORD), INPUT, OUTPUT).write.parquet(str(work.path("reference")))
    said = [r["warning"] for r in warnings.unionByName(more).collect()]
    n = spark.read.parquet(str(work.path("input"))).count()
    runs.write_manifest(work, n, spark.read.parquet(str(work.path("reference"))).count(), said, [r.asDict() for r in readers.manifest(found).collect()])
    at = lambda **x: argparse.Namespace(**{**vars(a), **{k: str(work.path(v)) for k, v in x.items()}})
    stages = [("sort", lambda: sort(spark, at(input="input", output="stage1"))), ("extract", lambda: extract(spark, at(input="stage1", output="stage2"))), ("generate", lambda: generate(spark, at(input="stage2", reference="reference", output="notes", audit="audit")))]
    done = runs.chain(work, stages)
    return {"run_id": work.run_id, "ok": all(r.ok for r in done), "stages": [r.stage for r in done], "state": work.state()}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="notemill", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    switch = argparse.BooleanOptionalAction

    def command(name: str, work, *groups, **paths) -> None:
        sub = commands.add_parser(name, help=work.__doc__)
        for path, needed in paths.items():
            sub.add_argument(f"--{path}", required=needed, default=None if needed else "")
        for group in groups:
            for option, keywords in group.items():
                sub.add_argument(f"--{option.replace('_', '-')}", **keywords)
        sub.set_defaults(work=work)

    #: The surveyed defaults of options.
    model = {"backend": {"default": "http", "choices": ("placeholder", "http", "completions")}, "url": {"default": Config.url}, "model": {"default": "none"}, "key": {"default": ""}, "seed": {"type": int, "default": 1225}, "retries": {"type": int, "default": 2}, "workers": {"type": int, "default": 0}, "at_once": {"type": int, "default": 1}, "dry_run": {"action": "store_true"}, "check_model": {"action": "store_true"}}
    part = {"start_index": {"type": int, "default": 0}, "max_patients": {"type": int, "default": 1}}
    loop = {"max_iterations": {"type": int, "default": 2}, "coverage": {"type": float, "default": 0.85}, "evidence": {"type": float, "default": 0.95}, "extract_only": {"action": "store_true"}, "raw_input_whole": {"action": "store_true"}}
    write = {"sample_count": {"type": int, "default": 5}, "selection": {"default": "deterministic"}, "max_rows": {"type": int}, "professor": {}, "max_fact_items": {"type": int, "default": 0}, "max_input_chars": {"type": int, "default": 0}, "raw": {"action": "store_true"}, "skip_unmatched": {"action": "store_true"}, "save_prompts": {"action": "store_true"}, "strict_validation": {"action": "store_true"}, "resume": {"action": "store_true"}}
    each = {"methods": {"default": ",".join(k for k, _ in judge.METHODS)}}
    command("merge", merge, {"keep_empty_output": {"action": switch, "default": True}, "sort": {"action": switch, "default": True}}, input=True, output=True)
    command("sort", sort, part, input=True, output=True, json=False)
    command("extract", extract, model, part, loop, input=True, output=True, report=False)
    command("generate", generate, model, write, input=True, reference=True, output=True, audit=True, prompts=False)
    command("evaluate", evaluate, model, each, {"opponent": {"default": "iterative_fact_to_note"}, "sample_per_professor": {"type": int, "default": 10}}, input=True, output=True, cache=True)
    command("all-tables", all_tables, model, each, {"ablation": {"default": "iterative_fact_to_note,ours"}, "opponent": {"default": "iterative_fact_to_note"}, "sample_per_professor": {"type": int, "default": 10}}, input=True, output=True, cache=True)
    command("tables", tables, each, input=True, output=True)
    command("experiments", experiments, model, write, {"jobs": {"type": int, "default": 3}, "ks": {"default": "3,5"}, "modes": {"default": "deterministic,random"}}, input=True, reference=True, output=True, prompts=False)
    command("run", run, model, part, loop, write, {"label": {"default": "run"}}, input=True, style=True, output=True, prompts=False, json=False, report=False)
    return out


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(arguments)
    if getattr(a, "check_model", False) and not available(config_of(a)):
        raise SystemExit(f"no model answers at {a.url}")
    session = reach(spark or SparkSession.builder.appName("notemill").getOrCreate())
    result = a.work(session, a)
    print(json.dumps(result, ensure_ascii=False, default=str))
    return result


if __name__ == "__main__":
    main()
