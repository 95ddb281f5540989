"""A judging run: prompts, the list of jobs, cached calls to a judge, one row of verdicts for each job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_scalar, truncate_middle
from ..sources.sinks import stored
from . import facts, judge, references
from .backends import Config, ask_cached
from .records import keep_first, require

#: Our own wording. The first words name the task, by which the offline judge answers.
SYSTEM = {
    "faithfulness": "JUDGE faithfulness AS JSON. Split the note into claims and say for each whether the source supports it: claims (claim, verdict supported or unsupported, error_type fabricated, contradicted, wrong_date or patient_mixing, evidence) and faithfulness_likert from 1 to 5.",
    "completeness": "JUDGE completeness AS JSON. List the critical facts of the reference note and say for each whether the note has it: critical_facts (fact, category, status present, partial or absent).",
    "style": "JUDGE style AS JSON. Say which of two notes is written more like the references, in form and not in content: winner A, B or tie.",
    "error_analysis": "JUDGE error_analysis AS JSON. Compare the note with source and reference: unsupported_claims (claim, error_type), missing_critical_facts (fact, category), patient_mixing_suspected.",
    "gt_facts": "JUDGE gt_facts AS JSON. List the critical facts of the reference note: critical_facts (fact, category).",
}
#: Characters of a source and of a note that a judge sees.
SOURCE_CHARS, NOTE_CHARS = 30_000, 8_000
JOB = ("method", "record_id")


def part(name: str, c: Column | str, limit: int = NOTE_CHARS) -> Column:
    return F.concat(F.lit(f"<{name}>\n"), truncate_middle(c, limit), F.lit(f"\n</{name}>\n"))


def methods_of(methods: list[str], opponent: str) -> list[str]:
    """Methods whose notes are read: those judged and the style opponent, each once, in order."""
    return list(dict.fromkeys([*methods, opponent]))


def method_frame(df: DataFrame, order: str) -> DataFrame:
    """record_id, professor, note, source, gt of one method's results, cleaned; the first row of a record counts."""
    require(df, "record_id", "professor", "generated_note", "Input", "Output")
    first = keep_first(df, "record_id", order)
    names = {"professor": "professor", "generated_note": "note", "Input": "source", "Output": "gt"}
    return first.select(clean_scalar("record_id").alias("record_id"), *(clean_scalar(F.col(c)).alias(n) for c, n in names.items()))


def jobs_of(notes: DataFrame, sample: DataFrame, methods: list[str]) -> DataFrame:
    """Rows of notes (method, record_id, ...) of the methods whose record is in the sample: each method with each sampled record
    that it has."""
    return notes.where(F.col("method").isin(methods)).join(sample.select("record_id").distinct(), "record_id", "left_semi")


def style_blocks(pool: DataFrame, jobs: DataFrame, count: int = 3, chars: int = NOTE_CHARS) -> DataFrame:
    """professor, record_id, block: the first ``count`` references of the job's professor but the record itself, numbered."""
    chosen = references.style_references(pool, max(count * 4, 12))
    wanted = jobs.select("professor", "record_id").distinct()
    rows = wanted.join(chosen.select("professor", F.col("record_id").alias("ref_id"), "pick", "output"), "professor").where("ref_id <> record_id")
    first = F.slice(F.array_sort(F.collect_list(F.struct("pick", truncate_middle("output", chars).alias("text")))), 1, count)
    block = F.array_join(F.transform("refs", lambda x, i: F.concat(F.lit("[Reference "), (i + 1).cast("string"), F.lit("]\n"), x["text"])), "\n\n")
    return rows.groupBy("professor", "record_id").agg(first.alias("refs")).select("professor", "record_id", block.alias("block"))


def calls_of(jobs: DataFrame, opponents: DataFrame, blocks: DataFrame, opponent: str, tasks: tuple[str, ...] = ("faithfulness", "completeness", "style"), ask_of_empty: bool = True) -> DataFrame:
    """method, record_id, task, system, user: what a judge is asked on each job.

    An empty note is only asked for completeness, of which it has nothing, and without ask_of_empty for nothing at all; style is asked twice, with places swapped, for
    methods other than the opponent where both notes have words. tasks may be error_analysis and gt_facts instead.
    """
    rows = jobs.join(opponents.select("record_id", F.col("note").alias("other")), "record_id", "left").join(blocks, ["professor", "record_id"], "left")
    rows = rows.withColumn("block", F.coalesce("block", F.lit("(no reference available)")))
    full, both = F.col("note") != "", (F.col("note") != "") & (F.coalesce("other", F.lit("")) != "") & (F.col("method") != opponent)
    texts = {
        "faithfulness": [("faithfulness", full, F.concat(part("source", "source", SOURCE_CHARS), part("note", "note")))],
        "completeness": [("completeness", F.lit(True) if ask_of_empty else full, F.concat(part("reference", "gt"), part("note", "note")))],
        "style": [("style_first", both, F.concat(F.col("block"), F.lit("\n"), part("note_a", "note"), part("note_b", "other"))), ("style_second", both, F.concat(F.col("block"), F.lit("\n"), part("note_a", "other"), part("note_b", "note")))],
        "error_analysis": [("error_analysis", full, F.concat(part("source", "source", SOURCE_CHARS), part("reference", "gt"), part("note", "note")))],
        "gt_facts": [("gt_facts", ~full, part("reference", "gt"))],
    }
    each = [F.when(due, F.struct(F.lit(name).alias("task"), F.lit(SYSTEM[task]).alias("system"), user.alias("user"))) for task in tasks for name, due, user in texts[task]]
    return rows.select(*JOB, F.inline(F.array_compact(F.array(*each))))


def answers_of(calls: DataFrame, cache: DataFrame, config: Config, **how) -> tuple[DataFrame, DataFrame]:
    """(answers, cache rows): one row a job with a map of task to reply and the first error, if any call failed."""
    task = F.regexp_replace("task", "_(first|second)$", "")
    keyed = stored(calls.withColumn("key", judge.cache_key(F.lit(config.model), task, F.col("system"), F.col("user"))), "calls")
    answered, fresh = ask_cached(keyed, cache, config, **how)
    pairs = F.map_from_entries(F.collect_list(F.struct("task", F.coalesce("response", F.lit("")))))
    return answered.groupBy(*JOB).agg(pairs.alias("replies"), F.min("error").alias("error")), fresh.withColumn("model", F.lit(config.model))


def reply(task: str) -> Column:
    return facts.json_object(F.try_element_at("replies", F.lit(task)))


def judged(jobs: DataFrame, answers: DataFrame, opponent: str) -> DataFrame:
    """One row a job with counts, flags and style_score (null for the opponent); a job with a failed call has its error and no
    verdicts. An empty note is unfaithful and incomplete, and loses the style comparison with any note of the opponent; if nothing
    was asked of it, it has no critical facts. Other jobs of which nothing was asked are left out."""
    others = jobs.where(F.col("method") == opponent).select("record_id", F.col("note").alias("other"))
    rows = jobs.select(*JOB, "professor", "note").join(answers, list(JOB), "left").where(F.col("replies").isNotNull() | (F.col("note") == ""))
    rows = rows.join(others, "record_id", "left")
    rows = rows.withColumns({"f": judge.faithfulness(reply("faithfulness")), "c": judge.completeness(reply("completeness")), "empty_note": F.col("note") == ""})
    winner = lambda k: F.coalesce(F.trim(F.try_variant_get(reply(k), "$.winner", "string")), F.lit(""))
    other = F.coalesce("other", F.lit(""))
    style = F.when(F.col("method") == opponent, F.lit(None).cast("double")).when(F.col("empty_note") & (other == ""), F.lit(None).cast("double")).otherwise(judge.style_score(F.col("note"), other, winner("style_first"), winner("style_second")))
    empty = F.col("empty_note")
    rows = rows.select(*JOB, "professor", "error", "empty_note", F.when(empty, 1).otherwise(F.col("f.likert")).alias("likert"), F.when(empty, 0).otherwise(F.col("f.n_claims")).alias("n_claims"), F.when(empty, 0).otherwise(F.col("f.n_unsupported")).alias("n_unsupported"), F.when(empty, 0).otherwise(F.col("f.n_mixing")).alias("n_mixing"), "c.n_critical", "c.n_absent", "c.n_partial", style.alias("style_score"))
    out = judge.with_verdicts(rows)
    some = F.col("n_critical") > 0  # without critical facts nothing is complete
    out = out.withColumns({k: F.col(k) & some for k in ("complete_strict", "complete_lenient")})
    keep = (*JOB, "professor", "error", "empty_note")
    return out.select(*keep, *(F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in out.columns if c not in keep))


def claims(answers: DataFrame) -> DataFrame:
    """method, record_id, claim, verdict, error_type: one row for each claim of a faithfulness reply that is an object."""
    items = F.coalesce(F.try_variant_get(reply("faithfulness"), "$.claims", "array<variant>"), F.array().cast("array<variant>"))
    rows = answers.select(*JOB, F.explode(F.filter(items, facts.is_fact)).alias("x"))
    return rows.select(*JOB, *(clean_scalar(F.try_variant_get("x", f"$.{k}", "string")).alias(k) for k in ("claim", "verdict", "error_type")))


def critical_facts(answers: DataFrame, task: str = "completeness") -> DataFrame:
    """method, record_id, fact, category, status: one row for each critical fact of a completeness (or gt_facts) reply."""
    items = F.coalesce(F.try_variant_get(reply(task), "$.critical_facts", "array<variant>"), F.array().cast("array<variant>"))
    rows = answers.select(*JOB, F.explode(F.filter(items, facts.is_fact)).alias("x"))
    return rows.select(*JOB, *(clean_scalar(F.try_variant_get("x", f"$.{k}", "string")).alias(k) for k in ("fact", "category", "status")))


def errors_judged(jobs: DataFrame, answers: DataFrame) -> DataFrame:
    """n_unsupported, n_missing, n_mixing, mixing_suspected of a combined error reply; an empty note misses every critical fact
    of its reference (gt_facts)."""
    listed = lambda task, k: F.filter(F.coalesce(F.try_variant_get(reply(task), f"$.{k}", "array<variant>"), F.array().cast("array<variant>")), facts.is_fact)
    bad = listed("error_analysis", "unsupported_claims")
    mixed = F.size(F.filter(bad, lambda x: clean_scalar(F.try_variant_get(x, "$.error_type", "string")) == "patient_mixing"))
    said = F.coalesce(F.try_variant_get(reply("error_analysis"), "$.patient_mixing_suspected", "boolean"), F.lit(False))
    missing = F.when(F.col("note") == "", F.size(F.coalesce(F.try_variant_get(reply("gt_facts"), "$.critical_facts", "array<variant>"), F.array().cast("array<variant>")))).otherwise(F.size(listed("error_analysis", "missing_critical_facts")))
    rows = jobs.select(*JOB, "professor", "note").join(answers, list(JOB))
    return rows.select(*JOB, "professor", "error", F.size(bad).alias("n_unsupported"), missing.alias("n_missing"), mixed.alias("n_mixing"), (said | (mixed > 0)).alias("mixing_suspected"))


def evaluate(notes: DataFrame, sample: DataFrame, methods: list[str], opponent: str, config: Config, cache: DataFrame, count: int = 3, ask_of_empty: bool = True, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdicts, answers, new cache rows) of a run over notes (method, record_id, professor, note, source, gt).

    Style references come from the first method's reference notes. Calls are made once for equal prompts, in this run and,
    by the cache, in earlier ones; a call that fails leaves its job a row with the error.
    """
    jobs = stored(jobs_of(notes, sample, methods_of(methods, opponent)), "jobs")
    pool = notes.where(F.col("method") == methods[0]).select("professor", "record_id", F.col("gt").alias("output")).where(F.col("output") != "")
    calls = calls_of(jobs.where(F.col("method").isin(methods)), jobs.where(F.col("method") == opponent), style_blocks(pool, jobs, count), opponent, ask_of_empty=ask_of_empty)
    answers, fresh = answers_of(calls, cache, config, **how)
    answers = stored(answers, "answers")
    return judged(jobs, answers, opponent).where(F.col("method").isin(methods)), answers, fresh
